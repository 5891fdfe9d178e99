"""Structured Streaming versions of the ledger operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.functions.ids import norm_id
from ledgerline.operators.changes import change_facts, fold_changes, named_events, settled_events
from ledgerline.sources.shared import delete, materialize


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A file stream of ledger events with the schema of what lies there; path is a folder or a single file."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(where).isFile():
        reader, path = reader.option("pathGlobFilter", where.getName()), where.getParent().toString()
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


FAN = 8  #: deltas of one level that are merged into one of the next


def fold_stream(events: DataFrame, state: str, checkpoint: str, partitions: int = 16) -> None:
    """Settle a stream of events into tables of winners by event_id, until the input ends.

    Each micro-batch writes only its own settled events, as `level=0/upto=<batch>`; of every FAN tables of a level one
    of the next level is made, so a batch costs its own size and, over time, a logarithm of the whole. The merge is a
    minimum, commutative and idempotent: an event_id that is sent again in a later batch counts once, with its lowest
    sequence; a batch that is replayed after a failure writes the same rows; it does not matter whether tables that
    were merged are still there. They are deleted when a later batch begins, as only then the merge is known to last.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        for level, upto in _merged(number):
            delete(spark, f"{state}/level={level}/upto={upto}")
        write = lambda df, level: df.repartition(partitions, "event_id").write.mode("overwrite").parquet(f"{state}/level={level}/upto={number}")
        write(settled_events(batch), 0)
        for level, parts in _due(number):
            write(settled_events(None, spark.read.parquet(*[f"{state}/level={level - 1}/upto={u}" for u in parts])), level)

    events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _due(number: int) -> list[tuple[int, list[int]]]:
    """The merges after a batch: (level, last batches of the tables of the level below that it takes)."""
    out, width = [], FAN
    while (number + 1) % width == 0:
        out.append((len(out) + 1, [number - k * (width // FAN) for k in range(FAN)]))
        width *= FAN
    return out


def _merged(number: int) -> list[tuple[int, int]]:
    """(level, upto) of the tables that the batch before has merged into others."""
    return [(level - 1, u) for level, parts in _due(number - 1) for u in parts] if number else []


def newest_state(spark: SparkSession, state: str) -> DataFrame:
    """The folded facts of all that was settled, for current_fields()."""
    settled = spark.read.option("recursiveFileLookup", "true").parquet(state)
    return materialize(fold_changes(change_facts(named_events(settled_events(None, settled)))))


def unique_events(events: DataFrame, delay: str = "30 days") -> DataFrame:
    """Events of a stream once each; an event that comes later than `delay` after its time may come out again."""
    return events.withWatermark("occurred_at", delay).withColumn("event_id", norm_id("event_id")).dropDuplicatesWithinWatermark(["event_id"])


def hourly_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events per type and hour with late data up to `delay`."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def anchored_allowance(events: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """Rate allowance per key: a window opens at a key's first event and lasts `seconds`; only `limit` events pass.

    The window is anchored at its first use, so it is state, not a tumbling window. events: key, at (timestamp), id,
    in order of `at` within a batch. Yields (key, id, allowed).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, used = state.get if state.exists else (None, 0)
        for frame in frames:
            rows = frame.sort_values(["at", "id"])
            out = []
            for id_, at in zip(rows["id"], rows["at"]):
                now = at.value // 1000
                if opened is None or now - opened >= seconds * 1_000_000:
                    opened, used = now, 0
                out.append((key[0], id_, used < limit))
                used += 1
            yield pd.DataFrame(out, columns=["key", "id", "allowed"])
        state.update((opened, used))

    return events.groupBy("key").applyInPandasWithState(step, "key bigint, id bigint, allowed boolean", "opened bigint, used int", "append", GroupStateTimeout.NoTimeout)
