"""Overlapping and gapped time intervals (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerline.functions.ids import norm_id
from ledgerline.sources.shared import materialize

SHARD_US = 1 << 36  #: microseconds of one time shard, about 19 hours
SHARDS = 1 << 18  #: shards of one block, whose bitmap has one bit for each shard that is covered in full
HELD = 500_000  #: runs that a task unites before they go on

BITMAPS = "entity string, level int, shard bigint, bits binary"
_ARROW = pa.schema([("entity", pa.string()), ("level", pa.int32()), ("shard", pa.int64()), ("bits", pa.binary())])


def encode(starts: np.ndarray, ends: np.ndarray) -> bytes:
    """A run-length compressed bitmap: lengths of its clear and set runs in turn, from the shard's first unit."""
    turns = np.empty(2 * len(starts), dtype="<i8")
    turns[::2], turns[1::2] = starts, ends
    return np.diff(turns, prepend=0).tobytes()


def decode(bitmaps: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the bitmap, start, end) of all set runs."""
    sizes = np.array([len(b) // 16 for b in bitmaps], dtype=np.int64)
    lengths = np.frombuffer(b"".join(bitmaps), dtype="<i8")
    turns, of = np.cumsum(lengths), np.repeat(np.arange(len(bitmaps)), sizes)
    first = 2 * (np.cumsum(sizes) - sizes)  # each bitmap counts from 0 again
    base = np.where(first > 0, turns[np.maximum(first - 1, 0)], 0) if len(turns) else first
    return of, turns[::2] - base[of], turns[1::2] - base[of]


def union(group: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set runs of the union of bitmaps by group (ascending numbers from 0); runs that touch become one."""
    if not len(group):
        return group, starts, ends
    order = np.lexsort((starts, group))
    group, starts, ends = group[order], starts[order], ends[order]
    same = np.zeros(len(group), dtype=bool)
    same[1:] = group[1:] == group[:-1]
    # the reach of all runs before, within the group: groups follow each other on one line, each wider than any end
    wide = int(ends.max()) + 1
    step = min(len(group), (1 << 62) // max(wide, 1))
    reach = np.empty_like(ends)
    base = group - group[0]
    if base[-1] < step:
        reach = np.maximum.accumulate(base * wide + ends) - base * wide
    else:  # too many groups for one line of 64 bits
        for at in np.split(np.arange(len(group)), np.flatnonzero(~same)[1:]):
            reach[at] = np.maximum.accumulate(ends[at])
    new = ~same
    new[1:] |= starts[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(group)) - 1
    return group[first], starts[first], reach[last]


def _pieces(starts: np.ndarray, ends: np.ndarray, shard_us: int, shards: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, run, shard, start, end): the bits of each run, by level.

    Level 0 has units of one microsecond in shards of `shard_us`; whole shards are one bit each of level 1, in blocks
    of `shards`; whole blocks are bits of level 2, which has one bitmap. So a run sets bits in a few bitmaps, however
    long it is.
    """
    out, run = [], np.arange(len(starts))
    for level, width in ((0, shard_us), (1, shards)):
        first, last = starts // width, (ends - 1) // width
        one = first == last
        whole = one & (starts == first * width) & (ends == (last + 1) * width)
        inner = one & ~whole
        out.append((level, run[inner], first[inner], starts[inner] - first[inner] * width, ends[inner] - first[inner] * width))
        head, tail = ~one & (starts > first * width), ~one & (ends < (last + 1) * width)
        out.append((level, run[head], first[head], starts[head] - first[head] * width, np.full(head.sum(), width)))
        out.append((level, run[tail], last[tail], np.zeros(tail.sum(), dtype=np.int64), ends[tail] - last[tail] * width))
        starts, ends = np.where(whole | ~one, first + head, 0), np.where(whole | ~one, last + 1 - tail, 0)
        keep = ends > starts
        run, starts, ends = run[keep], starts[keep], ends[keep]
    # the bitmap of level 2 may count from the smallest unit that 64-bit microseconds can have
    low = -(1 << 63) // (shard_us * shards) - 1
    return [*out, (2, run, np.zeros(len(run), dtype=np.int64), starts - low, ends - low)]


def _united(names: list, name: np.ndarray, level: np.ndarray, shard: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
    """(entity, level, shard, starts, ends) of each bitmap that the runs make."""
    order = np.lexsort((shard, level, name))
    name, level, shard, starts, ends = name[order], level[order], shard[order], starts[order], ends[order]
    new = np.ones(len(name), dtype=bool)
    new[1:] = (name[1:] != name[:-1]) | (level[1:] != level[:-1]) | (shard[1:] != shard[:-1])
    first = np.flatnonzero(new)
    group, starts, ends = union(np.cumsum(new) - 1, starts, ends)
    bounds = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
    for k, at in enumerate(first):
        own = slice(bounds[k], bounds[k + 1])
        yield names[name[at]], int(level[at]), int(shard[at]), starts[own], ends[own]


def _batch(bitmaps: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*[(e, lv, s, encode(a, b)) for e, lv, s, a, b in bitmaps])) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def run_bitmaps(runs: DataFrame, shard_us: int = SHARD_US, shards: int = SHARDS, held: int = HELD) -> DataFrame:
    """Compressed run bitmaps of the covered microseconds: entity, level, shard, bits; of one key several, not yet united.

    runs: entity, start_us, end_us (end exclusive). Rows with a null entity or bound, or whose end is not after their
    start, set no bit. Each task unites what it holds before anything is shuffled, `held` runs at a time.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            kept.append(batch)
            n += batch.num_rows
            if n >= held:
                yield _made(kept)
                kept, n = [], 0
        if n:
            yield _made(kept)

    def _made(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(kept)
        entity = whole.column("entity").combine_chunks().dictionary_encode()
        entity = entity.combine_chunks() if isinstance(entity, pa.ChunkedArray) else entity
        number = entity.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pieces = _pieces(whole.column("start_us").to_numpy(), whole.column("end_us").to_numpy(), shard_us, shards)
        joined = [np.concatenate(x) for x in zip(*[(np.full(len(p[1]), p[0]), number[p[1]], *p[2:]) for p in pieces])]
        return _batch(list(_united(entity.dictionary.to_pylist(), joined[1], joined[0], *joined[2:])))

    sound = runs.select(F.col("entity").cast("string").alias("entity"), F.col("start_us").cast("bigint").alias("start_us"), F.col("end_us").cast("bigint").alias("end_us")).where("entity is not null and start_us is not null and end_us > start_us")
    return sound.mapInArrow(build, BITMAPS)


def unite(bitmaps: DataFrame) -> DataFrame:
    """One bitmap per (entity, level, shard): the bitwise or of all that have this key.

    Bitmaps come sorted by key, so a task holds one batch and the runs of the key that goes on in the next one.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple | None = None  # the last bitmap of the batch before may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            names, level, shard = batch.column("entity").to_pylist(), batch.column("level").to_numpy(), batch.column("shard").to_numpy()
            of, starts, ends = decode(batch.column("bits").to_pylist())
            if open_:
                names.append(open_[0])
                level, shard = np.append(level, open_[1]), np.append(shard, open_[2])
                of = np.concatenate([of, np.full(len(open_[3]), len(names) - 1)])
                starts, ends = np.concatenate([starts, open_[3]]), np.concatenate([ends, open_[4]])
            numbers: dict[str, int] = {}
            name = np.array([numbers.setdefault(x, len(numbers)) for x in (names[-1:] + names[:-1] if open_ else names)])
            name = np.append(name[1:], name[0]) if open_ else name
            done = list(_united(list(numbers), name[of], level[of], shard[of], starts, ends))
            last = (names[batch.num_rows - 1], int(level[batch.num_rows - 1]), int(shard[batch.num_rows - 1]))
            open_ = next(x for x in done if x[:3] == last)
            yield _batch([x for x in done if x[:3] != last])
        if open_:
            yield _batch([open_])

    return bitmaps.repartition("entity", "level", "shard").sortWithinPartitions("entity", "level", "shard").mapInArrow(merge, BITMAPS)


def _set_runs(bitmaps: DataFrame, shard_us: int, shards: int) -> DataFrame:
    """entity, level, start_us, end_us of the set runs of united bitmaps."""
    low = -(1 << 63) // (shard_us * shards) - 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                of, starts, ends = decode(batch.column("bits").to_pylist())
                level = batch.column("level").to_numpy()[of]
                unit = np.array([1, shard_us, shard_us * shards])[level]
                base = np.where(level == 2, low, batch.column("shard").to_numpy()[of] * np.array([shard_us, shards, 0])[level])
                yield pa.RecordBatch.from_arrays([batch.column("entity").take(pa.array(of)), pa.array(level.astype(np.int32)), pa.array((base + starts) * unit), pa.array((base + ends) * unit)], names=["entity", "level", "start_us", "end_us"])

    return bitmaps.mapInArrow(read, "entity string, level int, start_us bigint, end_us bigint")


def set_and_clear_runs(bitmaps: DataFrame, shard_us: int = SHARD_US, shards: int = SHARDS) -> DataFrame:
    """The set runs (`period`) and the clear runs between them (`gap`) of each entity: entity, kind, start_us, end_us.

    bitmaps: united. Set runs within what a higher level covers in full are left out; runs that touch at the border of
    a shard become one, as both turns there cancel. What follows a turn is looked for within its shard first; what
    passes from shard to shard is one row per (entity, shard). So an entity that holds most rows is spread over its
    shards.
    """
    runs = materialize(_set_runs(bitmaps, shard_us, shards))
    # an entity has at most as many full stretches as half the shards of its time
    full = runs.where("level > 0").groupBy("entity").agg(F.collect_list(F.struct("level", "start_us", "end_us")).alias("full")).withColumnRenamed("entity", "f_entity")
    clear = runs.join(full, F.col("entity") == F.col("f_entity"), "left").where("full is null or not exists(full, f -> f.level > level and f.start_us <= start_us and start_us < f.end_us)")
    turn = lambda at, kind: F.struct(F.col(at).alias("unit"), F.lit(kind).alias("kind"))
    turns = clear.select("entity", F.explode(F.array(turn("start_us", "period"), turn("end_us", "gap"))).alias("t")).select("entity", F.expr(f"t.unit div {shard_us} - if(t.unit % {shard_us} < 0, 1, 0)").alias("shard"), "t.unit", "t.kind")
    border = turns.where(F.col("unit") % shard_us == 0).groupBy("entity", "shard", "unit").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind")).where("n = 1").select("entity", "shard", "unit", "kind")
    turns = turns.where(F.col("unit") % shard_us != 0).unionByName(border)
    by_shard, in_shard = W.partitionBy("entity").orderBy("shard"), W.partitionBy("entity", "shard").orderBy("unit")
    turns = turns.withColumn("next_unit", F.lead("unit").over(in_shard))
    later = turns.groupBy("entity", "shard").agg(F.min("unit").alias("first_unit"))
    later = later.select("entity", "shard", F.lead("first_unit").over(by_shard).alias("later_unit"))
    out = turns.join(later, ["entity", "shard"]).select("entity", "kind", F.col("unit").alias("start_us"), F.coalesce("next_unit", "later_unit").alias("end_us"))
    return out.where("end_us is not null")


def periods_and_gaps(runs: DataFrame, shard_us: int = SHARD_US, shards: int = SHARDS) -> DataFrame:
    """Continuous periods of each entity and the gaps between them; runs that touch belong together.

    Time is discretised into microseconds; the covered ones are kept as run-length compressed bitmaps per entity and
    time shard, which are united and read off. Ties, repeated and nested runs change nothing; an empty input gives no
    rows; extra columns are ignored.
    """
    return set_and_clear_runs(unite(run_bitmaps(runs, shard_us, shards)), shard_us, shards)


def audit_periods(audit_runs: DataFrame) -> DataFrame:
    runs = audit_runs.select(norm_id("case_id").alias("entity"), F.unix_micros("started_at").alias("start_us"), F.unix_micros(F.coalesce("ended_at", "last_checked_at")).alias("end_us"))
    return periods_and_gaps(runs).withColumnRenamed("entity", "case_id")
