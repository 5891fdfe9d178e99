"""Windows and folds over ordered rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type


def affordable_prefix(rows: DataFrame, group: list[str], order: list[str], cost: str, budget: Column) -> DataFrame:
    """Rows up to the first whose running cost exceeds the budget; a free row behind that one stays out."""
    w = W.partitionBy(*group).orderBy(*order)
    so_far = F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("spent", so_far).where(F.col("spent") <= budget)


def round_robin(rows: DataFrame, group: list[str], family: str, rank: Column, order: list[str]) -> DataFrame:
    """Families dealt in turn: position by (index within the family, rank of the family)."""
    index = F.row_number().over(W.partitionBy(*group, family).orderBy(*order))
    dealt = rows.withColumn("_i", index)
    return dealt.withColumn("position", F.row_number().over(W.partitionBy(*group).orderBy("_i", rank, *order)).cast("bigint")).drop("_i")


def first_kept(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per key the first row's order value and the number of later rows that were dropped."""
    return rows.groupBy(*keys).agg(F.min(order).alias("first_at"), (F.count(F.lit(1)) - 1).alias("dropped"))


def in_order(rows: DataFrame, key: str, order: list[str], columns: list[str], schema: str, fold: Callable[[], Callable]) -> DataFrame:
    """Fold each key's rows in order: fold() gives a function that takes a row's columns and, called without, the result.

    Rows are sorted within partitions by key and order and go past one by one, so a key of any length takes no memory;
    it is one task's work by nature, as each step needs the one before. schema: of the result, behind the key.
    """
    names = [key, *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, step, done = False, None, []
        current = None
        for batch in batches:
            for k, *values in zip(*[batch.column(n).to_pylist() for n in names]):
                if not seen or k != current:
                    if seen:
                        done.append((current, *step()))
                    seen, current, step = True, k, fold()
                step(*values)
            if len(done) >= 10_000:
                yield made(done)
                done = []
        yield made(done + ([(current, *step())] if seen else []))

    out = f"{key} {rows.schema[key].dataType.simpleString()}, {schema}"
    types = [f.dataType for f in rows.sparkSession.createDataFrame([], out).schema]
    arrow = [(n, to_arrow_type(t)) for n, t in zip([c.split(" ")[0] for c in out.split(", ")], types)]

    def made(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, arrow)], names=[n for n, _ in arrow])

    return rows.select(key, *order, *[c for c in columns if c not in order]).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, out)


def hash_chain(rows: DataFrame, key: str, order: list[str], body: Column, genesis: str = "0" * 64) -> DataFrame:
    """Head of each key's hash-linked chain: every link is sha256(previous head, sha256(body)); with the chain's length.

    A null body counts as empty text.
    """

    def fold():
        head, links = genesis, 0

        def step(*digest):
            nonlocal head, links
            if not digest:
                return links, head
            head, links = hashlib.sha256((head + digest[0]).encode()).hexdigest(), links + 1

        return step

    return in_order(rows.withColumn("_d", F.sha2(F.coalesce(body, F.lit("")), 256)), key, order, ["_d"], "links bigint, head string", fold)


def ordered_digest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """SHA-256 of each key's values, sorted and put together, whatever order they come in; and their number."""

    def fold():
        digest, n = hashlib.sha256(), 0

        def step(*values):
            nonlocal n
            if not values:
                return digest.hexdigest(), n
            digest.update((values[0] or "").encode())
            n += 1

        return step

    return in_order(rows, key, [value], [value], "digest string, n bigint", fold)


def verify_chain(rows: DataFrame, key: str, sequence: str, previous: str, current: str, genesis: str = "0" * 64) -> DataFrame:
    """Links whose sequence isn't the row number or whose previous hash isn't the row before's hash."""
    w = W.partitionBy(key).orderBy(sequence)
    before = F.coalesce(F.lag(current).over(w), F.lit(genesis))
    out = rows.select(key, sequence, (F.row_number().over(w) != F.col(sequence)).alias("bad_sequence"), (~before.eqNullSafe(F.col(previous))).alias("bad_link"))
    return out.where("bad_sequence or bad_link")


def reserve(rows: DataFrame, key: str, order: list[str], amounts: list[str], limits: list[int]) -> DataFrame:
    """All-or-nothing reservations in order: a row is accepted if every amount still fits, else nothing is charged.

    Whether a row fits depends on which rows before it did, so each key's rows are folded in order. A row with a null
    amount is rejected.
    """

    def fold():
        used, counts = [0] * len(amounts), [0, 0]

        def step(*row):
            if not row:
                return (*used, *counts)
            fits = all(x is not None and u + x <= m for x, u, m in zip(row, used, limits))
            counts[not fits] += 1
            if fits:
                used[:] = [u + x for u, x in zip(used, row)]

        return step

    whole = rows.withColumns({a: F.col(a).cast("bigint") for a in amounts})
    return in_order(whole, key, order, amounts, ", ".join([f"{a} bigint" for a in amounts] + ["accepted bigint", "rejected bigint"]), fold)
