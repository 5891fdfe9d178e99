"""Containers: capacity, wholeness, fill; bucket bounds against brute force."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm.packing import compared, containers, containers_opened, histogram, items_of, optimal_bounds, pack, pack_shard
from ledgerline.sources.shared import materialize


def test_counted_as_packed():
    """Containers counted on the histogram are those that packing makes, for every lower bound."""
    r = np.random.default_rng(1)
    for _ in range(30):
        lengths = np.sort(r.choice(np.arange(1, 41), 12, replace=False))
        counts = r.integers(1, 30, 12)
        items = np.repeat(lengths, counts)
        got = containers_opened(lengths, counts, 40)
        assert got.tolist() == [pack_shard(items[items >= x], 40).max() + 1 for x in lengths]


def test_bounds_are_optimal():
    r = np.random.default_rng(1)
    for _ in range(10):
        lengths = np.sort(r.choice(np.arange(1, 31), 8, replace=False))
        counts = r.integers(1, 20, 8)
        items = np.repeat(lengths, counts)

        def opened(bounds):
            return sum(pack_shard(items[(items > lo) & (items <= hi)], 30).max() + 1 for lo, hi in zip((0, *bounds), bounds))

        for k in (1, 2, 3, 8, 20):
            got = optimal_bounds(lengths, counts, 30, k)
            assert len(got) == min(k, 8) and got[-1] == lengths[-1]
            assert opened(got) == min(opened((*c, lengths[-1])) for c in combinations(lengths[:-1], min(k, 8) - 1))
    assert optimal_bounds(np.array([], dtype=int), np.array([], dtype=int), 30, 3) == []
    many = np.arange(1, 2001)
    assert len(optimal_bounds(many, np.ones(2000, dtype=int), 2000, 5, grid=20)) == 5


def test_shard_never_overflows():
    r = np.random.default_rng(2)
    lengths = np.minimum(r.geometric(0.01, 3000), 500) - 1
    number = pack_shard(lengths, 500)
    sums = np.bincount(number, lengths)
    assert sums.max() <= 500 and len(sums) <= np.ceil(lengths.sum() / 500) + 1


def test_bounds_decide_the_containers(spark):
    """Other bounds, other containers; none holds items of two buckets."""
    items = materialize(spark.range(400).selectExpr("id as doc_id", "0 as piece", "cast(1 + id * 37 % 90 as int) as n_tokens"))
    sizes, made = histogram(items), []
    for bounds in ([100], [30, 100], [50, 100], [10, 20, 40, 100]):
        rows = pack(items, bounds, sizes, 100, shard=150).collect()
        assert len(rows) == 400
        held = {}
        for x in rows:
            held.setdefault(x.container_id, []).append(x)
            assert x.bucket_bound == min(b for b in bounds if b >= x.n_tokens)
        assert all(sum(x.n_tokens for x in h) <= 100 and len({x.bucket_bound for x in h}) == 1 for h in held.values())
        made.append({frozenset(x.doc_id for x in h) for h in held.values()})
    assert all(a != b for a, b in combinations(made, 2))


def test_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = containers(d, 1000).cache()
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in d.select("doc_id").collect()}
    assert out.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).where("n > 1000").count() == 0
    whole = items_of(d, 10**9).collect()
    pieces = {r.doc_id: (r.n, r.m) for r in out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("m")).collect()}
    assert all(pieces[r.doc_id] == (r.n_tokens, max(1, -(-r.n_tokens // 1000))) for r in whole)
    used = out.select("container_id").distinct().count()
    assert used <= sum(r.n_tokens for r in whole) / 1000 * 1.03 + 5
    assert {r.method for r in compared(d, 1000).collect()} == {"optimal", "even", "one_bucket"}


def test_nulls_and_repeats(spark):
    d = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a b c", 2), (3, "a b c", 2), (None, "x", 3), (4, "word " * 3000, 0)], "doc_id bigint, text string, piece int")
    rows = containers(d, 500).collect()
    assert sorted(str(r.doc_id) for r in rows if r.doc_id != 4) == ["1", "2", "3", "3", "None"]
    assert sum(r.doc_id == 4 for r in rows) == -(-sum(r.n_tokens for r in rows if r.doc_id == 4) // 500)
    assert containers(d.limit(0), 500).count() == 0


def test_one_hot_id(spark):
    """Rows of one id are spread like others: no shard takes them all."""
    items = materialize(spark.range(3000).selectExpr("if(id % 3 = 0, id, 7) as doc_id", "0 as piece", "5 as n_tokens"))
    out = pack(items, [5], histogram(items), 100, shard=500)
    assert max(r["count"] for r in out.selectExpr("split(container_id, '/')[1] as s").groupBy("s").count().collect()) < 700
