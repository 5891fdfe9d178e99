"""Filling fixed-capacity containers with items (problem 6)."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.llm.tokens import VOCABULARY, token_count
from ledgerline.sources.shared import materialize

CAPACITY = 4096  #: tokens of one container
BUCKETS = 4  #: length buckets
GRID = 64  #: lengths among which the bounds are chosen, half of them by items, half by tokens
SHARD = 20_000  #: items that one task packs at a time


def containers_opened(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """Containers that a bucket from lengths[i] up to the longest takes, for every i; lengths ascending.

    The token-budget batches of pack_shard() on a histogram: longest items first, each into the fullest container that
    still takes it. As the bucket's items come longest first, one pass gives every lower bound. The work depends on
    the number of lengths, not of items.
    """
    rooms, opened, out = np.zeros(capacity + 1, dtype=np.int64), 0, np.zeros(len(lengths), dtype=np.int64)
    for i in range(len(lengths) - 1, -1, -1):
        size, n = int(lengths[i]), int(counts[i])
        for room in np.flatnonzero(rooms[size:]) + size:
            if not n:
                break
            fit = int(room) // size  # a container that took one is the fullest, so it takes all it can
            whole = min(int(rooms[room]), n // fit)
            rooms[room] -= whole
            rooms[room - fit * size] += whole
            n -= whole * fit
            if n and n < fit and rooms[room]:
                rooms[room] -= 1
                rooms[room - n * size] += 1
                n = 0
        if n:
            fit = capacity // size
            opened += -(-n // fit)
            rooms[capacity - fit * size] += n // fit
            if n % fit:
                rooms[capacity - n % fit * size] += 1
        out[i] = opened
    return out


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, capacity: int, buckets: int = BUCKETS, grid: int = GRID) -> list[int]:
    """Upper bounds of `buckets` length buckets with the least padding, by dynamic programming over the histogram.

    Padding is the room that is left over when each bucket is filled by itself; as the tokens are given, the least
    padding is the least number of containers. lengths: ascending, 1 to capacity; counts: items of each. Bounds are
    chosen among `grid` lengths that cut the items or the tokens evenly; with no more lengths than that, among all. Where
    there are fewer lengths than buckets, each has its own.
    """
    if not len(lengths):
        return []
    ends = np.arange(len(lengths))
    if len(lengths) > grid:
        even = np.arange(1, grid // 2 + 1) / (grid // 2)
        cuts = [np.searchsorted(sums, sums[-1] * even) for sums in (np.cumsum(counts.astype(float)), np.cumsum(counts * lengths.astype(float)))]
        ends = np.unique(np.minimum(np.append(np.concatenate(cuts), len(lengths) - 1), len(lengths) - 1))
    ends = ends + 1  # one past each bound
    starts = np.append(0, ends[:-1])
    cost = [containers_opened(lengths[:e], counts[:e], capacity)[starts[: j + 1]] for j, e in enumerate(ends)]
    best, choices = np.array([float(c[0]) for c in cost]), []
    for k in range(1, min(buckets, len(ends))):
        total, choice = np.full(len(ends), np.inf), np.zeros(len(ends), dtype=int)
        for j in range(k, len(ends)):  # the last bucket begins behind the bound i
            tried = best[k - 1 : j] + cost[j][k : j + 1]
            choice[j] = int(np.argmin(tried)) + k - 1
            total[j] = tried[choice[j] - k + 1]
        best = total
        choices.append(choice)
    bounds, j = [], len(ends) - 1
    for choice in reversed(choices):
        bounds.append(int(lengths[ends[j] - 1]))
        j = choice[j]
    return sorted([*bounds, int(lengths[ends[j] - 1])])


def items_of(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, n_tokens: each document whole, or cut into full pieces and a rest if it exceeds the capacity."""
    sizes = documents.select("doc_id", token_count("text", vocabulary).alias("total"))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("total") / capacity)).cast("int")
    cut = sizes.select("doc_id", "total", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    return cut.select("doc_id", "piece", F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("int").alias("n_tokens"))


def histogram(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All lengths and the number of items of each: capacity + 1 rows at most."""
    rows = sorted((r[0], r[1]) for r in items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect())
    return np.array([r[0] for r in rows], dtype=int), np.array([r[1] for r in rows], dtype=int)


def length_buckets(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, buckets: int = BUCKETS) -> list[int]:
    """Bounds for a histogram; empty items go to the first bucket."""
    sized = lengths > 0
    return optimal_bounds(lengths[sized], counts[sized], capacity, buckets) or [capacity]


def pack_shard(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item: longest first, each into the fullest container that still takes it."""
    out = np.empty(len(lengths), dtype=np.int64)
    rooms: list[tuple[int, int]] = []  # (room, container), ascending
    opened = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, container = rooms.pop(at)
        else:
            room, container = capacity, opened
            opened += 1
        out[i] = container
        if room > size or size == 0:
            insort(rooms, (room - size, container))
    return out


def _bucket(bounds: list[int]) -> Column:
    out = F.lit(0)
    for b in bounds[:-1]:
        out = out + (F.col("n_tokens") > b).cast("int")
    return out


def pack(items: DataFrame, bounds: list[int], histogram: tuple[np.ndarray, np.ndarray], capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """doc_id, piece, n_tokens, bucket_bound, container_id (`bucket/shard/number`): batches form inside a bucket only.

    A bucket's items are dealt evenly to shards of about `shard` items, whatever their ids, so one task never holds
    more than that; only ids and lengths are shuffled. Empty documents are items of length 0. An empty input gives no
    rows. items: written before, so that a task that is repeated deals alike.
    """
    lengths, counts = histogram
    of = np.searchsorted(bounds, lengths)
    shards = [max(1, -(-int(counts[of == k].sum()) // shard)) for k in range(len(bounds))]
    bucket = _bucket(bounds)
    spread = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.array(*map(F.lit, shards))[bucket]).cast("int")
    dealt = items.select("doc_id", "piece", "n_tokens", bucket.alias("bucket"), spread.alias("shard"))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "doc_id", "piece"], kind="stable")
        number = pack_shard(frame["n_tokens"].to_numpy(), capacity)
        bucket = int(frame["bucket"].iloc[0])
        where = f"{bucket}/{frame['shard'].iloc[0]}"
        return pd.DataFrame({"doc_id": frame["doc_id"], "piece": frame["piece"], "n_tokens": frame["n_tokens"], "bucket_bound": bounds[bucket], "container_id": [f"{where}/{k}" for k in number]})

    kind = items.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("bucket", "shard").applyInPandas(fill, f"doc_id {kind}, piece int, n_tokens int, bucket_bound int, container_id string")


def containers(documents: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Assignment of all documents to containers of `capacity` tokens.

    Dynamic programming over the global histogram of lengths chooses the bounds of the length buckets; token-budget
    batches form inside each bucket. Null and empty texts have no tokens and are assigned too; repeated rows are items
    of their own; extra columns are ignored; a text longer than the capacity is cut into full pieces and a rest.
    """
    items = materialize(items_of(documents, capacity, vocabulary))
    sizes = histogram(items)
    return pack(items, length_buckets(*sizes, capacity, buckets), sizes, capacity)


def compared(documents: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Containers and their fill by the choice of bounds: method, n_buckets, n_containers, fill."""
    items = materialize(items_of(documents, capacity, vocabulary))
    sizes = histogram(items)
    even = [capacity * (k + 1) // buckets for k in range(buckets)]
    out = None
    for method, bounds in (("optimal", length_buckets(*sizes, capacity, buckets)), ("even", even), ("one_bucket", [capacity])):
        full = pack(items, bounds, sizes, capacity).agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n"))
        row = full.select(F.lit(method).alias("method"), F.lit(len(bounds)).alias("n_buckets"), "n_containers", F.round(F.col("n") / (F.col("n_containers") * capacity), 6).alias("fill"))
        out = row if out is None else out.unionByName(row)
    return out
