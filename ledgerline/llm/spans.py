"""Long exact spans shared between records (problem 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerline.functions.bitmap import maybe_in
from ledgerline.sources.shared import counted, discard, materialize

SPAN = 300  #: code points of the shortest shared span
SLICE = 200_000  #: code points that are hashed together
_POSITION = 20  #: bits of a position within a slice

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * _A
    out += right
    out *= _C
    out ^= out >> np.uint64(31)
    return out


class Windows:
    """64-bit hashes of all windows of a text, each length made from the windows of half that length."""

    def __init__(self, codes: np.ndarray):
        one = (codes.astype(np.uint64) + np.uint64(1)) * _A
        one ^= one >> np.uint64(32)
        one *= _B
        one ^= one >> np.uint64(29)
        self.size, self.levels = len(codes), {1: one}

    def level(self, length: int) -> np.ndarray:
        """length: a power of two."""
        if length not in self.levels:
            half = self.level(length // 2)
            self.levels[length] = _pairs(half[: len(half) - length // 2], half[length // 2 :])
        return self.levels[length]

    def of(self, length: int) -> np.ndarray:
        """Hash of each window of any length: two overlapping windows of a power of two cover it."""
        part = 1 << ((length - 1).bit_length() - 1)
        h, n = self.level(part), self.size - length + 1
        return _pairs(h[:n], h[length - part : length - part + n])


def _slices(docs: Iterator[tuple], span: int, size: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(owners, lengths, codes): texts put together to slices; a longer text is cut into pieces that overlap."""
    held, n = [], 0
    for owner, text in docs:
        for base in range(0, max(1, len(text) - span + 1), size):
            piece = text[base : base + size + span - 1]
            held.append(((owner, base), piece))
            n += len(piece)
            if n >= size:
                yield _slice(held)
                held, n = [], 0
    if held:
        yield _slice(held)


def _slice(held: list) -> tuple[list, np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(t for _, t in held).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return [o for o, _ in held], np.array([len(t) for _, t in held]), codes


def _least_in(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` successive keys, by doubling."""
    out, done = keys, 1
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(out) - (width - done)], out[width - done :]) if width > done else out


ANCHORS = "doc_id {0}, first bigint, n int, anchor bigint, before int, after int, context bigint"


def anchors(documents: DataFrame, span: int = SPAN, size: int = SLICE) -> DataFrame:
    """Windows of `span` code points, put together by their anchor.

    The anchor of a window is the one of its subwindows of span/4 code points whose hash is least, so equal windows
    have equal anchors at the same place, and successive windows mostly share one: about a hundred windows make one
    row. Columns: the first window and the number of windows, the hash of the anchor, of the anchor extended to twice
    its length to either side, and of the whole context that the windows cover.
    """
    quarter, half = span // 4, span // 2
    mask = np.uint64((1 << _POSITION) - 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            docs = ((d, t) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if t is not None and len(t) >= span)
            for owners, lengths, codes in _slices(docs, span, size):
                win = Windows(codes)
                short, long, twice = win.of(quarter), win.of(span), win.of(half)
                keys = (short & ~mask) | np.arange(len(short), dtype=np.uint64)
                at = (_least_in(keys, span - quarter + 1) & mask).astype(np.int64)
                ends = np.cumsum(lengths)
                owner = np.repeat(np.arange(len(lengths)), lengths)[: len(at)]
                inside = np.arange(len(at)) + span <= ends[owner]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                last = np.minimum(np.append(first[1:], len(at)), (ends - span + 1)[owner[first]]) - 1
                first, last = first[inside[first]], last[inside[first]]
                place, own = at[first], owner[first]
                n = last - first + 1
                doubled = np.append(twice, np.zeros(span, dtype=np.uint64)) >> np.uint64(32)
                context = _pairs(_pairs(long[first], long[last]), n.astype(np.uint64))
                starts = ends - lengths
                bases = np.array([o[1] for o in owners], dtype=np.int64)
                ids = pa.array([o[0] for o in owners], type=kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(own)),
                        pa.array(first - starts[own] + bases[own]),
                        pa.array(n.astype(np.int32)),
                        pa.array(short[place].view(np.int64)),
                        pa.array(doubled[np.maximum(place - (half - quarter), 0)].astype(np.uint32).view(np.int32)),
                        pa.array(doubled[place].astype(np.uint32).view(np.int32)),
                        pa.array(context.view(np.int64)),
                    ],
                    names=["doc_id", "first", "n", "anchor", "before", "after", "context"],
                )

    return documents.select("doc_id", "text").where(F.length("text") >= span).mapInArrow(scan, ANCHORS.format(documents.schema["doc_id"].dataType.simpleString()))


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that stand in more than one document; combined on the map side, whatever their number."""
    return rows.groupBy(*keys).agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")).where("_lo <> _hi").select(*keys)


def _windows(places: DataFrame, n_places: int, documents: DataFrame, span: int, size: int) -> DataFrame:
    """Hash of every window of the contexts in `places`, from the texts of the documents that hold them."""
    kept = places.groupBy("doc_id").agg(F.collect_list(F.struct("first", "n", "anchor", "context", "lo", "hi", "whole")).alias("at"))
    texts = maybe_in(documents.select(F.col("doc_id").alias("t_doc"), "text").where("text is not null"), "t_doc", places, "doc_id", n_places)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.schema.field("t_doc").type
            for text, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist()):
                for lo in range(0, len(at), 1000):
                    part = at[lo : lo + 1000]
                    pieces = [text[a["first"] : a["first"] + a["n"] + span - 1] for a in part]
                    lengths = np.array([len(p) for p in pieces])
                    hashes = Windows(np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), dtype="<u4")).of(span)
                    n = lengths - span + 1
                    of = np.repeat(np.arange(len(part)), n)
                    offset = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                    index = pa.array(of)
                    col = lambda name, kind, part=part, index=index: pa.array([a[name] for a in part], type=kind).take(index)
                    yield pa.RecordBatch.from_arrays(
                        [col("anchor", pa.int64()), pa.array(hashes[np.repeat(np.cumsum(lengths) - lengths, n) + offset].view(np.int64)), col("context", pa.int64()), pa.array(offset.astype(np.int32)), col("lo", ids), col("hi", ids), col("whole", pa.bool_())],
                        names=["anchor", "window", "context", "offset", "lo", "hi", "whole"],
                    )

    return texts.join(kept, F.col("t_doc") == F.col("doc_id")).select("t_doc", "text", "at").mapInArrow(scan, f"anchor bigint, window bigint, context bigint, offset int, lo {kind}, hi {kind}, whole boolean")


def shared_spans(documents: DataFrame, span: int = SPAN, size: int = SLICE) -> DataFrame:
    """doc_id, start_char, end_char: the parts of each text covered by spans that stand verbatim in another document.

    Level-wise doubling of the windows' anchors up to `span`, the length asked for; longest_spans() doubles on. Anchors of span/4 code points that stand in one document alone are
    dropped; those left are extended to span/2, to the side where each window has room, and dropped likewise; those
    left after that are extended to the whole context of their windows. A context in two documents is shared as it is.
    Of the other contexts whose anchor has more than one context, every single window of `span` is compared, one
    representative for each context. At every level only keys are grouped, with minimum and maximum of doc_id, so a
    passage in a third of all documents makes no large group; no pairs of documents are made.

    Positions are code points from 0, end exclusive; touching and overlapping spans are merged. Null and short texts
    have none. doc_id must be unique: rows of one doc_id count as one document. Extra columns are ignored.
    """
    documents = documents.select("doc_id", "text").where("doc_id is not null")
    # level span/4: anchors
    first = materialize(anchors(documents, span, size))
    keys = materialize(_repeated(first, ["anchor"]), n="count(1)")
    one = materialize(maybe_in(first, "anchor", keys, "anchor", counted(keys)["n"]).join(keys, "anchor", "left_semi"))
    discard(first)

    # level span/2: anchors extended to either side
    sides = one.withColumn("side", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("before").alias("twice")), F.struct(F.lit(1).alias("which"), F.col("after").alias("twice")))))
    sides = sides.select("doc_id", "first", "n", "context", "anchor", F.col("side.which").alias("which"), F.col("side.twice").alias("twice"))
    two = sides.join(_repeated(sides, ["anchor", "which", "twice"]), ["anchor", "which", "twice"], "left_semi").select("doc_id", "first", "n", "anchor", "context").distinct()
    two = materialize(two)
    discard(one)

    # level span: the windows themselves, as whole contexts where these are repeated

    contexts = two.groupBy("anchor", "context", "n").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(F.struct("doc_id", "first")).alias("at"))
    contexts = materialize(contexts.select("anchor", "context", "n", "lo", "hi", F.col("at.doc_id").alias("doc_id"), F.col("at.first").alias("first"), (F.col("lo") != F.col("hi")).alias("whole")))
    mixed = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.count_if(~F.col("whole")).alias("single")).where("m > 1 and single > 0").select("anchor")
    open_ = materialize(contexts.join(mixed, "anchor", "left_semi"), n="count(1)")
    windows = materialize(_windows(open_, counted(open_)["n"], documents, span, size))
    shared = windows.groupBy("anchor", "window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("anchor", "window")
    shared = materialize(shared, n="count(1)")
    in_context = W.partitionBy("anchor", "context").orderBy("offset")
    hits = maybe_in(windows.where("not whole"), "window", shared, "window", counted(shared)["n"]).join(shared, ["anchor", "window"], "left_semi").select("anchor", "context", "offset")
    runs = hits.withColumn("run", F.col("offset") - F.row_number().over(in_context)).groupBy("anchor", "context", "run").agg(F.min("offset").alias("from"), F.max("offset").alias("to")).drop("run")
    runs = runs.unionByName(contexts.where("whole").select("anchor", "context", F.lit(0).alias("from"), (F.col("n") - 1).alias("to")))
    found = two.join(runs, ["anchor", "context"]).select("doc_id", (F.col("first") + F.col("from")).alias("start_char"), (F.col("first") + F.col("to") + span).alias("end_char"))
    return merge_spans(found)


def longest_spans(documents: DataFrame, spans: DataFrame, span: int = SPAN, size: int = SLICE) -> DataFrame:
    """doc_id, start_char, length: for each shared window, the longest of span, 2 span, 4 span... that is shared from there.

    spans: shared_spans() of the same documents. Doubling goes on from level `span`: windows that stand in one document
    alone are dropped, those repeated are extended to twice the length, until no candidates survive. Only the shared
    spans are read, and no window is tried that leaves its span, as such a one can't be shared.
    """
    held = spans.groupBy(F.col("doc_id").alias("s_doc")).agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char"))).alias("at"))  # bounded by the text itself
    held = materialize(held, n="count(1)")
    texts = maybe_in(documents.select("doc_id", "text").where("text is not null"), "doc_id", held, "s_doc", counted(held)["n"]).join(held, F.col("doc_id") == F.col("s_doc")).select("doc_id", "text", "at")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, at in zip(batch.column("doc_id"), batch.column("text").to_pylist(), batch.column("at").to_pylist()):
                for a in at:
                    win = Windows(np.frombuffer(text[a["start_char"] : a["end_char"]].encode("utf-32-le", "surrogatepass"), dtype="<u4"))
                    levels = [span]
                    while 2 * levels[-1] <= win.size:
                        levels.append(2 * levels[-1])
                    made = [win.of(x).view(np.int64) for x in levels]
                    for base in range(0, len(made[0]), size):
                        parts = [m[base : base + size] for m in made]
                        table, there = np.zeros((len(parts[0]), len(parts)), dtype=np.int64), np.zeros((len(parts[0]), len(parts)), dtype=bool)
                        for k, m in enumerate(parts):
                            table[: len(m), k], there[: len(m), k] = m, True
                        ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
                        doc_ids = pa.array([doc.as_py()], batch.schema.field("doc_id").type).take(pa.array(np.zeros(len(table), dtype=np.int64)))
                        yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.arange(len(table)) + base + a["start_char"]), pa.ListArray.from_arrays(pa.array(ends), pa.array(table[there]))], names=["doc_id", "start_char", "hashes"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    state, length, out = materialize(texts.mapInArrow(scan, f"doc_id {kind}, start_char bigint, hashes array<bigint>")), span, None
    while True:
        level = state.where(F.size("hashes") > 0).select("doc_id", "start_char", "hashes", F.col("hashes")[0].alias("key"))
        kept = level.join(_repeated(level, ["key"]), "key", "left_semi").select("doc_id", "start_char", F.slice("hashes", 2, F.size("hashes")).alias("hashes"), F.lit(length).cast("bigint").alias("length"))
        state = materialize(kept, n="count(1)")
        out = state.drop("hashes") if out is None else out.unionByName(state.drop("hashes"))
        if not counted(state)["n"]:
            return out.groupBy("doc_id", "start_char").agg(F.max("length").alias("length"))
        length *= 2


def merge_spans(found: DataFrame) -> DataFrame:
    """Overlapping and touching spans of each document as one row; a document's spans are bounded by its own text."""
    by_doc = W.partitionBy("doc_id").orderBy("start_char", "end_char")
    reach = F.max("end_char").over(by_doc.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(F.col("start_char") <= reach, 0).otherwise(1)
    groups = found.withColumn("opens", opens).withColumn("group", F.sum("opens").over(by_doc.rowsBetween(W.unboundedPreceding, 0)))
    return groups.groupBy("doc_id", "group").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char")).drop("group")


def shared_report(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """Of each document with shared spans: their number and code points, and their share of the text."""
    sums = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars"))
    return sums.join(documents.select("doc_id", F.length("text").cast("bigint").alias("total_chars")), "doc_id").withColumn("share", F.round(F.col("shared_chars") / F.col("total_chars"), 6))
