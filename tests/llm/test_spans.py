"""Shared spans against brute force over all windows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import Row

from ledgerline.llm.spans import longest_spans, merge_spans, shared_report, shared_spans

SF = "/root/testdata/sf0.001"


def brute(docs, span):
    held = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - span + 1):
            held[t[i : i + span]].add(d)
    out = set()
    for d, t in docs:
        at = [i for i in range(len(t or "") - span + 1) if len(held[t[i : i + span]]) > 1]
        start = end = None
        for i in at:
            if end is not None and i <= end:
                end = i + span
            else:
                if end is not None:
                    out.add((d, start, end))
                start, end = i, i + span
        if end is not None:
            out.add((d, start, end))
    return out


def got(spark, docs, span, size=200_000):
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    return {(r.doc_id, r.start_char, r.end_char) for r in shared_spans(df, span, size).collect()}


def copied(seed, n, alphabet, span):
    """Texts that quote each other, at other offsets, with changes, over borders of all kinds."""
    r = random.Random(seed)
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 400))) for _ in range(n)]
    for _ in range(3 * n):
        a, b = r.randrange(n), r.randrange(n)
        i = r.randint(0, max(0, len(texts[a]) - 1))
        piece, at = texts[a][i : i + r.randint(span // 2, 4 * span)], r.randint(0, len(texts[b]))
        texts[b] = (texts[b][:at] + piece + texts[b][at:])[:3000]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,alphabet,size", [(1, "abcdefgh ", 200_000), (2, "ab", 300), (3, "가나다라마바사😀é ", 150)])
def test_random_copies(spark, seed, alphabet, size):
    docs = copied(seed, 25, alphabet, 40)
    assert got(spark, docs, 40, size) == brute(docs, 40)


def test_edges(spark):
    long = "".join(random.Random(5).choice("abcdefghijklmnop") for _ in range(1000))
    docs = [(1, None), (2, ""), (3, "x" * 90), (4, "x" * 41), (5, long), (6, long[:39]), (7, "??" + long[100:139] + "!"), (8, long[200:240]), (9, long[200:240]), (10, "ab" * 60), (11, "q" + "ba" * 50), (12, long[900:] + long[:60])]
    assert got(spark, docs, 40) == brute(docs, 40)
    assert got(spark, [(1, long + long)], 40) == set()
    assert shared_spans(spark.createDataFrame([], "doc_id bigint, text string"), 40).count() == 0


def test_hot_passage_in_a_third_of_all_documents(spark):
    r = random.Random(9)
    notice = "".join(r.choice("abcdefghijkl ") for _ in range(130))
    word = lambda n: "".join(r.choice("abcdefghijkl ") for _ in range(n))
    docs = [(i, word(50) + (notice if i % 3 == 0 else "") + word(50)) for i in range(150)]
    assert got(spark, docs, 40) == brute(docs, 40)


def test_whole_table_and_extra_columns(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    spans = shared_spans(df.withColumnRenamed("n_chars", "first").withColumnRenamed("lang", "anchor"))
    assert {tuple(r) for r in spans.select("doc_id", "start_char", "end_char").collect()} == brute(docs, 300) != set()
    report = {r.doc_id: r.share for r in shared_report(spans, df).collect()}
    assert report and all(0 < x <= 1 for x in report.values())


@pytest.mark.parametrize("seed,alphabet", [(1, "abcdefgh "), (4, "ab")])
def test_doubling_until_nothing_is_left(spark, seed, alphabet):
    """Every reported window is shared, and the one of twice its length is not."""
    docs = copied(seed, 25, alphabet, 40)
    docs += [(100, docs[0][1] + docs[1][1] + docs[2][1] * 2), (101, None), (102, docs[0][1] + docs[1][1] + "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    spans = shared_spans(df, 40)
    rows, text = longest_spans(df, spans, 40).collect(), dict(docs)
    shared = lambda d, piece: any(piece in (t or "") for o, t in docs if o != d)
    for r in rows:
        piece, twice = (text[r.doc_id][r.start_char : r.start_char + n] for n in (r.length, 2 * r.length))
        assert len(piece) == r.length and shared(r.doc_id, piece) and not (len(twice) == 2 * r.length and shared(r.doc_id, twice))
    assert {r.doc_id for r in rows} == {r.doc_id for r in spans.collect()} and max(r.length for r in rows) >= 160
    assert longest_spans(df, spans.limit(0), 40).count() == 0


def test_touching_spans_merge(spark):
    df = spark.createDataFrame([Row(doc_id=1, start_char=0, end_char=5), Row(doc_id=1, start_char=5, end_char=9), Row(doc_id=1, start_char=10, end_char=12), Row(doc_id=2, start_char=1, end_char=2), Row(doc_id=1, start_char=0, end_char=3)])
    assert sorted(map(tuple, merge_spans(df).select("doc_id", "start_char", "end_char").collect())) == [(1, 0, 9), (1, 10, 12), (2, 1, 2)]
