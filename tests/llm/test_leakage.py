"""Leaks against a plain word-by-word check."""

import random

import pytest

from ledgerline.llm.leakage import LeakAutomaton, leaks, original_spans, placed, plain, words

ITEM = "Take case 1131, whose dusty ferry-timetable precedes some bakery-rota; Each clinic-rota numbered 69508 precedes the placid pottery-mark: which parent chain breaks?"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
    return row[-1]


def contains(text, item, run=12):
    d, w = words(text), words(item)
    if any(w[i : i + run] == d[j : j + run] for i in range(len(w) - run + 1) for j in range(len(d) - run + 1)):
        return True
    most, least = 4 * len(w) // 3, -(-3 * len(w) // 4)
    return bool(w) and any(lcs(w, d[j : j + most]) >= least for j in range(len(d)))


def test_against_plain_check():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 30)))) for i in range(12)]
    a = LeakAutomaton(items)
    n = 0
    for _ in range(250):
        seq = words(r.choice(items)[1])
        for _ in range(r.randint(0, 14)):
            if seq and r.random() < 0.5:
                del seq[r.randrange(len(seq))]
            else:
                seq.insert(r.randint(0, len(seq)), r.choice(vocabulary))
        text = " ".join([r.choice(vocabulary) for _ in range(r.randint(0, 30))] + seq + [r.choice(vocabulary) for _ in range(r.randint(0, 30))])
        want = {i for i, t in items if contains(text, t)}
        assert {a.ids[p[0]] for p in a.scan(text)} == want
        n += len(want)
    assert n > 100


@pytest.mark.parametrize(
    "text",
    [
        ITEM.upper(),
        ITEM.replace(" ", "\n\n"),
        ITEM.replace("e", "e" + chr(0x200B)),
        "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ITEM),
        ITEM.replace("dusty", "<b>dusty</b>").replace("some", "so<i>me</i>").replace(";", "<br/>"),
        ITEM.replace("clinic", "cli-\nnic").replace(" ", chr(0xA0)),
        ITEM.replace("-", chr(0x2011)),
        "before " + " ".join(words(ITEM)[5:17]) + " after",
        " ".join(w for i, w in enumerate(words(ITEM)) if i % 5),
    ],
)
def test_forms_that_are_leaks(text):
    a = LeakAutomaton([(7, ITEM), (8, "nothing of this sort is here at all")])
    assert {p[0] for p in a.scan("Some text. " + text + " More text.")} == {0}


def test_forms_that_are_not():
    a = LeakAutomaton([(7, ITEM)])
    seq = words(ITEM)
    assert not a.scan(" ".join(seq[5:16]))  # eleven words
    assert not a.scan(" ".join(reversed(seq)))
    assert not a.scan(" x y ".join(seq))  # far too long a stretch
    assert not a.scan("")


def test_offsets():
    text = "<p>One &amp; two</p>\n So" + chr(0x200B) + "me <b>dusty</b> " + chr(0xFF26) + "erry here"
    assert words(text) == ["one", "two", "some", "dusty", "ferry", "here"]
    [(_, s, e)] = original_spans(text, [(0, 2, 5, True)])
    assert words(text[s:e]) == ["some", "dusty", "ferry"] and text[s] == "S" and text[e - 1] == "y"
    assert plain("A&amp;B") == "a&b"


def test_places_follow_the_same_text():
    """placed() gives the text of plain(), whatever stands in it, with places that ascend."""
    r = random.Random(8)
    parts = ["a", "B", "-\n", "<b>", "</p>", "&eacute;", "&#65;", "&", "<", chr(0x301), chr(0xAC00), chr(0x1100), chr(0x1161), chr(0x11A8), chr(0xFF76), chr(0xFF9E), chr(0x200B), chr(0xDF), chr(0xFB01), chr(0x1F600), " ", "\n", "x-\r\n y", chr(0x3F9), chr(0x130)]
    for _ in range(400):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        for rejoin in (True, False):
            made, begin, end = placed(text, rejoin)
            assert made == plain(text, rejoin) and len(begin) == len(end) == len(made), text
            assert all(0 <= x < y <= len(text) for x, y in zip(begin, end)) and all(x <= y for x, y in zip(begin, begin[1:]))


def test_every_passage_comes_out():
    """Two runs of one item far apart, a near one beside them, one across a line-end hyphen that stays a hyphen."""
    seq, fill = words(ITEM), " ".join(f"filler{i}" for i in range(200))
    run, near = " ".join(seq[2:16]), " ".join(w for i, w in enumerate(seq) if i % 5)
    text = f"{run} {fill} {run} {fill} {near} {fill} " + run.replace("ferry timetable", "ferry-\ntimetable")
    a = LeakAutomaton([(7, ITEM), (8, "other words")])
    spans = sorted((s, e) for _, s, e in original_spans(text, a.scan(text)))
    assert [words(text[s:e], False) for s, e in spans] == [words(x, False) for x in (run, run, near, run)]


def test_table(spark):
    docs = spark.createDataFrame([(1, "see: " + ITEM, "en"), (1, "see: " + ITEM, "en"), (2, None, None), (3, "", "x"), (4, "word " * 50_000 + ITEM, None)], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(5, ITEM), (6, None), (7, "  ...  "), (5, ITEM)], "item_id bigint, text string")
    rows = leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(1, 5), (1, 5), (4, 5)]
    assert all(r.end_char - r.start_char == len(ITEM) - 1 for r in rows)  # without the question mark
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0
    assert sorted((r.doc_id, r.item_id) for r in leaks(docs, items.unionByName(spark.createDataFrame([(9, "other")], items.schema)), block=1).collect()) == [(1, 5), (1, 5), (4, 5)]
