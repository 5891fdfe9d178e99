"""Parsers, text rules, joins, sequences, sources and streams on small inputs with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import namespaces as N, text as X, urls as U
from ledgerline.functions.bitmap import maybe_in
from ledgerline.operators import content as C, generators, graph, joins, parsers as R, sequences as Q, signals as S
from ledgerline.sources import files


def one(spark, column, **values):
    types = {str: "string", int: "bigint", type(None): "string"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


def bodies(spark, *texts, kind="text/plain"):
    return spark.createDataFrame([(i, t, kind, "x") for i, t in enumerate(texts)], "id bigint, body string, content_type string, code string")


@pytest.mark.parametrize("kind,value,masked", [("phone", "010-1234-5678", "010-****-5678"), ("phone", "01012345678", "010-****-5678"), ("plate", "12가3456", "12가34**"), ("business", "109-86-31667", "109-86-316**"), ("resident", "900101-1234567", "900101-1******"), ("email", "fixture@example.test", "fi*****@example.test"), ("email", "a@b.test", "a*@b.test"), ("other", "abcd", "****")])
def test_masks(spark, kind, value, masked):
    assert one(spark, X.mask(kind, "v"), v=value) == masked


def test_signals_hold_no_value(spark):
    raw = ["010-1234-5678", "fixture@example.test", "900101-1234567"]
    rows = S.value_signals(bodies(spark, None, "", f"call {raw[0]} twice {raw[0]}, mail {raw[1]}, id {raw[2]}")).collect()
    assert {(r.code, r.occurrences, r.unique_values) for r in rows} == {("KR_PHONE_VALUE_CANDIDATE", 2, 1), ("EMAIL_VALUE_CANDIDATE", 1, 1), ("KR_RESIDENT_VALUE_CANDIDATE", 1, 1)}
    assert not any(v in str(rows) for v in raw)


def test_look_around(spark):
    found = {r.id for r in S.value_signals(bodies(spark, "01012345678901", "x12가3456", "가12가3456", "12가3456")).collect()}
    assert found == {3}


def test_verdicts(spark):
    texts = ["fetch('/api/x')", "SYNTHETIC_CANARY_1 a@b.test", "a@b.test just a moment", "nothing", "{broken", '{"a": 1}', "<img src=x>"]
    rows = {r.id: (list(r.codes), r.content, list(r.pending_reviews)) for r in S.marker_signals(bodies(spark, *texts, None)).collect()}
    assert rows == {
        0: (["RUNTIME_ENDPOINT_CANDIDATE"], "NOT_INSPECTED", []),
        1: (["SYNTHETIC_CANARY_PRESENT", "EMAIL_VALUE_CANDIDATE"], "SYNTHETIC_CONTENT_CONFIRMED", []),
        2: (["EMAIL_VALUE_CANDIDATE", "CHALLENGE_PAGE_INDICATOR"], "SENSITIVE_CANDIDATE", []),
        3: ([], "NOT_INSPECTED", []),
        4: (["JSON_PARSE_INCOMPLETE"], "NOT_INSPECTED", []),
        5: ([], "NOT_INSPECTED", []),
        6: ([], "NOT_INSPECTED", ["image_or_base64_review"]),
    }


def test_redaction(spark):
    text = "pw: password=hunter22 mail a@b.test tel 010-1234-5678 key sb_secret_abcdefghijkl0 https://x.test/?token=abc1&p=2 12가3456 CANARY-1"
    out = one(spark, X.redact("v", ["CANARY-1"]), v=text)
    assert out == "pw: password=[REDACTED] mail [REDACTED_EMAIL] tel [REDACTED_PHONE] key [REDACTED_SERVER_SECRET_CANDIDATE] https://x.test/?token=[REDACTED][REDACTED_VEHICLE_PLATE] [REDACTED_CANARY]"
    assert one(spark, X.redact("v"), v=None) is None


def test_inline_images(spark):
    texts = ["a data:image/png;base64,QUJD b", "DATA:IMAGE/x-y;BASE64,QUI= c data:image/gif;base64,QQ==", "data:image/png;base64,!", "plain"]
    rows = S.project_inline_images(bodies(spark, *texts)).orderBy("id").collect()
    assert [(r.projected, r.images) for r in rows] == [("a data:image/png;base64,[inline-image-omitted] b", 1), ("DATA:IMAGE/x-y;BASE64,[inline-image-omitted] c data:image/gif;base64,[inline-image-omitted]", 2), (texts[2], 0), ("plain", 0)]


@pytest.mark.parametrize(
    "url,shown",
    [("https://user:pw@app.example/customers/alice?token=secret#private", "https://app.example/<path-omitted>?<query-omitted>#<fragment-omitted>"), ("HTTP://A.Example:80/", "http://a.example/"), ("https://a.example:8443", "https://a.example:8443/"), ("ftp://a/", "<invalid-url>"), ("nonsense", "<invalid-url>")],
)
def test_safe_url(spark, url, shown):
    assert one(spark, U.safe_url("v"), v=url) == shown


def test_references_and_ids(spark):
    import hashlib
    import hmac
    import uuid

    assert one(spark, U.keyed_ref("v", "k" * 80), v="é") == "hmac-sha256:" + hmac.new(b"k" * 80, "é".encode(), hashlib.sha256).hexdigest()
    for v in ("a", "é", "x" * 99):
        assert one(spark, U.uuid5_hex(uuid.NAMESPACE_DNS.hex, F.lit("s"), "v"), v=v) == uuid.uuid5(uuid.NAMESPACE_DNS, "s\x1f" + v).hex


@pytest.mark.parametrize("raw,want", [("https://A.test:443/a%20b?x=1", "https://a.test/a%20b?x=1"), ("https://a.test", "https://a.test/"), ("https://a.test/%2e%2e/x", None), ("https://a.test/a//b", None), ("http://a.test/", None), ("https://u@a.test/", None), ("https://a.test/%25252525252541", None), ("https://a.test/#f", None), ("https://a b/", None)])
def test_canonical_url(spark, raw, want):
    assert one(spark, N.canonical_url("v"), v=raw) == want


def test_pointers(spark):
    body = json.dumps({"a/b": {"~": [1, {"x": "y"}]}, "n": None})
    assert one(spark, N.at_pointer("v", "/a~1b/~0/1/x"), v=body) == "y"
    assert [one(spark, N.at_pointer("v", p), v=body) for p in ("/n", "/zz", "/a~2", "no")] == [None] * 4
    assert one(spark, N.json_depth("v"), v='{"[[[": [[1], "\\"]]]"]}') == 3


PAGE = """<html><head><style>p{x:y}</style></head><body><p>Seen <b>here</b></p><div style="display: none"><p>secret<br>text</p></div><p>after</p>
<input type="password" value="v1"><a href="/x">l</a><script src="/s.js"></script><script type="application/json">{"a": 1}</script><script>var p = 1;</script>
<table><tr><th>commission rate condition</th></tr><tr><td>10%</td></tr></table></body></html>"""


def test_html_regions(spark):
    r = R.html_regions(bodies(spark, PAGE, None, "", "<p>open <div hidden>x")).orderBy("id").collect()
    p = r[0]
    assert " ".join(p.visible.split()) == "Seen here after l commission rate condition 10%" and " ".join(p.hidden.split()) == "secret text" and p.inputs == "v1"
    assert (p.hidden_elements, p.password_inputs, p.script_elements) == (1, 1, 3)
    assert [s for s in p.scripts if s] == ["var p = 1;"] and p.json_scripts == ['{"a": 1}']
    assert [(x.kind, x.url) for x in p.links] == [("a", "/x"), ("script", "/s.js")] and p.tables == [[["commission rate condition"], ["10%"]]]
    assert (r[2].visible, r[2].hidden) == ("open ", "x")
    assert sorted(x.url for x in R.resolved_links(R.html_regions(bodies(spark, PAGE)), "https://h.test/a/b").collect()) == ["https://h.test/s.js", "https://h.test/x"]


def test_json_nodes(spark):
    rows = R.field_counters(R.json_nodes(bodies(spark, '{"email": "", "salary": 0, "x": {"phone": "sample", "margin": false}}', "no json", "[" * 5000, None))).collect()
    assert [(r.id, r.fields, r.known_sensitive, r.filled_sensitive, r.contacts) for r in rows] == [(0, 5, 4, 2, 0)]


@pytest.mark.parametrize(
    "source,value,reason",
    [("const a = [{x: 1, 'y': \"z\\n\", q: [true, null,],}]", '[{"x": 1, "y": "z\\n", "q": [true, null]}]', None), ("let a = {b: -1.5e2, /* c */ d: 0x1f}", '{"b": -150.0, "d": 31}', None), ("var a = [f()]", None, "js_unsupported_dynamic_expression"), ("var a = {x: 1, x: 2}", None, "js_duplicate_key"), ("var a = [\"x", None, "js_unterminated_string"), ("var a = [1", None, "js_syntax")],
)
def test_js_literals(spark, source, value, reason):
    r = R.js_literals(bodies(spark, source)).first()
    assert (r.name, r.reason) == ("a", reason) and (value is None or json.loads(r.value_json) == json.loads(value))


def test_patches(spark):
    patch = "From 0 x\ndiff --git a/p.py b/p.py\n--- a/p.py\n+++ b/p.py\n@@ -1,2 +1,2 @@\n same\n-diff --git a/no b/no\n+new\ndiff --git a/q b/q\nnew file mode 100644\n--- /dev/null\n+++ b/q\n@@ -0,0 +1 @@\n+only\n"
    rows = R.patch_lines(bodies(spark, patch, "@@ -1 +1 @@\n-a\n+b", None)).collect()
    assert [(r.path, r.status) for r in rows if r.id == 0 and r.sign is None] == [("p.py", "modified"), ("q", "added")]
    assert [(r.path, r.sign, r.line) for r in rows if r.sign] == [("p.py", "-", "diff --git a/no b/no"), ("p.py", "+", "new"), ("q", "+", "only")]
    assert [r.error for r in rows if r.id == 1] == ["patch_provenance_invalid"]


def test_chunks_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(1234))
    rows = R.text_chunks(bodies(spark, text, "", "ab"), 100, 10).where("id = 0").orderBy("chunk").collect()
    assert all(r.text == text[r.start_char : r.start_char + 100] for r in rows) and rows[-1].start_char + len(rows[-1].text) == len(text)
    assert R.text_chunks(bodies(spark, "", "ab"), 100, 10).count() == 1


def test_content_reviews(spark):
    codes = {r.id: (list(r.codes), r.chunks) for r in C.chunk_findings(bodies(spark, "x" * 190 + " a@b.test " + "y" * 300, "z"), 200, 50).collect()}
    assert codes == {0: (["EMAIL_VALUE_CANDIDATE"], 3), 1: ([], 1)}
    flags = C.gate_flags(bodies(spark, "<p>commission stock</p><script>fetch('/login?x')</script>")).first()
    assert (list(flags.business_words), flags.server_call, flags.login_endpoint) == (["commission", "inventory"], True, True)
    assert C.dom_proximity(bodies(spark, "const rows = [1]; e.innerHTML = rows; let far = {}; " + " " * 2000)).first().links == 2
    states = C.strongest_states(spark.createDataFrame([(1, "a/b/c", "value"), (1, "a/d", "template"), (1, "e", "calculation")], "id bigint, path string, state string"))
    assert {(r.container, r.state) for r in states.collect()} == {("", "value"), ("a", "value"), ("a/b", "value")}


def test_bitmap_filter_keeps_all_partners(spark):
    left, keys = spark.range(20_000).withColumnRenamed("id", "k"), spark.range(0, 20_000, 97).withColumnRenamed("id", "q")
    kept = maybe_in(left, "k", keys, "q")
    assert keys.join(kept, F.col("k") == F.col("q")).count() == keys.count() and kept.count() < 1000
    assert maybe_in(left, "k", keys.limit(0), "q").count() == 0


def test_interval_join(spark):
    p = spark.sql("select id, timestamp_seconds(id * 5000) as at from range(60)")
    s = spark.sql("select id as sid, timestamp_seconds(id * 7000) as a, timestamp_seconds(id * 7000 + case when id % 5 = 0 then 100000000 when id % 5 = 1 then 0 else id * 900 end) as b from range(30)")
    want = {(r.id, r.sid) for r in p.join(s, (F.col("at") >= F.col("a")) & (F.col("at") < F.col("b"))).collect()}
    assert {(r.id, r.sid) for r in joins.interval_join(p, "at", s, "a", "b", bucket_s=3600).collect()} == want and len(want) > 50


def test_sequences(spark):
    rows = spark.createDataFrame([("a", 1, 3), ("a", 2, 4), ("a", 3, 2), ("a", 4, 0), ("b", 1, 9)], "k string, n int, cost bigint")
    assert [(r.k, r.n) for r in Q.affordable_prefix(rows, ["k"], ["n"], "cost", F.lit(6)).orderBy("k", "n").collect()] == [("a", 1)]
    assert {tuple(r) for r in Q.reserve(rows, "k", ["n"], ["cost"], [6]).collect()} == {("a", 5, 3, 1), ("b", 0, 0, 1)}
    chain = Q.hash_chain(rows, "k", ["n"], F.col("cost").cast("string")).collect()
    assert {r.k: r.links for r in chain} == {"a": 4, "b": 1}
    links = spark.createDataFrame([("a", 1, "0" * 64, "h1"), ("a", 2, "h1", "h2"), ("a", 4, "h9", "h3")], "k string, seq int, prev string, cur string")
    assert [(r.seq, r.bad_sequence, r.bad_link) for r in Q.verify_chain(links, "k", "seq", "prev", "cur").collect()] == [(4, True, True)]


def test_ties_and_diffs(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 5, "n")], "k string, at int, v string")
    assert sorted(r.v for r in joins.latest_with_ties(rows, ["k"], "at").collect()) == ["n", "y", "z"]
    assert sorted(r.v for r in joins.latest(rows, ["k"], ["at"]).collect()) == ["n", "z"]
    old, new = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "k int, v string"), spark.createDataFrame([(1, None), (2, "c"), (4, "d")], "k int, v string")
    assert {tuple(r) for r in joins.snapshot_diff(old, new, ["k"], ["v"]).collect()} == {(2, "changed"), (3, "removed"), (4, "added")}


def test_reach_passes_loops_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (9, 1)], "source int, target int")
    assert {tuple(r) for r in graph.reach(edges, spark.createDataFrame([(1,)], "node int"), 3).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_names(spark):
    assert one(spark, generators.romanize("v"), v="한국 물류a") == "hangukmulryu"
    assert one(spark, generators.initials("v"), v="아름다운") == "ardu"
    assert one(spark, generators.ascii_term("v"), v="Ａb-9 é") == "ab9"
    stems = lambda name: {r.stem: r.why for r in generators.stems(spark.createDataFrame([(name,), (None,)], "name string")).collect()}
    latin = stems("Blue Harbor Trading Co Ltd")
    assert latin["blueharbortrading"] == "name" and latin["bht"] == "initialism" and latin["blue"] == "leading-word" and latin["blue-harbortrading"] == latin["blueharbor-trading"] == "compound" and "co" not in latin
    korean = stems("㈜별빛렌터카 코리아")
    assert korean["byeolbit"] == "hangul-stem" and korean["bb"] == "hangul-stem-initials" and korean["renteoka"] == "hangul-tail" and korean["byeolbitrenteoka"] == "hangul-whole" and korean["byeo"] == "truncated"
    assert "joyeolbit" not in korean and stems("그룹") == {"geurup": "hangul-original", "gr": "hangul-original-initials", "grp": "devowelled", "geur": "truncated"}
    words = spark.createDataFrame([(w, i) for i, w in enumerate(("sales", "dev"))], "word string, word_no int")
    rows = spark.createDataFrame([("n", s, "word", i) for i, s in enumerate(("alpha", "beta", "gamma"))], "name string, stem string, why string, weight int")
    names = [r.candidate for r in generators.combine(rows, words, 5).orderBy("position").collect()]
    assert len(names) == 5 and {"alpha", "beta", "gamma"} <= set(names)  # the bare stems have their places
    assert [one(spark, N.valid_name(k, "v"), v=v) for k, v in (("account", "a--b"), ("account", "a-b"), ("bucket", "10.0.0.1"), ("group", "a..b"), ("dns_label", "-a"))] == [False, True, False, False, False]


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1, "y": "b"}\n{"x": 1}\n{"x": 1, "y": "b", "z": 0}\nno\n{"y": "c", "x": 2}\n')
    good, bad = files.json_lines(spark, str(tmp_path / "a.jsonl"), "x bigint, y string")
    assert sorted(map(tuple, good.collect())) == [(1, "b"), (2, "c")] and bad.count() == 3
    (tmp_path / "d").mkdir()
    (tmp_path / "d/ok.json").write_text('{"a": 1}')
    (tmp_path / "d/bad.json").write_text("{")
    (tmp_path / "d/big.json").write_text(json.dumps("x" * 500))
    assert sorted(str(r.reason) for r in files.json_documents(spark, str(tmp_path / "d"), 100).collect()) == ["None", "not_json", "too_large"]
    assert {r.bytes for r in files.file_manifest(spark, str(tmp_path / "d")).collect()} == {8, 1, 502}
    df = spark.createDataFrame([("e1", "h1"), ("e2", "h2"), ("e1", "h1")], "event_id string, payload_hash string")
    files.append_events(df, str(tmp_path / "t"))
    files.append_events(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    with pytest.raises(ValueError):
        files.append_events(spark.createDataFrame([("e1", "other")], df.schema), str(tmp_path / "t"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_new(df, str(tmp_path / "t"))


def test_recorded_pages(spark, tmp_path):
    from ledgerline.sources.pages import RecordedPages

    for query, pages in {"q1": {1: ([1, 2], 2), 2: ([3], None)}, "q2": {1: ([4], 1)}, "q3": {1: ([5], 7)}}.items():
        (tmp_path / query).mkdir()
        for n, (items, following) in pages.items():
            (tmp_path / query / f"{n}.json").write_text(json.dumps({"items": items, "next": following}))
    spark.dataSource.register(RecordedPages)
    rows = spark.read.format("recorded_pages").option("path", str(tmp_path)).load().collect()
    assert sorted((r.query, r.page, r.item_json, r.end_condition) for r in rows) == [("q1", 1, "1", "exhausted"), ("q1", 1, "2", "exhausted"), ("q1", 2, "3", "exhausted"), ("q2", 1, "4", "cursor_loop"), ("q3", 1, "5", "page_missing")]


def test_streams(spark, tmp_path):
    from ledgerline.streaming import ledger

    spark.sql("select 1L as key, id, timestamp_seconds(id * 10) as at from range(20)").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key bigint, id bigint, at timestamp").parquet(str(tmp_path / "in"))
    q = ledger.anchored_allowance(stream, 2, 60).writeStream.format("memory").queryName("allowance").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.table("allowance").where("allowed").collect()) == [0, 1, 6, 7, 12, 13, 18, 19]
    spark.sql("select concat('E', id % 7) as event_id, timestamp_seconds(id) as occurred_at from range(20)").write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("event_id string, occurred_at timestamp").parquet(str(tmp_path / "ev"))
    q = ledger.unique_events(stream).writeStream.format("memory").queryName("uniq").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("uniq").count() == 7


def test_tables_of_the_run_are_cleaned_up(spark):
    from ledgerline.sources import shared

    one, two = shared.materialize(spark.range(5)), shared.materialize(spark.range(7))
    shared.discard(one)
    assert two.count() == 7
    with pytest.raises(Exception):  # noqa: B017
        one.count()
    shared.clean_up(spark)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(two._ledgerline_path).count()
