"""Scopes, evaluation, pages, ledgers and revisions against answers by hand."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ledgerline.operators import discovery as D, revisions as R, sequences as Q


def t(*a):
    return datetime(*a, tzinfo=timezone.utc)


def test_scope_decisions(spark):
    urls = ["https://a.test/x/y", "https://a.test/xy", "https://a.test/x", "https://a.test/x/no", "https://b.test/", "http://a.test/x", "https://a.test/x?token=1", "https://a.test:8443/x", None]
    rows = spark.createDataFrame(list(enumerate(urls)), "id int, url string")
    targets = spark.createDataFrame([("p", "https://A.test", "/x/", 1), ("old", "https://b.test", "/", 1)], "policy_id string, origin string, prefix string, id int")
    policies = spark.createDataFrame([("p", t(2030, 1, 1), ["https://a.test/x/no"]), ("old", t(2020, 1, 1), [])], "policy_id string, expires_at timestamp, excluded array<string>")
    out = {r.id: (r.decision, r.policies) for r in D.scope_decisions(rows, targets, policies, F.lit("2026-01-01").cast("timestamp")).collect()}
    assert [out[i][0] for i in range(9)] == ["allowed", "outside", "allowed", "excluded", "expired", "invalid", "invalid", "outside", "invalid"]
    assert out[0][1] == ["p"] and out[1][1] == []


def test_evaluation_stops_at_the_first_query_that_is_too_dear(spark):
    results = spark.createDataFrame([("q1", "a", 2, ["c1", "c2"]), ("q2", "b", 5, ["c3"]), ("q3", "a", 0, ["c4"])], "query_id string, family string, cost bigint, candidate_ids array<string>")
    candidates = spark.createDataFrame([("c1", ["a"], "relevant"), ("c2", ["b"], "known_false_positive"), ("c3", ["a", "b"], "relevant"), ("c4", ["a"], "unlabeled_unknown")], "candidate_id string, families array<string>, label string")
    schedules = spark.createDataFrame([("s", i, q) for i, q in enumerate(("q1", "q2", "q3"))], "schedule string, position int, query_id string")
    got = {(r.budget, r.family): r for r in D.evaluate_at_budgets(results, candidates, schedules, [1, 3, 10]).collect()}
    one = lambda b, f: (got[b, f].selected, got[b, f].relevant_found, got[b, f].relevant_total, got[b, f].recall, got[b, f].precision, got[b, f].unknown)
    assert one(1, "") == (0, 0, 2, 0.0, None, 0)
    assert one(3, "") == (2, 1, 2, 0.5, 0.5, 0)  # the free q3 stays out behind q2
    assert one(3, "a") == (1, 1, 2, 0.5, 1.0, 0) and one(3, "b") == (0, 0, 1, 0.0, None, 0)
    assert one(10, "") == (4, 2, 2, 1.0, 0.666667, 1) and one(10, "b") == (1, 1, 1, 1.0, 1.0, 0)


def test_previous_over_stretches(spark):
    rows = spark.createDataFrame([("k", i, f"s{i}") for i in (1, 5, 9, 10, 40, 41)] + [("o", 3, "x"), (None, 1, "y")], "key string, seq bigint, state string")
    got = {(r.key, r.seq): r.previous for r in D.with_previous(rows, "key", "seq", "state", 8).collect() if r.key}
    assert got == {("k", 1): None, ("k", 5): "s1", ("k", 9): "s5", ("k", 10): "s9", ("k", 40): "s10", ("k", 41): "s40", ("o", 3): None}
    bad = D.illegal_transitions(rows.where("key = 'k'"), "key", "seq", "state", {None: ["s1"], "s1": ["s5"], "s5": ["s9"]}).collect()
    assert sorted(r.seq for r in bad) == [10, 40, 41]


def test_pages_end_in_every_way(spark):
    page = lambda more, *urls: '{"results": [' + ",".join(f'{{"id": "{i}", "url": "{u}"}}' for i, u in enumerate(urls)) + "]" + ("" if more is None else f', "has_more": {str(more).lower()}') + "}"
    rows = [("done", 1, page(True, "https://a.test/", "https://b.test/")), ("done", 2, page(False, "https://a.test/")), ("done", 3, page(False, "https://late.test/")), ("gap", 1, page(True, "https://a.test/")), ("gap", 3, page(False, "https://b.test/"))]
    rows += [("open", 1, page(None, "https://a.test/")), ("bad", 1, "{}"), ("broken", 1, "no"), ("dirty", 1, page(False, "mailto:x", "https://a.test/")), ("done", 1, page(True, "https://a.test/", "https://b.test/"))]
    found, coverage = D.follow_pages(spark.createDataFrame(rows, "query string, page int, body string"))
    assert sorted((r.query, r.url, r.position) for r in found.collect() if r.query == "done") == [("done", "https://a.test/", 1), ("done", "https://b.test/", 2)]
    got = {r.query: (r.pages, r.candidates, r.rejected, r.end_condition, r.complete) for r in coverage.collect()}
    assert got == {"done": (2, 2, 0, "page_exhausted", True), "gap": (1, 1, 0, "PAGE_MISSING", False), "open": (1, 1, 0, "PAGINATION_UNDECLARED", False), "bad": (1, 0, 0, "RESPONSE_SHAPE_MISMATCH", False), "broken": (1, 0, 0, "RESPONSE_SHAPE_MISMATCH", False), "dirty": (1, 1, 1, "page_exhausted", False)}
    capped = D.follow_pages(spark.createDataFrame(rows, "query string, page int, body string"), 1)[1]
    assert {r.query: r.end_condition for r in capped.collect()}["done"] == "candidate_limit_reached"


def test_pages_that_repeat_each_other(spark):
    page = lambda *ids: '{"results": [' + ",".join('{"url": "u"}' if i is None else f'{{"id": "{i}"}}' for i in ids) + "]}"
    rows = [("q", 1, page("a", "b", "b")), ("q", 2, page("b", "c", None)), ("q", 3, page("a", "c")), ("q", 4, page()), ("r", 1, "no"), ("q", 3, page("a", "c"))]
    got = {r.query: (r.pages, r.records, r.repeated, r.stale_pages) for r in D.page_overlap(spark.createDataFrame(rows, "query string, page int, body string")).collect()}
    assert got == {"q": (4, 8, 3, 1), "r": (1, 0, 0, 0)}


def test_folds_in_order(spark):
    import hashlib

    rows = spark.createDataFrame([("a", i, str(i), i) for i in range(500)] + [("b", 1, None, None), (None, 1, "x", 1)], "k string, n int, body string, cost bigint").repartition(5)
    head = "0" * 64
    for i in range(500):
        head = hashlib.sha256((head + hashlib.sha256(str(i).encode()).hexdigest()).encode()).hexdigest()
    got = {r.k: (r.links, r.head) for r in Q.hash_chain(rows, "k", ["n"], F.col("body")).collect()}
    assert got["a"] == (500, head) and got["b"][0] == got[None][0] == 1
    digest = {r.k: (r.digest, r.n) for r in Q.ordered_digest(rows, "k", "body").collect()}
    assert digest["a"] == (hashlib.sha256("".join(sorted(map(str, range(500)))).encode()).hexdigest(), 500)
    used = {r.k: (r.cost, r.accepted, r.rejected) for r in Q.reserve(rows, "k", ["n"], ["cost"], [10]).collect()}
    assert used["a"] == (10, 5, 495) and used["b"] == (0, 0, 1)
    assert Q.hash_chain(rows.limit(0), "k", ["n"], F.col("body")).count() == 0


def test_revisions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    sha = "Ab" * 20
    assert one(R.tree_url(F.lit("o/r"), F.lit("release/1"))).endswith("/o/r/git/trees/release%2F1?recursive=1")
    assert [one(R.tree_url(F.lit(s), F.lit(v))) for s, v in (("o/r/x", "main"), ("-o/r", "main"), ("o/r", "a..b"), ("o/r", "/a"), ("o/r", None))] == [None] * 5
    assert one(R.commit_detail_url(F.lit(f"https://github.com/o/r/commit/{sha}.patch"))).endswith(f"/o/r/commits/{sha.lower()}?per_page=100&page=1")
    assert one(R.raw_url(F.lit("o/r"), F.lit(sha), F.lit("a b/ü#.md"))).endswith(f"/o/r/{sha}/a%20b/%C3%BC%23.md") and one(R.raw_url(F.lit("o/r"), F.lit(sha), F.lit("../x"))) is None
    routes = [("a.PNG", b""), ("a", b"\xff\xd8\xff\xe0"), ("a.txt", b"RIFF\0\0\0\0WEBPVP8 "), ("a.pdf", b"x"), ("a", b"PK\x03\x04"), ("a.txt", b"ab\0c"), ("a.svg", b"x"), ("a", b" <svg x"), ("a", b"<?xml v?><svg"), ("a", b"plain"), ("a", b"\xff\xfe")]
    df = spark.createDataFrame([(p, h) for p, h in routes], "p string, h binary").select(R.file_route("p", "h").alias("r"))
    assert [r.r for r in df.collect()] == ["image"] * 3 + ["unsupported_binary"] * 3 + ["svg"] * 3 + ["text"] * 2
    holds = spark.createDataFrame([([],), (["HIDDEN_DOM_PRESENT"],), (["HIDDEN_DOM_PRESENT", "EMAIL_VALUE_CANDIDATE"],)], "c array<string>").select(R.material_hold("c").alias("h"))
    assert [r.h for r in holds.collect()] == [True, False, True]


def test_steps(spark):
    assert R.step_problem({"action": "click", "target_id": "a", "target_button_class": "b"}) == R.step_problem({"action": "click"}) == R.step_problem({"action": "wait", "milliseconds": True}) == "invalid_ui_steps"
    assert R.step_problem({"action": "click", "target_button_class": "b", "target_index": 63}) is None and R.step_problem({"action": "click", "target_id": "b", "target_index": 1}) == "invalid_ui_steps"
    assert R.step_problem({"action": "check", "target_id": "x", "checked": 1}) == "invalid_ui_steps" and R.step_problem({"action": "select", "target_id": "x", "index": 101}) == "invalid_ui_steps"
    assert R.step_problem({"action": "click", "target_id": "a", "expect_visible_ids": ["b"], "expect_hidden_ids": ["b"]}) == "invalid_ui_steps" and R.step_problem([]) == "invalid_ui_steps"
    rows = R.interaction_steps(spark.createDataFrame([(1, "no"), (2, None), (3, '{"ui_steps": ' + str([{}] * 13) + "}"), (4, "{}")], "id bigint, body string")).collect()
    assert {r.id: (r.reason, r.steps) for r in rows} == {1: ("invalid_ui_steps", 0), 3: ("invalid_ui_steps", 0), 4: (None, 0)}


def test_mirrors_holds_and_bounds(spark):
    h = lambda c: c * 64
    rows = [("a", "r", h("a"), True), ("a", "r", h("a"), True), ("b", "r", h("a"), True), ("b", "r", h("b"), True), ("c", "r", h("a"), True), ("c", "s", h("a"), True), ("d", "r", "x", True), ("d", "r", "x", True), ("e", "r", h("a"), None), ("e", "r", h("a"), True), ("f", "r", h("a"), True)]
    got = {r.k: r.state for r in R.mirror_states(spark.createDataFrame(rows, "k string, representation string, sha256 string, capture_complete boolean"), ["k"]).collect()}
    assert got == {"a": "same_at_observation", "b": "different_at_observation", "c": "comparison_pending", "d": "comparison_pending", "e": "comparison_pending"}
    jobs = spark.createDataFrame([(1, "p", "blocked"), (2, "p", "ok"), (3, None, "blocked"), (4, None, "ok"), (5, "q", None)], "id int, parent string, state string")
    assert {r.id: r.held for r in R.lineage_hold(jobs, "parent", F.col("state") == "blocked").collect()} == {1: True, 2: True, 3: True, 4: False, 5: False}
    refs = spark.createDataFrame([("j", "r1"), ("j", "r2"), ("j", "r3"), ("j", "r4"), ("j", "r1")], "job_id string, result_ref string")
    results = spark.createDataFrame([("r1", "j"), ("r1", "j"), ("r2", "k"), ("r3", "j"), ("r3", "k")], "result_ref string, job_id string")
    assert {r.result_ref: r.state for r in D.bound_results(refs, results).collect()} == {"r1": "exact", "r2": "other_job", "r3": "ambiguous", "r4": "missing"}
    hosts, known = spark.createDataFrame([("x.a.test",), ("a.test",), ("ba.test",), ("",), (None,)], "h string"), spark.createDataFrame([("a.test",), ("test.x",), ("A.test",)], "d string")
    assert {(r.host, r.domain) for r in D.suffix_matches(hosts, "h", known, "d").collect()} == {("x.a.test", "a.test"), ("a.test", "a.test")}
