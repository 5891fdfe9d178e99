"""The general problems 1 to 5: nulls, blanks, ties, repeats, empty tables, clashing columns, hot keys."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import changes, hierarchy, intervals, nested, references


def t(*a):
    return datetime(*a, tzinfo=timezone.utc)


# 1


def elements(spark, bodies):
    rows = [(r, t(2025, 1, day), b) for r, day, b in bodies]
    out = nested.flatten(spark.createDataFrame(rows, "record_ref string, received_at timestamp, body string"))
    return {(r.record_ref, r.node_kind, r.parent_path, r.node_path) for r in out.collect()}


def test_nested_paths_and_parents(spark):
    body = {"channels": [{"a": 1, "attempts": [{"x": 1}, None, 5, {"x": 2}]}, None], "wrap": {"pages": {"n": 1}}, "signals": json.dumps([{"c": 1, "members": {"m": 1}}]), "pages": 13}
    assert elements(spark, [(" REF-1 ", 1, json.dumps(body))]) == {
        ("ref-1", "channels", "", "channels[0]"),
        ("ref-1", "attempts", "channels[0]", "channels[0].attempts[0]"),
        ("ref-1", "attempts", "channels[0]", "channels[0].attempts[3]"),
        ("ref-1", "pages", "", "wrap.pages[0]"),
        ("ref-1", "signals", "", "signals[0]"),
        ("ref-1", "members", "signals[0]", "signals[0].members[0]"),
    }


def test_nested_latest_valid_body_counts(spark):
    one, two = json.dumps({"pages": [{}]}), json.dumps({"pages": [{}, {}]})
    assert elements(spark, [("r", 1, one), ("R", 2, two), ("r", 3, "{broken"), ("r", 3, None), ("q", 1, "NaN"), (None, 1, one), ("", 1, one)]) == {("r", "pages", "", "pages[0]"), ("r", "pages", "", "pages[1]")}
    assert elements(spark, [("r", 1, one), ("r", 2, "5")]) == set()  # valid, but holds nothing
    assert elements(spark, [("r", 1, json.dumps(one)), ("s", 1, ""), ("d", 1, "[" * 100_000)]) == {("r", "pages", "", "pages[0]")}
    assert elements(spark, []) == set()


def nodes_of(spark, *bodies):
    rows = [(f"r{i}", t(2025, 1, 1), b if isinstance(b, str) else json.dumps(b), 1) for i, b in enumerate(bodies)]
    return nested.flatten(spark.createDataFrame(rows, "record_ref string, received_at timestamp, body string, variant int"))


def test_shapes_route_to_variants(spark):
    nodes = nodes_of(spark, {"pages": [{"u": "x"}, {"u": "y"}, {"u": None}, {"u": "z", "members": [{"n": 1, "variant": "q"}]}]})
    kinds = {r.shape: r.n_nodes for r in nested.variants(nodes.where("node_kind = 'pages'")).collect()}
    assert kinds == {'{"u":text}': 2, '{"u":null}': 1, '{"members":table,"u":text}': 1}
    tables = nested.route(nodes)
    assert [(r.n, r.parent_path, r.f_variant) for r in tables.kind("members").collect()] == [(1, "pages[3]", "q")]
    by_shape = {shape: tables.variant(*key) for key, shape in tables.shapes.items()}
    assert by_shape['{"u":text}'].columns == ["record_ref", "node_path", "parent_kind", "parent_path", "variant", "u"] and by_shape['{"u":text}'].count() == 2
    assert by_shape['{"u":null}'].columns == ["record_ref", "node_path", "parent_kind", "parent_path", "variant"]  # null has no type


def test_every_kind_and_variant_is_typed(spark):
    """Mixed types, nulls, names that clash; with room for few typed tables, the rest is whole as well."""
    from ledgerline.plans import problems

    assert nested.shape_columns('{"a,\\"]":[{"x":int}|text],"b":table,"c":null,"d":{"e":bool,"f":int},"g":int}') == {'a,"]': "[{\"x\":int}|text]", "c": "null", "d": '{"e":bool,"f":int}', "g": "int"}
    assert nested.shape_columns("{}") == {}
    body = {k: [{"n": 1, "odd'name": True}, {"n": 1.5, "pages": []}, {"n": None, "s": [1], "N": "true"}, {"n": "true", "s": 10**30}, {}] for k in nested.LIST_FIELDS}
    nodes = nodes_of(spark, body)
    for limit in (nested.TABLES, 3, 0):
        tables = nested.route(nodes, limit)
        wanted = nested.named_columns({"N": ["string"], "n": ["bigint", "double", "string"], "odd'name": ["boolean"], "s": ["string"]})
        for kind in nested.LIST_FIELDS:
            got = tables.kind(kind, wanted)
            rows = {(r["N"], r.n_bigint, r.n_double, r.n_string, r["odd'name"], r.s) for r in got.collect()}
            assert rows == {(None, 1, None, None, True, None), (None, None, 1.5, None, None, None), ("true", None, None, None, None, "[1]"), (None, None, None, "true", None, str(10**30)), (None,) * 6}
            assert got.count() == 5 and got.select("variant").distinct().count() == 5
        assert tables.supertype().count() == 5 * len(nested.LIST_FIELDS)
    assert tables.columns("none") == {} and {f"p1_{k}" for k in nested.LIST_FIELDS} <= set(problems.QUERIES)
    assert nested.route(nodes.limit(0)).supertype().count() == 0


@pytest.mark.parametrize("depth", [500, 100_000])
def test_bodies_of_any_depth(spark, depth):
    deep = "[" * depth + '{"pages": [{"u": "x", "inner": ' + '{"a":' * depth + "1" + "}" * depth + "}]}" + "]" * depth
    assert elements(spark, [("r", 1, '{"pages": {}}'), ("r", 2, deep), ("s", 1, deep[:-1])]) == {("r", "pages", "", "[0]" * depth + ".pages[0]")}
    assert nested.dumps(nested.parse(deep)) == deep.replace(" ", "")


def test_parser_with_a_stack_agrees(spark):
    """The parser for deep bodies against the plain one on sound and broken texts."""
    import random

    r = random.Random(3)
    texts = ['{"a": [1, -2.5e3, true, null, "x\\u00e9"], "b": {}}', "[]", "{}", "1", '"x"', " [1 , 2] ", "[1,]", '{"a":1,}', '{"a" 1}', '{1:2}', "[1 2]", "", "nul", "[1]]", "01", "-", '{"a":1 "b":2}', "NaN", "[1e999]"]
    for text in list(texts):
        texts += [text[:i] + r.choice('[]{},:"1a ') + text[i + r.randint(0, 1) :] for i in range(len(text))]
    for text in texts:
        out = []
        for f in (nested.parse, nested._parse_deep):
            try:
                out.append(f(text))
            except ValueError:
                out.append("broken")
        assert out[0] == out[1], text
    assert nested.parse("[" + "1" * 5000 + "]") == ["1" * 5000] and nested.parse("[1e999]") == ["1e999"]


def test_half_surrogates_and_explicit_nulls(spark):
    nodes = nodes_of(spark, '{"pages": [{"u": "\\ud800", "v": null}]}', '{"pages": [{"u": "{\\"a\\": 1}"}]}')
    assert sorted(str(r.own) for r in nodes.collect()) == ["{'u': 'j{\"a\": 1}'}", "{'u': 't\ufffd', 'v': None}"]


# 2

REFS = "ref_table string, ref_field string, target string, row_id string, key string, ref_time timestamp, created_at string"
TARGETS = "target string, key string, created_at timestamp, gone_at timestamp, n int"


@pytest.mark.parametrize("floor", [1, 10**9])
def test_orphans_heavy_and_light_agree(spark, floor):
    refs = [("o", "f", "a", f"r{i}", "hot", t(2025, 1 + i % 12, 1), "x") for i in range(40)] + [("o", "f", "a", "s1", "none", t(2025, 3, 1), "x"), ("o", "f", "a", "s1", "none", t(2025, 3, 1), "x"), ("o", "f", "a", "s2", None, t(2025, 3, 1), "x"), ("o", "f", "b", "s3", "hot", t(2025, 3, 1), "x"), ("o", "f", "a", "s4", "none", None, "x"), ("o", "f", "a", "s5", "kept", None, "x"), ("o", "f", "a", "s6", "kept", t(2025, 1, 1), "x"), ("o", "f", "a", "s7", "kept", t(2025, 2, 1), "x")]
    targets = [("a", "hot", t(2025, 3, 1), t(2025, 6, 1), 1), ("a", "kept", t(2025, 1, 1), t(2025, 2, 1), 1)]
    out = references.orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS), most=1000, floor=floor).collect()
    got = {(r.row_id, r.missing_id, r.reason, r.ref_month) for r in out}
    want = {(f"r{i}", "hot", "late" if i % 12 < 2 else "withdrawn", f"2025-{1 + i % 12:02d}") for i in range(40) if not 2 <= i % 12 < 5}
    assert got == want | {("s1", "none", "absent", "2025-03"), ("s3", "hot", "absent", "2025-03"), ("s4", "none", "absent", None), ("s7", "kept", "withdrawn", "2025-02")}
    assert len(out) == len(got)


def test_orphans_empty(spark):
    none, some = spark.createDataFrame([], REFS), spark.createDataFrame([], TARGETS)
    assert references.orphan_references(none, some).count() == 0
    one = spark.createDataFrame([("o", "f", "a", "r", "k", t(2025, 1, 1), "x")], REFS)
    assert [r.reason for r in references.orphan_references(one, some).collect()] == ["absent"]


# 3


def spans(spark, runs, shard=10, shards=4):
    df = spark.createDataFrame([(*r, "x") for r in runs], "entity string, start_us bigint, end_us bigint, unit string")
    return sorted((r.entity, r.kind, r.start_us, r.end_us) for r in intervals.periods_and_gaps(df, shard, shards).collect())


@pytest.mark.parametrize("seed", [4, 5, 6, 7])
def test_periods_against_plain_bits(spark, seed):
    """Runs within a shard, over shards, over blocks of shards; whole shards and blocks; touching at their borders."""
    import random

    r = random.Random(seed)
    runs = [(r.choice("abc"), a, a + r.choice([0, -3, 1, 2, 5, 10, 20, 30, 40, 80, 95])) for a in (r.choice([r.randint(-100, 250), 10 * r.randint(-10, 25), 40 * r.randint(-2, 6)]) for _ in range(30 + seed))]
    want = []
    for e in "abc":
        bits = {u for k, a, b in runs if k == e for u in range(a, b)}
        edges = [u for u in range(-200, 400) if (u in bits) != (u - 1 in bits)]
        periods = list(zip(edges[::2], edges[1::2]))
        want += [(e, "period", a, b) for a, b in periods] + [(e, "gap", p[1], q[0]) for p, q in zip(periods, periods[1:])]
    assert spans(spark, runs) == sorted(want)


def test_periods_edges(spark):
    assert spans(spark, []) == []
    assert spans(spark, [(None, 1, 2), ("a", None, 2), ("a", 5, 5), ("a", 7, 6), ("a", 1, None)]) == []
    assert spans(spark, [("a", 0, 10), ("a", 10, 20), ("a", 0, 10), ("a", 3, 4)]) == [("a", "period", 0, 20)]
    huge = [("a", -(1 << 62), 5), ("a", 5, 1 << 62), ("b", 3, 4)]
    assert spans(spark, huge, intervals.SHARD_US, intervals.SHARDS) == [("a", "period", -(1 << 62), 1 << 62), ("b", "period", 3, 4)]
    assert spans(spark, [("a", 0, 1), ("a", 10**15, 10**15 + 1)]) == [("a", "gap", 1, 10**15), ("a", "period", 0, 1), ("a", "period", 10**15, 10**15 + 1)]


def test_bitmaps_are_united_bit_by_bit():
    """encode, decode and union against sets of bits."""
    import random

    import numpy as np

    r = random.Random(1)
    sets = [{u for a in (r.randint(0, 50) for _ in range(r.randint(0, 6))) for u in range(a, a + r.randint(1, 9))} for _ in range(12)]

    def runs(bits):
        edges = [u for u in range(0, 80) if (u in bits) != (u - 1 in bits)]
        return np.array(edges[::2], dtype=np.int64), np.array(edges[1::2], dtype=np.int64)

    maps = [intervals.encode(*runs(s)) for s in sets]
    of, a, b = intervals.decode(maps)
    assert [{u for k, x, y in zip(of, a, b) if k == i for u in range(x, y)} for i in range(12)] == sets
    group, a, b = intervals.union(of // 3, a, b)
    got = [{u for k, x, y in zip(group, a, b) if k == i for u in range(x, y)} for i in range(4)]
    assert got == [sets[i] | sets[i + 1] | sets[i + 2] for i in range(0, 12, 3)] and len(a) == sum(len(runs(s)[0]) for s in got)


def test_bitmaps_of_one_key_over_many_batches(spark):
    """A hot entity whose bitmaps come in many batches, each united with the one before."""
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        runs = spark.range(600).selectExpr("if(id % 3 = 0, 'hot', concat('e', id % 5)) as entity", "id * 7 % 400 as start_us", "id * 7 % 400 + 1 + id % 2 as end_us").repartition(5)
        bits = {}
        for r in runs.collect():
            bits.setdefault(r.entity, set()).update(range(r.start_us, r.end_us))
        maps = intervals.unite(intervals.run_bitmaps(runs, 1000, 4, held=10))
        rows = maps.collect()
        assert sorted(r.entity for r in rows) == sorted(bits)
        got = intervals.set_and_clear_runs(maps, 1000, 4).where("kind = 'period'").collect()
        assert {e: {u for r in got if r.entity == e for u in range(r.start_us, r.end_us)} for e in bits} == bits
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


# 4


def tree(spark, edges):
    df = spark.createDataFrame([(n, p, 0) for n, p in edges], "node string, parent string, depth int")
    return {r.node: (r.node_kind, r.root, r.node_depth, "/".join(r.path)) for r in hierarchy.hierarchy(df).collect()}


def plain_tree(edges):
    parent = {n: p for n, p in edges if n is not None}
    out = {}
    for n in parent:
        path, at = [n], parent[n]
        while at in parent and at not in path:
            path.append(at)
            at = parent[at]
        if at == n:
            out[n] = ("cycle", n, 0, n)
        elif at in parent:
            loop = path[path.index(at) :]
            path = path[: path.index(at) + 1]
            assert loop
            out[n] = ("below", path[-1], len(path) - 1, "/".join(reversed(path)))
        else:
            out[n] = ("tree", path[-1], len(path) - 1, "/".join(reversed(path)))
    return out


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), (None, "a")],
        [("a", "a"), ("b", "a"), ("c", "b")],
        [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", "d"), ("f", "e"), ("g", "f"), ("h", "g"), ("r", None)],
        [(f"n{i}", f"n{i - 1}" if i else None) for i in range(40)],
        [("x0", "x6"), *[(f"x{i}", f"x{i - 1}") for i in range(1, 7)], *[(f"y{i}", f"y{i - 1}" if i else "x3") for i in range(20)]],
        [*[(f"n{i}", f"n{(i * 7919) % i}" if i else None) for i in range(120)], *[(f"c{i}", f"c{(i + 1) % 5}") for i in range(5)], *[(f"d{i}", f"d{i // 2}" if i > 1 else "c3") for i in range(1, 60)]],
        [("hub", None), *[(f"s{i}", "hub") for i in range(60)], *[(f"t{i}", f"s{i}") for i in range(60)]],
    ],
)
def test_hierarchy(spark, edges):
    assert tree(spark, edges) == plain_tree(edges)


def test_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "node string, parent string")
    out = hierarchy.hierarchy(df)
    slash = hierarchy.hierarchy(spark.createDataFrame([("a/b", None), ("c", "a/b"), ("a", "c"), ("b", "b")], "node string, parent string"))
    assert {(r.node, r.root, tuple(r.path)) for r in slash.collect()} == {("a/b", "a/b", ("a/b",)), ("c", "a/b", ("a/b", "c")), ("a", "a/b", ("a/b", "c", "a")), ("b", "b", ("b",))}
    assert {(r.ancestor, r.node, r.distance) for r in hierarchy.descendants(slash).collect()} == {("a/b", "c", 1), ("c", "a", 1), ("a/b", "a", 2)}
    assert {(r.ancestor, r.node, r.distance) for r in hierarchy.descendants(out).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}
    assert {(r.ancestor, r.n_descendants, r.height) for r in hierarchy.descendant_counts(out).collect()} == {("a", 3, 2), ("b", 1, 1)}


def test_hot_parent_is_salted(spark):
    from ledgerline.functions.ids import heavy_keys, skew_join

    left = spark.range(1000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("7", 2)], "rk string, v int")
    heavy = heavy_keys(left, ["k"], 1000, 10, 50)
    assert [r[0] for r in heavy] == ["hot"]
    salted, plain = skew_join(left, right, "k", "rk", heavy, "left", 50), left.join(right, left["k"] == right["rk"], "left")
    assert salted.columns == plain.columns and sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


# 5


def event(seq, kind, entity, payload, event_id=None, spoil=False):
    import hashlib

    body = payload if isinstance(payload, str) or payload is None else json.dumps(payload)
    return (seq, event_id or f"e{seq}", kind, entity, t(2025, 1, 1), body, "0" * 64 if spoil or body is None else hashlib.sha256(body.encode()).hexdigest(), "x")


EVENTS = "sequence bigint, event_id string, event_type string, entity_id string, occurred_at timestamp, payload_json string, payload_hash string, change string"


def state(spark, events):
    return {(r.entity_id, r.field_name, r.sequence, r.value) for r in changes.ledger_state(spark.createDataFrame(events, EVENTS)).collect()}


def test_changes(spark):
    events = [
        event(1, "FINDING_CLOSED", "f", {"early": 1}),
        event(2, "FINDING_OPENED", " F ", {"a": 1, "b": None, "c": {"d": [1]}}),
        event(3, "FINDING_CLOSED", "f", {"a": 2}),
        event(3, "FINDING_CLOSED", "f", {"a": 2}),
        event(4, "FINDING_CLOSED", "f", {"a": 99}, spoil=True),
        event(9, "FINDING_CLOSED", "f", {"a": 7}, event_id="E3 "),
        event(5, "OBSERVATION_ADDED", "f", {"z": 1}),
        event(6, "ASSET_REGISTERED", "g", {"p": "old", "q": 1}),
        event(7, "ASSET_WITHDRAWN", "g", {}),
        event(8, "ASSET_CHANGED", "g", {"p": "lost"}),
        event(10, "ASSET_REGISTERED", "g", {"p": "new"}),
        event(11, "JOB_ENQUEUED", "j", {"k": 1}),
        event(12, "JOB_WITHDRAWN", "j", {}),
        event(13, "JOB_ENQUEUED", "l", "[1]"),
        event(14, "JOB_ENQUEUED", None, {"k": 1}),
        event(15, "JOB_ENQUEUED", "m", None),
    ]
    want = {("f", "a", 3, "2"), ("f", "b", 2, None), ("f", "c", 2, '{"d":[1]}'), ("g", "p", 10, "new")}
    assert state(spark, events) == want
    assert state(spark, events[::-1]) == want
    assert state(spark, []) == set()


def test_changes_fold_in_any_batches(spark):
    events = [event(i, ["ASSET_REGISTERED", "ASSET_CHANGED", "ASSET_WITHDRAWN", "ASSET_CHANGED"][i * 7 % 4], "abc"[i % 3], {f"f{i % 5}": i}) for i in range(60)]
    want = state(spark, events)
    facts = lambda rows: changes.change_facts(changes.sound_events(spark.createDataFrame(rows, EVENTS)))
    base = changes.fold_changes(facts(events[1::2]))
    base = changes.fold_changes(facts(events[1::2][:5]), base)  # repeated
    late = changes.fold_changes(facts(events[::2]), base)
    assert {(r.entity_id, r.field_name, r.sequence, r.value) for r in changes.current_fields(late).collect()} == want


def test_stream_equals_batch(spark, tmp_path):
    from ledgerline.streaming import ledger

    events = [event(i, ["ASSET_REGISTERED", "ASSET_CHANGED", "ASSET_WITHDRAWN", "ASSET_CHANGED"][i * 7 % 4], "abc"[i % 3], {f"f{i % 5}": i}) for i in range(60)]
    spark.createDataFrame(events, EVENTS).repartition(4).write.parquet(str(tmp_path / "in"))
    ledger.fold_stream(ledger.read_events(spark, str(tmp_path / "in"), 1), str(tmp_path / "state"), str(tmp_path / "ck"), 2)
    got = changes.current_fields(ledger.newest_state(spark, str(tmp_path / "state")))
    assert {(r.entity_id, r.field_name, r.sequence, r.value) for r in got.collect()} == state(spark, events)


def test_repeats_are_settled_across_batches(spark, tmp_path):
    """event_ids sent again with another sequence, the winner first or last; what a loser had hidden counts again."""
    from ledgerline.streaming import ledger

    first = [event(1, "ASSET_REGISTERED", "a", {"x": 1}), event(5, "ASSET_CHANGED", "a", {"x": 5}), event(10, "ASSET_CHANGED", "a", {"x": 10}, "twice"), event(2, "ASSET_REGISTERED", "b", {"y": 1}), event(9, "ASSET_WITHDRAWN", "b", {}, "gone"), event(3, "ASSET_CHANGED", "a", {"z": 3}, "early")]
    second = [event(4, "ASSET_CHANGED", "a", {"x": 10}, " TWICE"), event(1, "ASSET_WITHDRAWN", "b", {}, "gone"), event(8, "ASSET_CHANGED", "a", {"z": 8}, "early"), event(2, "ASSET_CHANGED", None, {"x": 0}, "early")]
    want = {("a", "x", 5, "5"), ("b", "y", 2, "1")}
    assert state(spark, first + second) == want
    table = lambda rows: spark.createDataFrame(rows, EVENTS)
    for one, two in ((first, second), (second, first)):
        got = changes.ledger_state(table(two), changes.settled_events(table(one)))
        assert {(r.entity_id, r.field_name, r.sequence, r.value) for r in got.collect()} == want
    for n in range(4):  # each event in a file of its own batch
        for e in (first + second)[n::4]:
            table([e]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ledger.fold_stream(ledger.read_events(spark, str(tmp_path / "in"), 1), str(tmp_path / "state"), str(tmp_path / "ck"), 2)
    assert sorted(p.name for p in (tmp_path / "state").glob("level=*/upto=*")) == ["upto=7", "upto=8", "upto=9"]  # 10 batches, eight of them merged
    got = changes.current_fields(ledger.newest_state(spark, str(tmp_path / "state")))
    assert {(r.entity_id, r.field_name, r.sequence, r.value) for r in got.collect()} == want


def test_any_split_order_and_repetition_gives_one_state(spark):
    """Random feeds with event_ids sent again under other sequences, cut into batches in random order, some twice."""
    import random

    for seed in range(4):
        r = random.Random(seed)
        kinds = ["ASSET_REGISTERED", "ASSET_CHANGED", "ASSET_WITHDRAWN", "OBSERVATION_ADDED"]
        feed = [event(i, r.choice(kinds), r.choice("abcd"), {f"f{r.randrange(3)}": i}, f"id{r.randrange(25)}") for i in range(40)]
        want = state(spark, feed)
        batches, base = [[] for _ in range(3)], None
        for e in r.sample(feed, len(feed)) + r.sample(feed, 8):
            r.choice(batches).append(e)
        for b in [*batches, batches[0]]:
            base = changes.settled_events(spark.createDataFrame(b, EVENTS), base)
        got = changes.current_fields(changes.fold_changes(changes.change_facts(changes.named_events(base))))
        assert {(x.entity_id, x.field_name, x.sequence, x.value) for x in got.collect()} == want
