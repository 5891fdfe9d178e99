"""Queries of the closure evidence, caps, summaries and remaining text rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W, functions as F

from ledgerline.functions.ids import norm_id
from ledgerline.functions import namespaces as N, patterns as P, text as X
from ledgerline.operators import closure, content as C, parsers as R
from ledgerline.plans import problems, structures
from ledgerline.plans.common import CAPTURES, FIELDS, PLAIN, sql
from ledgerline.plans.relational import I
from ledgerline.sources.shared import table

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return keep


@query(
    "ref_ST3_F30_closure_evidence",
    f"""WITH a AS (SELECT {I('asset_id')} AS a_id, coalesce(max(binding_changed_at), TIMESTAMPTZ '1970-01-01 00:00:00+00') AS changed, list_distinct(list_prepend('__asset__', coalesce(any_value(required_aliases), []))) AS keys, any_value(alias_bindings) AS bindings, any_value(target_id) AS own_target, any_value(policy_id) AS own_policy FROM assets GROUP BY 1),
f AS (SELECT {I('finding_id')} AS finding_id, {I('asset_id')} AS asset_id, max(remediation_at) AS remediation_at FROM findings WHERE remediation_at IS NOT NULL GROUP BY 1, 2),
need AS (SELECT finding_id, a_id, greatest(remediation_at, changed) AS floor_at, unnest(keys) AS k, bindings, own_target, own_policy FROM f JOIN a ON f.asset_id = a.a_id),
o AS (SELECT {I('asset_id')} AS asset_id, coalesce(alias_id, '__asset__') AS k, * EXCLUDE (asset_id) FROM observations),
last AS (SELECT * FROM (SELECT n.finding_id, n.k AS nk, CASE WHEN n.k = '__asset__' THEN own_target ELSE map_extract(bindings, n.k)[1] END AS want_target, own_policy AS want_policy, o.*, rank() OVER (PARTITION BY n.finding_id, n.k ORDER BY observed_at DESC) AS r FROM need n JOIN o ON n.a_id = o.asset_id AND n.k = o.k AND o.observed_at > n.floor_at) WHERE r = 1),
keys AS (SELECT finding_id, nk, count(DISTINCT access || '|' || content) > 1 AS conflict, bool_and(coalesce(access IN ('ACCESS_DENIED_OBSERVED', 'AUTH_REDIRECT_OBSERVED', 'NOT_FOUND_OBSERVED') AND content IN ('NOT_INSPECTED', 'PUBLIC_UI') AND capture_complete AND expected_policy AND control_healthy AND coalesce(reason_code, '') = '' AND policy_evidence_ref <> '' AND control_evidence_ref <> '' AND policy_evidence_ref IS DISTINCT FROM evidence_ref AND control_evidence_ref IS DISTINCT FROM evidence_ref AND policy_evidence_ref <> control_evidence_ref AND target_id IS NOT DISTINCT FROM want_target AND policy_id IS NOT DISTINCT FROM want_policy, false)) AS good FROM last GROUP BY 1, 2)
SELECT n.finding_id, n.required, coalesce(observed, 0) AS observed, coalesce(conflicting, 0) AS conflicting, coalesce(p, 0) = n.required AS proven FROM (SELECT finding_id, count(*) AS required FROM need GROUP BY 1) n LEFT JOIN (SELECT finding_id, count(*) AS observed, count(*) FILTER (conflict) AS conflicting, count(*) FILTER (good AND NOT conflict) AS p FROM keys GROUP BY 1) k ON n.finding_id = k.finding_id""",
)
def st3(s, d):
    return closure.closure_evidence(table(s, d, "findings"), table(s, d, "assets"), table(s, d, "observations"))


@query("ref_F11_canaries", f"SELECT id, sha256(regexp_extract(body, 'SYNTHETIC_CANARY_[A-Za-z0-9_]+')) AS marker_digest FROM ({PLAIN}) WHERE contains(body, 'SYNTHETIC_CANARY_')")
def f11(s, d):
    return sql(s, d, PLAIN).where(F.contains("body", F.lit("SYNTHETIC_CANARY_"))).select("id", F.sha2(F.regexp_extract("body", "SYNTHETIC_CANARY_[A-Za-z0-9_]+", 0), 256).alias("marker_digest"))


@query("ref_F15_F16_filled", f"SELECT field, count(*) FILTER (value IS NOT NULL AND value <> '') AS filled, count(*) FILTER (value IS NOT NULL AND value <> '' AND NOT regexp_full_match(lower(value), '\\s*(?:example|sample|placeholder|dummy|test|[-_]+|\\{{\\{{.*\\}}\\}})\\s*')) AS substantive FROM ({FIELDS}) GROUP BY 1")
def f15(s, d):
    filled = F.coalesce(F.col("value") != "", F.lit(False))
    return sql(s, d, FIELDS).groupBy("field").agg(F.count_if(filled).alias("filled"), F.count_if(filled & ~F.col("value").rlike(P.java(f"^(?:{P.EXAMPLE})$", True))).alias("substantive"))


@query("ref_F18_amounts", f"SELECT content_type, CAST(sum(len(regexp_extract_all(body, '(?i){P.AMOUNT}'))) AS BIGINT) AS amounts FROM ({CAPTURES}) WHERE body IS NOT NULL GROUP BY 1")
def f18(s, d):
    return sql(s, d, CAPTURES).where("body is not null").groupBy("content_type").agg(F.sum(F.regexp_count("body", F.lit(P.java(P.AMOUNT, True)))).cast("bigint").alias("amounts"))


@query("ref_F19_gate_words", "SELECT source, " + ", ".join(f"count(*) FILTER (regexp_matches(text, '(?i){p}')) AS {k}" for k, p in C.GATE_WORDS.items()) + " FROM documents WHERE text IS NOT NULL GROUP BY 1")
def f19(s, d):
    return table(s, d, "documents").where("text is not null").groupBy("source").agg(*[F.count_if(X.has("text", p, True)).alias(k) for k, p in C.GATE_WORDS.items()])


_HOSTS = "SELECT c_custkey AS id, CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'nodot' WHEN 1 THEN concat('a', CAST(c_custkey AS STRING), '.test') WHEN 2 THEN '-bad.test' WHEN 3 THEN 'a..test' ELSE 'x_y.test' END AS host FROM customer"


@query("ref_F26_domains", f"SELECT id, regexp_full_match(host, '(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\\.)+[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?') AS valid FROM ({_HOSTS})")
def f26(s, d):
    label = N.NAME_RULES["dns_label"][0].strip("^$")
    return sql(s, d, _HOSTS).select("id", F.col("host").rlike(rf"^(?:{label}\.)+{label}$").alias("valid"))


@query("ref_C17_C18_record_signals", "SELECT c_custkey AS id, 'SENSITIVE_FIELD_NAMES SENSITIVE_VALUES_CANDIDATE CONTACT_VALUE_CANDIDATE' AS codes FROM customer")
def c17(s, d):
    c = R.field_counters(R.json_nodes(sql(s, d, structures._JS)))
    rules = [("SENSITIVE_FIELD_NAMES", F.col("known_sensitive") > 0), ("SENSITIVE_VALUES_CANDIDATE", F.col("filled_sensitive") > 0), ("CONTACT_VALUE_CANDIDATE", F.col("contacts") > 0)]
    return c.select("id", F.array_join(F.array_compact(F.array(*[F.when(r, F.lit(k)) for k, r in rules])), " ").alias("codes"))


@query("ref_C26_limit_flags", "SELECT doc_kind, count(*) FILTER (octet_length(encode(text)) > 4096) AS partial, count(*) AS bodies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def c26(s, d):
    return table(s, d, "documents").where("text is not null").groupBy("doc_kind").agg(F.count_if(F.octet_length("text") > 4096).alias("partial"), F.count("*").alias("bodies"))


@query("ref_A19_signal_sums", f"SELECT code, CAST(sum(occurrences_bigint) AS BIGINT) AS occurrences, count(*) AS n FROM ({problems.ORACLE['p1_signals']}) GROUP BY 1")
def a19(s, d):
    """Occurrences by signal code over all nested reports, through the typed table of signals."""
    return problems.p1_typed(s, d, "signals").groupBy("code").agg(F.sum("occurrences_bigint").cast("bigint").alias("occurrences"), F.count("*").alias("n"))


@query("ref_A24_versions", "SELECT json_extract_string(report_json, '$.classifier_version') AS version, count(*) AS n FROM audit_results WHERE json_valid(report_json) GROUP BY 1")
def a24(s, d):
    return table(s, d, "audit_results").where(F.try_parse_json("report_json").isNotNull()).groupBy(N.at_pointer("report_json", "/classifier_version").alias("version")).agg(F.count("*").alias("n"))


@query("ref_S13_two_caps", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3 ORDER BY l_orderkey, l_linenumber LIMIT 50")
def s13(s, d):
    """At most 3 rows of each group and 50 in all, by arrival: the caps are the feature."""
    r = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber"))
    return table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", r.alias("r")).where("r <= 3").drop("r").orderBy("l_orderkey", "l_linenumber").limit(50)


@query("ref_S17_commit_lists", "SELECT l_orderkey AS id, count(DISTINCT l_partkey) FILTER (l_linenumber % 4 <> 0) AS commits, count(*) FILTER (l_linenumber % 4 = 0) AS rejected FROM lineitem GROUP BY 1")
def s17(s, d):
    """Commit ids of a history page as JSON: 40 hex digits, each once; others are counted as rejected."""
    sha = F.when(F.col("l_linenumber") % 4 == 0, "short").otherwise(F.sha1(F.col("l_partkey").cast("string")))
    pages = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.to_json(F.collect_list(F.struct(sha.alias("sha")))).alias("body"))
    rows = pages.select("id", F.explode(F.from_json("body", "array<struct<sha:string>>")).alias("c")).select("id", F.when(F.col("c.sha").rlike("^[0-9a-f]{40}$"), F.col("c.sha")).alias("sha"))
    return rows.groupBy("id").agg(F.countDistinct("sha").alias("commits"), F.count_if(F.col("sha").isNull()).alias("rejected"))


_LAST_STATES = f"(SELECT state FROM (SELECT state, row_number() OVER (PARTITION BY {I('job_id')} ORDER BY updated_at DESC, state DESC) AS r FROM audit_jobs WHERE {I('job_id')} IS NOT NULL) WHERE r = 1)"


@query("ref_K4_summary", f"SELECT 'jobs' AS section, state AS item, count(*) AS n FROM {_LAST_STATES} GROUP BY 2 UNION ALL SELECT 'findings', status, count(*) FROM (SELECT DISTINCT {I('finding_id')}, status FROM findings) GROUP BY 2 UNION ALL SELECT 'runs', coalesce(reason, 'running'), count(*) FROM (SELECT DISTINCT {I('run_id')}, reason FROM audit_runs) GROUP BY 2 UNION ALL SELECT 'channels', state, count(*) FROM ({problems.ORACLE['p1_channels']}) GROUP BY 2 UNION ALL SELECT 'signals', code, count(*) FROM ({problems.ORACLE['p1_signals']}) GROUP BY 2 UNION ALL SELECT 'documents', doc_kind, count(*) FROM documents GROUP BY 2")
def k4(s, d):
    """The report without values: how many of what there is, section by section."""
    from ledgerline.operators.references import latest_jobs

    channels, signals = problems.typed(s, d, "channels", "signals")
    parts = {"jobs": latest_jobs(table(s, d, "audit_jobs"), "state").select("state"), "findings": table(s, d, "findings").select(norm_id("finding_id").alias("k"), "status").distinct().select("status"), "runs": table(s, d, "audit_runs").select(norm_id("run_id").alias("k"), "reason").distinct().select(F.coalesce("reason", F.lit("running"))), "channels": channels.select("state"), "signals": signals.select("code"), "documents": table(s, d, "documents").select("doc_kind")}
    rows = [df.toDF("item").groupBy("item").agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "item", "n") for section, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


_TOP = "(SELECT job_id FROM found ORDER BY job_id LIMIT 100)"


@query("ref_S7_manifest_closure", problems._P4 + f"SELECT DISTINCT unnest(path) AS job_id FROM found WHERE job_id IN {_TOP}")
def s7(s, d):
    """The first 100 entries of a manifest with all their parents: the cap is the feature."""
    return problems._tree(s, d).orderBy("node").limit(100).select(F.explode("path").alias("job_id")).distinct()


@query("ref_N4_search_queries", f"SELECT DISTINCT name, q FROM (SELECT name, name AS q FROM ({structures._NAMES}) UNION ALL SELECT name, string_split_regex(name, '[^a-z0-9]+')[1] || ' ' || f FROM ({structures._NAMES}), (VALUES ('sales'), ('admin')) v(f))")
def n4(s, d):
    names = sql(s, d, structures._NAMES)
    first = F.get(F.split("name", "[^a-z0-9]+"), F.lit(0))
    return names.select("name", F.explode(F.array("name", *[F.concat(first, F.lit(f" {f}")) for f in ("sales", "admin")])).alias("q")).distinct()


#: Reason codes by class of a recorded failure. Fixed values.
REASONS = {"timeout": "timeout", "refused": "connection_refused", "reset": "connection_reset", "dns": "dns_failure", "tls": "tls_error"}
_FAIL = "SELECT l_orderkey AS id, CASE CAST(l_partkey % 7 AS INT) WHEN 0 THEN 'timeout' WHEN 1 THEN 'refused' WHEN 2 THEN 'reset' WHEN 3 THEN 'dns' WHEN 4 THEN 'tls' WHEN 5 THEN NULL ELSE 'odd' END AS failure FROM lineitem"


@query("ref_P25_reason_codes", f"SELECT CASE {' '.join(f'WHEN failure = {k!r} THEN {v!r}' for k, v in REASONS.items())} ELSE 'transport_error' END AS reason, count(*) AS n FROM ({_FAIL}) GROUP BY 1")
def p25(s, d):
    """A fixed lookup as a map literal: no join."""
    codes = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return sql(s, d, _FAIL).groupBy(F.coalesce(F.try_element_at(codes, F.col("failure")), F.lit("transport_error")).alias("reason")).agg(F.count("*").alias("n"))


_MAGIC = "SELECT p_partkey AS id, concat('f', CASE CAST(p_size % 5 AS INT) WHEN 0 THEN '.svg' WHEN 1 THEN '.txt' WHEN 2 THEN '.pdf' WHEN 3 THEN '.JPG' ELSE '' END) AS name, CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN '89504e470d0a1a0a00' WHEN 1 THEN '47494638396100' WHEN 2 THEN '504b030414' WHEN 3 THEN '68650078' WHEN 4 THEN '203c7376672078' ELSE '68656c6c6f' END AS head FROM part"


@query("ref_C36_file_routing", f"SELECT id, CASE WHEN ends_with(name, '.JPG') OR starts_with(head, '89504e470d0a1a0a') OR starts_with(head, '474946383961') THEN 'image' WHEN ends_with(name, '.pdf') OR starts_with(head, '504b0304') OR head = '68650078' THEN 'unsupported_binary' WHEN ends_with(name, '.svg') OR head = '203c7376672078' THEN 'svg' ELSE 'text' END AS route FROM ({_MAGIC})")
def c36(s, d):
    from ledgerline.operators.revisions import file_route

    return sql(s, d, _MAGIC).select("id", file_route("name", F.unhex("head")).alias("route"))


@query("ref_K5_evidence_manifest", "SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL")
def k5(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"))


@query("ref_N6_reconcile", "SELECT o_custkey % 3000 AS work_id, count(*) AS n FROM orders WHERE o_custkey % 3000 NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1")
def n6(s, d):
    """Generated work that no earlier plan has: an anti join of the distinct work ids."""
    made = table(s, d, "orders").groupBy((F.col("o_custkey") % 3000).alias("work_id")).agg(F.count("*").alias("n"))
    return made.join(table(s, d, "customer").where("c_custkey % 2 = 0"), F.col("work_id") == F.col("c_custkey"), "left_anti")


@query("ref_ST13_once_per_digest", "SELECT sha256(props) AS digest, count(*) AS uses, CAST(json_extract(any_value(props), '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props) GROUP BY 1")
def st13(s, d):
    """Costly work once per distinct content: values are made distinct by digest before they are parsed."""
    once = table(s, d, "events").where("props is not null").groupBy(F.sha2("props", 256).alias("digest")).agg(F.count("*").alias("uses"), F.min("props").alias("props"))
    return once.where(F.try_parse_json("props").isNotNull()).select("digest", "uses", N.at_pointer("props", "/k", "bigint").alias("k"))


# SQL for queries of other modules
_FIT = "acc.r + x.r <= 500 AND acc.b + x.b <= 100000"
ORACLE["ref_ST6_reservations"] = f"""SELECT user_id, v.r AS requests, v.b AS bytes, v.a AS accepted, v.j AS rejected FROM (SELECT user_id, list_reduce(list_prepend(struct_pack(r := 0::BIGINT, b := 0::BIGINT, a := 0::BIGINT, j := 0::BIGINT), list(struct_pack(r := (event_id % 50)::BIGINT, b := event_id::BIGINT, a := 0::BIGINT, j := 0::BIGINT) ORDER BY ts, event_id)),
 lambda acc, x: struct_pack(r := acc.r + CASE WHEN {_FIT} THEN x.r ELSE 0 END, b := acc.b + CASE WHEN {_FIT} THEN x.b ELSE 0 END, a := acc.a + CASE WHEN {_FIT} THEN 1 ELSE 0 END, j := acc.j + CASE WHEN {_FIT} THEN 0 ELSE 1 END)) AS v FROM events GROUP BY 1)"""
ORACLE["ref_N3_word_prefixes"] = f"""WITH n AS (SELECT name, regexp_extract_all(name, '[a-z0-9]+') AS w FROM ({structures._NAMES})), p AS (SELECT name, w[1:k] AS p FROM (SELECT name, w, unnest(range(2, least(len(w), 5))) AS k FROM n WHERE len(w) >= 3)),
b AS (SELECT name, p, replace(array_to_string(p, '|'), '|', sep) AS base FROM p, (VALUES (''), ('-'), ('_')) s(sep) WHERE length(array_to_string(p, '')) >= 4)
SELECT DISTINCT name, base || j || r AS candidate FROM b, (VALUES ('', ''), ('', 'sales'), ('-', 'sales'), ('_', 'sales'), ('', 'admin'), ('-', 'admin'), ('_', 'admin'), ('', 'dev'), ('-', 'dev'), ('_', 'dev')) v(j, r) WHERE NOT list_contains(p, r) AND length(base || j || r) BETWEEN 2 AND 39"""
ORACLE["ref_N2_W11_candidates"] = f"""WITH st AS ({structures.ORACLE['ref_N1_stems']}), m AS (SELECT name, stem AS c, weight, 0 AS rnd, 0 AS j FROM st UNION ALL SELECT name, stem || joiner || word, weight, no + 1, jn FROM st, (VALUES ('sales', 0), ('partners', 1), ('dashboard', 2), ('dev', 3), ('admin', 4), ('team', 5), ('data', 6), ('api', 7)) w(word, no), (VALUES ('', 0), ('-', 1), ('_', 2)) q(joiner, jn) WHERE why <> 'initialism' AND NOT contains(stem, word) AND NOT contains(word, stem)),
best AS (SELECT name, c, min((weight, rnd, j)) AS r FROM m WHERE length(c) BETWEEN 2 AND 39 GROUP BY 1, 2), rk AS (SELECT name, c, r, row_number() OVER (PARTITION BY name ORDER BY r, length(c), c) AS n FROM best), rs AS (SELECT *, n > 60 AND r[2] = 0 AS reserved, sum(CASE WHEN n > 60 AND r[2] = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY name) AS held FROM rk)
SELECT name, c AS candidate, row_number() OVER (PARTITION BY name ORDER BY r, length(c), c) AS position FROM rs WHERE reserved OR n <= 60 - held"""


@query("ref_C1_C26_analysis")
def analysis(s, d):
    """The whole analysis of every document and vector; signals as their codes."""
    from ledgerline.operators.analysis import analyze

    found = analyze(sql(s, d, CAPTURES).withColumn("base_url", F.lit("https://app.example.test/")))
    return found.select("id", F.transform("signals", lambda x: x["code"]).alias("codes"), "content", "analysis_complete", "pending_reviews", "hidden_elements", "password_inputs", "script_elements", "kind_hint", "linked_candidates", "reasons")


_PLAIN_CODES = {
    "PRIVATE_KEY_CANDIDATE": ("-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", ""), "SERVER_SECRET_CANDIDATE": ("sb_secret_[A-Za-z0-9_-]{12,}", ""), "PUBLISHABLE_KEY_PRESENT": ("sb_publishable_", ""),
    "UNTRUSTED_INSTRUCTION_TEXT": (P.UNTRUSTED, "i"), "CLIENT_ENCRYPTION_INDICATOR": (P.ENCRYPTION, "i"), "CHALLENGE_PAGE_INDICATOR": (P.CHALLENGE, "i"), "SYNTHETIC_CANARY_PRESENT": ("SYNTHETIC_CANARY_", ""),
}


@query("ref_C3_C24_analysis_by_type", "SELECT content_type, code, count(*) AS n FROM (SELECT content_type, unnest([" + ", ".join(f"CASE WHEN regexp_matches(body, '{p}', '{o or 'c'}') THEN '{c}' END" for c, (p, o) in _PLAIN_CODES.items()) + f"]) AS code FROM ({CAPTURES})) WHERE code IS NOT NULL GROUP BY 1, 2")
def analysis_by_type(s, d):
    """Signals that depend on the raw body alone, of all captures, counted by type; the others are left to the tests."""
    from ledgerline.operators.analysis import analyze

    rows = sql(s, d, CAPTURES)
    found = analyze(rows)
    codes = found.select("id", F.explode(F.transform("signals", lambda x: x["code"])).alias("code")).where(F.col("code").isin(list(_PLAIN_CODES)))
    return codes.join(rows.select("id", "content_type"), "id").groupBy("content_type", "code").agg(F.count(F.lit(1)).alias("n"))


@query("ref_C30_semantic_review", "SELECT c_custkey AS id, 'json' AS document_type, true AS syntax_valid, CAST(4 AS BIGINT) AS sensitive_fields, CAST(CASE WHEN c_custkey % 4 IN (2, 3) THEN 3 ELSE 2 END AS BIGINT) AS sensitive_filled FROM customer")
def semantic(s, d):
    """Sensitive fields of JSON bodies through the semantic review; the other types are tested by vectors."""
    from ledgerline.operators.analysis import semantic_review

    found = semantic_review(sql(s, d, structures._JS).withColumn("content_type", F.lit("application/json")))
    return found.select("id", "document_type", "syntax_valid", "sensitive_fields", "sensitive_filled")


@query("ref_C27_C14_page_profiles")
def page_profiles(s, d):
    """Data categories of every capture with what speaks for them, by count of evidence."""
    from ledgerline.operators.analysis import analyze

    rows = analyze(sql(s, d, CAPTURES)).select("id", "kind_hint", F.explode("categories").alias("c")).select("id", "kind_hint", "c.*")
    return rows.select("id", "kind_hint", "category", "candidates", "filled", F.array_join("bases", ",").alias("bases"), F.when(F.size("bases") > 1, "medium").otherwise("low").alias("confidence"))
