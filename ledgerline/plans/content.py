"""Queries of content reviews, name rules and remaining relational operators."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ledgerline.functions import namespaces as N
from ledgerline.operators import content as C, joins as J, parsers as R, signals as S
from ledgerline.plans import problems
from ledgerline.plans.common import CAPTURES, CREDENTIAL_SQL, FIELDS, PLAIN, URLS, sql
from ledgerline.plans.structures import _JS, _MADE_PAGES, _PAGES, _PATHS_JSON
from ledgerline.sources.shared import table

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return keep


@query("ref_P4_canonical_url", f"SELECT id, CASE WHEN regexp_matches(url, '^(?i:https)://') AND NOT contains(url, '#') AND NOT contains(url, '@') AND len(list_filter(list_transform(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: url_decode(split_part(x, '=', 1))), lambda k: {CREDENTIAL_SQL})) = 0 THEN 'https://' || lower(regexp_extract(url, '://([^/:?#]+)', 1)) || CASE WHEN regexp_extract(url, '://[^/:?#]+:([0-9]+)', 1) IN ('', '443') THEN '' ELSE ':' || regexp_extract(url, '://[^/:?#]+:([0-9]+)', 1) END || CASE WHEN regexp_extract(url, '://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]+([^?#]*)', 1) END || CASE WHEN contains(url, '?') THEN '?' || regexp_extract(url, '\\?([^#]*)', 1) ELSE '' END END AS canonical FROM ({URLS})")
def p4(s, d):
    return sql(s, d, URLS).select("id", N.canonical_url("url").alias("canonical"))


_HDR = "SELECT o_orderkey AS id, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN concat('<https://x.test/l?page=', CAST(o_custkey AS STRING), '>; rel=\"next\", <https://x.test/l?page=9>; rel=\"last\"') WHEN 2 THEN '<https://x.test/a>; rel=\"next\", <https://x.test/b>; rel=\"next\"' ELSE '<https://x.test/a>; rel=\"prev\"' END AS header FROM orders"


@query("ref_P6_next_page", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 1 THEN 'https://x.test/l?page=' || CAST(o_custkey AS STRING) END AS next_url FROM orders")
def p6(s, d):
    return sql(s, d, _HDR).select("id", N.next_page("header").alias("next_url"))


@query("ref_P13_redact_mapping", "SELECT c_custkey AS id, '{\"customer_name\": \"[REDACTED_FIELD]\", \"salary\": 0, \"list\": [{\"email\": \"[REDACTED_FIELD]\"}, {\"phone\": \"[REDACTED_FIELD]\"}], \"note\": false}' AS redacted FROM customer")
def p13(s, d):
    return C.redacted_json(sql(s, d, _JS))


_ARMS = " ".join(f"WHEN list_has_any(w, {v!r}) THEN '{k}'" for k, v in C.FIRST_CATEGORIES.items())


@query("ref_P16_first_category", f"SELECT field, CASE {_ARMS} END AS category, count(*) AS n FROM (SELECT field, regexp_extract_all(lower(regexp_replace(field, '([a-z])([A-Z])', '\\1_\\2', 'g')), '[a-z]+|[가-힣]+') AS w FROM ({FIELDS})) GROUP BY ALL")
def p16(s, d):
    return sql(s, d, FIELDS).groupBy("field").agg(F.count("*").alias("n")).select("field", C.first_category("field").alias("category"), "n")


_IS_PAGE = "(content_type = 'text/html' OR regexp_matches(body, '(?i)<(?:html|body|input|script|form|table|div|section)\\b'))"


@query("ref_P18_kind_hint", f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN json_valid(body) AND regexp_matches(body, '^\\s*[\\[{{]') THEN 'data_file' WHEN {_IS_PAGE} THEN CASE WHEN regexp_matches(lower(body), '<table[\\s/>]|\\b(?:dashboard|chart|analytics|metric)\\b') THEN 'dashboard' WHEN regexp_matches(lower(body), '<form[\\s/>]') AND regexp_matches(lower(body), '\\b(?:calculate|calculator|estimate|quote)\\b') THEN 'calculator' ELSE 'webpage' END WHEN contains(content_type, 'javascript') OR regexp_matches(body, '\\b(?:function|const|let|import|export)\\b') THEN 'source_code' ELSE 'unknown' END AS kind FROM ({CAPTURES}) WHERE body IS NOT NULL) GROUP BY 1")
def p18(s, d):
    from ledgerline.operators.analysis import analyze

    return analyze(sql(s, d, CAPTURES)).groupBy(F.col("kind_hint").alias("kind")).agg(F.count("*").alias("n"))


_KINDS = " ".join(f"WHEN x IN {tuple(v)!r} THEN '{k}'" for k, v in N.TREE_KINDS.items())


@query("ref_P20_tree_files", f"SELECT id, CASE {_KINDS} ELSE 'other' END AS kind, NOT (contains(path, '/../') OR starts_with(path, '/') OR contains(path, '//')) AS valid FROM (SELECT id, path, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS x FROM ({_PATHS_JSON}))")
def p20(s, d):
    return sql(s, d, _PATHS_JSON).select("id", N.tree_kind("path").alias("kind"), N.tree_path_valid("path").alias("valid"))


@query("ref_P21_image_headers", "SELECT p_partkey AS id, 'png' AS format, CAST(p_size AS BIGINT) AS width, CAST(p_size * 2 AS BIGINT) AS height FROM part")
def p21(s, d):
    size = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    blob = F.concat(F.unhex(F.lit("89504e470d0a1a0a0000000d49484452")), size(F.col("p_size").cast("bigint")), size((F.col("p_size") * 2).cast("bigint")), F.unhex(F.lit("0802")))
    return R.image_headers(table(s, d, "part").select(F.col("p_partkey").alias("id"), blob.alias("content")))


@query("ref_F4_plates", f"SELECT id, CAST(len(regexp_extract_all(body, '(?:^|[^0-9A-Za-z_가-힣])([0-9]{{2,3}}[가-힣]\\s?[0-9]{{4}})(?:[^0-9]|$)', 1)) AS BIGINT) AS occurrences FROM ({PLAIN}) WHERE regexp_matches(body, '(?:^|[^0-9A-Za-z_가-힣])[0-9]{{2,3}}[가-힣]\\s?[0-9]{{4}}(?:[^0-9]|$)')")
def f4(s, d):
    from ledgerline.operators.signals import value_signals

    return value_signals(sql(s, d, PLAIN)).where("code = 'KR_VEHICLE_PLATE_CANDIDATE'").select("id", "occurrences")


@query("ref_F17_sensitive_fields", f"SELECT field, lower(field) IN ('email', 'cost_price', '원가', 'margin', 'salary') AS sensitive FROM ({FIELDS}) GROUP BY 1")
def f17(s, d):
    return sql(s, d, FIELDS).select("field").distinct().select("field", N.sensitive_key("field").alias("sensitive"))


_F24 = {k: f"regexp_matches(n, '{p}') AND length(n) BETWEEN {a} AND {b}" + (f" AND NOT regexp_matches(n, '{x}')" if x else "") for k, (p, a, b, x) in N.NAME_RULES.items()}
_NM = "SELECT p_partkey AS id, CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN concat('a--', CAST(p_size AS STRING)) WHEN 1 THEN concat(CASE WHEN p_size % 2 = 0 THEN '10' ELSE '999' END, '.0.0.', CAST(p_size AS STRING)) WHEN 2 THEN concat('x..', CAST(p_size AS STRING)) WHEN 3 THEN concat('-', CAST(p_size AS STRING)) WHEN 4 THEN 'b' ELSE concat('team-', CAST(p_size AS STRING), '.lab') END AS n FROM part"


@query("ref_F24_valid_names", "SELECT id, " + ", ".join(f"{c} AS {k}" for k, c in _F24.items()) + f" FROM ({_NM})")
def f24(s, d):
    return sql(s, d, _NM).select("id", *[N.valid_name(k, "n").alias(k) for k in N.NAME_RULES])


_REFERENCES = "SELECT 'asset' AS kind, asset_id AS v FROM assets UNION ALL SELECT 'evidence', evidence_ref FROM observations UNION ALL SELECT 'hash', payload_hash FROM observations UNION ALL SELECT 'locator', asset_ref FROM audit_jobs UNION ALL SELECT 'dedupe', dedupe_key FROM audit_jobs UNION ALL SELECT 'result', result_ref FROM audit_results UNION ALL SELECT 'event', event_id FROM ledger_events UNION ALL SELECT 'job', job_id FROM audit_jobs"


@query("ref_F25_grammars", "SELECT kind, count(*) AS n, " + ", ".join(f"count(*) FILTER (regexp_matches(v, '{g}')) AS {k}" for k, g in N.GRAMMARS.items()) + f" FROM ({_REFERENCES}) WHERE v IS NOT NULL GROUP BY 1")
def f25(s, d):
    """How many references of each column have which of the grammars."""
    rows = sql(s, d, _REFERENCES).where("v is not null")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("v").rlike(g)).alias(k) for k, g in N.GRAMMARS.items()])


@query("ref_F27_json_pointer", "SELECT c_custkey AS id, 'x@y.test' AS email, CAST(0 AS BIGINT) AS salary, NULL::VARCHAR AS missing FROM customer")
def f27(s, d):
    return sql(s, d, _JS).select("id", N.at_pointer("body", "/list/0/email").alias("email"), N.at_pointer("body", "/salary", "bigint").alias("salary"), N.at_pointer("body", "/list/01/email").alias("missing"))


@query("ref_F28_document_references", f"SELECT id, regexp_matches(lower(path), '\\.(?:{'|'.join(N.DOCUMENT_SUFFIXES)})$') AND NOT starts_with(path, '//') AS is_document FROM ({_PATHS_JSON})")
def f28(s, d):
    return sql(s, d, _PATHS_JSON).select("id", N.document_reference("path").alias("is_document"))


@query("ref_F31_public_addresses", "SELECT c_custkey AS id, c_custkey % 4 <> 0 AS is_public FROM customer")
def f31(s, d):
    n = (F.col("c_custkey") % 200 + 1).cast("string")
    ip = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("10.0.0."), n)).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("8.8.4."), n)).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("::ffff:9.9.9."), n)).otherwise(F.concat(F.lit("2001:4860::"), n))
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), N.public_address(ip).alias("is_public"))


@query("ref_FJSON_depth", "SELECT DISTINCT event_id, CAST(list_max(list_transform(range(1, length(x) + 1), lambda i: length(regexp_replace(x[1:i], '[\\]}]', '', 'g')) - length(regexp_replace(x[1:i], '[\\[{]', '', 'g')))) AS INT) AS depth FROM (SELECT DISTINCT event_id, regexp_replace(regexp_replace(payload_json, '\"(?:[^\"\\\\]|\\\\.)*\"', '', 'g'), '[^\\[\\]{}]', '', 'g') AS x FROM ledger_events WHERE sha256(payload_json) = payload_hash) WHERE length(x) > 0")
def depth(s, d):
    e = table(s, d, "ledger_events").where(F.sha2("payload_json", 256) == F.col("payload_hash"))
    return e.select("event_id", N.json_depth("payload_json").alias("depth")).distinct().where("depth > 0")


@query("ref_C9_C20_page_signals", "SELECT -1 - p_partkey AS id, 'HIDDEN_DOM_PRESENT LOGIN_FORM_INDICATOR RUNTIME_ENDPOINT_CANDIDATE' AS codes FROM part")
def c9(s, d):
    return C.page_signals(sql(s, d, _MADE_PAGES)).select("id", F.array_join("codes", " ").alias("codes"))


@query("ref_C9_C20_page_signals_all")
def c9_all(s, d):
    """All pages, the documents' captures too; ref_C9_C20_page_signals holds the made pages against SQL."""
    return C.page_signals(sql(s, d, _PAGES)).select("id", F.array_join("codes", " ").alias("codes"), "marker_region")


# The value, secret and verdict rules over all captures; the queries of these names without _all leave the pages out.


@query("ref_C2_C25_verdicts_all")
def verdicts_all(s, d):
    captures = sql(s, d, CAPTURES)
    rows = S.marker_signals(sql(s, d, PLAIN)).unionByName(C.page_verdicts(captures))
    return rows.select("id", F.array_join("codes", " ").alias("codes"), "content", F.array_join("pending_reviews", " ").alias("pending"))


def _values(s, d, *codes):
    return S.value_signals(C.text_captures(sql(s, d, CAPTURES))).where(F.col("code").isin(*codes))


@query("ref_F1_email_signals_all")
def f1_all(s, d):
    return _values(s, d, "EMAIL_VALUE_CANDIDATE").select("id", "occurrences", "unique_values", F.array_join("masked_examples", " ").alias("examples"))


@query("ref_F2_F3_number_signals_all")
def f2_all(s, d):
    return _values(s, d, "KR_PHONE_VALUE_CANDIDATE", "KR_RESIDENT_VALUE_CANDIDATE").select("id", "code", "occurrences")


@query("ref_F4_plates_all")
def f4_all(s, d):
    return _values(s, d, "KR_VEHICLE_PLATE_CANDIDATE").select("id", "occurrences")


@query("ref_F5_business_numbers_all")
def f5_all(s, d):
    return _values(s, d, "KR_BUSINESS_NUMBER_CANDIDATE").select("id", "occurrences", "unique_values")


@query("ref_F7_secret_offsets_all")
def f7_all(s, d):
    return C.region_secrets(sql(s, d, CAPTURES))


@query("ref_C29_chunk_findings")
def c29(s, d):
    return C.chunk_findings(sql(s, d, CAPTURES), 2_000, 200).select("id", F.array_join("codes", " ").alias("codes"), "chunks")


@query("ref_C31_dom_proximity", "SELECT -20 AS id, 1 AS links")
def c31(s, d):
    return C.dom_proximity(sql(s, d, PLAIN)).where("links > 0").select(F.col("id").cast("int").alias("id"), F.col("links").cast("int").alias("links"))


@query("ref_C32_gate_flags", "SELECT -1 - p_partkey AS id, 'commission' AS business_words, true AS server_call, false AS login_endpoint, true AS password_input FROM part")
def c32(s, d):
    return C.gate_flags(sql(s, d, _MADE_PAGES)).withColumn("business_words", F.array_join("business_words", ","))


@query("ref_C32_gate_flags_all")
def c32_all(s, d):
    """All pages, the documents' captures too; ref_C32_gate_flags holds the made pages against SQL."""
    return C.gate_flags(sql(s, d, _PAGES)).withColumn("business_words", F.array_join("business_words", ","))


_RATES = "SELECT c_custkey AS id, concat('const rates = [{price: ', CAST(c_nationkey AS STRING), ', customerEmail: \"n/a\", cost: \"=A1\", other: 1}]; let x = [f()]') AS body FROM customer"


@query("ref_U4_static_categories", "SELECT c_custkey AS id, category, 1::BIGINT AS candidates, filled::BIGINT AS filled, templates::BIGINT AS templates, calculations::BIGINT AS calculations FROM customer, (VALUES ('pricing', 1, 0, 0), ('customer_contact', 0, 1, 0), ('margin', 0, 0, 1)) v(category, filled, templates, calculations)")
def u4(s, d):
    return C.static_categories(sql(s, d, _RATES))


@query("ref_A14_strongest_states", f"SELECT id, container, CASE max(r) WHEN 3 THEN 'value' WHEN 2 THEN 'calculation' WHEN 1 THEN 'template' ELSE 'field_name_only' END AS state FROM (SELECT id, unnest(['', 'a', 'a/b' || CAST(n % 2 AS STRING)]) AS container, CAST(id % 4 AS INT) AS r FROM (SELECT l_orderkey + l_linenumber AS id, l_linenumber AS n FROM lineitem)) GROUP BY 1, 2")
def a14(s, d):
    rows = table(s, d, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber")).alias("id"), F.concat(F.lit("a/b"), (F.col("l_linenumber") % 2).cast("string"), F.lit("/c")).alias("path"))
    state = F.get(F.array(*map(F.lit, ("field_name_only", "template", "calculation", "value"))), (F.col("id") % 4).cast("int"))
    return C.strongest_states(rows.select("id", "path", state.alias("state")))


@query("ref_U6_references", "SELECT -1 - p_partkey AS id, 'a' AS relation, '/p/' || CAST(p_partkey AS STRING) AS url FROM part UNION ALL SELECT -1 - p_partkey, 'fetch_literal', '/api' FROM part")
def u6(s, d):
    return C.references(sql(s, d, _MADE_PAGES))


@query("ref_U6_references_all")
def u6_all(s, d):
    """All pages, the documents' captures too; ref_U6_references holds the made pages against SQL."""
    return C.references(sql(s, d, _PAGES))


_COMMIT = "SELECT l_orderkey AS id, concat('{\"sha\":\"', md5(CAST(l_orderkey AS STRING)), '\",\"parents\":', CASE WHEN l_orderkey % 3 = 0 THEN '[]' ELSE '[{\"sha\":\"p\"}]' END, ',\"files\":[') AS head, l_linenumber AS n, concat('{\"filename\":\"f', CAST(l_linenumber AS STRING), '.py\",\"status\":\"', CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'removed' ELSE 'modified' END, '\"}') AS file FROM lineitem"


@query("ref_U11_A15_commit_files", "SELECT l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'removed' ELSE 'modified' END AS status, count(DISTINCT l_linenumber) AS files, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END + CASE WHEN l_returnflag = 'A' OR l_orderkey % 3 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS refs FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem) GROUP BY 1, 2")
def u11(s, d):
    """Commit details as JSON: files by status, and how many file versions (current, previous) they refer to."""
    docs = sql(s, d, _COMMIT).groupBy("id", "head").agg(F.array_sort(F.collect_set(F.struct("n", "file"))).alias("f")).select("id", F.concat("head", F.array_join(F.transform("f", lambda x: x["file"]), ","), F.lit("]}")).alias("body"))
    c = docs.select("id", F.from_json("body", "sha string, parents array<struct<sha:string>>, files array<struct<filename:string,status:string>>").alias("c"))
    f = c.select("id", F.size("c.parents").alias("parents"), F.explode("c.files").alias("f")).select("id", "parents", "f.*")
    refs = F.when(F.col("status") != "removed", 1).otherwise(0) + F.when((F.col("status") != "added") & (F.col("parents") > 0), 1).otherwise(0)
    return f.groupBy("id", "status").agg(F.count("*").alias("files"), F.sum(refs).cast("bigint").alias("refs"))


# Joins, aggregations and windows that are left


@query("ref_J15_tree_parity", "SELECT coalesce(a.k, b.k) AS path, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT p_partkey AS k, md5(p_name) AS h FROM part WHERE p_partkey % 7 <> 0) a FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_size = 5 THEN 'x' ELSE md5(p_name) END AS h FROM part WHERE p_partkey % 11 <> 0) b ON a.k = b.k WHERE a.h IS DISTINCT FROM b.h")
def j15(s, d):
    p = table(s, d, "part")
    a = p.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("path"), F.md5("p_name").alias("h"))
    b = p.where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("path"), F.when(F.col("p_size") == 5, "x").otherwise(F.md5("p_name")).alias("h"))
    return J.snapshot_diff(a, b, ["path"], ["h"])


@query("ref_W16_strongest_k", f"WITH a AS (SELECT split_part(repository, '/', 1) AS account, min(CASE ownership_status WHEN 'confirmed' THEN 0 WHEN 'pending' THEN 1 ELSE 2 END) AS p, min((record_ref, node_path)) AS first_at FROM ({problems.ORACLE['p1_repositories']}) WHERE repository IS NOT NULL GROUP BY 1), r AS (SELECT account, row_number() OVER (ORDER BY p, first_at, account) AS n FROM a) SELECT account, n AS position FROM r WHERE n <= 40")
def w16(s, d):
    """The 40 accounts with the strongest evidence, ties by first arrival: a top-k report. What a stronger one displaces stays out."""
    p = F.when(F.col("ownership_status") == "confirmed", 0).when(F.col("ownership_status") == "pending", 1).otherwise(2)
    r = problems.p1_typed(s, d, "repositories").where("repository is not null").groupBy(F.split_part("repository", F.lit("/"), F.lit(1)).alias("account"))
    best = r.agg(F.min(p).alias("p"), F.min(F.struct("record_ref", "node_path")).alias("first_at")).orderBy("p", "first_at", "account").limit(40)
    return best.select("account", F.row_number().over(W.orderBy("p", "first_at", "account")).cast("bigint").alias("position"))


@query("ref_T3_sorted_lists", "SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS position, c_custkey FROM customer")
def t3(s, d):
    """All customers; the order is a position per key instead of an array, whose size has no bound."""
    at = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey"))
    return table(s, d, "customer").select("c_nationkey", at.alias("position"), "c_custkey")


@query("ref_T7_capped_with_flag", "SELECT user_id, least(n, 32) AS kept, n > 32 AS truncated FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def t7(s, d):
    n = table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.least("n", F.lit(32).cast("bigint")).alias("kept"), (F.col("n") > 32).alias("truncated"))


@query("ref_FDT_timestamps", "SELECT id, CASE WHEN id % 4 IN (0, 1) THEN epoch_us(TIMESTAMPTZ '2024-05-01 10:00:00+00') END AS at_us FROM (SELECT o_orderkey AS id FROM orders)")
def fdt(s, d):
    """Time texts need a zone; naive, date-only and wrong ones are null, zones are normalised to UTC."""
    text = F.when(F.col("o_orderkey") % 4 == 0, "2024-05-01T10:00:00Z").when(F.col("o_orderkey") % 4 == 1, "2024-05-01T19:00:00+09:00").when(F.col("o_orderkey") % 4 == 2, "2024-05-01T10:00:00").otherwise("2024-13-01T10:00:00Z")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(text.rlike(r"^\d{4}-\d\d-\d\dT.*(?:Z|[+-]\d\d:\d\d)$"), F.unix_micros(F.try_to_timestamp(text))).alias("at_us"))


@query("ref_FBACKOFF", "SELECT o_orderkey AS id, greatest(least(900, 30 * CAST(pow(2, least(o_orderkey % 8, 5)) AS BIGINT)), o_orderkey % 400) AS seconds FROM orders")
def backoff(s, d):
    n = F.col("o_orderkey")
    return table(s, d, "orders").select(n.alias("id"), F.greatest(F.least(F.lit(900), (30 * F.pow(F.lit(2), F.least(n % 8, F.lit(5)))).cast("bigint")), n % 400).alias("seconds"))
