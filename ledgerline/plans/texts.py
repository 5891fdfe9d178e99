"""Queries of the text, address and content operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import patterns as P, text as X, urls as U
from ledgerline.operators import signals as S
from ledgerline.plans.common import CAPTURES, CREDENTIAL_SQL, FIELDS, PLAIN, URLS, sql

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return keep


RX = U.PARTS.replace("'", "''")
_P = {n: f"regexp_extract(u, '{RX}', {i + 1})" for i, n in enumerate(U.NAMES)}
_URL = f"""WITH f AS ({URLS}), p AS (SELECT id, url, u, lower({_P['scheme']}) AS scheme, {_P['user']} AS usr, lower({_P['host']}) AS host, {_P['port']} AS port, {_P['path']} AS path, {_P['query']} AS q, {_P['fragment']} AS frag FROM (SELECT id, url, {{0}} AS u FROM f)),
a AS (SELECT *, host || CASE WHEN port = '' OR (scheme = 'https' AND port = '443') OR (scheme = 'http' AND port = '80') THEN '' ELSE ':' || port END AS authority, scheme IN ('http', 'https') AND host <> '' AS web FROM p) """
_URL_, _URL_S = _URL.format("url"), _URL.format("CASE WHEN contains(url, '://') THEN url ELSE 'https://' || url END")


def urls(s, d):
    return sql(s, d, URLS)


@query("ref_P1_safe_url", _URL_ + "SELECT id, CASE WHEN web THEN substr(scheme || '://' || authority || CASE WHEN path IN ('', '/') THEN '/' ELSE '/<path-omitted>' END || CASE WHEN q <> '' THEN '?<query-omitted>' ELSE '' END || CASE WHEN frag <> '' THEN '#<fragment-omitted>' ELSE '' END, 1, 512) ELSE '<invalid-url>' END AS shown FROM a")
def safe_url(s, d):
    return urls(s, d).select("id", U.safe_url("url").alias("shown"))


@query("ref_P2_origin", _URL_ + "SELECT id, CASE WHEN web AND usr = '' THEN scheme || '://' || authority END AS origin FROM a")
def origin(s, d):
    return urls(s, d).select("id", U.origin("url").alias("origin"))


@query("ref_P3_exact_url", _URL_S + "SELECT id, CASE WHEN web AND usr = '' THEN scheme || '://' || authority END AS public_origin, CASE WHEN web AND usr = '' THEN scheme || '://' || authority || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END || CASE WHEN frag <> '' THEN '#' || frag ELSE '' END END AS exact FROM a")
def exact_url(s, d):
    return urls(s, d).select("id", U.origin(U.with_scheme("url")).alias("public_origin"), U.exact_url("url").alias("exact"))


@query("ref_P5_clean_homepage", _URL_ + "SELECT id, CASE WHEN scheme = 'https' AND host <> '' AND port IN ('', '443') AND usr = '' AND q = '' AND frag = '' AND host <> 'localhost' AND NOT ends_with(host, '.local') AND NOT regexp_matches(host, '^(?:0|10|127)(?:\\.[0-9]+){3}$|^192\\.168(?:\\.[0-9]+){2}$') THEN 'https://' || host END AS homepage FROM a")
def homepage(s, d):
    return urls(s, d).select("id", U.clean_homepage("url").alias("homepage"))


@query("ref_F22_credential_keys", _URL_ + f"SELECT id, array_to_string(list_filter(list_transform(string_split(q, '&'), lambda x: split_part(x, '=', 1)), lambda x: {CREDENTIAL_SQL.replace('(k,', '(url_decode(x),').replace('lower(k)', 'lower(url_decode(x))')}), ',') AS keys FROM a")
def credential_keys(s, d):
    return urls(s, d).select("id", F.array_join(U.credential_keys("url"), ",").alias("keys"))


@query("ref_P28_environment_hint", _URL_ + "SELECT id, CASE WHEN list_has_any(string_split(host, '.'), ['dev', 'test', 'staging', 'stage', 'preview']) THEN 'development_candidate' ELSE 'unspecified' END AS hint FROM a")
def environment(s, d):
    return urls(s, d).select("id", U.environment_hint("url").alias("hint"))


_KEY = b"ledgerline-test-key".ljust(64, b"\0")


@query("ref_P7_keyed_ref", f"SELECT id, 'hmac-sha256:' || sha256(unhex('{bytes(b ^ 0x5C for b in _KEY).hex()}') || unhex(sha256(unhex('{bytes(b ^ 0x36 for b in _KEY).hex()}') || encode(url)))) AS ref FROM ({URLS})")
def keyed(s, d):
    return urls(s, d).select("id", U.keyed_ref("url", "ledgerline-test-key").alias("ref"))


NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # the standard URL namespace
_U5 = f"sha1(unhex('{NAMESPACE}') || encode(scope || chr(31) || url))"


@query("ref_P8_uuid5", f"SELECT id, substr(h, 1, 12) || '5' || substr(h, 14, 3) || substr('89ab89ab89ab89ab', CAST(strpos('0123456789abcdef', substr(h, 17, 1)) AS INT), 1) || substr(h, 18, 15) AS uid FROM (SELECT id, {_U5} AS h FROM (SELECT id, 'scope-1' AS scope, url FROM ({URLS})))")
def uuid5(s, d):
    return urls(s, d).select("id", U.uuid5_hex(NAMESPACE, F.lit("scope-1"), "url").alias("uid"))


@query("ref_P9_canonical_hash", """SELECT o_orderkey AS id, sha256('{"customer":' || CAST(o_custkey AS STRING) || ',"priority":"' || o_orderpriority || '","status":' || CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}') AS payload_hash FROM orders""")
def canonical_hash(s, d):
    """Sorted keys, compact separators, nulls kept; then SHA-256."""
    row = F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("status"))
    return sql(s, d, "SELECT * FROM orders").select(F.col("o_orderkey").alias("id"), F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256).alias("payload_hash"))


@query("ref_P14_clean_text", f"SELECT id, substr(trim(regexp_replace(body, '[\\x00-\\x20\\x7f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')), 1, 256) AS label FROM ({PLAIN})")
def clean(s, d):
    return sql(s, d, PLAIN).select("id", X.clean_text("body").alias("label"))


_WORDS = "' ' || trim(regexp_replace(lower(regexp_replace(field, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[_\\-\\s]+', ' ', 'g')) || ' '"
_CATS = ", ".join(f"CASE WHEN list_bool_or(list_transform({[' ' + t.replace('_', ' ') + ' ' for t in terms]!r}, lambda t: contains(w, t))) THEN '{c}' END" for c, terms in sorted(P.CATEGORY_TERMS.items()))


@query("ref_P15_key_categories", f"SELECT field, array_to_string(list_filter([{_CATS}], lambda x: x IS NOT NULL), ',') AS categories, count(*) AS n FROM (SELECT field, {_WORDS} AS w FROM ({FIELDS})) GROUP BY ALL")
def categories(s, d):
    return sql(s, d, FIELDS).groupBy("field").agg(F.count("*").alias("n")).select("field", F.array_join(X.key_categories("field"), ",").alias("categories"), "n")


@query("ref_P17_value_state", f"SELECT state, count(*) AS n FROM (SELECT CASE WHEN value IS NULL OR value IN ('', '[]', '{{}}') THEN 'field_name_only' WHEN regexp_full_match(lower(value), '\\s*(?:|[-_]+|n/?a|null|undefined|example|sample|placeholder|dummy|test|\\{{\\{{.*\\}}\\}})\\s*') THEN 'template' WHEN starts_with(ltrim(value), '=') THEN 'calculation' ELSE 'value' END AS state FROM ({FIELDS})) GROUP BY 1")
def value_states(s, d):
    return sql(s, d, FIELDS).groupBy(X.value_state("value").alias("state")).agg(F.count("*").alias("n"))


_PATHS = "SELECT p_partkey AS id, concat(lower(p_brand), '/file_', CAST(p_partkey AS STRING), CASE CAST(p_size % 10 AS INT) WHEN 0 THEN '.CSV' WHEN 1 THEN '.sql' WHEN 2 THEN '.pdf' WHEN 3 THEN '.pem' WHEN 4 THEN '.py' WHEN 5 THEN '.tar.gz' WHEN 6 THEN '' WHEN 7 THEN '.yaml' WHEN 8 THEN '.tsx' ELSE '.bin' END) AS path FROM part"
_CASE = " ".join(f"WHEN x IN {tuple(v)!r} THEN '{k}'" for k, v in P.SUFFIX_CLASSES.items())


@query("ref_P19_suffix_class", f"SELECT id, CASE {_CASE} ELSE 'other' END AS class FROM (SELECT id, lower(regexp_extract(path, '[^/]\\.([A-Za-z0-9]+)$', 1)) AS x FROM ({_PATHS}))")
def suffixes(s, d):
    return sql(s, d, _PATHS).select("id", X.suffix_class("path").alias("class"))


_ST = "SELECT o_orderkey AS id, CAST(CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN 200 WHEN 1 THEN 204 WHEN 2 THEN 301 WHEN 3 THEN 401 WHEN 4 THEN 403 WHEN 5 THEN 404 WHEN 6 THEN 410 ELSE 503 END AS INT) AS status FROM orders"


@query("ref_P24_status_access", f"SELECT access, count(*) AS n FROM (SELECT CASE WHEN status BETWEEN 200 AND 299 THEN 'BODY_SERVED' WHEN status IN (401, 403) THEN 'ACCESS_DENIED_OBSERVED' WHEN status IN (404, 410) THEN 'NOT_FOUND_OBSERVED' ELSE 'INDETERMINATE' END AS access FROM ({_ST})) GROUP BY 1")
def access(s, d):
    c = F.col("status")
    kind = F.when(c.between(200, 299), "BODY_SERVED").when(c.isin(401, 403), "ACCESS_DENIED_OBSERVED").when(c.isin(404, 410), "NOT_FOUND_OBSERVED").otherwise("INDETERMINATE")
    return sql(s, d, _ST).groupBy(kind.alias("access")).agg(F.count("*").alias("n"))


_SC = "SELECT l_orderkey AS id, l_linenumber AS n, CAST(l_quantity AS DOUBLE) / 40 AS o, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount * 9 END AS i, l_tax * 10 AS w, l_quantity / 50 AS g, l_discount AS c1, l_tax AS c2, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE -0.25 END AS c3 FROM lineitem"
_CL = lambda x, dflt: f"least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), CAST(coalesce({x}, {dflt}) AS DOUBLE)))"


@query("ref_P26_priority_score", f"SELECT id, n, floor(s * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS score FROM (SELECT id, n, {_CL('o', 0.1)} * {_CL('i', 0.5)} * {_CL('w', 0.5)} * {_CL('g', 0.5)} / (1 + {_CL('c1', 0.5)} + {_CL('c2', 0.5)} + {_CL('c3', 0.5)}) AS s FROM ({_SC}))")
def score(s, d):
    """Product of the clamped benefits over one plus the clamped costs, to six digits; missing inputs have defaults."""
    clamp = lambda c, default: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(c).cast("double"), F.lit(default))))
    value = clamp("o", 0.1) * clamp("i", 0.5) * clamp("w", 0.5) * clamp("g", 0.5) / (1 + clamp("c1", 0.5) + clamp("c2", 0.5) + clamp("c3", 0.5))
    return sql(s, d, _SC).select("id", "n", (F.floor(value * 1e6 + 0.5) / 1e6).alias("score"))


# Value signals. RE2 has no look-around: the SQL takes the neighbours into the match; the vectors keep them apart.
_MAIL = P.EMAIL.replace("'", "''")
_EMAILS = f"SELECT id, regexp_extract_all(body, '{_MAIL}') AS found FROM ({PLAIN})"
_MASK = "left(split_part(m, '@', 1), 2) || repeat('*', CAST(greatest(1, length(split_part(m, '@', 1)) - 2) AS INT)) || '@' || split_part(m, '@', 2)"
_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query("ref_F1_email_signals", f"SELECT id, CAST(len(found) AS BIGINT) AS occurrences, CAST(len(list_distinct(found)) AS BIGINT) AS unique_values, array_to_string({_FIRST.format('k')}[1:3], ' ') AS examples FROM (SELECT id, found, list_transform(found, lambda m: {_MASK}) AS k FROM ({_EMAILS}) WHERE len(found) > 0)")
def emails(s, d):
    rows = S.value_signals(sql(s, d, PLAIN)).where("code = 'EMAIL_VALUE_CANDIDATE'")
    return rows.select("id", "occurrences", "unique_values", F.array_join("masked_examples", " ").alias("examples"))


@query("ref_F1_email_by_source", f"SELECT source, CAST(sum(len(found)) AS BIGINT) AS occurrences, count(*) FILTER (len(found) > 0) AS documents FROM (SELECT source, regexp_extract_all(text, '{_MAIL}') AS found FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def emails_by_source(s, d):
    """Occurrences per source: one map-side combined aggregation over the pruned columns."""
    found = sql(s, d, "SELECT source, text FROM documents WHERE text IS NOT NULL").select("source", F.size(X.matches("text", P.EMAIL)).alias("n"))
    return found.groupBy("source").agg(F.sum("n").cast("bigint").alias("occurrences"), F.count_if(F.col("n") > 0).alias("documents"))


def _re2(p: str) -> str:
    return "(?:^|[^0-9])(" + p.replace("(?<!\\d)", "").replace("(?!\\d)", "").replace("\\d", "[0-9]") + ")(?:[^0-9]|$)"


_KINDS = [("KR_PHONE_VALUE_CANDIDATE", _re2(P.PHONE)), ("KR_RESIDENT_VALUE_CANDIDATE", _re2(P.RESIDENT))]
_OTHER = " UNION ALL ".join(f"SELECT id, '{c}' AS code, CAST(len(m) AS BIGINT) AS occurrences FROM (SELECT id, regexp_extract_all(body, '{p}', 1) AS m FROM ({PLAIN})) WHERE len(m) > 0" for c, p in _KINDS)


@query("ref_F2_F3_number_signals", _OTHER)
def numbers(s, d):
    return S.value_signals(sql(s, d, PLAIN)).where(F.col("code").isin([c for c, _ in _KINDS])).select("id", "code", "occurrences")


_DIG = "list_transform(string_split(regexp_replace(m, '[^0-9]', '', 'g'), ''), lambda x: CAST(x AS INT))"
_W = " + ".join(f"g[{i + 1}] * {w}" for i, w in enumerate(P.TAX_WEIGHTS))


@query("ref_F5_business_numbers", f"SELECT id, count(*) AS occurrences, count(DISTINCT m) AS unique_values FROM (SELECT id, m, {_DIG} AS g FROM (SELECT id, unnest(regexp_extract_all(body, '{_re2(P.BUSINESS)}', 1)) AS m FROM ({PLAIN}))) WHERE len(g) = 10 AND len(list_distinct(g)) > 1 AND (10 - ({_W} + g[9] * 5 // 10) % 10) % 10 = g[10] GROUP BY 1")
def business(s, d):
    return S.value_signals(sql(s, d, PLAIN)).where("code = 'KR_BUSINESS_NUMBER_CANDIDATE'").select("id", "occurrences", "unique_values")


@query("ref_F6_confidential", f"SELECT id, regexp_matches(body, '(?i){P.NEGATED_CONFIDENTIAL}') AS negated FROM ({PLAIN}) WHERE regexp_matches(body, '(?i){P.CONFIDENTIAL}')")
def confidential(s, d):
    return sql(s, d, PLAIN).where(X.has("body", P.CONFIDENTIAL, True)).select("id", X.has("body", P.NEGATED_CONFIDENTIAL, True).alias("negated"))


@query("ref_F7_secret_offsets", " UNION ALL ".join(f"SELECT id, '{c}' AS code, CAST(strpos(body, m) - 1 AS BIGINT) AS \"offset\" FROM (SELECT id, body, regexp_extract(body, '{p}') AS m FROM ({PLAIN})) WHERE m <> ''" for c, p in P.SECRETS.items()))
def secrets(s, d):
    return S.secret_offsets(sql(s, d, PLAIN))


_SIMPLE = {"F8_publishable_key": ("sb_publishable_", False), "F9_untrusted_text": (P.UNTRUSTED, True), "F10_client_encryption": (P.ENCRYPTION, True), "F12_fetch_literal": (P.FETCH_LITERAL, False), "F12_fetch_dynamic": (P.FETCH_DYNAMIC, False), "F13_password_assignment": (P.PASSWORD_ASSIGNMENT, True), "F14_challenge_page": (P.CHALLENGE, True), "F20_server_call": (P.SERVER_CALL, True), "C25_image_pending": (P.IMAGE_PENDING, True)}
for _name, (_pattern, _ic) in _SIMPLE.items():
    _rx = ("(?i)" if _ic else "") + _pattern.replace("'", "''").replace("{1,2048}", "+")  # RE2 repeats 1,000 times at most
    query(f"ref_{_name}", f"SELECT content_type, count(*) FILTER (regexp_matches(body, '{_rx}')) AS hits, count(*) AS bodies FROM ({CAPTURES}) WHERE body IS NOT NULL GROUP BY 1")(
        lambda s, d, p=_pattern, ic=_ic: sql(s, d, CAPTURES).where("body is not null").groupBy("content_type").agg(F.count_if(X.has("body", p, ic)).alias("hits"), F.count("*").alias("bodies"))
    )


def _m(p: str, ic: bool = False) -> str:
    return f"regexp_matches(body, '{'(?i)' if ic else ''}{p.replace(chr(39), chr(39) * 2).replace('{1,2048}', '+')}')"


_JS = "contains(content_type, 'javascript')"
_TAXOK = f"len(list_filter(list_transform(regexp_extract_all(body, '{_re2(P.BUSINESS)}', 1), lambda m: {_DIG}), lambda g: len(list_distinct(g)) > 1 AND (10 - ({_W} + g[9] * 5 // 10) % 10) % 10 = g[10])) > 0"
_CODES = [(c, _m(p)) for c, p in P.SECRETS.items()]
_CODES += [("PUBLISHABLE_KEY_PRESENT", "contains(body, 'sb_publishable_')"), ("UNTRUSTED_INSTRUCTION_TEXT", _m(P.UNTRUSTED, True)), ("CLIENT_ENCRYPTION_INDICATOR", _m(P.ENCRYPTION, True)), ("SYNTHETIC_CANARY_PRESENT", "contains(body, 'SYNTHETIC_CANARY_')")]
_CODES += [("JSON_PARSE_INCOMPLETE", "regexp_matches(ltrim(body), '^[{\\[]') AND NOT json_valid(body)")]
_CODES += [("EMAIL_VALUE_CANDIDATE", f"{_m(P.EMAIL)} AND NOT {_JS}"), ("KR_PHONE_VALUE_CANDIDATE", f"{_m(_re2(P.PHONE))} AND NOT {_JS}"), ("KR_RESIDENT_VALUE_CANDIDATE", f"{_m(_re2(P.RESIDENT))} AND NOT {_JS}")]
_CODES += [("KR_VEHICLE_PLATE_CANDIDATE", f"regexp_matches(body, '(?:^|[^0-9A-Za-z_가-힣])[0-9]{{2,3}}[가-힣]\\s?[0-9]{{4}}(?:[^0-9]|$)') AND NOT {_JS}"), ("KR_BUSINESS_NUMBER_CANDIDATE", f"{_TAXOK} AND NOT {_JS}"), ("CONFIDENTIAL_MARKER_CANDIDATE", _m(P.CONFIDENTIAL, True))]
_CODES += [("CLIENT_PASSWORD_CANDIDATE", f"{_JS} AND ({_m(P.PASSWORD_ASSIGNMENT, True)} OR {_m(P.PASSWORD_COMPARISON, True)})"), ("RUNTIME_ENDPOINT_CANDIDATE", _m(P.FETCH_LITERAL)), ("RUNTIME_ENDPOINT_UNRESOLVED", f"{_JS} AND {_m(P.FETCH_DYNAMIC)}")]
_LIST = "list_filter([" + ", ".join(f"CASE WHEN {rule} THEN '{c}' END" for c, rule in _CODES) + "], lambda x: x IS NOT NULL)"


@query("ref_C2_C25_verdicts", f"""SELECT id, array_to_string(codes || CASE WHEN {_m(P.CHALLENGE, True)} THEN ['CHALLENGE_PAGE_INDICATOR'] ELSE [] END, ' ') AS codes,
  CASE WHEN list_contains(codes, 'SYNTHETIC_CANARY_PRESENT') THEN 'SYNTHETIC_CONTENT_CONFIRMED' WHEN len(list_filter(codes, lambda c: ends_with(c, '_CANDIDATE') AND c <> 'RUNTIME_ENDPOINT_CANDIDATE')) > 0 THEN 'SENSITIVE_CANDIDATE' ELSE 'NOT_INSPECTED' END AS content,
  CASE WHEN {_m(P.IMAGE_PENDING, True)} THEN 'image_or_base64_review' ELSE '' END AS pending FROM (SELECT id, body, {_LIST} AS codes FROM ({PLAIN}))""")
def verdicts(s, d):
    return S.marker_signals(sql(s, d, PLAIN)).select("id", F.array_join("codes", " ").alias("codes"), "content", F.array_join("pending_reviews", " ").alias("pending"))


@query("ref_F21_dom_flow", f"SELECT id, CAST(len(regexp_extract_all(body, '{P.DOM_DECLARATION}')) AS BIGINT) AS declarations, CAST(len(regexp_extract_all(body, '{P.DOM_SINK}')) AS BIGINT) AS sinks, CAST(len(regexp_extract_all(body, '(?i){P.DOM_EVENT}')) AS BIGINT) AS events, CAST(len(regexp_extract_all(body, '(?i){P.DOM_RENDER}')) AS BIGINT) AS renders FROM ({PLAIN})")
def flow(s, d):
    return S.dom_flow(sql(s, d, PLAIN))


@query("ref_P22_inline_images", f"SELECT id, regexp_replace(body, '{P.INLINE_IMAGE}', '\\1[inline-image-omitted]', 'g') AS projected, CAST(len(regexp_extract_all(body, '{P.INLINE_IMAGE}')) AS BIGINT) AS images, sha256(body) AS digest FROM ({CAPTURES}) WHERE body IS NOT NULL")
def images(s, d):
    return S.project_inline_images(sql(s, d, CAPTURES))


_RED = "body"
_RED = f"regexp_replace({_RED}, '{P.PRIVATE_KEY_BLOCK}', '[REDACTED_PRIVATE_KEY]', 'g')"
for _c, _p in P.SECRETS.items():
    _RED = f"regexp_replace({_RED}, '{_p}', '[REDACTED_{_c}]', 'g')"
_RED = f"""regexp_replace({_RED}, '(?i)\\b(password|passwd|secret|token|api[_-]?key|authorization)\\b\\s*[:=]\\s*(?:[^\\s,;<>"'']{{4,}}|"[^\\s,;<>"'']{{4,}}"|''[^\\s,;<>"'']{{4,}}'')', '\\1=[REDACTED]', 'g')"""
_RED = f"regexp_replace({_RED}, '{P.QUERY_SECRET}', '\\1[REDACTED]', 'g')"
_RED = f"regexp_replace({_RED}, '{_MAIL}', '[REDACTED_EMAIL]', 'g')"
for _c, _p in (("PHONE", P.PHONE), ("RESIDENT", P.RESIDENT), ("BUSINESS_NUMBER", P.BUSINESS)):
    _RED = f"regexp_replace({_RED}, '{_re2(_p).replace('(?:^|[^0-9])', '(^|[^0-9])').replace('(?:[^0-9]|$)', '([^0-9]|$)').replace('(0[1-9]', '(?:0[1-9]')}', '\\1[REDACTED_{_c}]\\3', 'g')"
_RED = f"regexp_replace({_RED}, '(^|[^0-9A-Za-z_가-힣])((?:서울|부산)?\\s?[0-9]{{2,3}}[가-힣]\\s?[0-9]{{4}})([^0-9]|$)', '\\1[REDACTED_VEHICLE_PLATE]\\3', 'g')"


@query("ref_P12_redact")
def redact(s, d):
    """All captures with known values replaced; look-around and back references have no counterpart in the SQL."""
    return sql(s, d, CAPTURES).where("body is not null").select("id", X.redact("body", ["SYNTHETIC_CANARY_7"]).alias("redacted"))


_VALS = "SELECT * FROM (VALUES ('phone', '010-1234-5678', '010-****-5678'), ('phone', '01012345678', '010-****-5678'), ('plate', '12가3456', '12가34**'), ('business', '109-86-31667', '109-86-316**'), ('resident', '900101-1234567', '900101-1******'), ('email', 'fixture@example.test', 'fi*****@example.test'), ('other', 'abcd', '****')) AS v(kind, value, masked)"


@query("ref_P10_mask_vectors", f"SELECT kind, value, masked FROM ({_VALS})")
def masks(s, d):
    shown = X.mask("other", "value")
    for kind in ("phone", "plate", "business", "resident", "email"):
        shown = F.when(F.col("kind") == kind, X.mask(kind, "value")).otherwise(shown)
    return sql(s, d, _VALS).select("kind", "value", shown.alias("masked"))


@query("ref_P11_masked_customers", "SELECT c_nationkey, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i)[1:3], ' ') AS examples FROM (SELECT c_nationkey, list('c*' || repeat('*', CAST(length(c_name) - 2 AS INT)) || '@' || c_mktsegment || '.test' ORDER BY c_custkey) AS k FROM (SELECT *, c_name FROM customer) GROUP BY 1)")
def masked_customers(s, d):
    """First three different masks per nation; the groups are cut to the first rows of each before they are gathered."""
    rows = sql(s, d, "SELECT c_nationkey, c_custkey, concat('c*', repeat('*', length(c_name) - 2), '@', c_mktsegment, '.test') AS k FROM customer")
    first = rows.groupBy("c_nationkey", "k").agg(F.min("c_custkey").alias("at"))
    from pyspark.sql import Window as W

    top = first.withColumn("r", F.row_number().over(W.partitionBy("c_nationkey").orderBy("at"))).where("r <= 3")
    return top.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "k"))), lambda x: x["k"]), " ").alias("examples"))
