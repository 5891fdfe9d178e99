"""Queries of the parser, graph, generator, source and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import patterns as P, text as X
from ledgerline.functions.ids import norm_id
from ledgerline.operators import changes, generators as N, graph as G, parsers as R
from ledgerline.plans import problems
from ledgerline.plans.common import sql
from ledgerline.plans.relational import I
from ledgerline.sources import files
from ledgerline.sources.shared import materialize, new_path, table
from ledgerline.streaming import ledger

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return keep


# Sources

_BODIES = "SELECT record_ref AS ref, body_json AS body FROM import_records UNION ALL SELECT result_ref, report_json FROM audit_results"


@query("ref_S2_strict_json", f"SELECT ref, coalesce(json_valid(body), false) AS valid, CASE WHEN json_valid(body) THEN json_type(body) = 'OBJECT' ELSE false END AS is_object FROM ({_BODIES})")
def s2(s, d):
    v = F.try_parse_json("body")
    return sql(s, d, _BODIES).select("ref", v.isNotNull().alias("valid"), F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False)).alias("is_object"))


_LINES = "SELECT CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN '' WHEN 1 THEN concat('# ', p_name) ELSE concat('https://x.test/', CAST(p_partkey AS STRING), chr(9), p_type, chr(9), 'more') END AS value FROM part"


@query("ref_S4_labelled_lines", "SELECT 'https://x.test/' || CAST(p_partkey AS STRING) AS address, p_type AS label FROM part WHERE p_partkey % 5 > 1")
def s4(s, d):
    return files.labelled_lines(sql(s, d, _LINES))


@query("ref_S5_inventory_validation", "SELECT array_to_string(list_filter([CASE WHEN provider IS NULL THEN 'no_provider' END, CASE WHEN target_id IS NULL THEN 'no_target' END, CASE WHEN coalesce(len(required_aliases), 0) = 0 THEN 'no_aliases' END, CASE WHEN withdrawn_at < registered_at THEN 'withdrawn_early' END], lambda x: x IS NOT NULL), ',') AS reasons, count(*) AS n FROM assets GROUP BY 1")
def s5(s, d):
    """Rows are not thrown away but carry the reasons why they are not valid."""
    rules = [("no_provider", F.col("provider").isNull()), ("no_target", F.col("target_id").isNull()), ("no_aliases", F.coalesce(F.size("required_aliases"), F.lit(0)) <= 0), ("withdrawn_early", F.col("withdrawn_at") < F.col("registered_at"))]
    return table(s, d, "assets").groupBy(F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules])), ",").alias("reasons")).agg(F.count("*").alias("n"))


@query("ref_S6_J7_candidate_channels", f"SELECT c.record_ref, c.node_path, c.url, k.channel_id IS NOT NULL AS channel_known FROM ({problems.ORACLE['p1_candidates']}) c LEFT JOIN (SELECT DISTINCT record_ref, channel_id FROM ({problems.ORACLE['p1_channels']})) k ON c.record_ref = k.record_ref AND c.channel_id = k.channel_id")
def s6(s, d):
    """Candidates of discovery imports and whether their channel is among the channels of the same import."""
    tables = problems._tables(s, d, "channels", "candidates")
    known = tables.kind("channels", {"channel_id": ("channel_id", "string")}).where("channel_id is not null").select("record_ref", "channel_id", F.lit(True).alias("known")).distinct()
    candidates = tables.kind("candidates", {"channel_id": ("channel_id", "string"), "url": ("url", "string")})
    return candidates.join(known, ["record_ref", "channel_id"], "left").select("record_ref", "node_path", "url", F.coalesce("known", F.lit(False)).alias("channel_known"))


@query("ref_K2_markdown", "SELECT '| ' || CAST(n_nationkey AS STRING) || ' | ' || n_name || ' |' AS line FROM nation")
def k2(s, d):
    return files.markdown_table(table(s, d, "nation"), ["n_nationkey", "n_name"], ["n_nationkey"])


@query("ref_K3_idempotent_append", "SELECT count(DISTINCT (event_id, payload_hash)) AS rows_kept FROM ledger_events WHERE event_id IN (SELECT event_id FROM ledger_events GROUP BY 1 HAVING count(DISTINCT payload_hash) = 1)")
def k3(s, d):
    e = table(s, d, "ledger_events").select("event_id", "payload_hash")
    sound = e.join(e.groupBy("event_id").agg(F.countDistinct("payload_hash").alias("k")).where("k = 1"), "event_id", "left_semi")
    target = new_path(s)
    files.append_events(sound, target)
    files.append_events(sound, target)
    return s.read.parquet(target).agg(F.count("*").alias("rows_kept"))


# Parsers

#: Pages made from parts, whose signals are known, and all pages, with the documents' captures.
_MADE_PAGES = "SELECT -1 - p_partkey AS id, concat('<html><body><p>Part ', p_name, '</p><div hidden><p>', p_brand, '</p></div><a href=\"/p/', CAST(p_partkey AS STRING), '\">x</a><input type=\"password\" value=\"v\"><script>var rows = [{\"a\": ', CAST(p_size AS STRING), '}]; fetch(\"/api\")</script><table><tr><th>commission rate</th></tr><tr><td>', CAST(p_size AS STRING), '%</td></tr></table></body></html>') AS body FROM part"
_PAGES = f"SELECT doc_id AS id, text AS body FROM documents WHERE doc_kind = 'page-capture' UNION ALL {_MADE_PAGES}"


@query("ref_U1_html_counters", "SELECT -1 - p_partkey AS id, 1 AS hidden_elements, 1 AS password_inputs, 1 AS script_elements, 1 AS n_links, p_brand AS hidden FROM part UNION ALL SELECT doc_id, 0, 0, 0, 0, '' FROM documents WHERE doc_kind = 'page-capture' AND text IS NOT NULL")
def u1(s, d):
    r = R.html_regions(sql(s, d, _PAGES))
    return r.select("id", *[F.col(c).cast("int").alias(c) for c in ("hidden_elements", "password_inputs", "script_elements")], F.size("links").alias("n_links"), "hidden")


@query("ref_C21_resolved_links", "SELECT -1 - p_partkey AS id, 'a' AS kind, 'https://app.example.test/p/' || CAST(p_partkey AS STRING) AS url FROM part")
def c21(s, d):
    return R.resolved_links(R.html_regions(sql(s, d, _PAGES)), "https://app.example.test/x/")


@query("ref_C33_A13_tables", "SELECT -1 - p_partkey AS id, 2 AS n_rows, 1 AS filled FROM part")
def c33(s, d):
    """Tables of pages whose head row speaks of commission, with the number of cells that hold an amount."""
    t = R.html_regions(sql(s, d, _PAGES)).select("id", F.explode("tables").alias("t")).where(F.array_join(F.flatten(F.slice("t", 1, 2)), " ").rlike(P.java("수수료|커미션|commission|incentive", True)))
    cells = F.flatten(F.slice("t", F.lit(2), F.size("t")))
    return t.select("id", F.size("t").alias("n_rows"), F.size(F.filter(cells, lambda c: c.rlike(P.java(P.AMOUNT, True)))).alias("filled"))


@query("ref_U3_js_literals", "SELECT -1 - p_partkey AS id, 'rows' AS name, '[{\"a\": ' || CAST(p_size AS STRING) || '}]' AS value_json FROM part")
def u3(s, d):
    scripts = R.html_regions(sql(s, d, _PAGES)).select("id", F.explode("scripts").alias("body"))
    return R.js_literals(scripts).where("reason is null").select("id", "name", "value_json")


_JS = "SELECT c_custkey AS id, concat('{\"customer_name\": ', CASE WHEN c_custkey % 4 = 0 THEN 'null' WHEN c_custkey % 4 = 1 THEN '\"sample\"' ELSE concat('\"', c_name, '\"') END, ', \"salary\": 0, \"list\": [{\"email\": \"x@y.test\"}, {\"phone\": \"\"}], \"note\": false}') AS body FROM customer"


@query("ref_U2_A12_field_counters", "SELECT c_custkey AS id, 6::BIGINT AS fields, 4::BIGINT AS known_sensitive, CASE WHEN c_custkey % 4 IN (0, 1) THEN 2::BIGINT ELSE 3::BIGINT END AS filled_sensitive, 1::BIGINT AS contacts FROM customer")
def u2(s, d):
    return R.field_counters(R.json_nodes(sql(s, d, _JS))).drop("truncated")


@query("ref_C27_category_profile", "SELECT 'customer_contact' AS category, 3 * count(*) AS candidates, CAST(sum(CASE WHEN c_custkey % 4 IN (0, 1) THEN 1 ELSE 2 END) AS BIGINT) AS filled FROM customer")
def c27(s, d):
    """Field-name categories over all bodies: candidates and filled fields that are no example."""
    n = R.json_nodes(sql(s, d, _JS)).select(F.explode(X.key_categories("key")).alias("category"), (F.col("filled") & ~F.col("example")).alias("real"))
    return n.groupBy("category").agg(F.count("*").alias("candidates"), F.count_if("real").alias("filled"))


_PATCH = "SELECT p_partkey AS id, concat('From 0123 x', chr(10), 'diff --git a/', p_brand, '.py b/', p_brand, '.py', chr(10), CASE WHEN p_size % 3 = 0 THEN concat('new file mode 100644', chr(10)) WHEN p_size % 3 = 1 THEN concat('deleted file mode 100644', chr(10)) ELSE '' END, '--- a/x', chr(10), '+++ b/x', chr(10), '@@ -1,2 +1,2 @@', chr(10), ' same', chr(10), '-old ', p_name, chr(10), '+new https://n.test/', CAST(p_size AS STRING), CASE WHEN p_size % 7 = 0 THEN '' ELSE chr(10) END, CASE WHEN p_size % 7 = 0 THEN concat(chr(10), '@@ -9,5 +9,5 @@', chr(10), ' cut') ELSE '' END) AS body FROM part"


@query("ref_U8_patch_files", "SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand || '.py' END AS path, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 3 = 0 THEN 'added' WHEN p_size % 3 = 1 THEN 'removed' ELSE 'modified' END AS status, CASE WHEN p_size % 7 = 0 THEN 'patch_provenance_invalid' END AS error FROM part")
def u8(s, d):
    return R.patch_lines(sql(s, d, _PATCH)).where("sign is null").select("id", "path", "status", "error")


@query("ref_P23_changed_lines", "SELECT p_partkey AS id, 'old ' || p_name AS line, '-' AS sign FROM part WHERE p_size % 7 <> 0 UNION ALL SELECT p_partkey, 'new https://n.test/' || CAST(p_size AS STRING), '+' FROM part WHERE p_size % 7 <> 0")
def p23(s, d):
    return R.patch_lines(sql(s, d, _PATCH)).where("sign is not null").select("id", "line", "sign")


@query("ref_SET4_patch_urls", "SELECT p_brand || '.py' AS path, count(DISTINCT p_size) AS introduced FROM part WHERE p_size % 7 <> 0 GROUP BY 1")
def set4(s, d):
    urls = R.patch_lines(sql(s, d, _PATCH)).where("sign = '+'").select("path", F.explode(F.regexp_extract_all("line", F.lit(r"https?://[^\s\"'<>]+"), F.lit(0))).alias("url"))
    return urls.groupBy("path").agg(F.countDistinct(F.regexp_replace("url", r"[.,);\]]+$", "")).alias("introduced"))


@query("ref_U9_chunks", "SELECT doc_id AS id, count(*) AS chunks, CAST(sum(least(500, n - k * 450)) AS BIGINT) AS chars FROM (SELECT doc_id, length(text) AS n, unnest(range(0, greatest(1, CAST(ceil((length(text) - 50) / 450) AS BIGINT)))) AS k FROM documents WHERE length(text) > 0) GROUP BY 1")
def u9(s, d):
    c = R.text_chunks(sql(s, d, "SELECT doc_id AS id, text AS body FROM documents"), 500, 50)
    return c.groupBy("id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


_TREE = "SELECT p_brand AS repo, p_partkey AS n, concat('{\"type\":\"', CASE WHEN p_partkey % 6 = 0 THEN 'tree' ELSE 'blob' END, '\",\"path\":\"src/', CAST(p_partkey % 300 AS STRING), '.csv\",\"sha\":\"', CASE WHEN p_partkey % 10 = 0 THEN 'bad' ELSE substr(concat(md5(CAST(p_partkey AS STRING)), md5(p_name)), 1, 40) END, '\",\"size\":', CAST(p_size AS STRING), '}') AS entry FROM part"


@query(
    "ref_U10_A16_tree",
    "WITH e AS (SELECT p_brand AS repo, p_partkey AS n, p_partkey % 300 AS f, p_partkey % 10 = 0 AS bad FROM part WHERE p_partkey % 6 <> 0), u AS (SELECT *, row_number() OVER (PARTITION BY repo, f ORDER BY n) AS r FROM e WHERE NOT bad) SELECT t.repo, entries, blobs, blobs - coalesce(kept, 0) AS rejected, coalesce(kept, 0) AS emitted, CASE WHEN blobs > coalesce(kept, 0) THEN 'RECORDS_REJECTED' ELSE '' END AS error_code FROM (SELECT p_brand AS repo, count(*) AS entries, count(*) FILTER (p_partkey % 6 <> 0) AS blobs FROM part GROUP BY 1) t LEFT JOIN (SELECT repo, count(*) AS kept FROM u WHERE r = 1 GROUP BY 1) k ON t.repo = k.repo",
)
def u10(s, d):
    """Tree pages as JSON, read with a declared schema; invalid and repeated paths are counted, not thrown."""
    page = sql(s, d, _TREE).groupBy("repo").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda x: x["entry"]).alias("tree"))).alias("body"))
    tree = page.select("repo", F.posexplode(F.from_json("body", "tree array<string>")["tree"]).alias("n", "entry")).select("repo", "n", F.from_json("entry", "type string, path string, sha string, size bigint").alias("e")).select("repo", "n", "e.*")
    valid = (F.col("type") == "blob") & F.col("sha").rlike("^[0-9a-f]{40}$") & (F.col("size") >= 0) & ~F.col("path").rlike(r"(^|/)\.\.?(/|$)|^/")
    files_ = tree.groupBy("repo", F.when(valid, F.col("path")).alias("p")).agg(F.count("*").alias("entries"), F.count_if(F.col("type") == "blob").alias("blobs"))
    out = files_.groupBy("repo").agg(F.sum("entries").alias("entries"), F.sum("blobs").alias("blobs"), F.count("p").alias("emitted"))
    rejected = F.col("blobs") - F.col("emitted")
    return out.select("repo", "entries", "blobs", rejected.alias("rejected"), "emitted", F.when(rejected > 0, "RECORDS_REJECTED").otherwise("").alias("error_code"))


@query("ref_U12_names", "SELECT DISTINCT c_custkey % 50 AS root, 'h' || CAST(c_custkey AS STRING) || '.r' || CAST(c_custkey % 50 AS STRING) || '.test' AS name FROM customer WHERE c_custkey % 3 <> 0")
def u12(s, d):
    rows = table(s, d, "customer").select((F.col("c_custkey") % 50).alias("root"), F.concat(F.when(F.col("c_custkey") % 3 == 0, "*.").otherwise(""), F.lit("h"), F.col("c_custkey").cast("string"), F.lit(".r"), (F.col("c_custkey") % 50).cast("string"), F.lit(".test\nother.example")).alias("names"))
    each = rows.select("root", F.explode(F.split("names", "\n")).alias("name"))
    return each.where(~F.startswith("name", F.lit("*")) & F.endswith("name", F.concat(F.lit(".r"), F.col("root").cast("string"), F.lit(".test")))).distinct()


_JAMO = ["g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h"]


@query("ref_U13_hangul", f"SELECT first, count(*) AS words FROM (SELECT {_JAMO!r}[(unicode(w) - 44032) // 588 + 1] AS first FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\x{{AC00}}-\\x{{D7A3}}]{{2,}}')) AS w FROM documents)) WHERE first <> '' GROUP BY 1")
def u13(s, d):
    """Initials of the different Korean words of all documents, counted; words with a mute initial left out."""
    words = table(s, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[\\uac00-\\ud7a3]{2,}"), F.lit(0))).alias("w")).distinct()
    first = F.regexp_extract(N.romanize(F.left("w", F.lit(1))), "^(kk|tt|pp|ss|jj|ch|[gndrmbsjktph])", 1)
    return words.select(first.alias("first")).where("first <> ''").groupBy("first").agg(F.count("*").alias("words"))


_PATHS_JSON = "SELECT p_partkey AS id, concat(CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN '/abs/' WHEN 1 THEN 'a/../' WHEN 2 THEN 'a//' ELSE 'src/' END, 'f', CAST(p_partkey AS STRING), CASE CAST(p_size % 6 AS INT) WHEN 0 THEN '.CSV' WHEN 1 THEN '.pdf' WHEN 2 THEN '.vue' WHEN 3 THEN '.env' WHEN 4 THEN '' ELSE '.bin' END) AS path FROM part"


# Graphs

_GRAPH = """SELECT event_id AS ordinal, concat('s', CAST(user_id % 7 AS STRING)) AS scope_id, CASE WHEN event_id % 3 = 0 THEN 'owner_inventory' ELSE 'public_discovery' END AS source_kind, concat('src', CAST(event_id % 5 AS STRING)) AS source_id,
 concat('r', CAST(event_id % 3000 AS STRING)) AS source_record_id, concat('opaque:', md5(CAST(event_id % 1500 AS STRING))) AS locator_ref, concat('a', CAST(user_id AS STRING)) AS asset_id, CASE WHEN event_id % 4 = 0 THEN 'al' END AS alias_id, 'observed_at' AS relationship,
 CASE WHEN event_id % 6 = 0 THEN 'ev' END AS ownership_evidence, CASE WHEN event_id % 9 = 0 THEN 'partial' ELSE 'complete' END AS coverage_state, CASE WHEN event_type = 'view' THEN 'observed' ELSE 'candidate' END AS existence_state,
 CASE WHEN event_type = 'purchase' THEN 'related' WHEN event_type = 'error' THEN 'low' ELSE 'unknown' END AS business_relevance, CASE WHEN event_id % 12 = 0 THEN 'approved' ELSE 'unknown' END AS publication_approval FROM events"""
_KEPT = f"""WITH g AS ({_GRAPH}), h AS (SELECT *, concat_ws('|', source_kind, locator_ref, asset_id, coalesce(alias_id, '-'), coalesce(ownership_evidence, '-'), coverage_state, existence_state, business_relevance, publication_approval) AS c FROM g),
f AS (SELECT *, first_value(c) OVER k AS c0, row_number() OVER k AS rn FROM h WINDOW k AS (PARTITION BY scope_id, source_id, source_record_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
conf AS (SELECT scope_id, source_id, source_record_id, count(*) FILTER (c <> c0) AS conflicts FROM f GROUP BY ALL), kept AS (SELECT f.*, conflicts FROM f JOIN conf USING (scope_id, source_id, source_record_id) WHERE rn = 1),
nodes AS (SELECT scope_id, locator_ref, CASE WHEN bool_or(conflicts > 0) THEN 'disputed' WHEN bool_or(source_kind = 'owner_inventory' AND ownership_evidence IS NOT NULL) THEN 'evidence_linked' ELSE 'ownership_pending' END AS ownership_state,
 CASE WHEN bool_or(existence_state = 'observed') THEN 'observed' ELSE 'candidate' END AS existence_state, CASE WHEN bool_or(business_relevance = 'related') THEN 'related' WHEN bool_or(business_relevance = 'low') THEN 'low' ELSE 'unknown' END AS business_relevance,
 CASE WHEN bool_or(source_kind = 'owner_inventory' AND ownership_evidence IS NOT NULL AND publication_approval = 'approved') THEN 'approved' ELSE 'unknown' END AS publication_approval,
 count(DISTINCT asset_id) AS n_assets, count(*) AS source_record_count, bool_or(source_kind = 'public_discovery') AS discovered, bool_or(source_kind = 'owner_inventory' AND ownership_evidence IS NOT NULL) AS owned FROM kept GROUP BY 1, 2) """


def _kept(s, d):
    return G.kept_records(sql(s, d, _GRAPH))


@query("ref_G1_A6_graph_nodes", _KEPT + "SELECT * EXCLUDE (discovered, owned) FROM nodes")
def g1(s, d):
    return G.nodes(_kept(s, d)).drop("discovered", "owned")


@query("ref_G1_node_assets", _KEPT + "SELECT DISTINCT scope_id, locator_ref, asset_id FROM kept WHERE asset_id IS NOT NULL")
def g1_assets(s, d):
    return G.node_assets(_kept(s, d))


@query("ref_G1_links", _KEPT + "SELECT k.scope_id, source_id, source_record_id, k.locator_ref, CASE WHEN conflicts > 0 THEN 'disputed' WHEN source_kind = 'owner_inventory' AND ownership_evidence IS NOT NULL THEN ownership_state ELSE 'candidate_signal' END AS link_state FROM kept k JOIN nodes n ON k.scope_id = n.scope_id AND k.locator_ref = n.locator_ref")
def g1_links(s, d):
    kept = materialize(_kept(s, d))
    return G.links(kept, G.nodes(kept))


@query("ref_A7_graph_conflicts", _KEPT + "SELECT scope_id, source_id, source_record_id, conflicts FROM conf WHERE conflicts > 0")
def a7(s, d):
    return _kept(s, d).where("conflicts > 0").select("scope_id", "source_id", "source_record_id", "conflicts")


@query("ref_A8_graph_gaps", _KEPT + "SELECT scope_id, source_id || '/' || source_record_id AS ref, coverage_state FROM kept WHERE coverage_state <> 'complete' UNION ALL SELECT scope_id, locator_ref, 'ownership_evidence_missing' FROM nodes WHERE discovered AND NOT owned")
def a8(s, d):
    kept = materialize(_kept(s, d))
    return G.gaps(kept, G.nodes(kept))


_EDGES = "SELECT DISTINCT user_id AS source, (user_id * 7 + event_id % 5) % 211 AS target FROM events"


@query("ref_G3_G4_reach", f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT 1::BIGINT AS node, 0::BIGINT AS distance UNION SELECT e.target, r.distance + 1 FROM r JOIN e ON r.node = e.source WHERE r.distance < 4) SELECT node, min(distance) AS distance FROM r GROUP BY 1")
def g3(s, d):
    return G.reach(sql(s, d, _EDGES), s.createDataFrame([(1,)], "node bigint"), 4)


_REDIRECTS = f"SELECT source, target, source % 3 = 0 AS redirect FROM ({_EDGES})"
_REACHED = f"WITH RECURSIVE e AS ({_REDIRECTS}), r AS (SELECT 1::BIGINT AS node, 0::BIGINT AS distance UNION SELECT e.target, r.distance + CASE WHEN e.redirect THEN 0 ELSE 1 END FROM r JOIN e ON r.node = e.source WHERE r.distance + CASE WHEN e.redirect THEN 0 ELSE 1 END <= 4), d AS (SELECT node, min(distance) AS distance FROM r WHERE node IS NOT NULL GROUP BY 1) "


@query("ref_G4_redirects", _REACHED + "SELECT node, distance FROM d")
def g4(s, d):
    """Links of every third node are redirects, which keep the distance."""
    return G.reach(sql(s, d, _REDIRECTS), s.createDataFrame([(1,)], "node bigint"), 4)


@query("ref_G3_request_budget", _REACHED + "SELECT node, distance FROM d ORDER BY distance, node LIMIT 12")
def g3_budget(s, d):
    """The first 12 nodes that a traversal passes: the budget is the feature."""
    return G.reach(sql(s, d, _REDIRECTS), s.createDataFrame([(1,)], "node bigint"), 4, 12)


# Generators

_NAMES = "SELECT DISTINCT concat(lower(n_name), ' ', lower(c_mktsegment), ' trading group') AS name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT * FROM (VALUES ('별빛렌터카 주식회사'), ('㈜한울 테크놀로지'), ('코리아별빛'), ('그룹'), ('유한회사 새봄 에너지 코리아'), ('푸른 harbor co ltd')) AS v(name)"


_ROMAN = "array_to_string(list_transform(list_filter(string_split({0}, ''), lambda c: c BETWEEN '가' AND '힣'), lambda c: " + f"{N.INITIAL!r}[(unicode(c) - 44032) // 588 + 1] || {N.VOWEL!r}[(unicode(c) - 44032) % 588 // 28 + 1] || {N.FINAL!r}[(unicode(c) - 44032) % 28 + 1]" + "), '')"
_FIRST = "array_to_string(list_transform(list_filter(string_split({0}, ''), lambda c: c BETWEEN '가' AND '힣'), lambda c: " + f"CASE WHEN {N.INITIAL!r}[(unicode(c) - 44032) // 588 + 1] = '' THEN {N.VOWEL!r}[(unicode(c) - 44032) % 588 // 28 + 1][1:1] ELSE {N.INITIAL!r}[(unicode(c) - 44032) // 588 + 1] END" + "), '')"
_KINDS = ", ".join(f"('{k}', {i}, {w})" for i, (k, w) in enumerate(N.STEM_KINDS.items()))
_SQL_STEMS = f"""WITH n0 AS (SELECT name, regexp_extract_all(replace(name, '㈜', '(주)'), '[a-z0-9]+') AS w0, CASE WHEN regexp_matches(name, '[가-힣]') THEN regexp_replace(replace(name, '㈜', '(주)'), '\\s+', '', 'g') END AS h FROM ({{names}})),
n1 AS (SELECT name, h, w0[1:len(w0) - coalesce(list_position(list_transform(list_reverse(w0), lambda x: NOT list_contains({N.LEGAL_TAILS!r}, x)), true) - 1, len(w0))] AS w, regexp_replace(regexp_replace(h, '^(?:주식회사|유한회사|\\(주\\))(.)', '\\1'), '(.)(?:주식회사|유한회사|홀딩스|코리아|컴퍼니|\\(주\\)|그룹)$', '\\1') AS bare FROM n0),
n AS (SELECT *, list_filter({N.HANGUL_TAILS!r}, lambda t: ends_with(bare, t) AND length(bare) > length(t))[1] AS tail FROM n1),
a AS (SELECT name, 'name' AS why, array_to_string(w, '') AS stem FROM n
  UNION ALL SELECT name, 'initialism', CASE WHEN len(w) > 1 THEN array_to_string(list_transform(w, lambda x: x[1:1]), '') END FROM n
  UNION ALL SELECT name, 'compound', array_to_string(w[1:k], '') || '-' || array_to_string(w[k + 1:], '') FROM (SELECT name, w, unnest(range(1, len(w))) AS k FROM n)
  UNION ALL SELECT name, 'leading-word', w[1] FROM n UNION ALL SELECT name, 'word', unnest(w[2:]) FROM n
  UNION ALL SELECT name, 'hangul-original', {_ROMAN.format('h')} FROM n UNION ALL SELECT name, 'hangul-original-initials', {_FIRST.format('h')} FROM n
  UNION ALL SELECT name, 'hangul-stem', {_ROMAN.format('bare[1:length(bare) - length(tail)]')} FROM n WHERE tail IS NOT NULL UNION ALL SELECT name, 'hangul-stem-initials', {_FIRST.format('bare[1:length(bare) - length(tail)]')} FROM n WHERE tail IS NOT NULL
  UNION ALL SELECT name, 'hangul-tail', {_ROMAN.format('tail')} FROM n UNION ALL SELECT name, 'hangul-whole', {_ROMAN.format('bare')} FROM n UNION ALL SELECT name, 'hangul-whole-initials', {_FIRST.format('bare')} FROM n),
b AS (SELECT * FROM a WHERE length(stem) >= 2), f AS (SELECT * FROM b WHERE why <> 'initialism' AND length(stem) >= 5),
c AS (SELECT * FROM b UNION ALL SELECT name, 'devowelled', x FROM (SELECT name, stem, stem[1:1] || regexp_replace(stem[2:], '[aeiou]', '', 'g') AS x FROM f) WHERE length(x) > 2 AND length(x) < length(stem) UNION ALL SELECT name, 'truncated', stem[1:4] FROM f)
SELECT name, stem, arg_min(why, k) AS why, arg_min(wt, k) AS weight FROM c JOIN (VALUES {_KINDS}) v(why, k, wt) USING (why) GROUP BY 1, 2"""


@query("ref_N1_stems", _SQL_STEMS.format(names=_NAMES))
def n1(s, d):
    return N.stems(sql(s, d, _NAMES))


@query("ref_N2_W11_candidates")
def n2(s, d):
    words = s.createDataFrame([(w, i) for i, w in enumerate(("sales", "partners", "dashboard", "dev", "admin", "team", "data", "api"))], "word string, word_no int")
    return N.combine(N.stems(sql(s, d, _NAMES)), words, 60)


@query("ref_N3_word_prefixes")
def n3(s, d):
    return N.word_prefixes(sql(s, d, _NAMES), ["sales", "admin", "dev"])


@query("ref_N5_spellings", "SELECT DISTINCT s FROM (SELECT replace(replace(n_name, 'A', CASE WHEN m & 1 = 1 THEN '4' ELSE 'A' END), 'E', CASE WHEN m & 2 = 2 THEN '3' ELSE 'E' END) AS s FROM nation, range(0, 4) r(m))")
def n5(s, d):
    """All spellings by a mask of replacements, each once."""
    m = table(s, d, "nation").select("n_name", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("m"))
    a = F.when(F.col("m").bitwiseAND(F.lit(1)) == 1, "4").otherwise("A")
    e = F.when(F.col("m").bitwiseAND(F.lit(2)) == 2, "3").otherwise("E")
    return m.select(F.replace(F.replace(F.col("n_name"), F.lit("A"), a), F.lit("E"), e).alias("s")).distinct()


@query("ref_N7_N8_templates", "SELECT n_name AS candidate, platform, replace(template, '{c}', n_name) AS url FROM nation, (VALUES ('pages', 'https://{c}.pages.test/'), ('forge', 'https://forge.test/{c}')) t(platform, template)")
def n8(s, d):
    t = s.createDataFrame([("pages", "https://{c}.pages.test/"), ("forge", "https://forge.test/{c}")], "platform string, template string")
    return N.from_templates(table(s, d, "nation").select(F.col("n_name").alias("candidate")), t)


# Streaming

@query("ref_ST1_ST3_stream_state")
def st1(s, d):
    """The present state from a stream of events in four micro-batches: equal to p5_found's.

    Rows are dealt to files by sequence, so an event_id sent again with another one comes in other batches as well.
    """
    folder = new_path(s)
    files = max(4, int(s.conf.get("spark.sql.shuffle.partitions")))
    table(s, d, "ledger_events").repartition(files, "sequence").write.parquet(f"{folder}/in")
    ledger.fold_stream(ledger.read_events(s, f"{folder}/in", -(-files // 4)), f"{folder}/state", f"{folder}/offsets")
    return changes.current_fields(ledger.newest_state(s, f"{folder}/state")).select("entity_id", "field_name", "sequence")


@query("ref_ST10_custody_heads", f"SELECT entity_id, count(*) AS links, list_reduce(list_prepend(repeat('0', 64), list(sha256(coalesce(payload_json, '')) ORDER BY sequence, event_id, payload_json NULLS FIRST)), lambda acc, x: sha256(acc || x)) AS head FROM (SELECT DISTINCT {I('entity_id')} AS entity_id, sequence, event_id, payload_json FROM ledger_events) WHERE entity_id IS NOT NULL GROUP BY 1")
def st10(s, d):
    from ledgerline.operators.sequences import hash_chain

    e = table(s, d, "ledger_events").select(norm_id("entity_id").alias("entity_id"), "sequence", "event_id", "payload_json").where("entity_id is not null").distinct()
    return hash_chain(e, "entity_id", ["sequence", "event_id", "payload_json"], F.col("payload_json"))


@query("ref_stream_events_by_hour", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def by_hour(s, d):
    """The batch form of the windowed stream count."""
    return table(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")




ORACLE["ref_ST1_ST3_stream_state"] = problems.ORACLE["p5_found"]
