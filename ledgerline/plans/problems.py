"""The pN_ queries of the general problems 1 to 5."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.operators import changes, hierarchy, intervals, nested, references
from ledgerline.sources.shared import materialize, table


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return nested.flatten(nested.audit_records(table(s, d, "import_records"), table(s, d, "audit_results")))


def _tables(s: SparkSession, d: str, *kinds: str) -> nested.SubtypeTables:
    """The typed tables of all kinds, or of some."""
    nodes = _nodes(s, d)
    return nested.route(nodes.where(F.col("node_kind").isin(*kinds)) if kinds else nodes)


def p1_found(s: SparkSession, d: str) -> DataFrame:
    """The supertype's keys and parent links, read from the typed tables of all variants."""
    return _tables(s, d).supertype().select("record_ref", "node_kind", "parent_path", "node_path")


def p1_variants(s: SparkSession, d: str) -> DataFrame:
    return nested.variants(_nodes(s, d))


def p1_signatures(s: SparkSession, d: str) -> DataFrame:
    """How many elements of each kind have which own fields of which codes (n: null)."""
    fields = F.transform(F.map_entries("own"), lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(F.left(e["value"], F.lit(1)), F.lit("n"))))
    return _nodes(s, d).groupBy("node_kind", F.array_join(F.array_sort(fields), ",").alias("signature")).agg(F.count(F.lit(1)).alias("n_nodes"))


_COUNT = ["bigint", "double", "string"]
#: Fields of the kinds with the types they come in. Fixed values.
FIELDS = {
    "channels": {"channel_id": ["string"], "state": ["string"], "complete": ["boolean"], "observed_at": ["string"], "pages": _COUNT, "items": _COUNT, "source_ref": ["string"]},
    "attempts": {"attempted_at": ["string"], "state": ["string"], "pages": _COUNT, "result_count": _COUNT, "error_code": ["string"]},
    "candidates": {"parent_candidate_id": ["string"], "url": ["string"], "kind": ["string"], "channel_id": ["string"], "observed_at": ["string"], "score_inputs": ["string"]},
    "repositories": {"repository": ["string"], "branch": ["string"], "ownership_status": ["string"], "owner_ref": ["string"], "deployment_urls": ["string"]},
    "pages": {"page_url": ["string"], "evidence_ref": ["string"]},
    "signals": {"code": ["string"], "occurrences": _COUNT, "masked_examples": ["string"], "confidence": ["string"]},
    "categories": {"category": ["string"], "candidate_count": _COUNT, "filled_field_count": _COUNT},
    "columns": {"name_hash": ["string"], "filled": _COUNT},
    "members": {"classifier_version": ["string"], "content": ["string"], "member_ref": ["string"]},
}


def typed(s: SparkSession, d: str, *kinds: str) -> list[DataFrame]:
    """The kinds' elements with typed columns, from the tables of their variants."""
    tables = _tables(s, d, *kinds)
    return [tables.kind(k, nested.named_columns(FIELDS[k])).drop("variant") for k in kinds]


def p1_typed(s: SparkSession, d: str, kind: str) -> DataFrame:
    return typed(s, d, kind)[0]


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(*references.audit_references(*(table(s, d, t) for t in ("assets", "observations", "findings", "audit_jobs", "audit_results"))))


def p2_counts(s: SparkSession, d: str) -> DataFrame:
    return references.orphan_counts(p2_found(s, d))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return intervals.audit_periods(table(s, d, "audit_runs"))


def p3_activity(s: SparkSession, d: str) -> DataFrame:
    """Periods, gaps and covered time of each case."""
    length = F.col("end_us") - F.col("start_us")
    sums = [F.sum(F.when(F.col("kind") == k, v)).alias(f"{k}_{n}") for k in ("period", "gap") for n, v in (("us", length),)]
    return p3_found(s, d).groupBy("case_id").agg(F.count_if(F.col("kind") == "period").alias("n_periods"), F.count_if(F.col("kind") == "gap").alias("n_gaps"), *sums)


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return hierarchy.audit_hierarchy(table(s, d, "audit_jobs"))


def _tree(s: SparkSession, d: str) -> DataFrame:
    return materialize(hierarchy.climb(hierarchy.audit_links(table(s, d, "audit_jobs"))))


def p4_descendants(s: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_tree(s, d))


def p4_subtrees(s: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendant_counts(_tree(s, d))


def p5_state(s: SparkSession, d: str) -> DataFrame:
    return changes.ledger_state(table(s, d, "ledger_events"))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return p5_state(s, d).select("entity_id", "field_name", "sequence")


def p5_batches(s: SparkSession, d: str) -> DataFrame:
    """The same state from two batches of events as sent, odd sequences first: repeats are settled across them."""
    events, odd = table(s, d, "ledger_events"), F.col("sequence") % 2 == 1
    base = materialize(changes.settled_events(events.where(odd)))
    return changes.ledger_state(events.where(~odd), base).select("entity_id", "field_name", "sequence")


QUERIES = {f.__name__: f for f in (p1_found, p1_variants, p1_signatures, p2_found, p2_counts, p3_found, p3_activity, p4_found, p4_descendants, p4_subtrees, p5_found, p5_state, p5_batches)}
QUERIES |= {f"p1_{k}": partial(p1_typed, kind=k) for k in nested.LIST_FIELDS}

_ID = "nullif(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '')"
_JOBS = f"""jobs AS (SELECT job_id, case_id, parent_job_id, created_at, updated_at, purged_at, result_refs FROM (
  SELECT {_ID.format('job_id')} AS job_id, {_ID.format('case_id')} AS case_id, {_ID.format('parent_job_id')} AS parent_job_id, created_at, updated_at, purged_at, result_refs,
    row_number() OVER (PARTITION BY {_ID.format('job_id')} ORDER BY updated_at DESC) AS rn FROM audit_jobs) WHERE rn = 1 AND job_id IS NOT NULL)"""
_P2 = f"""WITH {_JOBS},
refs AS (
  SELECT 'observations' AS ref_table, 'asset_id' AS ref_field, 'assets' AS target, {_ID.format('observation_id')} AS row_id, {_ID.format('asset_id')} AS k, observed_at AS t FROM observations
  UNION ALL SELECT 'findings', 'asset_id', 'assets', {_ID.format('finding_id')}, {_ID.format('asset_id')}, opened_at FROM findings
  UNION ALL SELECT 'audit_results', 'job_id', 'audit_jobs', {_ID.format('result_ref')}, {_ID.format('job_id')}, saved_at FROM audit_results
  UNION ALL SELECT 'audit_jobs', 'result_refs', 'audit_results', job_id, {_ID.format('r')}, updated_at FROM (SELECT job_id, updated_at, unnest(result_refs) AS r FROM jobs)),
targets AS (
  SELECT 'assets' AS target, {_ID.format('asset_id')} AS k, max(registered_at) AS made, max(withdrawn_at) AS gone FROM assets GROUP BY 1, 2
  UNION ALL SELECT 'audit_jobs', job_id, created_at, purged_at FROM jobs
  UNION ALL SELECT 'audit_results', {_ID.format('result_ref')}, max(saved_at), max(purged_at) FROM audit_results GROUP BY 1, 2),
found AS (SELECT DISTINCT ref_table, ref_field, row_id, r.k AS missing_id,
  CASE WHEN g.k IS NULL THEN 'absent' WHEN gone <= t THEN 'withdrawn' WHEN made > t THEN 'late' END AS reason, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS ref_month
  FROM refs r LEFT JOIN targets g ON r.target = g.target AND r.k = g.k WHERE r.k IS NOT NULL)
"""
_P3 = f"""WITH runs AS (SELECT {_ID.format('case_id')} AS case_id, epoch_us(started_at) AS s, epoch_us(coalesce(ended_at, last_checked_at)) AS e FROM audit_runs),
sound AS (SELECT * FROM runs WHERE case_id IS NOT NULL AND e > s),
reach AS (SELECT *, max(e) OVER (PARTITION BY case_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sound),
islands AS (SELECT *, sum(CASE WHEN before >= s THEN 0 ELSE 1 END) OVER (PARTITION BY case_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM reach),
periods AS (SELECT case_id, min(s) AS start_us, max(e) AS end_us FROM islands GROUP BY case_id, island),
found AS (SELECT case_id, 'period' AS kind, start_us, end_us FROM periods
  UNION ALL SELECT * FROM (SELECT case_id, 'gap', end_us, lead(start_us) OVER (PARTITION BY case_id ORDER BY start_us) AS n FROM periods) WHERE n IS NOT NULL)
"""
_P4 = f"""WITH RECURSIVE {_JOBS},
edges AS (SELECT j.job_id, p.job_id AS parent FROM jobs j LEFT JOIN jobs p ON j.parent_job_id = p.job_id AND j.case_id IS NOT DISTINCT FROM p.case_id),
tree AS (SELECT job_id, job_id AS root, 0::BIGINT AS depth, [job_id] AS path FROM edges WHERE parent IS NULL
  UNION ALL SELECT e.job_id, t.root, t.depth + 1, list_append(t.path, e.job_id) FROM edges e JOIN tree t ON e.parent = t.job_id),
up AS (SELECT job_id AS first_id, parent AS at_id FROM edges WHERE job_id NOT IN (SELECT job_id FROM tree)
  UNION SELECT u.first_id, e.parent FROM up u JOIN edges e ON u.at_id = e.job_id),
loops AS (SELECT first_id AS job_id FROM up WHERE first_id = at_id),
behind AS (SELECT job_id, job_id AS root, 0::BIGINT AS depth, [job_id] AS path FROM loops
  UNION ALL SELECT e.job_id, b.root, b.depth + 1, list_append(b.path, e.job_id) FROM edges e JOIN behind b ON e.parent = b.job_id WHERE e.job_id NOT IN (SELECT job_id FROM loops)),
found AS (SELECT job_id, 'tree' AS node_kind, root AS root_job_id, depth AS node_depth, array_to_string(path, '/') AS job_path, path FROM tree
  UNION ALL SELECT job_id, CASE WHEN depth = 0 THEN 'cycle' ELSE 'below' END, root, depth, array_to_string(path, '/'), path FROM behind),
pairs AS (SELECT path[i::BIGINT] AS ancestor, job_id AS node, node_depth - i + 1 AS distance FROM (SELECT *, unnest(range(1, node_depth + 1)) AS i FROM found WHERE node_kind <> 'cycle'))
"""
_P5 = f"""WITH good AS (SELECT {_ID.format('event_id')} AS event_id, sequence, event_type, {_ID.format('entity_id')} AS entity_id, payload_json FROM ledger_events WHERE sha256(payload_json) = payload_hash),
ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY sequence) AS rn FROM good) WHERE rn = 1 AND event_type <> 'OBSERVATION_ADDED'),
gone AS (SELECT entity_id, max(sequence) AS g FROM ev WHERE event_type LIKE '%\\_WITHDRAWN' ESCAPE '\\' GROUP BY 1),
since AS (SELECT e.entity_id, min(sequence) AS s FROM ev e LEFT JOIN gone USING (entity_id) WHERE event_type IN ('ASSET_REGISTERED', 'FINDING_OPENED', 'JOB_ENQUEUED') AND (g IS NULL OR sequence > g) GROUP BY 1),
fields AS (SELECT entity_id, sequence, unnest(json_keys(payload_json)) AS field_name FROM ev WHERE event_type NOT LIKE '%\\_WITHDRAWN' ESCAPE '\\' AND json_type(payload_json) = 'OBJECT'),
found AS (SELECT entity_id, field_name, max(sequence) AS sequence FROM fields JOIN since USING (entity_id) WHERE sequence >= s GROUP BY 1, 2)
"""
_OPEN = "CASE WHEN json_type({0}) = 'VARCHAR' AND regexp_matches(ltrim({0} ->> '$'), '^[\\[{{]') AND json_valid({0} ->> '$') THEN CAST({0} ->> '$' AS JSON) ELSE {0} END"
_FIELDS = "(" + ", ".join(f"'{x}'" for x in nested.LIST_FIELDS) + ")"
_P1 = f"""WITH RECURSIVE raw AS (SELECT {_ID.format('record_ref')} AS ref, received_at AS t, body_json AS body FROM import_records UNION ALL SELECT {_ID.format('result_ref')}, ingested_at, report_json FROM audit_results),
b AS (SELECT ref, CAST(body AS JSON) AS j FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY t DESC, body DESC) AS rn FROM raw WHERE ref IS NOT NULL AND json_valid(body)) WHERE rn = 1),
w AS (SELECT ref, {_OPEN.format('j')} AS v, '' AS path, '' AS parent, NULL::VARCHAR AS kind FROM b
  UNION ALL SELECT ref, child, CASE WHEN isobj THEN path || CASE WHEN path = '' THEN '' ELSE '.' END || k || CASE WHEN k IN {_FIELDS} AND json_type(child) = 'OBJECT' THEN '[0]' ELSE '' END ELSE path || '[' || k || ']' END, p,
    CASE WHEN isobj AND k IN {_FIELDS} THEN k WHEN NOT isobj AND json_type(child) = 'OBJECT' THEN kind END
  FROM (SELECT ref, path, kind, p, isobj, k, {_OPEN.format('c')} AS child FROM (SELECT *, CASE WHEN isobj THEN json_extract(v, '$."' || k || '"') ELSE json_extract(v, '$[' || k || ']') END AS c
    FROM (SELECT ref, v, path, kind, json_type(v) = 'OBJECT' AS isobj, CASE WHEN json_type(v) = 'OBJECT' AND kind IS NOT NULL THEN path ELSE parent END AS p,
      unnest(CASE WHEN json_type(v) = 'OBJECT' THEN json_keys(v) WHEN json_type(v) = 'ARRAY' THEN list_transform(range(CAST(json_array_length(v) AS BIGINT)), lambda i: CAST(i AS VARCHAR)) ELSE [] END) AS k FROM w)))
  WHERE json_type(child) IN ('OBJECT', 'ARRAY')),
found AS (SELECT ref AS record_ref, kind AS node_kind, parent AS parent_path, regexp_extract(parent, '([a-z]+)\\[[0-9]+\\]$', 1) AS parent_kind, path AS node_path, v FROM w WHERE kind IS NOT NULL AND json_type(v) = 'OBJECT')
"""
_AT = "json_extract(v, '$.\"' || k || '\"')"
_CASES = {"boolean": "WHEN 'BOOLEAN' THEN CAST({0} AS BOOLEAN)", "bigint": "WHEN 'BIGINT' THEN CAST({0} AS BIGINT) WHEN 'UBIGINT' THEN CAST({0} AS BIGINT)", "double": "WHEN 'DOUBLE' THEN CAST({0} AS DOUBLE)", "string": "WHEN 'VARCHAR' THEN {0} ->> '$' WHEN 'ARRAY' THEN CAST({0} AS VARCHAR) WHEN 'OBJECT' THEN CAST({0} AS VARCHAR)"}


def _typed_sql(kind: str) -> str:
    """The typed columns of a kind from the type of each JSON value."""
    x = lambda f: f"json_extract(v, '$.\"{f}\"')"
    columns = [f"CASE json_type({x(f)}) {_CASES[t].format(x(f))} END AS {name}" for name, (f, t) in nested.named_columns(FIELDS[kind]).items()]
    return _P1 + f"SELECT record_ref, node_path, parent_path, coalesce(parent_kind, '') AS parent_kind, {', '.join(columns)} FROM found WHERE node_kind = '{kind}'"


ORACLE = {
    **{f"p1_{k}": _typed_sql(k) for k in nested.LIST_FIELDS},
    "p1_signatures": _P1
    + f"""SELECT node_kind, signature, count(*) AS n_nodes FROM (SELECT node_kind, array_to_string(list_sort(list_filter(list_transform(json_keys(v), lambda k: CASE WHEN k IN {_FIELDS} AND json_type({_OPEN.format(_AT)}) IN ('ARRAY', 'OBJECT') THEN NULL
  ELSE k || ':' || CASE json_type({_OPEN.format(_AT)}) WHEN 'NULL' THEN 'n' WHEN 'BOOLEAN' THEN 'b' WHEN 'BIGINT' THEN 'i' WHEN 'UBIGINT' THEN 'i' WHEN 'DOUBLE' THEN 'f' WHEN 'VARCHAR' THEN 't' ELSE 'j' END END), lambda x: x IS NOT NULL)), ',') AS signature FROM found) GROUP BY 1, 2""",
    "p1_found": _P1 + "SELECT record_ref, node_kind, parent_path, node_path FROM found",
    "p5_state": _P5.replace("found AS (", "unused AS (") + "SELECT entity_id, field_name, max(sequence) AS sequence, arg_max(struct_pack(v := json_extract_string(payload_json, '$.\"' || field_name || '\"')), sequence).v AS value FROM (SELECT f.*, e.payload_json FROM fields f JOIN ev e USING (entity_id, sequence)) JOIN since USING (entity_id) WHERE sequence >= s GROUP BY 1, 2",
    "p2_found": _P2 + "SELECT * FROM found WHERE reason IS NOT NULL",
    "p2_counts": _P2 + "SELECT ref_table, ref_field, ref_month, reason, count(*) AS n_references, count(DISTINCT missing_id) AS n_missing FROM found WHERE reason IS NOT NULL GROUP BY 1, 2, 3, 4",
    "p3_found": _P3 + "SELECT * FROM found",
    "p3_activity": _P3 + "SELECT case_id, count(*) FILTER (kind = 'period') AS n_periods, count(*) FILTER (kind = 'gap') AS n_gaps, CAST(sum(end_us - start_us) FILTER (kind = 'period') AS BIGINT) AS period_us, CAST(sum(end_us - start_us) FILTER (kind = 'gap') AS BIGINT) AS gap_us FROM found GROUP BY 1",
    "p4_found": _P4 + "SELECT job_id, node_kind, root_job_id, node_depth, job_path FROM found",
    "p4_descendants": _P4 + "SELECT ancestor, node, distance FROM pairs",
    "p4_subtrees": _P4 + "SELECT ancestor, count(*) AS n_descendants, max(distance) AS height FROM pairs GROUP BY 1",
    "p5_found": _P5 + "SELECT * FROM found",
    "p5_batches": _P5 + "SELECT * FROM found",
}
