"""Queries of the inventory, discovery, scope and evaluation operators on the audit tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.ids import norm_id
from ledgerline.operators import discovery as D, joins as J, revisions as R
from ledgerline.plans import problems
from ledgerline.plans.common import CREDENTIAL_SQL, URLS, sql
from ledgerline.plans.relational import I, jobs, observations
from ledgerline.sources import files
from ledgerline.sources.shared import new_path, table

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return keep


def nodes(kind: str) -> str:
    return f"({problems.ORACLE[f'p1_{kind}']})"


_TARGETS = "SELECT * FROM (VALUES ('pol-a', 'https://www.1.example.test', '/'), ('pol-a', 'https://8.8.8.8:8443', '/customers'), ('pol-b', 'https://8.8.8.8', '/customers/'), ('pol-b', 'https://8.8.8.8', '/'), ('pol-c', 'https://8.8.8.8:8443', '/'), ('pol-c', 'https://10.0.0.7', '/customers/al')) AS t(policy_id, origin, prefix)"
_POLICIES = "SELECT * FROM (VALUES ('pol-a', TIMESTAMP '2027-01-01 00:00:00', 'https://8.8.8.8:8443/customers/alice?page=2'), ('pol-b', TIMESTAMP '2027-01-01 00:00:00', 'https://8.8.8.8/'), ('pol-c', TIMESTAMP '2026-01-01 00:00:00', 'https://none.example.test/')) AS p(policy_id, expires_at, one)"


@query(
    "ref_F23_J8_scope_decisions",
    f"""WITH u AS (SELECT id, CASE WHEN regexp_matches(url, '^(?i:https)://') AND NOT contains(url, '#') AND NOT contains(url, '@') AND len(list_filter(list_transform(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: url_decode(split_part(x, '=', 1))), lambda k: {CREDENTIAL_SQL})) = 0
  THEN 'https://' || lower(regexp_extract(url, '://([^/:?#]+)', 1)) || CASE WHEN regexp_extract(url, '://[^/:?#]+:([0-9]+)', 1) IN ('', '443') THEN '' ELSE ':' || regexp_extract(url, '://[^/:?#]+:([0-9]+)', 1) END END AS origin,
  CASE WHEN regexp_extract(url, '://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]+([^?#]*)', 1) END AS path, regexp_extract(url, '(\\?[^#]*)', 1) AS q FROM ({URLS})),
m AS (SELECT u.id, t.policy_id, CASE WHEN u.origin IS NULL THEN 4 WHEN t.policy_id IS NULL THEN 3 WHEN p.expires_at <= TIMESTAMP '2026-06-01 00:00:00' THEN 2 WHEN p.one = u.origin || u.path || u.q THEN 1 ELSE 0 END AS s
  FROM u LEFT JOIN ({_TARGETS}) t ON u.origin = t.origin AND (u.path = rtrim(t.prefix, '/') OR starts_with(u.path, rtrim(t.prefix, '/') || '/') OR rtrim(t.prefix, '/') = '') LEFT JOIN ({_POLICIES}) p ON t.policy_id = p.policy_id)
SELECT id, ['allowed', 'excluded', 'expired', 'outside', 'invalid'][min(s) + 1] AS decision, array_to_string(list_sort(list_distinct(list(policy_id) FILTER (s = 0))), ',') AS policies FROM m GROUP BY id""",
)
def scope(s, d):
    policies = sql(s, d, _POLICIES).select("policy_id", "expires_at", F.array("one").alias("excluded"))
    out = D.scope_decisions(sql(s, d, URLS), sql(s, d, _TARGETS), policies, F.lit("2026-06-01 00:00:00").cast("timestamp"))
    return out.select("id", "decision", F.when(F.size("policies") > 0, F.array_join("policies", ",")).alias("policies"))


_RESULTS = "SELECT l_orderkey AS query_id, CAST(l_orderkey % 3 AS STRING) AS family, CAST(count(*) AS BIGINT) AS cost FROM lineitem WHERE l_orderkey <= 2000 GROUP BY l_orderkey"
_CANDS = "SELECT p_partkey AS candidate_id, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'known_false_positive' WHEN 1 THEN 'unlabeled_unknown' ELSE 'relevant' END AS label, CAST(p_partkey % 3 AS STRING) AS f0, CAST(p_size % 3 AS STRING) AS f1 FROM part WHERE p_partkey % 2 = 1 OR p_size > 10"
_BUDGETS = [0, 50, 200, 1000]


@query(
    "ref_A10_J22_evaluation",
    f"""WITH r AS ({_RESULTS}), c AS (SELECT candidate_id, label, list_distinct([f0, f1]) AS families FROM ({_CANDS})),
sch AS (SELECT 'by_key' AS schedule, query_id, query_id AS position FROM r UNION ALL SELECT 'by_cost', query_id, cost * 10000000 + query_id FROM r),
sp AS (SELECT schedule, r.query_id, family, sum(cost) OVER (PARTITION BY schedule ORDER BY position ROWS UNBOUNDED PRECEDING) AS spent FROM sch JOIN r USING (query_id)),
h AS (SELECT schedule, family, spent, c.candidate_id, label, families FROM sp JOIN lineitem l ON l.l_orderkey = sp.query_id JOIN c ON c.candidate_id = l.l_partkey),
e AS (SELECT schedule, family, candidate_id, label, min(spent) AS spent FROM (SELECT schedule, family, candidate_id, label, spent FROM h WHERE list_contains(families, family) UNION ALL SELECT schedule, '', candidate_id, label, spent FROM h) GROUP BY ALL),
t AS (SELECT family, count(*) FILTER (label = 'relevant') AS relevant_total FROM (SELECT '' AS family, label FROM c UNION ALL SELECT unnest(families), label FROM c) GROUP BY 1),
f AS (SELECT schedule, budget, fam.family, coalesce(relevant_total, 0) AS relevant_total FROM (SELECT DISTINCT schedule FROM sch), (SELECT unnest({_BUDGETS}) AS budget), (SELECT DISTINCT family FROM r UNION ALL SELECT '') fam LEFT JOIN t ON fam.family = t.family),
k AS (SELECT f.schedule, f.budget, f.family, relevant_total, count(candidate_id) AS selected, count(*) FILTER (label = 'relevant') AS relevant_found, count(*) FILTER (label = 'known_false_positive') AS false_positive, count(*) FILTER (label = 'unlabeled_unknown') AS unknown FROM f LEFT JOIN e ON f.schedule = e.schedule AND f.family = e.family AND e.spent <= f.budget GROUP BY ALL)
SELECT schedule, budget, family, selected, relevant_found, relevant_total, false_positive, unknown, CASE WHEN relevant_total > 0 THEN round(relevant_found / relevant_total, 6) END AS recall, CASE WHEN relevant_found + false_positive > 0 THEN round(relevant_found / (relevant_found + false_positive), 6) END AS "precision" FROM k""",
)
def evaluation(s, d):
    r = sql(s, d, _RESULTS)
    ids = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.collect_set("l_partkey").alias("candidate_ids"))
    schedules = r.select(F.lit("by_key").alias("schedule"), "query_id", F.col("query_id").alias("position")).unionByName(r.select(F.lit("by_cost").alias("schedule"), "query_id", (F.col("cost") * 10_000_000 + F.col("query_id")).alias("position")))
    c = sql(s, d, _CANDS).select("candidate_id", "label", F.array_distinct(F.array("f0", "f1")).alias("families"))
    return D.evaluate_at_budgets(r.join(ids, "query_id"), c, schedules, _BUDGETS)


_ONE_OBSERVATION = f"(SELECT DISTINCT {I('observation_id')} AS observation_id, {I('asset_id')} AS asset_id, coalesce(alias_id, '') AS alias_id, observed_at, access, content FROM observations)"


@query("ref_W2_tied_observations", f"SELECT asset_id, alias_id, count(*) AS n_latest, count(DISTINCT (access, content)) > 1 AS conflict FROM (SELECT *, rank() OVER (PARTITION BY asset_id, alias_id ORDER BY observed_at DESC) AS r FROM {_ONE_OBSERVATION}) WHERE r = 1 GROUP BY 1, 2")
def tied(s, d):
    o = observations(s, d).withColumn("alias_id", F.coalesce("alias_id", F.lit("")))
    return D.tie_conflicts(o, ["asset_id", "alias_id"], "observed_at", ["access", "content"]).drop("observed_at")


#: What may follow on what in the ledger of a finding. Fixed values.
LEGAL = {None: ["FINDING_OPENED"], "FINDING_OPENED": ["REMEDIATION_RECORDED"], "REMEDIATION_RECORDED": ["FINDING_CLOSED", "REMEDIATION_RECORDED"], "FINDING_CLOSED": ["FINDING_REOPENED"], "FINDING_REOPENED": ["REMEDIATION_RECORDED"]}
_FINDING_EVENTS = [e for e in LEGAL if e]
_PAIRS = ", ".join(f"('{a or ''}', '{b}')" for a, after in LEGAL.items() for b in after)
_FE = f"(SELECT DISTINCT {I('entity_id')} AS entity_id, sequence, event_type FROM ledger_events WHERE event_type IN {tuple(_FINDING_EVENTS)} AND entity_id IS NOT NULL AND sha256(payload_json) = payload_hash)"


@query("ref_W14_illegal_transitions", f"SELECT entity_id, sequence, event_type, previous FROM (SELECT *, lag(event_type) OVER (PARTITION BY entity_id ORDER BY sequence, event_type) AS previous FROM {_FE} WHERE entity_id IS NOT NULL) WHERE (coalesce(previous, ''), event_type) NOT IN ({_PAIRS})")
def transitions(s, d):
    e = table(s, d, "ledger_events").where(F.col("event_type").isin(_FINDING_EVENTS) & (F.sha2("payload_json", 256) == F.col("payload_hash")))
    e = e.select(norm_id("entity_id").alias("entity_id"), "sequence", "event_type").where("entity_id is not null").distinct()
    return D.illegal_transitions(e, "entity_id", "sequence", "event_type", LEGAL)


REQUIRED = ["certificate-log", "code-index", "documents", "owner-linked-search"]  # channels that every import should have


@query("ref_J19_SET2_required_channels", f"WITH c AS (SELECT DISTINCT record_ref, channel_id FROM {nodes('channels')} WHERE channel_id IS NOT NULL), e AS (SELECT record_ref, unnest({REQUIRED}) AS channel_id FROM (SELECT DISTINCT record_ref FROM c)) SELECT coalesce(e.record_ref, c.record_ref) AS record_ref, coalesce(e.channel_id, c.channel_id) AS channel_id, CASE WHEN c.channel_id IS NULL THEN 'missed' WHEN e.channel_id IS NULL THEN 'additional' ELSE 'found' END AS outcome FROM e FULL JOIN c ON e.record_ref = c.record_ref AND e.channel_id = c.channel_id")
def required(s, d):
    c = problems.p1_typed(s, d, "channels").select("record_ref", "channel_id").where("channel_id is not null")
    e = c.select("record_ref").distinct().select("record_ref", F.explode(F.array(*map(F.lit, REQUIRED))).alias("channel_id"))
    return D.expected_and_found(e, c, ["record_ref", "channel_id"])


_LAST_JOBS = f"(SELECT * FROM (SELECT {I('job_id')} AS job_id, {I('case_id')} AS case_id, {I('parent_job_id')} AS parent_job_id, scope_id, job_type, state, priority, estimated_cost, next_eligible_at, last_error_code, result_refs, created_at, updated_at, row_number() OVER (PARTITION BY {I('job_id')} ORDER BY updated_at DESC) AS rn FROM audit_jobs) WHERE rn = 1 AND job_id IS NOT NULL)"


@query("ref_J10_bound_results", f"WITH refs AS (SELECT DISTINCT job_id, {I('r')} AS result_ref FROM (SELECT job_id, unnest(result_refs) AS r FROM {_LAST_JOBS})), res AS (SELECT {I('result_ref')} AS r_ref, min({I('job_id')}) AS lo, max({I('job_id')}) AS hi FROM audit_results GROUP BY 1) SELECT job_id, result_ref, CASE WHEN r_ref IS NULL THEN 'missing' WHEN lo <> hi THEN 'ambiguous' WHEN lo = job_id THEN 'exact' ELSE 'other_job' END AS state FROM refs LEFT JOIN res ON result_ref = r_ref WHERE result_ref IS NOT NULL")
def bound(s, d):
    from ledgerline.operators.references import latest_jobs

    refs = latest_jobs(table(s, d, "audit_jobs"), "result_refs").select("job_id", F.explode("result_refs").alias("r")).select("job_id", norm_id("r").alias("result_ref")).where("result_ref is not null")
    return D.bound_results(refs, table(s, d, "audit_results").select(norm_id("result_ref").alias("result_ref"), norm_id("job_id").alias("job_id")).where("result_ref is not null"))


@query("ref_A11_channel_status", f"SELECT record_ref, count(*) AS n_channels, count(*) FILTER (state = 'COMPLETE') AS n_done, CASE WHEN count(*) FILTER (state = 'COMPLETE') = count(*) THEN 'complete' WHEN count(*) FILTER (state = 'COMPLETE') > 0 THEN 'partial' ELSE 'failed' END AS status FROM {nodes('channels')} GROUP BY 1")
def status(s, d):
    return D.channel_status(problems.p1_typed(s, d, "channels"))


@query("ref_A22_coverage_by_kind", f"WITH c AS (SELECT record_ref, channel_id, kind FROM {nodes('candidates')}), k AS (SELECT DISTINCT record_ref, channel_id, true AS known FROM {nodes('channels')}) SELECT c.kind, count(*) AS candidates, count(known) AS with_channel, round(count(known) / count(*), 6) AS coverage FROM c LEFT JOIN k ON c.record_ref = k.record_ref AND c.channel_id = k.channel_id GROUP BY 1")
def coverage(s, d):
    channels, candidates = problems.typed(s, d, "channels", "candidates")
    known = channels.select("record_ref", "channel_id", F.lit(True).alias("known")).distinct()
    c = candidates.join(known, ["record_ref", "channel_id"], "left")
    return c.groupBy("kind").agg(F.count(F.lit(1)).alias("candidates"), F.count("known").alias("with_channel"), F.round(F.count("known") / F.count(F.lit(1)), 6).alias("coverage"))


@query("ref_A25_channel_health", f"SELECT channel_id, count(*) AS reports, count(*) FILTER (state = 'FAILED' OR state = 'BLOCKED') AS errors, CASE WHEN count(*) FILTER (state = 'FAILED' OR state = 'BLOCKED') = 0 THEN 'ok' WHEN count(*) FILTER (state = 'COMPLETE') > 0 THEN 'degraded' ELSE 'down' END AS health FROM {nodes('channels')} GROUP BY 1")
def health(s, d):
    bad, good = F.count_if(F.col("state").isin("FAILED", "BLOCKED")), F.count_if(F.col("state") == "COMPLETE")
    return problems.p1_typed(s, d, "channels").groupBy("channel_id").agg(F.count(F.lit(1)).alias("reports"), bad.alias("errors"), F.when(bad == 0, "ok").when(good > 0, "degraded").otherwise("down").alias("health"))


@query("ref_A27_last_repository", f"WITH r AS (SELECT repository, record_ref, node_path, branch, ownership_status FROM {nodes('repositories')}) SELECT repository, arg_max(branch, (record_ref, node_path)) AS branch, arg_max(ownership_status, (record_ref, node_path)) AS ownership_status, count(*) - 1 AS replaced FROM r GROUP BY 1")
def last_repository(s, d):
    """Repositories over all manifests; the last record wins."""
    return D.last_wins(problems.p1_typed(s, d, "repositories"), ["repository"], ["record_ref", "node_path"], ["branch", "ownership_status"])


@query("ref_A18_first_codes", f"WITH x AS (SELECT record_ref, code, min(node_path) AS p FROM {nodes('signals')} WHERE code IS NOT NULL GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY record_ref ORDER BY p, code) AS r FROM x) SELECT record_ref, array_to_string(list(code ORDER BY r) FILTER (r <= 8), ',') AS codes, count(*) AS n_values FROM n GROUP BY 1")
def first_codes(s, d):
    """The first eight different codes of each report, in the order of their paths."""
    out = D.first_seen(problems.p1_typed(s, d, "signals"), ["record_ref"], ["node_path"], "code", 8)
    return out.select("record_ref", F.array_join("values", ",").alias("codes"), "n_values")


@query("ref_G6_discovery_edges", f"SELECT DISTINCT 'owner' AS kind, owner_ref AS source, repository AS target FROM {nodes('repositories')} WHERE owner_ref IS NOT NULL UNION ALL SELECT DISTINCT 'page', r.repository, p.page_url FROM {nodes('pages')} p JOIN {nodes('repositories')} r ON p.record_ref = r.record_ref AND p.parent_path = r.node_path WHERE p.page_url IS NOT NULL")
def discovery_edges(s, d):
    """owner -> repository -> page, from the parent links of the flat tables."""
    r, p = problems.typed(s, d, "repositories", "pages")
    owner = r.where("owner_ref is not null").select(F.lit("owner").alias("kind"), F.col("owner_ref").alias("source"), F.col("repository").alias("target"))
    page = p.select("record_ref", F.col("parent_path").alias("node_path"), "page_url").join(r.select("record_ref", "node_path", "repository"), ["record_ref", "node_path"]).where("page_url is not null")
    return owner.unionByName(page.select(F.lit("page").alias("kind"), F.col("repository").alias("source"), F.col("page_url").alias("target"))).distinct()


@query("ref_G7_inventory_edges", f"SELECT DISTINCT asset_id, alias_id, map_extract(b, alias_id)[1] AS target_id FROM (SELECT {I('asset_id')} AS asset_id, unnest(map_keys(alias_bindings)) AS alias_id, alias_bindings AS b FROM assets)")
def inventory_edges(s, d):
    return table(s, d, "assets").select(norm_id("asset_id").alias("asset_id"), F.explode("alias_bindings").alias("alias_id", "target_id")).distinct()


@query("ref_W9_planned_jobs", f"SELECT job_id, case_id, CASE WHEN sum(estimated_cost) OVER (PARTITION BY case_id ORDER BY priority DESC, job_id ROWS UNBOUNDED PRECEDING) <= 40 THEN 'planned' ELSE 'deferred' END AS decision FROM {_LAST_JOBS} WHERE state IN ('ready', 'pending', 'retry_wait')")
def planned(s, d):
    j = jobs(s, d).where(F.col("state").isin("ready", "pending", "retry_wait"))
    return D.planned_or_deferred(j, ["case_id"], [F.desc("priority"), "job_id"], "estimated_cost", 40).select("job_id", "case_id", "decision")


@query("ref_T6_next_job", f"SELECT case_id, job_id, state FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE state WHEN 'ready' THEN 0 WHEN 'pending' THEN 1 ELSE 2 END, priority DESC, job_id) AS r FROM {_LAST_JOBS} WHERE state IN ('ready', 'pending', 'retry_wait')) WHERE r = 1")
def next_job(s, d):
    """The next job of each case, by state, priority and id; a minimum, combined on the map side."""
    rank = F.when(F.col("state") == "ready", 0).when(F.col("state") == "pending", 1).otherwise(2)
    j = jobs(s, d).where(F.col("state").isin("ready", "pending", "retry_wait"))
    return j.groupBy("case_id").agg(F.min(F.struct(rank.alias("r"), (-F.col("priority")).alias("p"), "job_id", "state")).alias("x")).select("case_id", "x.job_id", "x.state")


@query("ref_T2_first_jobs", f"SELECT case_id, job_id, position FROM (SELECT case_id, job_id, row_number() OVER (PARTITION BY case_id ORDER BY priority DESC, job_id) AS position FROM {_LAST_JOBS}) WHERE position <= 20")
def first_jobs(s, d):
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("priority"), "job_id")).cast("bigint")
    return jobs(s, d).select("case_id", "job_id", place.alias("position")).where("position <= 20")


@query("ref_T5_review_order", f"SELECT record_ref, repository, row_number() OVER (PARTITION BY record_ref ORDER BY CASE WHEN ownership_status = 'confirmed' THEN 1 ELSE 0 END, repository, node_path) AS position FROM {nodes('repositories')}")
def review_order(s, d):
    """Repositories of each manifest: those to be reviewed first, then by name."""
    from pyspark.sql import Window as W

    late = F.when(F.col("ownership_status") == "confirmed", 1).otherwise(0)
    return problems.p1_typed(s, d, "repositories").select("record_ref", "repository", F.row_number().over(W.partitionBy("record_ref").orderBy(late, "repository", "node_path")).cast("bigint").alias("position"))


@query("ref_J21_reusable_children", f"SELECT parent_job_id, job_type, job_id, state = 'succeeded' AS reusable FROM (SELECT *, row_number() OVER (PARTITION BY parent_job_id, job_type ORDER BY updated_at DESC, job_id DESC) AS r FROM {_LAST_JOBS} WHERE parent_job_id IS NOT NULL) WHERE r = 1")
def reusable(s, d):
    """The latest child of each job by type, and whether its result can be used again."""
    best = jobs(s, d).where("parent_job_id is not null").groupBy("parent_job_id", "job_type").agg(F.max(F.struct("updated_at", "job_id", "state")).alias("x"))
    return best.select("parent_job_id", "job_type", "x.job_id", (F.col("x.state") == "succeeded").alias("reusable"))


_ORG = "split_part(repository, '/', 1)"


@query("ref_J12_owned_accounts", f"WITH r AS (SELECT {_ORG} AS account, ownership_status FROM {nodes('repositories')}) SELECT account, CASE WHEN bool_or(ownership_status = 'confirmed') THEN 'owned' WHEN bool_or(ownership_status = 'rejected') THEN 'excluded' ELSE 'open' END AS standing, count(*) AS repositories FROM r GROUP BY 1")
def accounts(s, d):
    r = problems.p1_typed(s, d, "repositories").groupBy(F.split_part("repository", F.lit("/"), F.lit(1)).alias("account"))
    one = lambda v: F.bool_or(F.col("ownership_status") == v)
    return r.agg(F.when(one("confirmed"), "owned").when(one("rejected"), "excluded").otherwise("open").alias("standing"), F.count(F.lit(1)).alias("repositories"))


@query("ref_J13_open_candidates", f"SELECT c.record_ref, c.node_path, c.channel_id FROM {nodes('candidates')} c WHERE NOT EXISTS (SELECT 1 FROM {nodes('channels')} k WHERE k.record_ref = c.record_ref AND k.channel_id = c.channel_id AND k.state = 'SKIPPED')")
def open_candidates(s, d):
    """Candidates but for those of a channel that was skipped."""
    channels, candidates = problems.typed(s, d, "channels", "candidates")
    skipped = channels.where("state = 'SKIPPED'").select("record_ref", "channel_id").distinct()
    return candidates.join(skipped, ["record_ref", "channel_id"], "left_anti").select("record_ref", "node_path", "channel_id")


@query("ref_J23_known_domains", f"WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM {nodes('candidates')} WHERE url IS NOT NULL), d AS (SELECT DISTINCT lower(regexp_extract(page_url, '^https?://([^/:?#]+)', 1)) AS domain FROM {nodes('pages')} WHERE page_url IS NOT NULL UNION SELECT 'example.invalid'), m AS (SELECT host, domain, row_number() OVER (PARTITION BY host ORDER BY length(domain) DESC, domain DESC) AS r FROM h JOIN d ON host = domain OR ends_with(host, '.' || domain) WHERE host <> '' AND domain <> '') SELECT host, domain FROM m WHERE r = 1")
def known_domains(s, d):
    host = lambda c: F.lower(F.regexp_extract(c, "^https?://([^/:?#]+)", 1))
    pages, candidates = problems.typed(s, d, "pages", "candidates")
    domains = pages.select(host("page_url").alias("domain")).unionByName(s.createDataFrame([("example.invalid",)], "domain string"))
    return D.suffix_matches(candidates.select(host("url").alias("h")), "h", domains, "domain")


@query("ref_ST8_A23_cooldown", f"WITH j AS {_LAST_JOBS}, o AS (SELECT scope_id, max(next_eligible_at) AS until FROM j WHERE state = 'retry_wait' AND last_error_code IS NOT NULL GROUP BY 1) SELECT j.job_id, coalesce(until > j.updated_at, false) AS deferred FROM j LEFT JOIN o ON j.scope_id = o.scope_id WHERE state IN ('ready', 'pending')")
def cooldown(s, d):
    """Jobs that wait because another of their scope met an error and cools down."""
    from ledgerline.operators.references import latest_jobs

    j = latest_jobs(table(s, d, "audit_jobs"), "scope_id", "state", "next_eligible_at", "last_error_code")
    until = j.where("state = 'retry_wait' and last_error_code is not null").groupBy("scope_id").agg(F.max("next_eligible_at").alias("until"))
    return j.where(F.col("state").isin("ready", "pending")).join(J.small(until), "scope_id", "left").select("job_id", F.coalesce(F.col("until") > F.col("updated_at"), F.lit(False)).alias("deferred"))


@query("ref_SET3_eval_splits", "SELECT count(DISTINCT item_id) AS items, count(*) FILTER (splits > 1) AS in_two_splits, count(*) FILTER (splits = 0) AS in_no_split, (SELECT count(*) FROM (SELECT text FROM eval_items GROUP BY text HAVING count(DISTINCT item_split) > 1)) AS texts_in_two_splits FROM (SELECT item_id, count(DISTINCT item_split) AS splits FROM eval_items GROUP BY 1)")
def splits(s, d):
    """Whether splits are disjoint by id and by text, and cover all items."""
    t = table(s, d, "eval_items")
    n = t.groupBy("item_id").agg(F.count_distinct("item_split").alias("splits")).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("splits") > 1).alias("in_two_splits"), F.count_if(F.col("splits") == 0).alias("in_no_split"))
    texts = t.groupBy("text").agg(F.count_distinct("item_split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("texts_in_two_splits"))
    return n.crossJoin(texts)  # one row each


@query("ref_SET5_case_codes", f"SELECT case_id, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes FROM (SELECT case_id, last_error_code AS code FROM {_LAST_JOBS} UNION ALL SELECT {I('case_id')}, reason FROM audit_runs) WHERE code IS NOT NULL AND case_id IS NOT NULL GROUP BY 1")
def case_codes(s, d):
    """All error codes and reasons of each case, sorted, once each."""
    j = jobs(s, d).select("case_id", F.col("last_error_code").alias("code"))
    both = j.unionByName(table(s, d, "audit_runs").select(norm_id("case_id").alias("case_id"), F.col("reason").alias("code"))).where("code is not null and case_id is not null").distinct()
    return both.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))  # codes are a fixed vocabulary


_PAGES_SQL = """SELECT concat('q', CAST(o_custkey AS STRING)) AS query, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + CASE WHEN o_custkey % 9 = 0 AND row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 2 THEN 1 ELSE 0 END AS INT) AS page,
 CASE WHEN o_orderkey % 37 = 0 THEN '{"error": "x"}' ELSE concat('{"results": [{"id": "', CAST(o_orderkey AS STRING), '", "url": "', CASE WHEN o_orderkey % 11 = 0 THEN 'mailto:x' ELSE concat('https://s', CAST(o_orderkey % 5 AS STRING), '.example.test/') END, '"}, {"id": "b", "url": "https://t', CAST(o_orderkey % 3 AS STRING), '.example.test/"}]', CASE WHEN o_orderkey % 29 = 0 THEN '}' WHEN o_orderkey % 6 = 0 THEN ', "has_more": false}' ELSE ', "has_more": true}' END) END AS body FROM orders"""
_FOLLOW = f"""WITH p AS (SELECT query, page, json_extract(body, '$.results') AS results, CAST(json_extract(body, '$.has_more') AS BOOLEAN) AS more, page <> row_number() OVER (PARTITION BY query ORDER BY page) AS gap FROM ({_PAGES_SQL})),
e AS (SELECT *, CASE WHEN results IS NULL THEN 'RESPONSE_SHAPE_MISMATCH' WHEN more IS NULL THEN 'PAGINATION_UNDECLARED' WHEN NOT more THEN 'page_exhausted' END AS ended FROM p),
st AS (SELECT query, min(page) FILTER (ended IS NOT NULL AND NOT gap) AS stop, arg_min(ended, page) FILTER (ended IS NOT NULL AND NOT gap) AS ended, max(page) FILTER (NOT gap) AS last FROM e GROUP BY 1),
rd AS (SELECT e.query, e.page, e.results FROM e JOIN st ON e.query = st.query WHERE NOT gap AND e.page <= coalesce(st.stop, st.last)),
rw AS (SELECT query, page, i, json_extract_string(r, '$.id') AS id, json_extract_string(r, '$.url') AS url FROM (SELECT query, page, unnest(range(CAST(json_array_length(results) AS BIGINT))) AS i, results FROM rd WHERE results IS NOT NULL) x, LATERAL (SELECT json_extract(results, '$[' || i || ']') AS r)),
f AS (SELECT query, url, arg_min(id, (page, i)) AS record_id, min((page, i)) AS pos FROM rw WHERE starts_with(url, 'https://') GROUP BY 1, 2),
fo AS (SELECT query, url, record_id, row_number() OVER (PARTITION BY query ORDER BY pos) AS position FROM f)
"""


@query("ref_S15_followed_pages", _FOLLOW + "SELECT query, url, record_id, position FROM fo")
def followed(s, d):
    return D.follow_pages(sql(s, d, _PAGES_SQL))[0]


@query("ref_W8_page_coverage", _FOLLOW + "SELECT st.query, coalesce(n, 0) AS pages, coalesce(c, 0) AS candidates, coalesce(b, 0) AS rejected, coalesce(ended, 'PAGE_MISSING') AS end_condition, coalesce(ended, '') = 'page_exhausted' AND coalesce(b, 0) = 0 AS complete FROM st LEFT JOIN (SELECT query, count(*) AS n FROM rd GROUP BY 1) USING (query) LEFT JOIN (SELECT query, count(*) AS c FROM fo GROUP BY 1) USING (query) LEFT JOIN (SELECT query, count(*) AS b FROM rw WHERE NOT starts_with(url, 'https://') GROUP BY 1) USING (query)")
def page_coverage(s, d):
    return D.follow_pages(sql(s, d, _PAGES_SQL))[1]


@query(
    "ref_ST2_observation_checks",
    f"WITH a AS (SELECT {I('asset_id')} AS a_id, any_value(registered_at) AS reg, any_value(map_keys(alias_bindings)) AS aliases FROM assets GROUP BY 1), o AS (SELECT DISTINCT {I('observation_id')} AS observation_id, {I('asset_id')} AS asset_id, alias_id, evidence_ref, observed_at FROM observations) SELECT observation_id, CASE WHEN asset_id IS NULL THEN 'no_asset' WHEN a_id IS NULL THEN 'unknown_asset' WHEN observed_at < reg THEN 'before_registration' WHEN alias_id IS NOT NULL AND NOT coalesce(list_contains(aliases, alias_id), false) THEN 'unknown_alias' WHEN coalesce(trim(evidence_ref), '') = '' THEN 'no_evidence' END AS reason FROM o LEFT JOIN a ON o.asset_id = a.a_id",
)
def observation_checks(s, d):
    a = table(s, d, "assets").select(norm_id("asset_id").alias("asset_id"), "registered_at", F.array_sort(F.map_entries("alias_bindings")).alias("b")).where("asset_id is not null")
    a = a.groupBy("asset_id").agg(F.max(F.struct("registered_at", "b")).alias("x")).select("asset_id", "x.registered_at", F.map_from_entries("x.b").alias("alias_bindings"))
    o = table(s, d, "observations").select(norm_id("observation_id").alias("observation_id"), norm_id("asset_id").alias("asset_id"), "alias_id", "evidence_ref", "observed_at").distinct()
    return D.observation_checks(o, a)



_SHA = "substr(sha256(repository), 1, 40)"
_BR = "(regexp_matches(branch, '^[A-Za-z0-9._/-]{1,100}$') AND NOT regexp_matches(branch, '\\.\\.|^/|/$|//'))"


@query("ref_P29_P27_revision_urls", f"WITH r AS (SELECT record_ref, node_path, repository, branch, {_SHA} AS sha FROM {nodes('repositories')} WHERE repository IS NOT NULL) SELECT record_ref, node_path, CASE WHEN {_BR} THEN 'https://api.github.com/repos/' || repository || '/git/trees/' || replace(branch, '/', '%2F') || '?recursive=1' END AS tree, CASE WHEN {_BR} THEN 'https://api.github.com/repos/' || repository || '/commits?sha=' || replace(branch, '/', '%2F') || '&per_page=5' END AS history, 'https://api.github.com/repos/' || repository || '/commits/' || sha || '?per_page=100&page=1' AS detail, 'https://raw.githubusercontent.com/' || repository || '/' || sha || '/docs/' || replace(replace(node_path, '[', '%5B'), ']', '%5D') AS raw, 'https://' || lower(split_part(repository, '/', 1)) || '.github.io/' || split_part(repository, '/', 2) || '/' AS pages, CASE WHEN {_BR} THEN 'https://cdn.jsdelivr.net/gh/' || repository || '@' || branch || '/' END AS mirror, CASE WHEN {_BR} THEN 'branch_mutable' END AS kind FROM r")
def revision_urls(s, d):
    r = problems.p1_typed(s, d, "repositories").where("repository is not null").select("record_ref", "node_path", "repository", "branch", F.left(F.sha2("repository", 256), F.lit(40)).alias("sha"))
    shape = R.shaped(r.select(F.col("repository").alias("slug"), F.col("branch").alias("revision")).distinct())
    patch = F.concat(F.lit("https://github.com/"), "repository", F.lit("/commit/"), F.upper("sha"), F.lit(".patch"))
    out = r.join(shape, (F.col("repository") == F.col("slug")) & F.col("branch").eqNullSafe(F.coalesce(F.regexp_extract("mirror_url", "@(.*)/$", 1), F.col("branch"))))
    return out.select("record_ref", "node_path", R.tree_url("repository", "branch").alias("tree"), R.history_url("repository", "branch").alias("history"), R.commit_detail_url(patch).alias("detail"), R.raw_url("repository", "sha", F.concat(F.lit("docs/"), "node_path")).alias("raw"), F.col("pages_url").alias("pages"), F.col("mirror_url").alias("mirror"), F.col("revision_kind").alias("kind"))


@query("ref_F29_reports_held", f"SELECT record_ref, len(list_filter(list_distinct(list(code)), lambda c: NOT list_contains({R.NOT_MATERIAL!r}, c))) > 0 AS held FROM {nodes('signals')} WHERE code IS NOT NULL GROUP BY 1")
def reports_held(s, d):
    """Reports whose signals hold material back; a report's codes are a fixed vocabulary."""
    codes = problems.p1_typed(s, d, "signals").where("code is not null").select("record_ref", "code").distinct().groupBy("record_ref").agg(F.collect_list("code").alias("codes"))
    return codes.select("record_ref", R.material_hold("codes").alias("held"))


@query("ref_G2_same_captures", f"SELECT target_id, count(*) AS captures, CASE WHEN NOT bool_and(coalesce(capture_complete, false) AND regexp_matches(payload_hash, '^[0-9a-f]{{64}}$')) OR min(access) <> max(access) THEN 'comparison_pending' WHEN min(payload_hash) = max(payload_hash) THEN 'same_at_observation' ELSE 'different_at_observation' END AS state FROM (SELECT DISTINCT {I('observation_id')} AS o, target_id, access, payload_hash, capture_complete FROM observations WHERE target_id IS NOT NULL) GROUP BY 1 HAVING count(*) > 1")
def same_captures(s, d):
    o = table(s, d, "observations").where("target_id is not null").select(norm_id("observation_id").alias("o"), "target_id", F.col("access").alias("representation"), F.col("payload_hash").alias("sha256"), "capture_complete").distinct()
    return R.mirror_states(o, ["target_id"])


@query("ref_G8_held_siblings", f"WITH j AS {_LAST_JOBS}, h AS (SELECT DISTINCT parent_job_id FROM j WHERE state LIKE 'blocked%' AND parent_job_id IS NOT NULL) SELECT job_id, state LIKE 'blocked%' OR h.parent_job_id IS NOT NULL AS held FROM j LEFT JOIN h ON j.parent_job_id = h.parent_job_id")
def held_siblings(s, d):
    """Jobs that are held as one of their siblings is blocked."""
    return R.lineage_hold(jobs(s, d), "parent_job_id", F.col("state").startswith("blocked")).select("job_id", "held")


_STEPS_SQL = """SELECT p_partkey AS id, CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN '{"ui_steps": [{"action": "click", "target_id": "open-menu"}, {"action": "wait", "milliseconds": 200}]}' WHEN 1 THEN '{"ui_steps": [{"action": "click", "target_id": "login-button"}]}'
 WHEN 2 THEN '{"ui_steps": [{"action": "fill", "target_id": "q", "value": "secret"}]}' WHEN 3 THEN '{"ui_steps": [{"action": "click", "target_id": "a", "expect_png_download": true}]}' WHEN 4 THEN '{"ui_steps": [{"action": "wait", "milliseconds": 9000}]}' WHEN 5 THEN '{"observe_target_ids": ["a", "a"]}'
 WHEN 6 THEN '[]' WHEN 7 THEN '{"ui_steps": [{"action": "fill", "target_id": "q", "value": "TEST_1"}, {"action": "select", "target_id": "s", "index": 3}, {"action": "check", "target_id": "c", "checked": true}]}' ELSE '{"observe_png_download": 1}' END AS body FROM part"""


@query("ref_U14_interaction_steps", "SELECT p_partkey AS id, CASE CAST(p_partkey % 9 AS INT) WHEN 1 THEN 'prohibited_ui_target' WHEN 2 THEN 'prohibited_ui_value' WHEN 3 THEN 'png_observation_not_authorized' WHEN 4 THEN 'invalid_ui_steps' WHEN 5 THEN 'invalid_observe_target_ids' WHEN 6 THEN 'invalid_ui_steps' WHEN 8 THEN 'invalid_png_observation' END AS reason, CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN 2 WHEN 7 THEN 3 ELSE 0 END AS steps FROM part")
def steps(s, d):
    return R.interaction_steps(sql(s, d, _STEPS_SQL))


@query("ref_A21_attempts_by_channel", f"WITH c AS (SELECT record_ref, node_path, channel_id, complete, pages_bigint AS announced FROM {nodes('channels')}), a AS (SELECT record_ref, parent_path, count(*) AS attempts, sum(pages_bigint) AS tried FROM {nodes('attempts')} GROUP BY 1, 2) SELECT c.record_ref, c.node_path, c.channel_id, coalesce(attempts, 0) AS attempts, CASE WHEN c.complete AND coalesce(tried, 0) >= coalesce(announced, 0) THEN 'covered' WHEN tried > 0 THEN 'partly' ELSE 'open' END AS coverage FROM c LEFT JOIN a ON c.record_ref = a.record_ref AND c.node_path = a.parent_path")
def attempts(s, d):
    """What the attempts of each channel cover, through the parent links of the flat tables."""
    c, a = problems.typed(s, d, "channels", "attempts")
    a = a.groupBy("record_ref", F.col("parent_path").alias("node_path")).agg(F.count(F.lit(1)).alias("attempts"), F.sum("pages_bigint").alias("tried"))
    both = c.join(a, ["record_ref", "node_path"], "left")
    covered = F.col("complete") & (F.coalesce("tried", F.lit(0)) >= F.coalesce("pages_bigint", F.lit(0)))
    return both.select("record_ref", "node_path", "channel_id", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.when(covered, "covered").when(F.col("tried") > 0, "partly").otherwise("open").alias("coverage"))


_OWN_TARGETS = "(SELECT target_id FROM assets WHERE target_id IS NOT NULL UNION SELECT unnest(map_values(alias_bindings)) FROM assets)"


@query("ref_J5_inventory_and_discovery", f"WITH e AS {_OWN_TARGETS}, f AS (SELECT DISTINCT target_id FROM observations WHERE target_id IS NOT NULL) SELECT coalesce(e.target_id, f.target_id) AS target_id, CASE WHEN f.target_id IS NULL THEN 'missed' WHEN e.target_id IS NULL THEN 'additional' ELSE 'found' END AS outcome FROM e FULL JOIN f ON e.target_id = f.target_id")
def inventory_and_discovery(s, d):
    """Targets that the inventory owns and those that were observed."""
    a = table(s, d, "assets")
    own = a.select("target_id").unionByName(a.select(F.explode(F.map_values("alias_bindings")).alias("target_id"))).where("target_id is not null")
    return D.expected_and_found(own, table(s, d, "observations").select("target_id").where("target_id is not null"), ["target_id"])


@query("ref_J6_target_owners", f"WITH t AS (SELECT target_id, count(DISTINCT a) AS n FROM (SELECT target_id, {I('asset_id')} AS a FROM assets WHERE target_id IS NOT NULL UNION SELECT unnest(map_values(alias_bindings)), {I('asset_id')} FROM assets) GROUP BY 1), o AS (SELECT DISTINCT {I('observation_id')} AS observation_id, target_id FROM observations) SELECT observation_id, CASE WHEN o.target_id IS NULL THEN 'none' WHEN n IS NULL THEN 'unknown' WHEN n = 1 THEN 'one' ELSE 'several' END AS owners FROM o LEFT JOIN t ON o.target_id = t.target_id")
def target_owners(s, d):
    """How many assets a target of an observation belongs to."""
    a = table(s, d, "assets").select(norm_id("asset_id").alias("a"), "target_id", "alias_bindings")
    t = a.select("target_id", "a").unionByName(a.select(F.explode(F.map_values("alias_bindings")).alias("target_id"), "a")).where("target_id is not null").groupBy(F.col("target_id").alias("t_id")).agg(F.count_distinct("a").alias("n"))
    o = table(s, d, "observations").select(norm_id("observation_id").alias("observation_id"), "target_id").distinct()
    owners = F.when(F.col("target_id").isNull(), "none").when(F.col("n").isNull(), "unknown").when(F.col("n") == 1, "one").otherwise("several")
    return o.join(t, F.col("target_id") == F.col("t_id"), "left").select("observation_id", owners.alias("owners"))


def _alive(at: str) -> str:
    return f"(SELECT DISTINCT {I('asset_id')} AS asset_id, provider FROM assets WHERE registered_at <= TIMESTAMPTZ '{at} 00:00:00+00' AND (withdrawn_at IS NULL OR withdrawn_at > TIMESTAMPTZ '{at} 00:00:00+00'))"


@query("ref_SET1_inventory_change", f"SELECT coalesce(a.asset_id, b.asset_id) AS asset_id, CASE WHEN a.asset_id IS NULL THEN 'added' WHEN b.asset_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM {_alive('2025-07-01')} a FULL JOIN {_alive('2026-01-01')} b ON a.asset_id = b.asset_id WHERE a.asset_id IS NULL OR b.asset_id IS NULL OR a.provider IS DISTINCT FROM b.provider")
def inventory_change(s, d):
    """Assets added, removed or changed between two days."""

    def alive(at: str):
        day = F.lit(f"{at} 00:00:00+00").cast("timestamp")
        a = table(s, d, "assets").where((F.col("registered_at") <= day) & (F.col("withdrawn_at").isNull() | (F.col("withdrawn_at") > day)))
        return a.select(norm_id("asset_id").alias("asset_id"), "provider").distinct()

    return J.snapshot_diff(alive("2025-07-01"), alive("2026-01-01"), ["asset_id"], ["provider"])


@query("ref_S16_page_overlap", f"WITH p AS (SELECT query, page, json_extract(body, '$.results') AS results FROM ({_PAGES_SQL})), rw AS (SELECT query, page, i, json_extract_string(results, '$[' || i || '].id') AS id FROM (SELECT query, page, results, unnest(range(CAST(json_array_length(results) AS BIGINT))) AS i FROM p WHERE results IS NOT NULL)), f AS (SELECT query, id, min(page) AS first_page FROM rw GROUP BY 1, 2), b AS (SELECT p.query, p.page, count(rw.i) AS n, count(*) FILTER (rw.page > f.first_page) AS repeats FROM p LEFT JOIN rw ON p.query = rw.query AND p.page = rw.page LEFT JOIN f ON rw.query = f.query AND rw.id = f.id GROUP BY 1, 2) SELECT query, count(*) AS pages, CAST(sum(n) AS BIGINT) AS records, CAST(sum(repeats) AS BIGINT) AS repeated, count(*) FILTER (n > 0 AND n = repeats) AS stale_pages FROM b GROUP BY 1")
def overlap(s, d):
    return D.page_overlap(sql(s, d, _PAGES_SQL))


@query("ref_S3_bounded_lines", "SELECT 'row' AS kind, access, count(*) AS n FROM observations WHERE alias_id IS NOT NULL GROUP BY 2 UNION ALL SELECT 'rejected', NULL, (SELECT count(*) FROM observations WHERE alias_id IS NULL) + (SELECT count(*) FROM ledger_events WHERE payload_json IS NOT NULL)")
def bounded_lines(s, d):
    """JSON lines of two kinds, written and scanned with an exact schema: rows by access, and the number of other lines."""
    path = new_path(s)
    lines = table(s, d, "observations").select(F.to_json(F.struct("observation_id", "access", "alias_id")).alias("value"))
    lines.unionByName(table(s, d, "ledger_events").where("payload_json is not null").select(F.col("payload_json").alias("value"))).write.text(path)
    good, bad = files.json_lines(s, path, "observation_id string, access string, alias_id string")
    rows = good.groupBy("access").agg(F.count(F.lit(1)).alias("n")).select(F.lit("row").alias("kind"), "access", "n")
    return rows.unionByName(bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejected").alias("kind"), F.lit(None).cast("string").alias("access"), "n"))


_SEEDS = ["config", "secret", "price", "customer"]


@query("ref_N7_repository_seeds", f"SELECT DISTINCT lower(repository) AS repository, seed FROM {nodes('repositories')}, (SELECT unnest({_SEEDS!r}) AS seed) WHERE repository IS NOT NULL")
def repository_seeds(s, d):
    """Searches of every repository, once whatever the case of its name, for every seed."""
    r = problems.p1_typed(s, d, "repositories").where("repository is not null").select(F.lower("repository").alias("repository")).distinct()
    return r.select("repository", F.explode(F.array(*map(F.lit, _SEEDS))).alias("seed"))


@query("ref_C28_asset_profiles", f"WITH a AS (SELECT {I('asset_id')} AS asset_id, any_value(provider) AS provider, any_value(CAST(cardinality(alias_bindings) AS BIGINT)) AS bound_aliases FROM assets GROUP BY 1), o AS (SELECT asset_id, max(content) AS content FROM (SELECT {I('asset_id')} AS asset_id, content, rank() OVER (PARTITION BY {I('asset_id')} ORDER BY observed_at DESC) AS r FROM observations) WHERE r = 1 GROUP BY 1), f AS (SELECT asset_id, count(*) AS open_findings FROM (SELECT DISTINCT {I('finding_id')} AS finding_id, {I('asset_id')} AS asset_id, status FROM findings WHERE status <> 'CLOSED') GROUP BY 1) SELECT a.asset_id, provider, bound_aliases, coalesce(content, 'NOT_INSPECTED') AS content, coalesce(open_findings, 0) AS open_findings FROM a LEFT JOIN o ON a.asset_id = o.asset_id LEFT JOIN f ON a.asset_id = f.asset_id WHERE a.asset_id IS NOT NULL")
def asset_profiles(s, d):
    """Every asset with its bound aliases, the content last seen (NOT_INSPECTED where none was) and its open findings."""
    a = table(s, d, "assets").select(norm_id("asset_id").alias("asset_id"), "provider", F.size("alias_bindings").cast("bigint").alias("bound_aliases")).where("asset_id is not null")
    a = a.groupBy("asset_id").agg(F.max("provider").alias("provider"), F.max("bound_aliases").alias("bound_aliases"))
    o = observations(s, d).where("asset_id is not null").groupBy("asset_id").agg(F.max(F.struct("observed_at", "content"))["content"].alias("content"))
    f = table(s, d, "findings").where("status <> 'CLOSED'").select(norm_id("finding_id").alias("finding_id"), norm_id("asset_id").alias("asset_id"), "status").distinct().groupBy("asset_id").agg(F.count(F.lit(1)).alias("open_findings"))
    out = a.join(o, "asset_id", "left").join(f, "asset_id", "left")
    return out.select("asset_id", "provider", "bound_aliases", F.coalesce("content", F.lit("NOT_INSPECTED")).alias("content"), F.coalesce("open_findings", F.lit(0)).alias("open_findings"))
