"""Queries of the join, aggregation, window, order and set operators."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ledgerline.functions.ids import norm_id
from ledgerline.operators import joins as J, sequences as Q
from ledgerline.operators.references import latest_jobs
from ledgerline.plans.common import sql
from ledgerline.sources.shared import table

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return keep


def I(c: str) -> str:  # noqa: E743, N802
    return f"nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"


_AS = f"(SELECT DISTINCT {I('asset_id')} AS asset_id, provider, lower(trim(scope_id)) AS scope_id, registered_at, withdrawn_at FROM assets)"
_FI = f"(SELECT DISTINCT {I('finding_id')} AS finding_id, {I('asset_id')} AS asset_id, status, opened_at FROM findings)"
_OB = f"(SELECT DISTINCT {I('observation_id')} AS observation_id, {I('asset_id')} AS asset_id, alias_id, observed_at, access, content FROM observations)"
_JO = f"(SELECT * FROM (SELECT {I('job_id')} AS job_id, {I('case_id')} AS case_id, {I('parent_job_id')} AS parent_job_id, state, priority, attempts, estimated_cost, created_at, updated_at, last_error_code, job_type, row_number() OVER (PARTITION BY {I('job_id')} ORDER BY updated_at DESC) AS rn FROM audit_jobs) WHERE rn = 1)"


def assets(s, d):
    return table(s, d, "assets").select(norm_id("asset_id").alias("asset_id"), "provider", F.lower(F.trim("scope_id")).alias("scope_id"), "registered_at", "withdrawn_at").distinct()


def findings(s, d):
    return table(s, d, "findings").select(norm_id("finding_id").alias("finding_id"), norm_id("asset_id").alias("asset_id"), "status", "opened_at").distinct()


def observations(s, d):
    return table(s, d, "observations").select(norm_id("observation_id").alias("observation_id"), norm_id("asset_id").alias("asset_id"), "alias_id", "observed_at", "access", "content").distinct()


def jobs(s, d):
    j = latest_jobs(table(s, d, "audit_jobs"), "case_id", "parent_job_id", "state", "priority", "attempts", "estimated_cost", "created_at", "last_error_code", "job_type")
    return j.withColumns({"case_id": norm_id("case_id"), "parent_job_id": norm_id("parent_job_id")})


@query("ref_J1_findings_with_assets", f"SELECT f.finding_id, f.asset_id, f.status, a.provider, a.scope_id FROM {_FI} f JOIN {_AS} a USING (asset_id)")
def j1(s, d):
    return findings(s, d).join(assets(s, d), "asset_id").select("finding_id", "asset_id", "status", "provider", "scope_id")


@query("ref_J2_orphans_and_known", f"SELECT access, count(*) FILTER (asset_id IN (SELECT asset_id FROM {_AS})) AS known, count(*) FILTER (asset_id IS NULL OR asset_id NOT IN (SELECT asset_id FROM {_AS})) AS orphans FROM {_OB} GROUP BY 1")
def j2(s, d):
    """Semi and anti join in one pass: a left join to the distinct ids, counted by whether it met one."""
    ids = assets(s, d).select(F.col("asset_id").alias("a_id")).distinct()
    rows = observations(s, d).join(ids, F.col("asset_id") == F.col("a_id"), "left")
    return rows.groupBy("access").agg(F.count("a_id").alias("known"), F.count_if(F.col("a_id").isNull()).alias("orphans"))


@query(
    "ref_J3_alias_bindings",
    f"""WITH b AS (SELECT {I('asset_id')} AS asset_id, max(alias_bindings) AS m FROM assets GROUP BY 1), o AS (SELECT DISTINCT {I('observation_id')} AS observation_id, {I('asset_id')} AS asset_id, alias_id, target_id FROM observations WHERE alias_id IS NOT NULL)
SELECT CASE WHEN b.asset_id IS NULL THEN 'unknown_asset' WHEN m[alias_id] IS NULL THEN 'unbound_alias' WHEN target_id IS NULL THEN 'no_target' WHEN m[alias_id] = target_id THEN 'bound' ELSE 'mismatch' END AS binding, count(*) AS n FROM o LEFT JOIN b USING (asset_id) GROUP BY 1""",
)
def j3(s, d):
    b = table(s, d, "assets").select(norm_id("asset_id").alias("a_id"), F.posexplode_outer("alias_bindings").alias("p", "alias", "target")).select("a_id", "alias", "target").distinct()
    o = table(s, d, "observations").where("alias_id is not null").select(norm_id("observation_id").alias("observation_id"), norm_id("asset_id").alias("asset_id"), "alias_id", "target_id").distinct()
    known = b.select(F.col("a_id").alias("k_id")).distinct()
    rows = o.join(known, F.col("asset_id") == F.col("k_id"), "left").join(b, (F.col("asset_id") == F.col("a_id")) & (F.col("alias_id") == F.col("alias")), "left")
    kind = F.when(F.col("k_id").isNull(), "unknown_asset").when(F.col("target").isNull(), "unbound_alias").when(F.col("target_id").isNull(), "no_target").when(F.col("target") == F.col("target_id"), "bound").otherwise("mismatch")
    return rows.groupBy(kind.alias("binding")).agg(F.count("*").alias("n"))


@query(
    "ref_J4_source_record_missing",
    "WITH r AS (SELECT DISTINCT sha256(payload_json) AS h, entity_id FROM ledger_events) SELECT event_type, count(*) FILTER (h IS NULL) AS missing, count(*) AS events FROM (SELECT DISTINCT event_id, event_type, entity_id, payload_hash FROM ledger_events) e LEFT JOIN r ON e.payload_hash = r.h AND e.entity_id = r.entity_id GROUP BY 1",
)
def j4(s, d):
    """Events against source records by digest of the record and entity."""
    e = table(s, d, "ledger_events")
    r = e.select(F.sha2("payload_json", 256).alias("h"), F.col("entity_id").alias("r_entity")).distinct()
    rows = e.select("event_id", "event_type", "entity_id", "payload_hash").distinct().join(r, (F.col("payload_hash") == F.col("h")) & (F.col("entity_id") == F.col("r_entity")), "left")
    return rows.groupBy("event_type").agg(F.count_if(F.col("h").isNull()).alias("missing"), F.count("*").alias("events"))


_RULES = "SELECT * FROM (VALUES ('https://', '/customers'), ('http://', '/'), ('https://', '/customers/al'), ('https://', '/other/')) AS r(scheme, prefix)"


@query("ref_J9_jobs_and_results", f"WITH r AS (SELECT {I('job_id')} AS job_id, count(DISTINCT {I('result_ref')}) AS n FROM audit_results WHERE {I('job_id')} IS NOT NULL GROUP BY 1) SELECT CASE WHEN j.job_id IS NULL THEN 'unknown_job' WHEN n IS NULL THEN 'no_result' WHEN n = 1 THEN 'one_result' ELSE 'many_results' END AS status, count(*) AS n_jobs FROM {_JO} j FULL JOIN r ON j.job_id = r.job_id GROUP BY 1")
def j9(s, d):
    r = table(s, d, "audit_results").select(norm_id("job_id").alias("r_job"), norm_id("result_ref").alias("ref")).where("r_job is not null").groupBy("r_job").agg(F.countDistinct("ref").alias("n"))
    both = jobs(s, d).select("job_id").join(r, F.col("job_id") == F.col("r_job"), "full")
    status = F.when(F.col("job_id").isNull(), "unknown_job").when(F.col("n").isNull(), "no_result").when(F.col("n") == 1, "one_result").otherwise("many_results")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n_jobs"))


@query(
    "ref_J11_runs_at_observation",
    f"WITH r AS (SELECT DISTINCT {I('run_id')} AS run_id, started_at, ended_at FROM audit_runs WHERE ended_at > started_at) SELECT o.observation_id, r.run_id FROM {_OB} o JOIN r ON o.observed_at >= r.started_at AND o.observed_at < r.ended_at",
)
def j11(s, d):
    """All observations, whatever their access."""
    r = table(s, d, "audit_runs").where("ended_at > started_at").select(norm_id("run_id").alias("run_id"), "started_at", "ended_at").distinct()
    return J.interval_join(observations(s, d), "observed_at", r, "started_at", "ended_at").select("observation_id", "run_id")


_SNAP = "SELECT {k} AS channel, count(*) AS n, max(props) AS last FROM events WHERE event_id % 2 = {m} GROUP BY 1"
_S0, _S1 = _SNAP.format(k="user_id", m=0), _SNAP.format(k="user_id + 1", m=1)


@query("ref_J14_snapshot_diff", f"SELECT coalesce(a.channel, b.channel) AS channel, CASE WHEN a.channel IS NULL THEN 'added' WHEN b.channel IS NULL THEN 'removed' ELSE 'changed' END AS change FROM ({_S0}) a FULL JOIN ({_S1}) b ON a.channel = b.channel WHERE a.channel IS NULL OR b.channel IS NULL OR a.n IS DISTINCT FROM b.n OR a.last IS DISTINCT FROM b.last")
def j14(s, d):
    return J.snapshot_diff(sql(s, d, _S0), sql(s, d, _S1), ["channel"], ["n", "last"])


@query("ref_J16_parent_states", f"WITH j AS {_JO} SELECT j.state, p.state AS parent_state, count(*) AS n FROM j LEFT JOIN j p ON j.parent_job_id = p.job_id AND j.case_id IS NOT DISTINCT FROM p.case_id GROUP BY 1, 2")
def j16(s, d):
    j = jobs(s, d).select("job_id", "case_id", "parent_job_id", "state")
    p = j.select(F.col("job_id").alias("p_job"), F.col("case_id").alias("p_case"), F.col("state").alias("parent_state"))
    return j.join(p, (F.col("parent_job_id") == F.col("p_job")) & F.col("case_id").eqNullSafe(F.col("p_case")), "left").groupBy("state", "parent_state").agg(F.count("*").alias("n"))


_STATES = ["ready", "running", "retry_wait", "succeeded", "failed_terminal", "blocked", "cancelled", "skipped", "expired"]


@query("ref_A1_states_with_zero", f"SELECT v.state, count(j.job_id) AS n FROM (VALUES {', '.join(f'({x!r})' for x in _STATES)}) v(state) LEFT JOIN {_JO} j ON v.state = j.state GROUP BY 1")
def a1(s, d):
    """Every state of the list has a row; the list is the left side, the counts are made before the join."""
    counts = jobs(s, d).groupBy("state").agg(F.count("*").alias("k"))
    return s.createDataFrame([(x,) for x in _STATES], "state string").join(counts, "state", "left").select("state", F.coalesce("k", F.lit(0)).alias("n"))


@query("ref_A2_run_totals", f"SELECT CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(download_bytes) AS BIGINT) AS download_bytes, CAST(sum(analysis_bytes) AS BIGINT) AS analysis_bytes, CAST(sum(jobs_claimed) AS BIGINT) AS jobs_claimed, {I('case_id')} AS case_id FROM (SELECT DISTINCT * FROM (SELECT run_id, case_id, requests, download_bytes, analysis_bytes, jobs_claimed FROM audit_runs)) GROUP BY 5")
def a2(s, d):
    cols = ["requests", "download_bytes", "analysis_bytes", "jobs_claimed"]
    return table(s, d, "audit_runs").select("run_id", "case_id", *cols).distinct().groupBy(norm_id("case_id").alias("case_id")).agg(*[F.sum(c).alias(c) for c in cols])


@query("ref_A3_earliest_retry", f"SELECT {I('case_id')} AS case_id, min(CASE WHEN state = 'retry_wait' THEN epoch_us(next_eligible_at) END) AS earliest_us FROM audit_jobs GROUP BY 1")
def a3(s, d):
    return table(s, d, "audit_jobs").groupBy(norm_id("case_id").alias("case_id")).agg(F.min(F.when(F.col("state") == "retry_wait", F.unix_micros("next_eligible_at"))).alias("earliest_us"))


@query("ref_A4_unresolved_reasons", f"SELECT reason, count(*) AS n FROM (SELECT DISTINCT job_id, coalesce(last_error_code, state) AS reason FROM {_JO} WHERE state <> 'succeeded') GROUP BY 1")
def a4(s, d):
    return jobs(s, d).where("state <> 'succeeded'").groupBy(F.coalesce("last_error_code", "state").alias("reason")).agg(F.countDistinct("job_id").alias("n"))


@query("ref_A9_snapshot_id", "SELECT scope_id, sha256(string_agg(h, '' ORDER BY h)) AS snapshot_id, count(*) AS n FROM (SELECT lower(trim(scope_id)) AS scope_id, sha256(concat(lower(trim(asset_id)), '|', coalesce(provider, ''))) AS h FROM assets) GROUP BY 1")
def a9(s, d):
    """Digest of a scope's rows that doesn't depend on their order; rows go past in order."""
    rows = table(s, d, "assets").select(F.lower(F.trim("scope_id")).alias("scope_id"), F.sha2(F.concat(F.lower(F.trim("asset_id")), F.lit("|"), F.coalesce("provider", F.lit(""))), 256).alias("h"))
    return Q.ordered_digest(rows, "scope_id", "h").withColumnRenamed("digest", "snapshot_id")


_EV = "SELECT doc_id, source, lang, CASE WHEN doc_id % 5 IN (0, 1) THEN 'relevant' WHEN doc_id % 5 = 2 THEN 'known_false_positive' ELSE 'unlabeled_unknown' END AS label FROM documents"
_TOT = f"SELECT count(*) FILTER (label = 'relevant' AND doc_id % 2 = 1) AS t FROM ({_EV})"


@query("ref_A15_status_counts", "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS added, count(*) FILTER (l_returnflag = 'N') AS modified, count(*) FILTER (l_returnflag = 'R') AS removed FROM lineitem GROUP BY 1")
def a15(s, d):
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(*[F.count_if(F.col("l_returnflag") == f).alias(n) for f, n in (("A", "added"), ("N", "modified"), ("R", "removed"))])


_LT = f"(SELECT *, rank() OVER (PARTITION BY asset_id, alias_id ORDER BY observed_at DESC) AS r FROM {_OB} WHERE asset_id IS NOT NULL)"


@query("ref_W1_latest_with_ties", f"SELECT observation_id, asset_id, alias_id, epoch_us(observed_at) AS observed_us FROM {_LT} WHERE r = 1")
def w1(s, d):
    return J.latest_with_ties(observations(s, d).where("asset_id is not null"), ["asset_id", "alias_id"], "observed_at").select("observation_id", "asset_id", "alias_id", F.unix_micros("observed_at").alias("observed_us"))


@query("ref_W3_latest_per_target", "SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def w3(s, d):
    return J.latest(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


_COST = "CAST(event_id % 4 AS BIGINT)"


@query("ref_W4_affordable_prefix", f"SELECT user_id, event_id, CAST(spent AS BIGINT) AS spent FROM (SELECT user_id, event_id, sum({_COST}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) WHERE spent <= 20")
def w4(s, d):
    rows = table(s, d, "events").select("user_id", "event_id", "ts", (F.col("event_id") % 4).alias("cost"))
    return Q.affordable_prefix(rows, ["user_id"], ["ts", "event_id"], "cost", F.lit(20)).select("user_id", "event_id", "spent")


@query("ref_W5_aged_order", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(substr(o_orderpriority, 1, 1) AS INT) + trunc((epoch_us(TIMESTAMP '2000-01-01') - epoch_us(o_orderdate)) / 3600000000) DESC, o_orderdate, o_orderkey) AS position FROM orders")
def w5(s, d):
    hours = F.floor((F.lit(946684800000000) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 3600000000)
    aged = F.substring("o_orderpriority", 1, 1).cast("int") + hours
    return table(s, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy(aged.desc(), "o_orderdate", "o_orderkey")).cast("bigint").alias("position"))


@query("ref_W7_hash_chain", "SELECT user_id, count(*) AS links, list_reduce(list_prepend(repeat('0', 64), list(sha256(event_type || coalesce(props, '')) ORDER BY ts, event_id)), lambda acc, x: sha256(acc || x)) AS head FROM events GROUP BY 1")
def w7(s, d):
    return Q.hash_chain(table(s, d, "events"), "user_id", ["ts", "event_id"], F.concat("event_type", F.coalesce("props", F.lit(""))))


@query("ref_W10_round_robin", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY i, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, event_type, event_id) AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events)")
def w10(s, d):
    rank = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return Q.round_robin(table(s, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_type", F.struct(rank.alias("a"), "event_type"), ["event_id"]).select("user_id", "event_id", "position")


@query("ref_W12_first_kept", "SELECT user_id, event_type, min(event_id) AS first_at, count(*) - 1 AS dropped FROM events GROUP BY 1, 2")
def w12(s, d):
    return Q.first_kept(table(s, d, "events"), ["user_id", "event_type"], "event_id")


@query("ref_W13_caps", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 10")
def w13(s, d):
    """First ten rows of each supplier; Spark keeps only the top rows of a group before the shuffle."""
    r = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber"))
    return table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", r.alias("r")).where("r <= 10").drop("r")


@query("ref_W15_lease_expiry", "SELECT state, CASE WHEN state = 'running' AND lease_expires_at <= TIMESTAMPTZ '2025-09-01 00:00:00+00' THEN 'reclaim' ELSE 'keep' END AS action, count(*) AS n FROM audit_jobs GROUP BY 1, 2")
def w15(s, d):
    now = F.timestamp_micros(F.lit(1756684800000000))
    due = (F.col("state") == "running") & (F.col("lease_expires_at") <= now)
    return table(s, d, "audit_jobs").groupBy("state", F.when(due, "reclaim").otherwise("keep").alias("action")).agg(F.count("*").alias("n"))


@query("ref_T1_timeline_order", "SELECT entity_id, count(*) AS n, count(*) FILTER (occurred_at < before) AS out_of_order FROM (SELECT entity_id, occurred_at, lag(occurred_at) OVER (PARTITION BY entity_id ORDER BY sequence, event_id, occurred_at) AS before FROM ledger_events) GROUP BY 1")
def t1(s, d):
    before = F.lag("occurred_at").over(W.partitionBy("entity_id").orderBy("sequence", "event_id", "occurred_at"))
    return table(s, d, "ledger_events").select("entity_id", "occurred_at", before.alias("before")).groupBy("entity_id").agg(F.count("*").alias("n"), F.count_if(F.col("occurred_at") < F.col("before")).alias("out_of_order"))


@query("ref_T4_due_jobs", f"SELECT job_id, state, epoch_us(updated_at) AS updated_us FROM {_JO} WHERE state IN ('ready', 'retry_wait') AND updated_at <= TIMESTAMPTZ '2026-01-01 00:00:00+00'")
def t4(s, d):
    return jobs(s, d).where(F.col("state").isin("ready", "retry_wait") & (F.col("updated_at") <= F.timestamp_micros(F.lit(1767225600000000)))).orderBy("updated_at", "job_id").select("job_id", "state", F.unix_micros("updated_at").alias("updated_us"))


_A, _B = "SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A'", "SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'"


@query("ref_SET6_is_permutation", "SELECT count(*) FILTER (a <> b) AS differing, count(*) AS keys FROM (SELECT o_custkey, count(*) FILTER (o_orderkey % 2 = 0) AS a, count(*) FILTER (o_orderkey % 2 = 1) AS b FROM orders GROUP BY 1)")
def set6(s, d):
    """Multiset equality by counts of each key on both sides."""
    k = table(s, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderkey") % 2 == 0).alias("a"), F.count_if(F.col("o_orderkey") % 2 == 1).alias("b"))
    return k.agg(F.count_if(F.col("a") != F.col("b")).alias("differing"), F.count("*").alias("keys"))


@query("ref_SET7_alias_union", f"SELECT {I('asset_id')} AS asset_id, array_to_string(list_sort(list_distinct(flatten(list(coalesce(required_aliases, []))))), ',') AS aliases FROM assets GROUP BY 1")
def set7(s, d):
    rows = table(s, d, "assets").select(norm_id("asset_id").alias("asset_id"), F.explode_outer("required_aliases").alias("alias"))
    return rows.groupBy("asset_id").agg(F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"))


@query("ref_ST6_reservations")
def st6(s, d):
    rows = table(s, d, "events").select("user_id", "ts", "event_id", (F.col("event_id") % 50).alias("requests"), F.col("event_id").alias("bytes"))
    return Q.reserve(rows, "user_id", ["ts", "event_id"], ["requests", "bytes"], [500, 100_000])
