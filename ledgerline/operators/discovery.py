"""Operators on inventories, discovery channels, scopes and evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerline.functions import urls as U
from ledgerline.functions.namespaces import canonical_url
from ledgerline.operators.joins import latest_with_ties, small


def scope_decisions(urls: DataFrame, targets: DataFrame, policies: DataFrame, now: Column) -> DataFrame:
    """Whether any policy allows an address: id, decision, policies (those that allow it).

    urls: id, url. targets: policy_id, origin, prefix. policies: policy_id, expires_at, excluded (array of canonical
    addresses). An address is allowed if its canonical form has a target's origin and a path that equals the prefix or
    goes on behind it with `/`, and if the policy has neither expired nor excluded it. The decision is the best of
    allowed, excluded, expired, outside; invalid for an address without a canonical form (not https, credentials, unsafe
    paths). Origins are joined by equality, prefixes are a residual; both tables of a scope are configuration.
    """
    u = urls.select("id", canonical_url("url").alias("canonical"))
    u = u.withColumn("u_origin", F.regexp_extract("canonical", "^(https://[^/?]+)", 1)).withColumn("u_path", F.regexp_extract("canonical", "^https://[^/?]+([^?]*)", 1))
    bare = F.rtrim(F.col("prefix"), F.lit("/"))
    rules = targets.join(small(policies), "policy_id").select("policy_id", F.lower("origin").alias("t_origin"), bare.alias("bare"), "expires_at", "excluded")
    inside = (F.col("u_path") == F.col("bare")) | F.startswith(F.col("u_path"), F.concat("bare", F.lit("/"))) | (F.col("bare") == "")
    both = u.join(small(rules), (F.col("u_origin") == F.col("t_origin")) & inside, "left")
    state = F.when(F.col("canonical").isNull(), 4).when(F.col("policy_id").isNull(), 3).when(F.col("expires_at") <= now, 2).when(F.array_contains("excluded", F.col("canonical")), 1).otherwise(0)
    out = both.withColumn("state", state).groupBy("id").agg(F.min("state").alias("state"), F.array_sort(F.collect_set(F.when(F.col("state") == 0, F.col("policy_id")))).alias("policies"))
    names = F.array(*map(F.lit, ("allowed", "excluded", "expired", "outside", "invalid")))
    return out.select("id", names[F.col("state")].alias("decision"), "policies")


def evaluate_at_budgets(results: DataFrame, candidates: DataFrame, schedules: DataFrame, budgets: list[int]) -> DataFrame:
    """Recall and precision of every schedule at every budget, overall (family '') and by family.

    results: query_id, family, cost, candidate_ids. candidates: candidate_id, families (array), label, one row each:
    those that are held out. schedules: schedule, position, query_id, each an order of the same queries. Queries run in
    order until the first that the budget can't pay. A candidate counts from the first query that found it, so each
    (schedule, family, candidate) keeps one number, its least spent cost, whatever the number of budgets.
    """
    order = W.partitionBy("schedule").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    spent = schedules.join(results, "query_id").withColumn("spent", F.sum("cost").over(order))
    found = spent.select("schedule", "family", "spent", F.explode("candidate_ids").alias("candidate_id"))
    known = candidates.select(F.col("candidate_id").alias("c_id"), "families", "label")
    eligible = candidates.select(F.explode(F.concat(F.array(F.lit("")), "families")).alias("family"), "candidate_id", "label").distinct()
    totals = eligible.groupBy("family").agg(F.count_if(F.col("label") == "relevant").alias("relevant_total"))
    hits = found.join(known, F.col("candidate_id") == F.col("c_id"))
    own = hits.where(F.array_contains("families", F.col("family"))).select("schedule", "family", "candidate_id", "label", "spent")
    hits = own.unionByName(hits.select("schedule", F.lit("").alias("family"), "candidate_id", "label", "spent"))
    first = hits.groupBy("schedule", "family", "candidate_id", "label").agg(F.min("spent").alias("spent"))
    at = first.select("*", F.explode(F.array(*map(F.lit, budgets))).alias("budget")).where("spent <= budget")
    n = lambda label: F.count_if(F.col("label") == label)
    counted = at.groupBy("schedule", "budget", "family").agg(F.count(F.lit(1)).alias("selected"), n("relevant").alias("relevant_found"), n("known_false_positive").alias("false_positive"), n("unlabeled_unknown").alias("unknown"))
    families = results.select("family").distinct().unionByName(results.sparkSession.createDataFrame([("",)], "family string"))
    frame = schedules.select("schedule").distinct().join(small(families.join(totals, "family", "left"))).withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    out = frame.join(counted, ["schedule", "budget", "family"], "left").na.fill(0)
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    return out.select("schedule", "budget", "family", "selected", "relevant_found", "relevant_total", "false_positive", "unknown", share(F.col("relevant_found"), F.col("relevant_total")).alias("recall"), share(F.col("relevant_found"), F.col("relevant_found") + F.col("false_positive")).alias("precision"))


def tie_conflicts(rows: DataFrame, keys: list[str], at: str, compared: list[str]) -> DataFrame:
    """Per key its latest rows, those at the same time together: number of rows, and whether they disagree."""
    last = latest_with_ties(rows, keys, at)
    return last.groupBy(*keys).agg(F.max(at).alias(at), F.count(F.lit(1)).alias("n_latest"), (F.count_distinct(F.struct(*compared)) > 1).alias("conflict"))


def with_previous(rows: DataFrame, key: str, order: str, value: str, width: int = 1 << 16) -> DataFrame:
    """Rows with the value of the row before of their key, by `order` (an integer): column `previous`.

    A key is cut into stretches of `width` of the order; only the last row of each stretch passes to the next one, so
    a key with most rows is spread. Rows of equal order are taken by value.
    """
    cut = rows.withColumn("_cut", F.floor(F.col(order) / width))
    inside = W.partitionBy(key, "_cut").orderBy(order, value)
    last = cut.groupBy(key, "_cut").agg(F.max(F.struct(order, value))[value].alias("_last"))
    last = last.select(key, "_cut", F.lag("_last").over(W.partitionBy(key).orderBy("_cut")).alias("_before"))
    both = cut.withColumn("_lag", F.lag(value).over(inside)).withColumn("_n", F.row_number().over(inside)).join(last, [key, "_cut"])
    return both.withColumn("previous", F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_lag"))).drop("_cut", "_lag", "_n", "_before")


def illegal_transitions(rows: DataFrame, key: str, order: str, state: str, legal: dict[str | None, list[str]]) -> DataFrame:
    """Rows whose state may not follow the one before of their key; legal: state before (null: none) to states after."""
    allowed = F.lit(False)
    for before, after in legal.items():
        same = F.col("previous").isNull() if before is None else F.col("previous") == before
        allowed = F.when(same, F.col(state).isin(after)).otherwise(allowed)
    return with_previous(rows, key, order, state).where(~allowed)


def expected_and_found(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, outcome: found, missed (expected only) or additional (found only); repeated rows count once."""
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(True))
    f = found.select(*keys).distinct().withColumn("_f", F.lit(True))
    outcome = F.when(F.col("_f").isNull(), "missed").when(F.col("_e").isNull(), "additional").otherwise("found")
    return e.join(f, keys, "full").select(*keys, outcome.alias("outcome"))


def bound_results(refs: DataFrame, results: DataFrame) -> DataFrame:
    """State of each reference of a job to a result: exact, other_job, ambiguous or missing.

    refs: job_id, result_ref; results: result_ref, job_id. Exact: all rows of that result name the job.
    """
    r = results.groupBy(F.col("result_ref").alias("r_ref")).agg(F.min("job_id").alias("lo"), F.max("job_id").alias("hi"))
    state = F.when(F.col("r_ref").isNull(), "missing").when(F.col("lo") != F.col("hi"), "ambiguous").when(F.col("lo") == F.col("job_id"), "exact").otherwise("other_job")
    return refs.distinct().join(r, F.col("result_ref") == F.col("r_ref"), "left").select("job_id", "result_ref", state.alias("state"))


def channel_status(channels: DataFrame, done: str = "COMPLETE") -> DataFrame:
    """Status of each record's channels: complete if all are done, partial if some are, failed if none is."""
    n = channels.groupBy("record_ref").agg(F.count(F.lit(1)).alias("n_channels"), F.count_if(F.col("state") == done).alias("n_done"))
    return n.withColumn("status", F.when(F.col("n_done") == F.col("n_channels"), "complete").when(F.col("n_done") > 0, "partial").otherwise("failed"))


def last_wins(rows: DataFrame, key: list[str], order: list[str], kept: list[str]) -> DataFrame:
    """Per key the values of its greatest row by `order` (then by the values), and how many rows it replaced."""
    best = rows.groupBy(*key).agg(F.max(F.struct(*order, *kept)).alias("_b"), (F.count(F.lit(1)) - 1).alias("replaced"))
    return best.select(*key, *[F.col("_b")[c].alias(c) for c in kept], "replaced")


def first_seen(rows: DataFrame, group: list[str], order: list[str], value: str, most: int) -> DataFrame:
    """Per group its different values in the order they first came, the first `most` of them, and their number."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.min(F.struct(*order)).alias("_at"))
    place = F.row_number().over(W.partitionBy(*group).orderBy("_at", value))
    kept = first.withColumn("_n", place).groupBy(*group)
    return kept.agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", value)))), lambda x: x[value]).alias("values"), F.count(F.lit(1)).alias("n_values"))


def planned_or_deferred(rows: DataFrame, group: list[str], order: list, cost: str, budget: int) -> DataFrame:
    """Whether a row is planned: all up to the first of its group that the budget can't pay; the rest is deferred."""
    so_far = F.sum(cost).over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("decision", F.when(so_far <= budget, "planned").otherwise("deferred"))


PAGE = "struct<results:array<struct<id:string,url:string>>,has_more:boolean>"


def follow_pages(pages: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What a paged channel yields: (candidates, coverage).

    pages: query, page (from 1), body. Pages are read in order up to the first that ends the stream: without more pages
    (page_exhausted), not of the form (RESPONSE_SHAPE_MISMATCH), without a mark whether there is more
    (PAGINATION_UNDECLARED), or missing although announced (PAGE_MISSING). A page sent twice counts once, its greater body. Candidates are different web addresses,
    the first of each; at most `most` by query, and then the end is candidate_limit_reached. Records that are no web
    address are counted as rejected; only page_exhausted without rejected records is complete.
    """
    p = pages.groupBy("query", "page").agg(F.max("body").alias("body")).select("query", "page", F.from_json("body", PAGE).alias("p"))
    end = F.when(F.col("p.results").isNull(), "RESPONSE_SHAPE_MISMATCH").when(F.col("p.has_more").isNull(), "PAGINATION_UNDECLARED").when(~F.col("p.has_more"), "page_exhausted")
    in_query = W.partitionBy("query").orderBy("page")
    p = p.withColumn("end", end).withColumn("gap", F.col("page") != F.row_number().over(in_query))
    stop = p.groupBy("query").agg(F.min(F.when(F.col("end").isNotNull() & ~F.col("gap"), F.struct("page", "end"))).alias("stop"), F.max(F.when(~F.col("gap"), F.col("page"))).alias("last"))
    read = p.join(stop, "query").where(~F.col("gap") & (F.col("page") <= F.coalesce("stop.page", "last")))
    rows = read.select("query", "page", F.posexplode("p.results").alias("at", "r")).select("query", "page", "at", "r.id", "r.url")
    web = F.coalesce(U.part("url", "scheme").isin("http", "https") & (U.part("url", "host") != ""), F.lit(False))
    found = rows.where(web).groupBy("query", "url").agg(F.min(F.struct("page", "at", "id")).alias("f")).select("query", "url", F.col("f.id").alias("record_id"), "f.page", "f.at")
    place = F.row_number().over(W.partitionBy("query").orderBy("page", "at"))
    found = found.withColumn("n", place).where(F.lit(True) if most is None else F.col("n") <= most).select("query", "url", "record_id", F.col("n").cast("bigint").alias("position"))
    bad = rows.where(~web).groupBy("query").agg(F.count(F.lit(1)).alias("rejected"))
    kept = found.groupBy("query").agg(F.count(F.lit(1)).alias("candidates"))
    n_read = read.groupBy("query").agg(F.count(F.lit(1)).alias("pages"))
    coverage = stop.join(n_read, "query", "left").join(bad, "query", "left").join(kept, "query", "left").na.fill(0, ["pages", "rejected", "candidates"])
    reached = F.lit(False) if most is None else F.col("candidates") >= most
    condition = F.when(reached, "candidate_limit_reached").otherwise(F.coalesce("stop.end", F.lit("PAGE_MISSING")))
    coverage = coverage.select("query", "pages", "candidates", "rejected", condition.alias("end_condition"))
    return found, coverage.withColumn("complete", (F.col("end_condition") == "page_exhausted") & (F.col("rejected") == 0))


def page_overlap(pages: DataFrame) -> DataFrame:
    """How pages of a channel repeat each other: query, pages, records, repeated (records whose id an earlier page had), stale_pages.

    pages: as in follow_pages(); all of them count, in whatever order they came. A stale page has only records that
    earlier ones had. Records without an id are new.
    """
    p = pages.groupBy("query", "page").agg(F.max("body").alias("body")).select("query", "page", F.from_json("body", PAGE)["results"].alias("results"))
    rows = p.select("query", "page", F.posexplode_outer("results").alias("at", "r")).select("query", "page", "at", F.col("r.id").alias("id"))
    first = rows.where("id is not null").groupBy("query", "id").agg(F.min("page").alias("first_page"))
    seen = rows.join(first, ["query", "id"], "left").withColumn("again", F.coalesce(F.col("page") > F.col("first_page"), F.lit(False)))
    by_page = seen.groupBy("query", "page").agg(F.count("at").alias("n"), F.count_if("again").alias("repeats"))
    stale = (F.col("n") > 0) & (F.col("n") == F.col("repeats"))
    return by_page.groupBy("query").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("records"), F.sum("repeats").alias("repeated"), F.count_if(stale).alias("stale_pages"))


def observation_checks(observations: DataFrame, assets: DataFrame) -> DataFrame:
    """Why an observation can't be taken into the ledger, or null: observation_id, reason.

    observations: observation_id, asset_id, alias_id, evidence_ref, observed_at; assets: asset_id, registered_at,
    alias_bindings (map), one row each. In this order: no_asset, unknown_asset, before_registration, unknown_alias, no_evidence.
    """
    a = assets.select(F.col("asset_id").alias("a_id"), "registered_at", F.map_keys("alias_bindings").alias("aliases"))
    both = observations.join(a, F.col("asset_id") == F.col("a_id"), "left")
    reason = F.when(F.col("asset_id").isNull(), "no_asset").when(F.col("a_id").isNull(), "unknown_asset").when(F.col("observed_at") < F.col("registered_at"), "before_registration")
    reason = reason.when(F.col("alias_id").isNotNull() & ~F.coalesce(F.array_contains("aliases", F.col("alias_id")), F.lit(False)), "unknown_alias").when(F.coalesce(F.trim("evidence_ref"), F.lit("")) == "", "no_evidence")
    return both.select("observation_id", reason.alias("reason"))


def suffix_matches(hosts: DataFrame, host: str, domains: DataFrame, domain: str) -> DataFrame:
    """Hosts with the longest known domain that they equal or lie under; hosts without one are left out.

    Every host looks for its own suffixes (one for each label), so it is an equi-join.
    """
    labels = F.split(F.lower(host), r"\.")
    h = hosts.select(F.col(host).alias("host")).where("host <> ''").distinct().select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda n: F.array_join(F.slice(F.split(F.lower("host"), r"\."), n, F.lit(1000)), "."))).alias("suffix"))
    d = domains.select(F.lower(domain).alias("d_domain")).where("d_domain <> ''").distinct()
    return h.join(d, F.col("suffix") == F.col("d_domain")).groupBy("host").agg(F.max(F.struct(F.length("suffix").alias("n"), "suffix"))["suffix"].alias("domain"))
