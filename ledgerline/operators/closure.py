"""Evidence that a finding is closed: the latest observations of everything it covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerline.functions.ids import norm_id
from ledgerline.operators.joins import latest_with_ties

ACCESS = ["ACCESS_DENIED_OBSERVED", "AUTH_REDIRECT_OBSERVED", "NOT_FOUND_OBSERVED"]  # Fixed values
CONTENT = ["NOT_INSPECTED", "PUBLIC_UI"]  # Fixed values
WHOLE = "__asset__"  # stands for the asset itself beside its aliases


def closure_evidence(findings: DataFrame, assets: DataFrame, observations: DataFrame) -> DataFrame:
    """finding_id, required, observed, conflicting, proven: how many of a finding's keys have evidence, and whether all.

    Required are the asset and each alias that isn't null. Only observations strictly later than the remediation and the last change of
    binding count; of those the latest of each key, all of them if they tie. A key is proven if its tied observations
    agree in access and content and each shows no access, no sensitive content, a complete capture under the expected
    policy with a healthy control, no reason code, different references for policy, control and capture, and is bound to
    what it stands for: the asset's target, or the target its alias is bound to, and the asset's policy. Nothing missing
    counts as proven. Findings without a remediation or a known asset have no rows.

    The latest observation later than a floor is a key's latest of all, or there is none: so it is found once for each
    asset and key, never for each finding, and an asset with many findings and observations makes no pairs of them.
    """
    a = assets.select(norm_id("asset_id").alias("a_id"), F.array_distinct(F.concat(F.array(F.lit(WHOLE)), F.array_compact(F.coalesce("required_aliases", F.array().cast("array<string>"))))).alias("keys"), "binding_changed_at", F.array_sort(F.map_entries(F.coalesce("alias_bindings", F.create_map().cast("map<string,string>")))).alias("bindings"), F.struct("target_id", "policy_id").alias("own")).distinct()
    a = a.groupBy("a_id").agg(F.max(F.struct(F.coalesce("binding_changed_at", F.timestamp_seconds(F.lit(0))).alias("changed"), "keys", "bindings", "own")).alias("x")).select("a_id", "x.*")
    f = findings.where("remediation_at is not null").select(norm_id("finding_id").alias("finding_id"), norm_id("asset_id").alias("f_asset"), "remediation_at").distinct()
    f = f.groupBy("finding_id", "f_asset").agg(F.max("remediation_at").alias("remediation_at"))
    k = a.select("a_id", "changed", F.explode("keys").alias("key"), "bindings", "own")
    bound = F.when(F.col("key") == WHOLE, F.col("own.target_id")).otherwise(F.try_element_at(F.map_from_entries("bindings"), F.col("key")))
    k = k.select("a_id", "changed", "key", F.struct(bound.alias("target_id"), F.col("own.policy_id").alias("policy_id")).alias("want"))
    policy, control = F.col("policy_evidence_ref"), F.col("control_evidence_ref")
    three = (policy != "") & (control != "") & (policy != control) & ~policy.eqNullSafe(F.col("evidence_ref")) & ~control.eqNullSafe(F.col("evidence_ref"))
    fine = F.col("access").isin(ACCESS) & F.col("content").isin(CONTENT) & F.col("capture_complete") & F.col("expected_policy") & F.col("control_healthy") & (F.coalesce("reason_code", F.lit("")) == "") & three
    told = F.when(F.col("access").isNotNull() & F.col("content").isNotNull(), F.struct("access", "content"))
    o = observations.select(norm_id("asset_id").alias("o_asset"), F.coalesce("alias_id", F.lit(WHOLE)).alias("o_key"), "observed_at", told.alias("told"), F.coalesce(fine, F.lit(False)).alias("fine"), F.struct("target_id", "policy_id").alias("bind")).where("o_asset is not null and observed_at is not null")
    last = latest_with_ties(o, ["o_asset", "o_key"], "observed_at").groupBy("o_asset", "o_key").agg(F.max("observed_at").alias("at"), F.min("told").alias("low"), F.max("told").alias("high"), F.bool_and("fine").alias("fine"), F.min("bind").alias("bind"), F.max("bind").alias("other"))
    good = F.col("fine") & F.col("bind").eqNullSafe(F.col("want")) & F.col("other").eqNullSafe(F.col("want"))
    k = k.join(last, (F.col("a_id") == F.col("o_asset")) & (F.col("key") == F.col("o_key")), "left").select("a_id", "changed", "key", F.col("at").alias("last_at"), "low", "high", good.alias("good"))
    counts = F.col("finding_id").isNotNull() & (F.col("last_at") > F.greatest("remediation_at", "changed"))
    need = f.join(k, F.col("f_asset") == F.col("a_id")).select("finding_id", "key", *[F.when(counts, F.col(c)).alias(c) for c in ("last_at", "low", "high", "good")])
    ties = need.groupBy("finding_id", "key", "last_at").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_and("good").alias("good"))
    keys = ties.groupBy("finding_id", "key").agg(F.sum("n").alias("n"), F.max(F.struct("last_at", "low", "high", "good")).alias("x")).select("finding_id", "n", "x.*")
    conflict = F.coalesce(F.col("low") != F.col("high"), F.lit(False))
    out = keys.groupBy("finding_id").agg(F.sum("n").alias("required"), F.count("last_at").alias("observed"), F.count_if(conflict).alias("conflicting"), F.count_if(F.col("good") & ~conflict).alias("proven_keys"))
    return out.select("finding_id", "required", "observed", "conflicting", (F.col("proven_keys") == F.col("required")).alias("proven"))
