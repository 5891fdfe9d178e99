"""References to records that do not exist (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.bitmap import maybe_in
from ledgerline.functions.ids import norm_id, utc_month
from ledgerline.sources.shared import counted, materialize

HEAVY_KEYS = 100_000  #: at most so many keys are checked by broadcast
HEAVY_FLOOR = 20_000  #: a key with so many references is heavy, unless there are too many of them


def _reason(created: Column, gone: Column, known: Column, at: Column) -> Column:
    return F.when(known.isNull(), F.lit("absent")).when(gone <= at, F.lit("withdrawn")).when(created > at, F.lit("late"))


def orphan_references(refs: DataFrame, targets: DataFrame, most: int = HEAVY_KEYS, floor: int = HEAVY_FLOOR) -> DataFrame:
    """One row per distinct reference whose target is not there at the reference's time.

    refs: ref_table, ref_field, target (name of the target table), row_id, key, ref_time; targets: target, key,
    created_at, gone_at, one row per (target, key). Skew-aware split: references are counted per (target, key, month)
    on the map side; keys with more references than one task should take (at least `floor`, and at most `most` keys)
    are checked against a broadcast of their own target rows; the groups of all other keys are anti-joined by shuffle.
    Only groups with an orphan are looked for among the references, behind a filter that spares the others the
    shuffle; a group of a light key is no larger than a heavy key's least. Both results are united.

    Null or blank keys refer to nothing and are left out. A null ref_time can only be `absent`, with a null month.
    Repeated rows count once. Empty inputs give an empty result; extra columns are ignored.
    """
    refs = materialize(refs.select("ref_table", "ref_field", "target", "row_id", "key", "ref_time", utc_month("ref_time").alias("ref_month")).where("key is not null"), n="count(1)")
    targets = targets.select(F.col("target").alias("t_target"), F.col("key").alias("t_key"), "created_at", "gone_at")
    groups = materialize(refs.groupBy("target", "key", "ref_month").agg(F.count(F.lit(1)).alias("n"), F.min("ref_time").alias("first_at"), F.max("ref_time").alias("last_at")))
    total = counted(refs)["n"]
    least = max(floor, -(-total // most))
    hot = [(r[0], r[1]) for r in groups.groupBy("target", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()] if total >= least else []

    out = []
    light_refs, light_groups = refs, groups
    if hot:
        heavy = F.broadcast(refs.sparkSession.createDataFrame(hot, "h_target string, h_key string"))
        at = lambda d: [d["target"] == heavy["h_target"], d["key"] == heavy["h_key"]]
        lives = F.broadcast(heavy.join(targets, (F.col("h_target") == F.col("t_target")) & (F.col("h_key") == F.col("t_key")), "left"))
        out.append(refs.join(lives, at(refs)).withColumn("reason", _reason(F.col("created_at"), F.col("gone_at"), F.col("t_key"), F.col("ref_time"))))
        light_refs = refs.join(heavy, at(refs), "left_anti")
        light_groups = groups.join(heavy, at(groups), "left_anti")

    seen = light_groups.join(targets, (F.col("target") == F.col("t_target")) & (F.col("key") == F.col("t_key")), "left")
    # a group is kept if its first or last reference can be an orphan, or if it has no time at all
    group_id = F.xxhash64("target", "key", F.coalesce("ref_month", F.lit("")))
    doubtful = seen.where("t_key is null or gone_at <= last_at or created_at > first_at").select(F.col("target").alias("g_target"), F.col("key").alias("g_key"), F.col("ref_month").alias("g_month"), "t_key", "created_at", "gone_at", group_id.alias("g_id"))
    doubtful = materialize(doubtful, n="count(1)")
    maybe = maybe_in(light_refs.withColumn("r_id", group_id), "r_id", doubtful, "g_id", counted(doubtful)["n"])
    same = (F.col("r_id") == F.col("g_id")) & (F.col("target") == F.col("g_target")) & (F.col("key") == F.col("g_key")) & F.col("ref_month").eqNullSafe(F.col("g_month"))
    out.append(maybe.join(doubtful, same).withColumn("reason", _reason(F.col("created_at"), F.col("gone_at"), F.col("t_key"), F.col("ref_time"))))

    columns = ["ref_table", "ref_field", "row_id", F.col("key").alias("missing_id"), "reason", "ref_month"]
    parts = [o.where("reason is not null").select(*columns) for o in out]
    return (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).distinct()


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphan references per table, field, month and reason, with the number of different missing ids."""
    return orphans.groupBy("ref_table", "ref_field", "ref_month", "reason").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("missing_id").alias("n_missing"))


def latest_jobs(jobs: DataFrame, *columns: str) -> DataFrame:
    """The row with the latest updated_at of each job; among equal times the greatest row, so the choice is fixed."""
    kept = [c for c in columns if c not in ("job_id", "updated_at")]
    best = F.max(F.struct("updated_at", *[F.col(c) for c in kept])).alias("best")
    return jobs.withColumn("job_id", norm_id("job_id")).where("job_id is not null").groupBy("job_id").agg(best).select("job_id", "best.*")


def audit_references(assets: DataFrame, observations: DataFrame, findings: DataFrame, jobs: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The references of the audit tables and what they point at, in the form orphan_references() takes."""
    current = materialize(latest_jobs(jobs, "created_at", "purged_at", "result_refs"))

    def ref(df: DataFrame, name: str, field: str, target: str, row: str, key: Column, at: str) -> DataFrame:
        return df.select(F.lit(name).alias("ref_table"), F.lit(field).alias("ref_field"), F.lit(target).alias("target"), norm_id(row).alias("row_id"), norm_id(key).alias("key"), F.col(at).alias("ref_time"))

    refs = ref(observations, "observations", "asset_id", "assets", "observation_id", F.col("asset_id"), "observed_at")
    refs = refs.unionByName(ref(findings, "findings", "asset_id", "assets", "finding_id", F.col("asset_id"), "opened_at"))
    refs = refs.unionByName(ref(results, "audit_results", "job_id", "audit_jobs", "result_ref", F.col("job_id"), "saved_at"))
    refs = refs.unionByName(ref(current.select("job_id", "updated_at", F.explode("result_refs").alias("one_ref")), "audit_jobs", "result_refs", "audit_results", "job_id", F.col("one_ref"), "updated_at"))

    def target(df: DataFrame, name: str, key: str, created: str, gone: str) -> DataFrame:
        one = df.select(norm_id(key).alias("key"), F.col(created).alias("created_at"), F.col(gone).alias("gone_at")).where("key is not null")
        return one.groupBy("key").agg(F.max(F.struct("created_at", "gone_at")).alias("x")).select(F.lit(name).alias("target"), "key", "x.*")

    targets = target(assets, "assets", "asset_id", "registered_at", "withdrawn_at")
    targets = targets.unionByName(target(current, "audit_jobs", "job_id", "created_at", "purged_at"))
    return refs, targets.unionByName(target(results, "audit_results", "result_ref", "saved_at", "purged_at"))
