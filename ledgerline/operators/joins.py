"""Joins by interval, prefix and latest state, written so that no key need fit one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_ROWS = 100_000  #: a side is broadcast only if it was counted to have no more rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows by count, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def interval_join(points: DataFrame, at: str, spans: DataFrame, start: str, end: str, keys: list[str] = (), bucket_s: int = 86_400) -> DataFrame:
    """Points with the spans [start, end) that hold them; columns of both sides, points without a span left out.

    Both sides meet on a time bucket (and on `keys`), so it is an equi-join whatever the sizes. A span that covers many
    buckets is cut by levels of ever wider buckets, so it makes few rows and points look at one bucket of each level.
    """
    levels = 4
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    last = F.floor((F.unix_micros(F.col(end).cast("timestamp")) - 1) / 1_000_000)
    width = lambda lv: bucket_s * 32**lv
    count = F.floor(last / bucket_s) - F.floor(seconds(start) / bucket_s) + 1
    level = F.when(count <= 32, 0)
    for lv in range(1, levels):
        level = level.when(count <= 32 ** (lv + 1), lv)
    level = level.otherwise(levels)
    size = F.lit(bucket_s) * F.pow(F.lit(32), F.col("_level"))
    cut = spans.where(F.col(end) > F.col(start)).withColumn("_level", level)
    cut = cut.withColumn("_bucket", F.explode(F.sequence(F.floor(seconds(start) / size), F.floor(last / size))))
    looks = F.explode(F.array(*[F.struct(F.lit(lv).alias("_l"), F.floor(seconds(at) / width(lv)).alias("_b")) for lv in range(levels + 1)]))
    p = points.withColumn("_look", looks).withColumn("_pl", F.col("_look._l")).withColumn("_pb", F.col("_look._b")).drop("_look")
    condition = (F.col("_pl") == F.col("_level")) & (F.col("_pb") == F.col("_bucket")) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    renamed = cut.withColumnsRenamed({k: f"_s_{k}" for k in keys})
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"_s_{k}"))
    return p.join(renamed, condition).drop("_pl", "_pb", "_level", "_bucket", *[f"_s_{k}" for k in keys])


def prefix_join(paths: DataFrame, path: str, keys: list[str], rules: DataFrame, prefix: str) -> DataFrame:
    """Rows whose path equals a rule's prefix or goes on behind it with `/`; equal keys, the prefix as a residual.

    The rules are a configuration table: broadcast if counted small, else joined by shuffle on the keys.
    """
    r = small(rules.withColumnsRenamed({k: f"_r_{k}" for k in keys}))
    bare = F.rtrim(F.col(prefix), F.lit("/"))
    condition = (F.col(path) == bare) | F.startswith(F.col(path), F.concat(bare, F.lit("/"))) | (bare == "")
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"_r_{k}"))
    return paths.join(r, condition).drop(*[f"_r_{k}" for k in keys])


def latest_with_ties(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """All rows at the latest time of their key. The maximum is combined on the map side and joined back on key and
    time together, so a key with many rows is spread over its times."""
    top = rows.groupBy(*keys).agg(F.max(at).alias(at))
    condition = [rows[k].eqNullSafe(top[k]) for k in keys] + [rows[at] == top[at]]
    return rows.join(top, condition, "left_semi")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the greatest by `order` and then by all columns; combined on the map side, without a window."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_x")).select(*keys, "_x.*").select(*rows.columns)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """added, removed and changed keys between two snapshots; nulls are equal to each other."""
    o = old.select(*keys, F.struct(*compared).alias("_old"), F.lit(True).alias("_in_old"))
    n = new.select(*keys, F.struct(*compared).alias("_new"), F.lit(True).alias("_in_new"))
    kind = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return o.join(n, keys, "full").select(*keys, kind.alias("change")).where("change is not null")


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))
