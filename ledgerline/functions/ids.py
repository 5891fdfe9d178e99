"""Identifier, time and skew helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: All characters that Unicode counts as white space. Fixed values.
BLANK = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def norm_id(c: str | Column) -> Column:
    """Ids compare without letter case and surrounding white space; a blank id is null."""
    t = F.lower(F.btrim(as_col(c).cast("string"), F.lit(BLANK)))
    return F.when(t != "", t)


def utc_month(c: str | Column) -> Column:
    """`YYYY-MM` of a timestamp in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(as_col(c), F.current_timezone()), "yyyy-MM")


def heavy_keys(left: DataFrame, keys: list[str], total: int, most: int = 100_000, floor: int = 50_000) -> list:
    """Key values with more rows than one task should take: at least `floor`, and never more than `most` keys.

    Only where the table has over most * floor (5 billion) rows does the number of rows rise that makes a key hot.
    """
    n = max(floor, -(-total // most))
    if total < n:
        return []
    return left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= n).collect()


def skew_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, heavy: list, how: str = "left", block: int = 50_000) -> DataFrame:
    """Equi-join whose left side may have hot keys (`heavy`, rows of (key, n_rows) from heavy_keys).

    Rows of a hot key are spread over n_rows/block salts and the right rows of that key are repeated once per salt,
    so no task gets more than about `block` rows of a hot key. The list of hot keys is bounded by heavy_keys().
    """
    if not heavy:
        return left.join(right, left[left_key] == right[right_key], how)
    spark = left.sparkSession
    hot = F.broadcast(spark.createDataFrame([(r[0], max(1, -(-r[1] // block))) for r in heavy], f"_hot {left.schema[left_key].dataType.simpleString()}, _salts int"))
    spread = left.join(hot, left[left_key] == hot["_hot"], "left").withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.floor(F.rand(7) * F.col("_salts")).cast("int")).otherwise(0)).drop("_hot", "_salts")
    copies = right.join(hot, right[right_key] == hot["_hot"], "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_hot", "_salts")
    return spread.join(copies, (spread[left_key] == copies[right_key]) & (spread["_salt"] == copies["_copy"]), how).drop("_salt", "_copy")
