"""A bitmap of bounded size as a filter for joins: which keys can have a partner at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LEAST, MOST = 1 << 18, 1 << 26  #: bits of a filter; its words of 64 bits are broadcast: 4,096 to a million rows


def filter_bits(n_keys: int | None) -> int:
    """Eight to sixteen bits for each key within the bounds; a million keys are assumed where their number is unknown."""
    return 1 << 23 if n_keys is None else min(MOST, max(LEAST, 1 << (8 * n_keys).bit_length()))


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def maybe_in(left: DataFrame, left_key: str, keys: DataFrame, key: str, n_keys: int | None = None) -> DataFrame:
    """Rows of left whose key may be among `keys`: all that are, and few others unless keys outnumber the bits.

    n_keys: about how many keys there are, if that is known. The words that are broadcast are a million at most. The
    filter only spares the shuffle rows that can't match; the join that follows decides. Beyond some 50 million keys
    it lets more and more through; the join then does the work.
    """
    bits = filter_bits(n_keys)
    at = keys.where(F.col(key).isNotNull()).select(_bit(F.col(key), bits).alias("_b"))
    words = at.groupBy(F.expr("_b div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_b % 64 as int)))").alias("_bits"))
    rows = left.withColumn("_l", _bit(F.col(left_key), bits))
    hit = F.expr("(shiftright(_bits, cast(_l % 64 as int)) & 1L) = 1L")
    return rows.join(F.broadcast(words), F.expr("_l div 64") == F.col("_word")).where(hit).select(*left.columns)
