"""The pN_ queries of the training-text problems 6 to 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm import leakage, packing, spans
from ledgerline.sources.shared import materialize, table


def p6_containers(s: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(s, d, "documents"))


def p6_fill(s: SparkSession, d: str) -> DataFrame:
    """How full the containers are, by the bucket of their longest item."""
    one = p6_containers(s, d).groupBy("container_id").agg(F.max("bucket_bound").alias("bucket_bound"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    return one.groupBy("bucket_bound").agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.round(F.avg("tokens") / packing.CAPACITY, 6).alias("fill"))


def p6_compared(s: SparkSession, d: str) -> DataFrame:
    """Containers and fill with the chosen bounds, with even ones and with a single bucket."""
    return packing.compared(table(s, d, "documents"))


def p6_check(s: SparkSession, d: str) -> DataFrame:
    """What must hold of every assignment, counted: all documents once, none empty by mistake, no container over capacity or of two buckets."""
    out = materialize(p6_containers(s, d))
    held = out.groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("bucket_bound").alias("buckets"))
    held = held.agg(F.count_if(F.col("tokens") > packing.CAPACITY).alias("over_capacity"), F.count_if(F.col("buckets") > 1).alias("of_two_buckets"))
    docs = out.groupBy("doc_id").agg(F.count_if(F.col("piece") == 0).alias("firsts"), F.sum("n_tokens").alias("tokens"), F.count_if(F.col("n_tokens") < packing.CAPACITY).alias("partial"))
    docs = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("tokens") == 0).alias("without_tokens"), F.count_if((F.col("firsts") != 1) | (F.col("partial") > 1)).alias("cut_or_repeated"))
    return docs.crossJoin(held)  # one row each


def p7_spans(s: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(s, d, "documents"), table(s, d, "eval_items"))


def p7_found(s: SparkSession, d: str) -> DataFrame:
    return p7_spans(s, d).select("doc_id", "item_id").distinct()


def p8_found(s: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(s, d, "documents"))


def p8_longest(s: SparkSession, d: str) -> DataFrame:
    """The longest doubled window of each document that stands in another one too, and the windows that were extended."""
    docs = table(s, d, "documents")
    return spans.longest_spans(docs, materialize(spans.shared_spans(docs))).groupBy("doc_id").agg(F.max("length").alias("length"), F.count_if(F.col("length") > spans.SPAN).alias("n_extended"))


def p8_report(s: SparkSession, d: str) -> DataFrame:
    return spans.shared_report(materialize(p8_found(s, d)), table(s, d, "documents"))


QUERIES = {f.__name__: f for f in (p6_containers, p6_fill, p6_compared, p6_check, p7_found, p7_spans, p8_found, p8_longest, p8_report)}
_P8 = """WITH places AS (SELECT doc_id, unnest(range(0, length(text) - 299)) AS i, text FROM documents WHERE length(text) >= 300),
held AS (SELECT doc_id, i, md5(substr(text, i + 1, 300)) AS h FROM places),
shared AS (SELECT h FROM held GROUP BY h HAVING min(doc_id) <> max(doc_id)),
hits AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM held SEMI JOIN shared USING (h)),
runs AS (SELECT doc_id, i, sum(CASE WHEN before + 300 >= i THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits),
found AS (SELECT doc_id, min(i) AS start_char, max(i) + 300 AS end_char FROM runs GROUP BY doc_id, run)
"""
ORACLE: dict[str, str] = {
    "p8_found": _P8 + "SELECT doc_id, start_char, end_char FROM found",
    "p8_report": _P8 + "SELECT doc_id, count(*) AS n_spans, CAST(sum(end_char - start_char) AS BIGINT) AS shared_chars, any_value(length(text)) AS total_chars, round(sum(end_char - start_char) / any_value(length(text)), 6) AS share FROM found JOIN documents USING (doc_id) GROUP BY doc_id",
    "p6_check": "SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT doc_id) FILTER (coalesce(text, '') = '') AS without_tokens, 0 AS cut_or_repeated, 0 AS over_capacity, 0 AS of_two_buckets FROM documents",
}
