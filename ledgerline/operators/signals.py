"""Value-free signals of captured text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions import patterns as P
from ledgerline.functions.text import has, masked_examples, matches, tax_number_valid

VALUES = [("EMAIL_VALUE_CANDIDATE", "email", P.EMAIL), ("KR_PHONE_VALUE_CANDIDATE", "phone", P.PHONE), ("KR_RESIDENT_VALUE_CANDIDATE", "resident", P.RESIDENT), ("KR_VEHICLE_PLATE_CANDIDATE", "plate", P.PLATE)]
MAX_SIGNALS = 32
CANARY = "SYNTHETIC_CANARY_"  #: prefix of planted markers; a parameter of marker_signals()


def value_signals(captures: DataFrame) -> DataFrame:
    """id, code, occurrences, unique_values, masked_examples of the values in `body`; no value itself comes out.

    Null bodies have no signals; extra columns are ignored.
    """
    found = [F.struct(F.lit(code).alias("code"), F.lit(kind).alias("kind"), matches("body", pattern).alias("found")) for code, kind, pattern in VALUES]
    tax = F.filter(matches("body", P.BUSINESS), tax_number_valid)
    found.append(F.struct(F.lit("KR_BUSINESS_NUMBER_CANDIDATE").alias("code"), F.lit("business").alias("kind"), tax.alias("found")))
    rows = captures.where("body is not null").select("id", F.explode(F.array(*found)).alias("s")).select("id", "s.*").where(F.size("found") > 0)
    examples = masked_examples("other", F.col("found"))
    for kind in ("email", "phone", "resident", "plate", "business"):
        examples = F.when(F.col("kind") == kind, masked_examples(kind, F.col("found"))).otherwise(examples)
    return rows.select("id", "code", F.size("found").cast("bigint").alias("occurrences"), F.size(F.array_distinct("found")).cast("bigint").alias("unique_values"), examples.alias("masked_examples"))


def content_verdict(codes: str) -> Column:
    """Codes that end in _CANDIDATE make a SENSITIVE_CANDIDATE, except the mere endpoint; a canary overrides."""
    sensitive = F.exists(codes, lambda c: c.endswith("_CANDIDATE") & (c != "RUNTIME_ENDPOINT_CANDIDATE"))
    return F.when(F.array_contains(codes, "SYNTHETIC_CANARY_PRESENT"), "SYNTHETIC_CONTENT_CONFIRMED").when(sensitive, "SENSITIVE_CANDIDATE").otherwise("NOT_INSPECTED")


def marker_signals(captures: DataFrame, canary: str = CANARY) -> DataFrame:
    """id, codes (in order of emission, at most 32), content verdict and pending reviews of plain captures.

    Codes that end in _CANDIDATE make the content a SENSITIVE_CANDIDATE, except the mere endpoint; a canary overrides.
    The challenge code comes after the verdict and has no part in it.
    """
    script = F.lower("content_type").contains("javascript")
    tax = F.exists(matches("body", P.BUSINESS), tax_number_valid)
    value = lambda p: has("body", p) & ~script
    rules = [(code, has("body", pattern)) for code, pattern in P.SECRETS.items()]
    rules += [("PUBLISHABLE_KEY_PRESENT", F.contains("body", F.lit("sb_publishable_"))), ("UNTRUSTED_INSTRUCTION_TEXT", has("body", P.UNTRUSTED, True)), ("CLIENT_ENCRYPTION_INDICATOR", has("body", P.ENCRYPTION, True))]
    rules += [("SYNTHETIC_CANARY_PRESENT", F.contains("body", F.lit(canary)))]
    looks_json = F.contains(F.lower("content_type"), F.lit("json")) | F.ltrim("body").rlike(r"^[{\[]")
    rules += [("JSON_PARSE_INCOMPLETE", looks_json & F.try_parse_json("body").isNull())]
    rules += [(code, value(pattern)) for code, _, pattern in VALUES] + [("KR_BUSINESS_NUMBER_CANDIDATE", tax & ~script)]
    rules += [("CONFIDENTIAL_MARKER_CANDIDATE", has("body", P.CONFIDENTIAL, True))]
    rules += [("CLIENT_PASSWORD_CANDIDATE", script & (has("body", P.PASSWORD_ASSIGNMENT, True) | has("body", P.PASSWORD_COMPARISON, True)))]
    rules += [("RUNTIME_ENDPOINT_CANDIDATE", has("body", P.FETCH_LITERAL)), ("RUNTIME_ENDPOINT_UNRESOLVED", script & has("body", P.FETCH_DYNAMIC))]
    codes = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))
    rows = captures.where("body is not null").select("id", "body", F.slice(codes, 1, MAX_SIGNALS).alias("codes")).withColumn("content", content_verdict("codes"))
    late = F.when(has("body", P.CHALLENGE, True) & (F.size("codes") < MAX_SIGNALS), F.array(F.lit("CHALLENGE_PAGE_INDICATOR"))).otherwise(F.array())
    pending = F.when(has("body", P.IMAGE_PENDING, True), F.array(F.lit("image_or_base64_review"))).otherwise(F.array().cast("array<string>"))
    return rows.select("id", F.concat("codes", late.cast("array<string>")).alias("codes"), "content", pending.alias("pending_reviews"))


def secret_offsets(captures: DataFrame) -> DataFrame:
    """id, code, offset of the first match of each secret pattern; offsets in characters from 0."""
    one = [F.struct(F.lit(code).alias("code"), (F.regexp_instr("body", F.lit(P.java(pattern))) - 1).cast("bigint").alias("offset")) for code, pattern in P.SECRETS.items()]
    return captures.where("body is not null").select("id", F.explode(F.array(*one)).alias("s")).select("id", "s.*").where("offset >= 0")


def dom_flow(captures: DataFrame) -> DataFrame:
    """Lexical counts of data declarations, DOM writes, event bindings and render calls in script captures."""
    count = lambda p, ic=False: F.regexp_count("body", F.lit(P.java(p, ic))).cast("bigint")
    return captures.where("body is not null").select("id", count(P.DOM_DECLARATION).alias("declarations"), count(P.DOM_SINK).alias("sinks"), count(P.DOM_EVENT, True).alias("events"), count(P.DOM_RENDER, True).alias("renders"))


def project_inline_images(captures: DataFrame) -> DataFrame:
    """Bodies with the payload of inline images left out, the number of them and the digest of the whole body."""
    pattern = F.lit(P.INLINE_IMAGE)
    return captures.where("body is not null").select("id", F.regexp_replace("body", pattern, F.lit("$1[inline-image-omitted]")).alias("projected"), F.regexp_count("body", pattern).cast("bigint").alias("images"), F.sha2("body", 256).alias("digest"))
