"""Reviews of captured content that combine parsing and signals."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerline.functions import patterns as P
from ledgerline.functions.ids import as_col
from ledgerline.functions.namespaces import DOCUMENT_SUFFIXES
from ledgerline.functions.text import has, redact, value_state
from ledgerline.operators.parsers import _table, html_regions, js_literals, json_nodes, text_chunks

#: First-match categories of a field's words, in order of precedence. Fixed values.
FIRST_CATEGORIES = {
    "margin": ["margin", "cost", "cogs", "markup", "원가", "마진"],
    "pricing": ["price", "pricing", "rate", "rates", "rent", "rental", "lease", "discount", "fare", "fee", "요금", "가격", "렌트료", "할인", "리스료"],
    "customer_contact": ["customer", "client", "email", "phone", "telephone", "mobile", "contact", "고객", "이메일", "전화번호", "휴대폰"],
    "contract_vehicle_record": ["vehicle", "car", "vin", "plate", "차량", "차종", "차량번호"],
    "commission_settlement": ["commission", "settlement", "수수료", "정산"],
    "partner": ["partner", "vendor", "affiliate", "파트너", "협력"],
    "financial": ["revenue", "profit", "invoice", "balance", "expense", "budget", "매출", "수익", "예산"],
}
#: Business words in gate pages. Fixed values.
GATE_WORDS = {"commission": "수수료|commission", "cost": "원가|조달|cost.price|purchase.price", "interest": "금리|interest.rate", "depreciation": "감가|잔가|depreciation|residual", "deposit": "보증금|선납금|deposit", "inventory": "재고|inventory|stock", "customer_contract": "고객|계약|customer|contract"}


def first_category(key: str | Column) -> Column:
    """The one category of a field name: the first, in order of precedence, that shares a word with it."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(as_col(key), "([a-z])([A-Z])", "$1_$2")), F.lit("[a-z]+|[가-힣]+"), F.lit(0))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, terms in FIRST_CATEGORIES.items():
        out = out.when(F.arrays_overlap(words, F.array(*map(F.lit, terms))), name)
    return out


def static_categories(captures: DataFrame) -> DataFrame:
    """Categories of the fields in scripts' data literals: id, category, candidates, filled, templates, calculations."""
    data = js_literals(captures).where("reason is null").select("id", F.col("value_json").alias("body"))
    fields = json_nodes(data).select("id", first_category("key").alias("category"), F.when(F.col("kind").isin("object", "list", "null"), "field_name_only").otherwise(value_state("value")).alias("state")).where("category is not null")
    count = lambda s: F.count_if(F.col("state") == s)
    return fields.groupBy("id", "category").agg(F.count("*").alias("candidates"), count("value").alias("filled"), count("template").alias("templates"), count("calculation").alias("calculations"))


def strongest_states(nested: DataFrame) -> DataFrame:
    """State of each container: the strongest of its leaves, by path prefix. nested: id, path of the leaf, state."""
    rank = F.when(F.col("state") == "value", 3).when(F.col("state") == "calculation", 2).when(F.col("state") == "template", 1).otherwise(0)
    parts = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    best = nested.select("id", above.alias("container"), rank.alias("r")).groupBy("id", "container").agg(F.max("r").alias("r"))
    return best.select("id", "container", F.get(F.array(*map(F.lit, ("field_name_only", "template", "calculation", "value"))), F.col("r")).alias("state"))


def chunk_findings(captures: DataFrame, size: int = 240_000, overlap: int = 4_000) -> DataFrame:
    """Signal codes of long bodies, found per overlapping chunk and put together: id, codes (sorted), chunks."""
    from ledgerline.operators.signals import marker_signals

    chunks = text_chunks(captures, size, overlap).select(F.struct("id", "chunk").alias("id"), F.col("text").alias("body"), F.lit("text/plain").alias("content_type"))
    codes = marker_signals(chunks).select("id.id", "id.chunk", F.explode_outer("codes").alias("code"))
    return codes.groupBy("id").agg(F.array_sort(F.collect_set("code")).alias("codes"), F.countDistinct("chunk").alias("chunks"))


def page_signals(captures: DataFrame) -> DataFrame:
    """Signals of html captures by region: hidden elements, login forms, markers, client passwords in scripts, endpoints."""
    r = html_regions(captures)
    script = F.array_join("scripts", "\n")
    one = lambda rule, code: F.when(rule, F.lit(code))
    seen = F.concat_ws(" ", "visible", "hidden", "inputs")
    rules = [
        one(has(seen, P.EMAIL), "EMAIL_VALUE_CANDIDATE"),
        one(has("visible", P.CONFIDENTIAL, True) | has("hidden", P.CONFIDENTIAL, True), "CONFIDENTIAL_MARKER_CANDIDATE"),
        one(has(script, P.PASSWORD_ASSIGNMENT, True) | has(script, P.PASSWORD_COMPARISON, True), "CLIENT_PASSWORD_CANDIDATE"),
        one(F.col("hidden_elements") > 0, "HIDDEN_DOM_PRESENT"),
        one(F.col("password_inputs") > 0, "LOGIN_FORM_INDICATOR"),
        one(has(script, P.FETCH_LITERAL), "RUNTIME_ENDPOINT_CANDIDATE"),
        one(has(script, P.FETCH_DYNAMIC), "RUNTIME_ENDPOINT_UNRESOLVED"),
    ]
    return r.select("id", F.array_compact(F.array(*rules)).alias("codes"), F.when(has("visible", P.CONFIDENTIAL, True), "visible_body").when(has("hidden", P.CONFIDENTIAL, True), "hidden_body").alias("marker_region"))


def _is_page() -> Column:
    return F.coalesce(F.lower("content_type").startswith("text/html"), F.lit(False))


def region_captures(captures: DataFrame) -> DataFrame:
    """Captures as texts without mark-up: id, region, body, content_type. Plain ones are one region, `body`.

    A page has `visible`, and where they hold text `hidden`, `inputs`, `script` and each data script as `json<n>`.
    """
    plain = captures.where(~_is_page() & F.col("body").isNotNull()).select("id", F.lit("body").alias("region"), "body", "content_type")
    one = lambda region, body, kind: F.struct(region.alias("region"), body.alias("body"), F.lit(kind).alias("content_type"))
    texts = [one(F.lit(c), F.col(c), "text/plain") for c in ("visible", "hidden", "inputs")] + [one(F.lit("script"), F.array_join("scripts", "\n"), "text/javascript")]
    data = F.transform("json_scripts", lambda x, n: one(F.concat(F.lit("json"), n.cast("string")), x, "application/json"))
    pages = html_regions(captures.where(_is_page())).select("id", F.explode(F.concat(F.array(*texts), data)).alias("r")).select("id", "r.*")
    return plain.unionByName(pages.where("body <> '' or region = 'visible'"))


def text_captures(captures: DataFrame) -> DataFrame:
    """Captures with the regions of each page as one body, for value_signals(); no match reaches over two regions."""
    order = F.array_position(F.array(*map(F.lit, ("body", "visible", "hidden", "inputs", "script"))), F.col("region"))
    parts = F.array_sort(F.collect_list(F.struct(F.when(order > 0, order).otherwise(9).alias("n"), "region", "body")))
    pages = region_captures(captures.where(_is_page())).groupBy("id").agg(F.array_join(F.transform(parts, lambda x: x["body"]), "\n\u241e\n").alias("body"))
    return captures.where(~_is_page()).select("id", "body").unionByName(pages)


def page_verdicts(captures: DataFrame) -> DataFrame:
    """Like marker_signals() for html captures, from all their regions: id, codes (sorted), content, pending_reviews.

    Visible text is no JSON, so only data scripts are tested for that; images are mark-up, so the raw body tells of them.
    """
    from ledgerline.operators.signals import content_verdict, marker_signals

    pages = captures.where(_is_page() & F.col("body").isNotNull())
    regions = marker_signals(region_captures(pages).select(F.struct("id", "region").alias("id"), "body", "content_type"))
    no_json = F.filter("codes", lambda c: c != "JSON_PARSE_INCOMPLETE")
    found = regions.select("id.id", F.when(F.col("id.region").startswith("json"), F.col("codes")).otherwise(no_json).alias("codes"), "pending_reviews")
    none = F.array().cast("array<string>")
    found = found.unionByName(page_signals(pages).select("id", "codes", none.alias("pending_reviews")))
    found = found.unionByName(pages.select("id", none.alias("codes"), F.when(has("body", P.IMAGE_PENDING, True), F.array(F.lit("image_or_base64_review"))).otherwise(none).alias("pending_reviews")))
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return found.groupBy("id").agg(every("codes"), every("pending_reviews")).select("id", "codes", content_verdict("codes").alias("content"), "pending_reviews")


def region_secrets(captures: DataFrame) -> DataFrame:
    """secret_offsets() in every region: id, region, code, offset in the region's text."""
    from ledgerline.operators.signals import secret_offsets

    return secret_offsets(region_captures(captures).select(F.struct("id", "region").alias("id"), "body")).select("id.id", "id.region", "code", "offset")


def gate_flags(captures: DataFrame) -> DataFrame:
    """Static flags of gate pages: which business words and login or server calls occur."""
    r = html_regions(captures)
    script, text = F.array_join("scripts", "\n"), F.concat_ws(" ", "visible", "hidden")
    words = F.array_compact(F.array(*[F.when(has(text, p, True), F.lit(k)) for k, p in GATE_WORDS.items()]))
    login = F.exists(F.regexp_extract_all(script, F.lit(r"""\b(?:fetch|axios(?:\.get|\.post)?|open)\s*\(\s*["'`]([^"'`\s]{1,512})["'`]"""), F.lit(1)), lambda u: u.rlike("(?i)" + P.LOGIN_ENDPOINT))
    return r.select("id", words.alias("business_words"), has(script, P.SERVER_CALL, True).alias("server_call"), login.alias("login_endpoint"), (F.col("password_inputs") > 0).alias("password_input"))


def dom_proximity(captures: DataFrame, reach: int = 512) -> DataFrame:
    """Declared names that stand within `reach` characters of a DOM write: id, links."""
    sink, declared = re.compile(P.DOM_SINK), re.compile(P.DOM_DECLARATION)

    def one(id_, body):
        spots = [m.start() for m in sink.finditer(body)]
        near: list[list[int]] = []  # stretches around the writes; those that overlap are one
        for at in spots:
            lo, hi = max(0, at - reach), at + reach
            if near and lo <= near[-1][1]:
                near[-1][1] = hi
            else:
                near.append([lo, hi])
        names = {m.group(1) for m in declared.finditer(body)}
        seen = {w for lo, hi in near for w in re.findall(r"[A-Za-z_$][\w$]*", body[lo:hi])} if names else set()
        yield id_, len(names & seen)

    return _table(captures.where("body is not null"), ["id", "body"], "id bigint, links bigint", one)


def redacted_json(captures: DataFrame) -> DataFrame:
    """JSON bodies with sensitive fields and known values taken out, at any depth; other bodies as redacted text.

    The fields' names decide first, then texts are redacted by the pattern rules of the whole body.
    """
    sensitive = re.compile(P.SENSITIVE_KEY, re.I)

    def clean(value, depth=0):
        if depth > 128:
            return "[TOO_DEEP]"
        if isinstance(value, dict):
            return {k: "[REDACTED_FIELD]" if sensitive.search(k) else clean(v, depth + 1) for k, v in value.items()}
        return [clean(v, depth + 1) for v in value] if isinstance(value, list) else value

    def one(id_, body):
        try:
            yield id_, json.dumps(clean(json.loads(body)), ensure_ascii=False)
        except (ValueError, RecursionError):
            yield id_, body

    fields = _table(captures.where("body is not null"), ["id", "body"], "id bigint, body string", one)
    return fields.select("id", redact("body").alias("redacted"))


def references(captures: DataFrame, limit: int = 256) -> DataFrame:
    """Literal references of html and script bodies: id, relation, url; each once, at most `limit` per body.

    The first in order of the page are kept, links before fetches, these before document names in scripts. A body with more gets a row more that tells of the
    cut: relation `reference_limit`, url null.
    """
    page = html_regions(captures)
    links = page.select("id", F.posexplode("links").alias("at", "l")).select("id", F.lit(0).alias("part"), "at", F.col("l.kind").alias("relation"), F.col("l.url").alias("url"))
    fetched = page.select("id", F.posexplode(F.regexp_extract_all(F.array_join("scripts", "\n"), F.lit(P.FETCH_LITERAL), F.lit(1))).alias("at", "url")).select("id", F.lit(1).alias("part"), "at", F.lit("fetch_literal").alias("relation"), "url")
    # texts in scripts that end like documents, with escaped slashes taken back
    literal = "[\"'`]([^\"'`\\s]{1,2048}\\.(?i:" + "|".join(DOCUMENT_SUFFIXES) + ")(?:[?#][^\"'`\\s]*)?)[\"'`]"
    texts = F.transform(F.regexp_extract_all(F.array_join("scripts", "\n"), F.lit(literal), F.lit(1)), lambda x: F.regexp_replace(F.replace(x, F.lit("\\/"), F.lit("/")), r"(?i)\\u002f|\\x2f", "/"))
    documents = page.select("id", F.posexplode(texts).alias("at", "url")).select("id", F.lit(2).alias("part"), "at", F.lit("document_literal").alias("relation"), "url")
    both = links.unionByName(fetched).unionByName(documents).groupBy("id", "relation", "url").agg(F.min(F.struct("part", "at")).alias("first"))
    kept = both.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("first"))).where(F.col("r") <= limit + 1)
    over = F.col("r") > limit
    return kept.select("id", F.when(over, "reference_limit").otherwise(F.col("relation")).alias("relation"), F.when(~over, F.col("url")).alias("url"))
