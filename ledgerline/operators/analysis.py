"""One analysis of captured content of every kind: plain text, pages, JSON and scripts, from regions to verdict."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions import patterns as P
from ledgerline.functions.text import has, masked_examples, matches, tax_number_valid
from ledgerline.operators.content import FIRST_CATEGORIES
from ledgerline.operators.nested import parse
from ledgerline.operators.parsers import EXACT, Limits, Literal, Regions, _ASSIGNED, _table
from ledgerline.operators.signals import CANARY, MAX_SIGNALS, VALUES, content_verdict

PARTS = (
    "id bigint, page boolean, visible string, hidden string, inputs string, strings string, scripts array<string>, "
    "hidden_elements bigint, password_inputs bigint, script_elements bigint, tables array<struct<filled:bigint,rows:bigint>>, "
    "fields array<struct<code:string,count:bigint,records:bigint>>, categories array<struct<category:string,candidates:bigint,filled:bigint,templates:bigint,calculations:bigint,bases:array<string>>>, "
    "kind string, json_broken boolean, data_broken boolean, html_cut boolean, reasons array<string>, linked bigint, invalid_link boolean"
)
_NAMES = ["id", *re.findall(r"(?<=, )(\w+)(?= (?:string|bigint|boolean|array))", PARTS)]

_EXAMPLE, _PLACEHOLDER, _CALCULATION = re.compile(P.EXAMPLE, re.I), re.compile(P.PLACEHOLDER, re.I), re.compile(P.CALCULATION, re.I)
_ADDRESS, _FETCH = re.compile("[a-z]+://", re.I), re.compile(P.FETCH_LITERAL)
_COMMISSION, _CONDITION, _RATE, _AMOUNT = (re.compile(p, re.I) for p in (P.COMMISSION_HEADING, P.CONDITION_HEADING, P.AMOUNT_HEADING, P.AMOUNT))
_PAGE = re.compile(r"<(?:html|body|input|script|form|table|div|section)\b", re.I)
_CAMEL, _GAPS, _FIRST_WORDS = re.compile("([a-z])([A-Z])"), re.compile(r"[_\-\s]+"), re.compile("[a-z]+|[가-힣]+")
_TERMS = {category: [f" {t.replace('_', ' ')} " for t in terms] for category, terms in P.CATEGORY_TERMS.items()}


def categories_of(name: str) -> list[str]:
    """All categories with one of whose terms a name agrees; key_categories() for Python."""
    words = f" {_GAPS.sub(' ', _CAMEL.sub(r'\1 \2', name).casefold()).strip()} "
    return [c for c, terms in _TERMS.items() if any(t in words for t in terms)]


def _first_category(name: str) -> str | None:
    words = set(_FIRST_WORDS.findall(_CAMEL.sub(r"\1_\2", name).lower()))
    return next((c for c, terms in FIRST_CATEGORIES.items() if words & set(terms)), None)


def _filled(value) -> bool:
    """Zero and false are values; null, empty text and empty containers are not."""
    return value is not None and value != "" and value != [] and value != {}


def _real(value) -> bool:
    return _filled(value) and not (isinstance(value, str) and _EXAMPLE.fullmatch(value))


class _Page(Regions):
    """Regions with what names and labels say of the data."""

    def __init__(self, limits: Limits):
        super().__init__(limits)
        self.names: set[str] = set()
        self.labels: set[str] = set()
        self.tags: set[str] = set()

    def handle_starttag(self, tag, attrs):
        self.tags.add(tag)
        self.names.update(categories_of(" ".join(k for k, _ in attrs)))
        super().handle_starttag(tag, attrs)

    def handle_data(self, data):
        if self.script is None and not any(tag == "style" for tag, _ in self.open):
            self.labels.update(categories_of(data))
        super().handle_data(data)


@dataclass
class _Counts:
    candidates: int = 0
    filled: int = 0
    templates: int = 0
    calculations: int = 0


def _deep(text: str, limits: Limits):
    """A JSON value within the depth that is allowed."""
    value = parse(text)
    if limits.depth is not None:
        level, depth = [value], 0
        while level := [c for v in level if isinstance(v, (dict, list)) for c in (v.values() if isinstance(v, dict) else v)]:
            depth += 1
            if depth > limits.depth:
                raise ValueError("too deep")
    return value


def _containers(value, limits: Limits, cut: set[str]):
    """All objects and lists of a value, the last ones first; up to the limit on their number."""
    todo, n = [value], 0
    while todo:
        if limits.nodes is not None and n >= limits.nodes:
            cut.add("json_node_limit")
            return
        item = todo.pop()
        n += 1
        if isinstance(item, (dict, list)):
            yield item
            todo.extend(c for c in (item.values() if isinstance(item, dict) else item) if isinstance(c, (dict, list)))


def _strings(value, limits: Limits) -> list[str]:
    """Text leaves that are neither examples nor addresses, the last ones first."""
    todo, out, n = [value], [], 0
    while todo and (limits.nodes is None or n < limits.nodes):
        item, n = todo.pop(), n + 1
        if isinstance(item, (dict, list)):
            todo.extend(item.values() if isinstance(item, dict) else item)
        elif isinstance(item, str) and not _EXAMPLE.fullmatch(item) and not _ADDRESS.match(item):
            out.append(item)
    return out


def _field_signals(value, limits: Limits, cut: set[str]) -> list[tuple[str, int, int | None]]:
    known = filled = contacts = lists = persons = 0
    for item in _containers(value, limits, cut):
        if isinstance(item, dict):
            names = {k.casefold() for k in item}
            persons += bool(names & set(P.PERSON_FIELDS)) and any(map(_real, item.values()))
            for key, v in item.items():
                name = key.casefold()
                if name in P.SENSITIVE_FIELDS:
                    known += 1
                    filled += _real(v)
                contacts += name in P.CONTACT_FIELDS and _real(v)
                lists += name in P.LIST_FIELDS and isinstance(v, list) and bool(v)
    found = [("SENSITIVE_FIELD_NAMES", known, None), ("SENSITIVE_VALUES_CANDIDATE", filled, None), ("CONTACT_VALUE_CANDIDATE", contacts, None), ("PERSON_LIST_CANDIDATE", lists, persons or None), ("CUSTOMER_RECORD_CANDIDATE", persons, persons)]
    return [x for x in found if x[1]]


def _commission_tables(tables: list[list[list[str]]]) -> list[dict]:
    """Tables whose heading names a commission, a condition and an amount, and how many cells hold amounts."""
    out = []
    for rows in tables:
        heading = " ".join(" ".join(r) for r in rows[:2])
        if rows and _COMMISSION.search(heading) and _CONDITION.search(heading) and _RATE.search(heading):
            cells = [c for r in rows[1:] for c in r]
            out.append({"filled": sum(bool(_AMOUNT.search(c)) and not _PLACEHOLDER.fullmatch(c) for c in cells), "rows": len(rows)})
    return out


def _parts(id_, body: str, content_type: str | None, base_url: str | None, limits: Limits) -> tuple:
    kind = (content_type or "").casefold()
    scripts, values, reasons, links = [body] if "javascript" in kind else [], [], set(), []
    page, parsed, json_broken, data_broken = None, None, False, False
    visible, hidden, inputs = body, "", ""
    if "json" in kind or body.lstrip()[:1] in ("{", "["):
        try:
            values.append(_deep(body, limits))
            parsed = values[0]
        except ValueError:
            json_broken = True
            reasons.add("json_syntax_or_depth_invalid")
    if "html" in kind or _PAGE.search(body):
        page = _Page(limits)
        page.feed(body)
        page.close()
        visible, hidden, inputs = " ".join(page.text[False]), " ".join(page.text[True]), " ".join(page.inputs)
        scripts += page.scripts[False]
        links += page.links
        for chunk in page.scripts[True]:
            try:
                values.append(_deep(chunk, limits))
            except ValueError:
                data_broken = True
                reasons.add("embedded_json_syntax_or_depth_invalid")
        if page.cut:
            reasons.add("html_structure_limit")
    cut: set[str] = set()
    counts: dict[str, _Counts] = {}
    bases: dict[str, set[str]] = {}
    fields: dict[str, tuple] = {}
    for value in values:
        for code, n, records in _field_signals(value, limits, cut):
            fields.setdefault(code, (code, n, records))
        for item in _containers(value, limits, cut):
            for key, v in item.items() if isinstance(item, dict) else ():
                for category in categories_of(key):
                    c = counts.setdefault(category, _Counts())
                    c.candidates += 1
                    c.filled += _filled(v) and not (isinstance(v, str) and bool(_PLACEHOLDER.fullmatch(v)))
                    bases.setdefault(category, set()).add("structured_field_names")
    broken_literal = False
    for script in scripts:
        for m in _ASSIGNED.finditer(script):
            try:
                literal = Literal(script, m.end(), limits).value()
            except (ValueError, RecursionError) as e:
                broken_literal = True
                reasons.add(str(e) if str(e).startswith("js_") else "js_limit" if isinstance(e, RecursionError) else "js_syntax")
                continue
            for item in _containers(literal, limits, cut):
                for key, v in item.items() if isinstance(item, dict) else ():
                    if category := _first_category(key):
                        c = counts.setdefault(category, _Counts())
                        c.candidates += 1
                        bases.setdefault(category, set()).add("static_js_json_literal")
                        if not isinstance(v, (dict, list)) and _filled(v):
                            text = v if isinstance(v, str) else ""
                            if isinstance(v, str) and _PLACEHOLDER.fullmatch(text):
                                c.templates += 1
                            elif isinstance(v, str) and _CALCULATION.search(text):
                                c.calculations += 1
                            else:
                                c.filled += 1
    for found, basis in ((page.names, "markup_attribute_names"), (page.labels, "markup_text_labels")) if page else ():
        for category in found:
            bases.setdefault(category, set()).add(basis)
    reasons |= cut
    links += [("fetch_literal", m.group(1)) for m in _FETCH.finditer(body)]
    if limits.links is not None:
        links = links[: limits.links]
    linked, invalid = set(), False
    for relation, target in links:
        try:
            full = urljoin(base_url or "", target)
            if urlsplit(full).scheme in ("http", "https"):
                linked.add((relation, full))
        except ValueError:
            invalid = True
    lower = body.casefold()
    if "json" in kind or parsed is not None:
        hint = "data_file"
    elif page:
        hint = "dashboard" if "table" in page.tags or re.search(r"\b(?:dashboard|chart|analytics|metric)\b", lower) else "calculator" if "form" in page.tags and re.search(r"\b(?:calculate|calculator|estimate|quote)\b", lower) else "webpage"
    else:
        hint = "source_code" if "javascript" in kind or "typescript" in kind or re.search(r"\b(?:function|const|let|import|export)\b", body) else "unknown"
    rows = [{"category": c, "candidates": counts[c].candidates if c in counts else 1, "filled": counts[c].filled if c in counts else 0, "templates": counts[c].templates if c in counts else 0, "calculations": counts[c].calculations if c in counts else 0, "bases": sorted(bases[c])} for c in sorted(bases)]
    # values are looked for in what is shown and in text leaves of JSON, not in addresses, styles or code
    shown = [] if "css" in kind or "javascript" in kind or "json" in kind else [visible, hidden, inputs]
    value_text = " ".join([*shown, *(x for v in values for x in _strings(v, limits))])
    stats = page.counts if page else {"hidden": 0, "password": 0, "script": 0}
    return (
        id_, page is not None, visible, hidden, inputs, value_text, scripts, stats["hidden"], stats["password"], stats["script"], _commission_tables(page.tables) if page else [],
        [{"code": c, "count": n, "records": r} for c, n, r in fields.values()], rows, hint, json_broken, data_broken, bool(page and page.cut), sorted(reasons | ({"js_incomplete"} if broken_literal else set())), len(linked), invalid,
    )


def content_parts(captures: DataFrame, limits: Limits = EXACT) -> DataFrame:
    """Regions, counts and data categories of captures (id, body, content_type, base_url).

    Only bodies with some structure (mark-up, JSON, scripts, literal requests) are parsed; plain text takes its row from
    column expressions. Null bodies give no row.
    """
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    structured = kind.rlike("html|json|script") | has("body", _PAGE.pattern, True) | F.ltrim("body").rlike(r"^[{\[]") | has("body", P.FETCH_LITERAL)
    rows = captures.where("body is not null").select("id", "body", "content_type", "base_url", F.coalesce(structured, F.lit(False)).alias("structured"))
    made = _table(rows.where("structured"), ["id", "body", "content_type", "base_url"], PARTS, lambda *r: iter([_parts(*r, limits)]), _NAMES)
    none = lambda t: F.array().cast(t)
    css = F.coalesce(F.lower("content_type").contains("css"), F.lit(False))
    code = F.when(F.col("body").rlike(r"(?U)\b(?:function|const|let|import|export)\b"), "source_code").otherwise("unknown")
    types = {f.name: f.dataType for f in made.schema}
    plain = {"id": F.col("id"), "page": F.lit(False), "visible": F.col("body"), "hidden": F.lit(""), "inputs": F.lit(""), "strings": F.when(css, "").otherwise(F.col("body")), "kind": code}
    zero = lambda n: F.lit(0) if types[n].simpleString() == "bigint" else F.lit(False) if types[n].simpleString() == "boolean" else none(types[n].simpleString())
    return made.unionByName(rows.where("not structured").select(*[plain.get(n, zero(n)).cast(types[n]).alias(n) for n in _NAMES]))


DETAILS = {"region": "string", "negated": "boolean", "offset": "bigint", "occurrences": "bigint", "unique_values": "bigint", "masked_examples": "array<string>", "records": "bigint", "count": "bigint", "confidence": "string"}


def _signal(code: str | Column, rule: Column | None, **details) -> Column:
    fields = [F.lit(code).alias("code") if isinstance(code, str) else code.alias("code")] + [details.get(n, F.lit(None)).cast(t).alias(n) for n, t in DETAILS.items()]
    return F.struct(*fields) if rule is None else F.when(rule, F.struct(*fields))


def analyze(captures: DataFrame, canary: str = CANARY, limits: Limits = EXACT, max_bytes: int | None = None) -> DataFrame:
    """The whole analysis of each capture: its signals, verdict, categories and what is still to be reviewed.

    captures: id bigint, body, content_type, base_url (for links; may be null), capture_complete (may be missing).
    Yields id, signals (array of structs in order of emission, each code once, at most 32; no value comes out), content,
    analysis_complete, pending_reviews, structure counts, kind_hint, categories, linked_candidates. Bodies are analysed
    whole unless `max_bytes` is given; then their head is, and `analysis_byte_limit` tells. `limits` bounds the parsers
    in the same way, each with a flag; EXACT has none. Null bodies give no row; extra columns are ignored.
    """
    size = F.octet_length("body")
    whole = F.col("capture_complete") if "capture_complete" in captures.columns else F.lit(True)
    text = F.col("body") if max_bytes is None else F.when(size > max_bytes, F.make_valid_utf8(F.substring(F.encode("body", "UTF-8"), 1, max_bytes).cast("string"))).otherwise(F.col("body"))
    rows = captures.where("body is not null").select("id", text.alias("body"), "content_type", F.col("base_url") if "base_url" in captures.columns else F.lit("").alias("base_url"), F.coalesce(whole, F.lit(True)).alias("whole"), F.lit(False).alias("long") if max_bytes is None else (size > max_bytes).alias("long"))
    parts = content_parts(rows, limits)
    both = rows.join(parts.withColumnRenamed("id", "p_id"), F.col("id") == F.col("p_id"))

    out = [_signal("STRUCTURED_DATA_PARSE_INCOMPLETE", F.array_contains("reasons", "js_incomplete"))]
    out += [_signal(code, has("body", p), offset=F.regexp_instr("body", F.lit(P.java(p))) - 1) for code, p in P.SECRETS.items()]
    out += [_signal("PUBLISHABLE_KEY_PRESENT", F.contains("body", F.lit("sb_publishable_"))), _signal("UNTRUSTED_INSTRUCTION_TEXT", has("body", P.UNTRUSTED, True)), _signal("CLIENT_ENCRYPTION_INDICATOR", has("body", P.ENCRYPTION, True), confidence=F.lit("heuristic"))]
    out += [_signal("SYNTHETIC_CANARY_PRESENT", F.contains("body", F.lit(canary)))]
    out += [_signal("JSON_PARSE_INCOMPLETE", F.col("json_broken")), _signal("HTML_PARSE_INCOMPLETE", F.col("html_cut")), _signal("JSON_PARSE_INCOMPLETE", F.col("data_broken") & ~F.col("json_broken"))]
    for code, kind, pattern in VALUES:
        found = matches("strings", pattern)
        out.append(_signal(code, F.size(found) > 0, occurrences=F.size(found), unique_values=F.size(F.array_distinct(found)), masked_examples=masked_examples(kind, found), confidence=F.lit("heuristic")))
    tax = F.filter(matches("strings", P.BUSINESS), tax_number_valid)
    out.append(_signal("KR_BUSINESS_NUMBER_CANDIDATE", F.size(tax) > 0, occurrences=F.size(tax), unique_values=F.size(F.array_distinct(tax)), masked_examples=masked_examples("business", tax), confidence=F.lit("format_validated")))
    seen = has("visible", P.CONFIDENTIAL, True)
    for region, column, rule in (("visible_body", "visible", seen), ("hidden_body", "hidden", ~seen & has("hidden", P.CONFIDENTIAL, True))):
        out.append(_signal("CONFIDENTIAL_MARKER_CANDIDATE", rule, region=F.lit(region), negated=has(column, P.NEGATED_CONFIDENTIAL, True), confidence=F.lit("medium")))
    first = F.get("tables", F.lit(0))
    out.append(_signal("COMMISSION_TABLE_STRUCTURE", F.size("tables") > 0, records=first["filled"], confidence=F.when(first["filled"] > 0, "high").otherwise("medium")))
    filled = F.aggregate(F.filter("categories", lambda c: c["category"].isin(P.BUSINESS_CATEGORIES)), F.lit(0).cast("bigint"), lambda n, c: n + c["filled"])
    out.append(_signal("BUSINESS_DATA_VALUE_CANDIDATE", filled > 0, count=filled, confidence=F.lit("structural")))
    out.append(_signal("CLIENT_PASSWORD_CANDIDATE", F.exists("scripts", lambda x: has(x, P.PASSWORD_ASSIGNMENT, True) | has(x, P.PASSWORD_COMPARISON, True))))
    late = [_signal("HIDDEN_DOM_PRESENT", F.col("hidden_elements") > 0, count=F.col("hidden_elements")), _signal("LOGIN_FORM_INDICATOR", F.col("password_inputs") > 0, count=F.col("password_inputs"))]
    late += [_signal("RUNTIME_ENDPOINT_CANDIDATE", has("body", P.FETCH_LITERAL)), _signal("RUNTIME_ENDPOINT_UNRESOLVED", F.exists("scripts", lambda x: has(x, P.FETCH_DYNAMIC))), _signal("INVALID_LINK", F.col("invalid_link"))]
    fields = F.transform("fields", lambda f: _signal(f["code"], None, count=f["count"], records=f["records"], confidence=F.when(~f["code"].startswith("SENSITIVE"), F.lit("medium"))))
    signals = F.slice(F.concat(F.array_compact(F.array(*out)), fields, F.array_compact(F.array(*late))), 1, MAX_SIGNALS)
    both = both.withColumn("early", signals).withColumn("codes", F.transform("early", lambda x: x["code"])).withColumn("content", content_verdict("codes"))
    challenge = F.when(has("body", P.CHALLENGE, True) & (F.size("early") < MAX_SIGNALS), F.array(_signal("CHALLENGE_PAGE_INDICATOR", None)))
    structure = F.size("reasons") == 0
    image = has("body", P.IMAGE_PENDING, True)
    gaps = [F.when(~F.col("whole"), "capture_incomplete"), F.when(F.col("long"), "analysis_byte_limit"), F.when(~structure, "structure_parse_incomplete"), F.when(image, "image_or_base64_review")]
    return both.select(
        "id", F.concat("early", F.coalesce(challenge, F.slice("early", 1, 0))).alias("signals"), "content", (structure & F.col("whole") & ~F.col("long")).alias("analysis_complete"), F.array_compact(F.array(*gaps)).alias("pending_reviews"),
        "hidden_elements", "password_inputs", "script_elements", F.col("kind").alias("kind_hint"), "categories", "reasons", F.col("linked").alias("linked_candidates"),
    )


def semantic_review(captures: DataFrame, limits: Limits = EXACT) -> DataFrame:
    """What the structure of each capture says of its data: one row per capture, without values.

    document_type (json, html, javascript, other by content type), whether its syntax is sound, filled fields by
    category, known sensitive fields and how many are filled, declarations and DOM writes of scripts, and what is still to
    be reviewed. Columns of captures as in analyze().
    """
    from ledgerline.operators.signals import dom_flow

    kind = F.lower(F.coalesce("content_type", F.lit("")))
    type_ = F.when(kind.contains("json"), "json").when(kind.contains("html"), "html").when(kind.contains("javascript"), "javascript").otherwise("other")
    rows = captures.where("body is not null").select("id", "body", "content_type", F.col("base_url") if "base_url" in captures.columns else F.lit("").alias("base_url"), type_.alias("document_type"))
    flow = dom_flow(rows.select("id", "body")).withColumnRenamed("id", "f_id")
    both = rows.drop("base_url").join(content_parts(rows, limits).withColumnRenamed("id", "p_id"), F.col("id") == F.col("p_id")).join(flow, F.col("id") == F.col("f_id"))
    n = lambda code: F.coalesce(F.get(F.filter("fields", lambda f: f["code"] == code), F.lit(0))["count"], F.lit(0))
    filled = F.map_from_entries(F.transform(F.filter("categories", lambda c: c["filled"] > 0), lambda c: F.struct(c["category"], c["filled"])))
    pending = F.array_compact(F.array(F.when(F.col("document_type") == "other", "semantic_unsupported_content_type"), F.when((F.col("document_type") == "json") & F.col("json_broken"), "semantic_json_syntax_invalid"), F.when(F.array_contains("reasons", "json_node_limit"), "semantic_node_limit"), F.when(F.array_contains("reasons", "js_incomplete"), "semantic_literal_unresolved")))
    script = F.col("document_type").isin("html", "javascript")
    return both.select("id", "document_type", F.when(F.col("document_type") == "json", ~F.col("json_broken")).alias("syntax_valid"), filled.alias("filled_by_category"), n("SENSITIVE_FIELD_NAMES").alias("sensitive_fields"), n("SENSITIVE_VALUES_CANDIDATE").alias("sensitive_filled"), F.when(script, F.col("declarations")).alias("declarations"), F.when(script, F.col("sinks")).alias("sinks"), pending.alias("pending_reviews"))
