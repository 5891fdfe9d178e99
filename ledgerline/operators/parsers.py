"""Parsers that need a real grammar: table functions over Arrow batches, one pass over each body."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerline.functions import patterns as P
from ledgerline.operators.nested import Number, parse

VOID = frozenset("input img meta link br hr source area".split())  # Fixed values: tags that hold nothing


@dataclass(frozen=True)
class Limits:
    """Bounds of the parsers; null means none. What a bound cuts off is told by a flag beside the result."""

    nodes: int | None = None  # containers of a JSON value
    depth: int | None = None  # nesting of a JSON value or script literal
    values: int | None = None  # values of a script literal
    literals: int | None = None  # literals of a script
    inputs: int | None = None  # input values of a page
    tables: int | None = None  # tables of a page
    rows: int | None = None  # rows of a table
    links: int | None = None  # links of a page


EXACT = Limits()  #: everything, whatever its size; the default everywhere
BOUNDED = Limits(2048, 128, 10_000, 64, 128, 32, 256, 64)  #: the bounds of an interactive review. Fixed values


def _within(n: int, most: int | None) -> bool:
    return most is None or n < most


REGIONS = "id bigint, visible string, hidden string, inputs string, scripts array<string>, json_scripts array<string>, hidden_elements bigint, password_inputs bigint, script_elements bigint, links array<struct<kind:string,url:string>>, tables array<array<array<string>>>, truncated boolean"


class Regions(HTMLParser):
    """Text of a page by region, its links and its tables."""

    _HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

    def __init__(self, limits: Limits = EXACT):
        super().__init__(convert_charrefs=True)
        self.limits, self.cut = limits, False
        self.text: dict[bool, list[str]] = {False: [], True: []}
        self.inputs, self.links, self.tables = [], [], []
        self.scripts: dict[bool, list[str]] = {False: [], True: []}
        self.counts = {"hidden": 0, "password": 0, "script": 0}
        self.open: list[tuple[str, bool]] = []
        self.script: list[str] | None = None
        self.script_is_data = False
        self.rows, self.row, self.cell = None, None, None

    def keep(self, held: list, one, most: int | None) -> None:
        if _within(len(held), most):
            held.append(one)
        else:
            self.cut = True

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        hiding = "hidden" in a or bool(self._HIDING.search(a.get("style", "")))
        self.counts["hidden"] += hiding
        if tag not in VOID:
            self.open.append((tag, hiding))
        if tag == "input":
            self.counts["password"] += a.get("type", "").lower() == "password"
            if "value" in a:
                self.keep(self.inputs, a["value"], self.limits.inputs)
        elif tag == "script":
            self.counts["script"] += 1
            self.script, self.script_is_data = [], a.get("type", "").lower() in ("application/json", "application/ld+json")
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.row = []
            self.keep(self.rows, self.row, self.limits.rows)
        elif tag in ("td", "th") and self.rows:
            self.cell = []
        target = a.get({"script": "src", "iframe": "src", "a": "href", "link": "href"}.get(tag, ""), "")
        if target:
            self.links.append((tag, target))

    def handle_endtag(self, tag):
        if tag == "script" and self.script is not None:
            self.scripts[self.script_is_data].append("".join(self.script))
            self.script = None
        elif tag in ("td", "th") and self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.rows is not None:
            self.keep(self.tables, [r for r in self.rows if r], self.limits.tables)
            self.rows = None
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                break

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        elif not any(tag == "style" for tag, _ in self.open):
            self.text[any(hiding for _, hiding in self.open)].append(data)
        if self.cell is not None:
            self.cell.append(data)


def _table(rows: DataFrame, columns: list[str], schema: str, one: Callable[..., Iterator[tuple]], names: list[str] | None = None) -> DataFrame:
    names = names or [c.split(" ")[0] for c in re.split(r", (?![^<]*>)", schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in zip(*(frame[c] for c in columns)):
                out.extend(one(*row))
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    return rows.select(*columns).mapInPandas(run, schema)


def html_regions(captures: DataFrame, limits: Limits = EXACT) -> DataFrame:
    """One row per html capture (id, body): visible, hidden, input and script text, counters, links and tables.

    truncated tells whether a bound of `limits` cut something off.
    """

    def one(id_, body):
        page = Regions(limits)
        page.feed(body)
        page.close()
        yield (id_, " ".join(page.text[False]), " ".join(page.text[True]), " ".join(page.inputs), page.scripts[False], page.scripts[True], page.counts["hidden"], page.counts["password"], page.counts["script"], [{"kind": k, "url": u} for k, u in page.links], page.tables, page.cut)

    return _table(captures.where("body is not null"), ["id", "body"], REGIONS, one)


def resolved_links(regions: DataFrame, base_url: str, limits: Limits = EXACT) -> DataFrame:
    """Web links of each page in absolute form, each (kind, url) once.

    A link that is no address gives a row of kind `invalid_link` without url, one for each page; a cut by limits.links
    gives one of kind `link_limit`.
    """

    def one(id_, links):
        seen, invalid = [], False
        for link in links:
            try:
                full = urljoin(base_url, link["url"])
                if urlsplit(full).scheme in ("http", "https") and (link["kind"], full) not in seen:
                    seen.append((link["kind"], full))
            except ValueError:
                invalid = True
        if invalid:
            yield id_, "invalid_link", None
        if not _within(len(seen) - 1, limits.links):
            yield id_, "link_limit", None
        for kind, url in seen[: limits.links]:
            yield id_, kind, url

    return _table(regions, ["id", "links"], "id bigint, kind string, url string", one)


NODES = "id bigint, node bigint, key string, kind string, filled boolean, example boolean, value string, truncated boolean"


def json_nodes(captures: DataFrame, limits: Limits = EXACT) -> DataFrame:
    """Fields of each JSON body: node number of the object that holds it, key, kind, whether it is filled.

    Zero and false are filled; null, empty text and empty containers are not. Bodies that are deeper or have more
    containers than `limits` allow are marked truncated on all their rows; bodies that are no JSON give no rows.
    """
    example = re.compile(P.EXAMPLE, re.I)

    def one(id_, body):
        try:
            root = parse(body)
        except ValueError:
            return
        todo, out, number, cut = [(root, 0)], [], 0, False
        while todo:
            value, depth = todo.pop()
            number += 1
            if not _within(number - 1, limits.nodes) or limits.depth is not None and depth > limits.depth:
                cut = True
                break
            for key, child in value.items() if isinstance(value, dict) else ((None, c) for c in value) if isinstance(value, list) else ():
                kind = {dict: "object", list: "list", str: "text", bool: "bool", int: "number", float: "number"}.get(type(child), "null")
                if key is not None:
                    out.append((key, kind, child is not None and child != "" and child != [] and child != {}, isinstance(child, str) and bool(example.fullmatch(child)), child if isinstance(child, str) else None if kind in ("object", "list", "null") else str(child) if isinstance(child, Number) else json.dumps(child), number))
                if isinstance(child, (dict, list)):
                    todo.append((child, depth + 1))
        for key, kind, filled, is_example, text, node in out:
            yield id_, node, key, kind, filled, is_example, text, cut

    return _table(captures.where("body is not null"), ["id", "body"], NODES, one)


def field_counters(nodes: DataFrame) -> DataFrame:
    """Per body: known and filled sensitive fields and contact values."""
    key = F.lower("key")
    known = key.isin(P.SENSITIVE_FIELDS)
    real = F.col("filled") & ~F.col("example")
    contact = key.isin("email", "phone", "mobile", "telephone", "contact", "이메일", "전화번호")
    return nodes.groupBy("id").agg(F.count("*").alias("fields"), F.count_if(known).alias("known_sensitive"), F.count_if(known & real).alias("filled_sensitive"), F.count_if(contact & real).alias("contacts"), F.bool_or("truncated").alias("truncated"))


class Literal:
    """Data-only JavaScript literal: objects, lists, texts, numbers, true, false, null; anything else is a reason."""

    _NUMBER = re.compile(r"-?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)")
    _NAME = re.compile(r"[A-Za-z_$][\w$]*")
    _BLANK = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)*", re.S)
    _ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}

    def __init__(self, text: str, at: int, limits: Limits = EXACT):
        self.text, self.at, self.limits, self.seen = text, at, limits, 0

    def fail(self, reason: str):
        raise ValueError(reason)

    def peek(self) -> str:
        self.at = self._BLANK.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def take(self, sign: str) -> bool:
        if self.peek() == sign:
            self.at += 1
            return True
        return False

    def value(self, depth: int = 0):
        self.seen += 1
        if self.limits.depth is not None and depth > self.limits.depth or not _within(self.seen - 1, self.limits.values):
            self.fail("js_limit")
        sign = self.peek()
        if sign == "{":
            return self.obj(depth)
        if sign == "[":
            return self.items(depth)
        if sign and sign in "\"'":
            return self.string(sign)
        if m := self._NUMBER.match(self.text, self.at):
            self.at = m.end()
            return float(m.group()) if re.search(r"[.eE]", m.group()) and "x" not in m.group().lower() else int(m.group(), 0 if "x" in m.group().lower() else 10)
        if (m := self._NAME.match(self.text, self.at)) and m.group() in ("true", "false", "null"):
            self.at = m.end()
            return {"true": True, "false": False, "null": None}[m.group()]
        self.fail("js_unsupported_dynamic_expression")

    def string(self, quote: str) -> str:
        out = []
        self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == quote:
                return "".join(out)
            if c == "\n":
                break
            if c == "\\":
                e = self.text[self.at : self.at + 1]
                width = {"x": 2, "u": 4}.get(e, 0)
                self.at += 1 + width
                c = chr(int(self.text[self.at - width : self.at], 16)) if width else self._ESCAPES.get(e, e)
            out.append(c)
        self.fail("js_unterminated_string")

    def obj(self, depth: int) -> dict:
        out: dict = {}
        self.at += 1
        while not self.take("}"):
            sign = self.peek()
            if sign and sign in "\"'":
                key = self.string(sign)
            elif m := self._NAME.match(self.text, self.at) or self._NUMBER.match(self.text, self.at):
                key, self.at = m.group(), m.end()
            else:
                self.fail("js_unsupported_dynamic_expression")
            if not self.take(":"):
                self.fail("js_unsupported_dynamic_expression")
            if key in out:
                self.fail("js_duplicate_key")
            out[key] = self.value(depth + 1)
            if not self.take(",") and self.peek() != "}":
                self.fail("js_syntax")
        return out

    def items(self, depth: int) -> list:
        out = []
        self.at += 1
        while not self.take("]"):
            out.append(self.value(depth + 1))
            if not self.take(",") and self.peek() != "]":
                self.fail("js_syntax")
        return out


_ASSIGNED = re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?=[\[{])")


def js_literals(captures: DataFrame, limits: Limits = EXACT) -> DataFrame:
    """Data literals assigned in scripts: id, name, value_json or the reason why it is no plain data.

    A literal nested deeper than Python can follow (some hundreds of levels) has the reason `js_limit`, as those beyond
    `limits` have.
    """

    def one(id_, body):
        for n, m in enumerate(_ASSIGNED.finditer(body)):
            if not _within(n, limits.literals):
                yield id_, m.group(1), None, "js_literal_limit"
                return
            try:
                yield id_, m.group(1), json.dumps(Literal(body, m.end(), limits).value(), ensure_ascii=False), None
            except ValueError as e:
                yield id_, m.group(1), None, str(e) if str(e).startswith("js_") else "js_syntax"
            except RecursionError:
                yield id_, m.group(1), None, "js_limit"

    return _table(captures.where("body is not null"), ["id", "body"], "id bigint, name string, value_json string, reason string", one)


PATCH = "id bigint, file_no bigint, path string, status string, line_no bigint, sign string, line string, error string"


def patch_lines(patches: DataFrame) -> DataFrame:
    """Changed lines of unified patches (id, body) with their file; a row without sign for each file.

    Lines count only within the ranges that hunk headers announce, so text that looks like a header inside a hunk is
    content. A patch whose hunks don't add up gives one row with an error.
    """
    hunk = re.compile(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")

    def one(id_, body):
        out, files, old, new, broken = [], [], 0, 0, False
        for number, line in enumerate(body.split("\n")):
            if old > 0 or new > 0:
                sign = line[:1] or " "
                if sign not in "+- \\":
                    broken = True
                    break
                old -= sign in "- "
                new -= sign in "+ "
                if sign in "+-" and files:
                    out.append((len(files) - 1, number, sign, line[1:]))
            elif line.startswith("diff --git "):
                a, _, b = line[len("diff --git ") :].partition(" b/")
                files.append([a.removeprefix("a/"), b, "modified"])
            elif files and line.startswith("new file mode "):
                files[-1][2] = "added"
            elif files and line.startswith("deleted file mode "):
                files[-1][2] = "removed"
            elif files and line.startswith("rename to "):
                files[-1][2] = "renamed"
            elif line.startswith("@@"):
                m = hunk.match(line)
                if not m or not files:
                    broken = True
                    break
                old, new = int(m.group(1) or 1), int(m.group(2) or 1)
            if old < 0 or new < 0:
                broken = True
                break
        if broken or old or new or not files:
            yield id_, None, None, None, None, None, None, "patch_provenance_invalid"
            return
        for n, (a, b, status) in enumerate(files):
            yield id_, n, a if status == "removed" else b, status, None, None, None, None
        for n, number, sign, line in out:
            yield id_, n, files[n][0] if files[n][2] == "removed" else files[n][1], files[n][2], number, sign, line, None

    return _table(patches.where("body is not null"), ["id", "body"], PATCH, one)


def text_chunks(captures: DataFrame, size: int = 55_000, overlap: int = 4096) -> DataFrame:
    """Long bodies in overlapping chunks (id, chunk, start_char, text), made in the JVM; empty bodies have none."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length("body") - overlap) / step) - 1).cast("int"))
    rows = captures.where("length(body) > 0").select("id", "body", F.posexplode(starts).alias("chunk", "n"))
    return rows.select("id", F.col("chunk").cast("bigint").alias("chunk"), (F.col("n") * step).cast("bigint").alias("start_char"), F.substring(F.col("body"), F.col("n") * step + 1, F.lit(size)).alias("text"))


def image_headers(blobs: DataFrame) -> DataFrame:
    """Format and dimensions of images (id, content binary) from their first bytes; unknown formats have nulls."""

    def one(id_, b):
        kind = width = height = None
        if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
            kind, width, height = "png", int.from_bytes(b[16:20], "big"), int.from_bytes(b[20:24], "big")
        elif b[:6] in (b"GIF87a", b"GIF89a") and len(b) >= 10:
            kind, width, height = "gif", int.from_bytes(b[6:8], "little"), int.from_bytes(b[8:10], "little")
        elif b[:4] == b"RIFF" and b[8:12] == b"WEBP" and len(b) >= 30:
            kind = "webp"
            if b[12:16] == b"VP8X":
                width, height = 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
        elif b[:2] == b"\xff\xd8":
            at, kind = 2, "jpeg"
            while at + 9 <= len(b) and b[at] == 0xFF:
                if 0xC0 <= b[at + 1] <= 0xCF and b[at + 1] not in (0xC4, 0xC8, 0xCC):
                    height, width = int.from_bytes(b[at + 5 : at + 7], "big"), int.from_bytes(b[at + 7 : at + 9], "big")
                    break
                at += 2 + int.from_bytes(b[at + 2 : at + 4], "big")
        yield id_, kind, width, height

    return _table(blobs.where("content is not null"), ["id", "content"], "id bigint, format string, width bigint, height bigint", one)
