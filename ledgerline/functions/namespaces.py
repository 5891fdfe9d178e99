"""Checks and forms of names, paths, pointers and addresses."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import parse_qsl, quote, unquote_to_bytes, urlsplit

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ledgerline.functions import patterns as P
from ledgerline.functions.ids import as_col
from ledgerline.functions.urls import IPV4

#: File kinds by extension. Fixed values.
TREE_KINDS = {
    "data_file": ["csv", "db", "json", "jsonl", "ndjson", "parquet", "sqlite", "sql", "tsv", "xls", "xlsx"],
    "document": ["doc", "docx", "md", "pdf", "ppt", "pptx", "rtf", "txt"],
    "source_code": ["c", "cc", "cpp", "cs", "css", "go", "h", "hpp", "html", "java", "js", "jsx", "kt", "php", "py", "rb", "rs", "sh", "swift", "ts", "tsx", "vue"],
    "config": ["cfg", "conf", "env", "ini", "properties", "toml", "yaml", "yml"],
}
#: Name rules by kind of platform: pattern, least and most characters, what must not occur. Fixed values.
NAME_RULES = {
    "dns_label": (r"^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$", 1, 63, None),
    "account": (r"^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?$", 1, 39, "--"),
    "group": (r"^[a-z0-9](?:[a-z0-9_.-]*[a-z0-9])?$", 2, 255, r"\.\."),
    "bucket": (r"^[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?$", 3, 63, r"\.\.|\.-|-\.|^xn--|^" + IPV4 + "$"),
    "object_store": (r"^[a-z0-9](?:[a-z0-9._-]*[a-z0-9])?$", 3, 63, r"\.\."),
}
#: Identifier grammars. Fixed values.
GRAMMARS = {
    "entity": r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,255}$",
    "evidence": r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}:[A-Za-z0-9][A-Za-z0-9._/=-]{0,255}$",
    "queue": r"^[A-Za-z0-9][A-Za-z0-9._:/-]{0,255}$",
    "record": r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$",
    "case": r"^case_[0-9a-f]{32}$",
    "source": r"^src_[0-9a-f]{32}$",
    "collector": r"^col_[0-9a-f]{32}$",
    "opaque": r"^opaque:[0-9a-f]{32}$",
    "evidence_item": r"^evd_[0-9a-f]{32}$",
    "event": r"^evt_[0-9a-f]{32}$",
    "sha256": r"^[0-9a-f]{64}$",
    "digest": r"^sha256:[0-9a-f]{64}$",
    "locator": r"^(?:opaque:[0-9a-f]{32}|hmac-sha256:[0-9a-f]{64})$",
    "reference": r"^[A-Za-z][A-Za-z0-9_.:-]{0,159}$",
}
DOCUMENT_SUFFIXES = ["pdf", "doc", "docx", "xls", "xlsx", "csv", "hwp", "ppt", "pptx"]  # Fixed values


def valid_name(kind: str, name: str | Column) -> Column:
    pattern, least, most, never = NAME_RULES[kind]
    n = as_col(name)
    sound = n.rlike(pattern) & F.length(n).between(least, most)
    return sound & ~n.rlike(never) if never else sound


def tree_path_valid(path: str | Column) -> Column:
    p = as_col(path)
    return (F.length(p).between(1, 4096)) & ~p.rlike(r"^[/\\]|(?:^|/)\.{0,2}(?:/|$)|\\|[\x00-\x1f\x7f]")


def tree_kind(path: str | Column) -> Column:
    suffix = F.lower(F.regexp_extract(as_col(path), r"\.([^./]*)$", 1))
    kind = F.lit("other")
    for name, suffixes in TREE_KINDS.items():
        kind = F.when(suffix.isin(suffixes), F.lit(name)).otherwise(kind)
    return kind


def document_reference(value: str | Column) -> Column:
    """A literal path of a document: relative or https, by its suffix."""
    v = F.trim(as_col(value))
    foreign = v.rlike(r"^(?://|\\)") | (v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~F.startswith(F.lower(v), F.lit("https://")))
    path = F.lower(F.regexp_replace(v, r"[?#].*$", ""))
    return (F.length(v).between(1, 2048)) & ~v.rlike(r"[\x00-\x1f]") & ~foreign & path.rlike(r"\.(?:" + "|".join(DOCUMENT_SUFFIXES) + ")$")


def next_page(link_header: str | Column) -> Column:
    """The one rel="next" target of a pagination header; null if there is none or more than one."""
    parts = F.filter(F.split(as_col(link_header), ","), lambda p: p.rlike(r'^\s*<[^>]+>\s*;\s*rel="next"\s*$'))
    return F.when(F.size(parts) == 1, F.regexp_extract(F.get(parts, F.lit(0)), "<([^>]+)>", 1))


def json_pointer_path(pointer: str) -> str | None:
    """A JSON pointer as a variant path; None if its escapes are wrong."""
    if pointer == "":
        return "$"
    if not pointer.startswith("/"):
        return None
    out = "$"
    for token in pointer[1:].split("/"):
        plain = token.replace("~1", "\0").replace("~0", "\1")
        if "~" in plain:
            return None
        plain = plain.replace("\0", "/").replace("\1", "~")
        if plain.isascii() and plain.isdigit() and (plain == "0" or plain[0] != "0"):
            out += f"[{plain}]"
        else:
            out += f"['{plain}']"
    return out


def at_pointer(body: str | Column, pointer: str, kind: str = "string") -> Column:
    """The value at a pointer in a strict JSON text, null where it isn't there or isn't of the kind."""
    path = json_pointer_path(pointer)
    return F.lit(None).cast(kind) if path is None else F.try_variant_get(F.try_parse_json(as_col(body)), path, kind)


@F.pandas_udf(T.BooleanType())
def public_address(addresses: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether a literal address is public unicast; mapped forms count as what they hold, tunnels never."""

    def one(text) -> bool:
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return False
        if a.version == 6:
            if a.sixtofour is not None or a.teredo is not None:
                return False
            a = a.ipv4_mapped or a
        return a.is_global and not (a.is_multicast or a.is_reserved)

    for batch in addresses:
        yield batch.map(lambda x: x is not None and one(x)).astype(bool)


_CREDENTIAL = re.compile(P.CREDENTIAL_KEY, re.I)
_BAD_ESCAPE = re.compile("%(?![0-9A-Fa-f]{2})")


def credential_name(name: str) -> bool:
    """Whether a query parameter looks like a credential; its name is decoded up to three times more."""
    for _ in range(3):
        plain = unquote_to_bytes(name).decode("utf-8", "strict")
        if plain == name:
            break
        name = plain
    compact = re.sub("[^a-z0-9]", "", name.casefold())
    return bool(_CREDENTIAL.search(name)) or compact in P.CREDENTIAL_NAMES or compact.endswith(tuple(P.CREDENTIAL_ENDINGS))


@F.pandas_udf(T.StringType())
def canonical_url(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """https address with a decoded, checked and re-encoded path; null for anything unsafe or with credentials."""

    def one(raw) -> str | None:
        if not raw or any(ord(c) <= 32 or ord(c) == 127 for c in raw):
            return None
        try:
            parts = urlsplit(raw)
            port = parts.port or 443
            host = (parts.hostname or "").rstrip(".").encode("idna").decode("ascii").lower()
            if parts.scheme.lower() != "https" or parts.fragment or parts.username is not None or not host or _BAD_ESCAPE.search(parts.query):
                return None
            if any(credential_name(k) for k, _ in parse_qsl(parts.query, keep_blank_values=True)):
                return None
            path = parts.path or "/"
            for _ in range(4):
                plain = unquote_to_bytes(path).decode("utf-8", "strict")
                if plain == path:
                    break
                path = plain
            else:
                return None
        except (ValueError, UnicodeError):
            return None
        path = unicodedata.normalize("NFC", path)
        if not path.startswith("/") or any(x in path for x in ("%", "\\", "//")) or any(p in (".", "..") for p in path.split("/")) or any(ord(c) < 32 for c in path):
            return None
        return f"https://{host}{'' if port == 443 else f':{port}'}{quote(path, safe="/~!$&'()*+,;=:@-")}{'?' + parts.query if parts.query else ''}"

    for batch in urls:
        yield batch.map(lambda x: None if x is None else one(x))


def json_depth(text: str | Column) -> Column:
    """Greatest nesting of brackets outside quotes: quoted texts are taken out, the rest is one sum over its brackets."""
    marks = F.split(F.regexp_replace(F.regexp_replace(as_col(text), r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", ""), "")
    step = lambda acc, c: F.struct((acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"), F.greatest(acc["most"], acc["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most"))
    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda acc: acc["most"])


def sensitive_key(key: str | Column) -> Column:
    return F.lower(as_col(key)).isin(P.SENSITIVE_FIELDS)
