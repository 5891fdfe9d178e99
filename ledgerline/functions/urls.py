"""Addresses: parts, canonical forms, keyed references and deterministic ids, as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

from ledgerline.functions import patterns as P
from ledgerline.functions.ids import as_col

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:@]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
NAMES = ["scheme", "user", "host", "port", "path", "query", "fragment"]
ENVIRONMENTS = ["dev", "test", "staging", "stage", "preview"]  # Fixed values


def part(url: str | Column, name: str) -> Column:
    found = F.regexp_extract(as_col(url), PARTS, NAMES.index(name) + 1)
    return F.lower(found) if name in ("scheme", "host") else found


def _web(url: Column) -> Column:
    return part(url, "scheme").isin("http", "https") & (part(url, "host") != "")


def _authority(url: Column) -> Column:
    port = part(url, "port")
    default = (port == "") | ((part(url, "scheme") == "https") & (port == "443")) | ((part(url, "scheme") == "http") & (port == "80"))
    return F.concat(part(url, "host"), F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)))


def safe_url(url: str | Column) -> Column:
    """Address for display: origin, and only marks in place of path, query and fragment."""
    u = as_col(url)
    mark = lambda name, text: F.when(part(u, name) != "", F.lit(text)).otherwise("")
    path = F.when(part(u, "path").isin("", "/"), "/").otherwise("/<path-omitted>")
    shown = F.concat(part(u, "scheme"), F.lit("://"), _authority(u), path, mark("query", "?<query-omitted>"), mark("fragment", "#<fragment-omitted>"))
    return F.when(_web(u), F.substring(shown, 1, 512)).otherwise("<invalid-url>")


def origin(url: str | Column) -> Column:
    """scheme://host[:port] of a web address without credentials, else null."""
    u = as_col(url)
    return F.when(_web(u) & (part(u, "user") == ""), F.concat(part(u, "scheme"), F.lit("://"), _authority(u)))


def with_scheme(locator: str | Column) -> Column:
    return F.when(F.contains(as_col(locator), F.lit("://")), as_col(locator)).otherwise(F.concat(F.lit("https://"), as_col(locator)))


def exact_url(locator: str | Column) -> Column:
    """A requestable form of an address: origin in canonical form, the rest as it is."""
    u = with_scheme(locator)
    rest = lambda name, sign: F.when(part(u, name) != "", F.concat(F.lit(sign), part(u, name))).otherwise("")
    return F.concat(origin(u), part(u, "path"), rest("query", "?"), rest("fragment", "#"))


#: Address ranges that are not public: first address and bits of the network. Fixed values.
PRIVATE = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4)]
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"


def private_address(host: str | Column) -> Column:
    """Whether a host is a literal IPv4 address that is not public; false for names."""
    h = as_col(host)
    parts = F.transform(F.split(h, r"\."), lambda x: x.try_cast("bigint"))
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
    base = lambda a: sum(int(x) << 8 * (3 - i) for i, x in enumerate(a.split(".")))
    inside = [number.between(base(a), base(a) + (1 << 32 - bits) - 1) for a, bits in PRIVATE]
    return F.when(h.rlike(f"^{IPV4}$"), F.exists(F.array(*inside), lambda x: x)).otherwise(False)


def clean_homepage(url: str | Column) -> Column:
    """https origin of a home page without port, credentials, query or fragment; local hosts and addresses that aren't public are none."""
    u = as_col(url)
    host = part(u, "host")
    sound = (part(u, "scheme") == "https") & (host != "") & part(u, "port").isin("", "443") & (part(u, "user") == "") & (part(u, "query") == "") & (part(u, "fragment") == "")
    return F.when(sound & (F.length(u) <= 2048) & (host != "localhost") & ~host.endswith(".local") & ~private_address(host), F.concat(F.lit("https://"), host))


def credential_keys(url: str | Column) -> Column:
    """Names of query parameters that look like credentials, as they stand; they are decoded up to four times to tell."""
    names = F.transform(F.split(part(url, "query"), "&"), lambda p: F.substring_index(p, "=", 1))
    return F.filter(names, credential_key)


def credential_key(name: Column) -> Column:
    plain = F.coalesce(F.try_url_decode(name), name)
    for _ in range(3):  # only the first decoding takes a plus for a blank
        plain = F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain)
    compact = F.regexp_replace(F.lower(plain), "[^a-z0-9]", "")
    return plain.rlike("(?i)" + P.CREDENTIAL_KEY) | compact.isin(P.CREDENTIAL_NAMES) | compact.rlike(f"(?:{'|'.join(P.CREDENTIAL_ENDINGS)})$")


def environment_hint(url: str | Column) -> Column:
    labels = F.split(part(url, "host"), r"\.")
    return F.when(F.arrays_overlap(labels, F.array(*map(F.lit, ENVIRONMENTS))), "development_candidate").otherwise("unspecified")


def keyed_ref(value: str | Column, key: str) -> Column:
    """HMAC-SHA256 of a text under a key, as `hmac-sha256:<hex>`; all in the JVM."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in k).hex()))
    inner = F.sha2(F.concat(pad(0x36), F.encode(as_col(value), "UTF-8")), 256)
    return F.concat(F.lit("hmac-sha256:"), F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256))


def uuid5_hex(namespace_hex: str, *parts: str | Column) -> Column:
    """Version 5 UUID, without dashes, of parts joined by the unit separator."""
    name = F.concat_ws("\x1f", *[as_col(p).cast("string") for p in parts])
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))
