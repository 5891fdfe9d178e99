"""Masking, redaction and classification of text values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerline.functions import patterns as P
from ledgerline.functions.ids import as_col

MAX_EXAMPLES = 3


def _can_match(text: Column, pattern: str) -> Column | None:
    """A cheap test that every text with a match passes, or None."""
    tests = [F.contains(text, F.lit(n)) for n in P.NEEDS.get(pattern, [])] + [text.rlike(p) for p in [P.NEEDS_PATTERN.get(pattern)] if p]
    return tests[0] if tests else None


def has(text: str | Column, pattern: str, ignore_case: bool = False) -> Column:
    can, found = _can_match(as_col(text), pattern), as_col(text).rlike(P.java(pattern, ignore_case))
    return found if can is None else can & found


def matches(text: str | Column, pattern: str, group: int = 0) -> Column:
    can, found = _can_match(as_col(text), pattern), F.regexp_extract_all(as_col(text), F.lit(P.java(pattern)), F.lit(group))
    return found if can is None else F.when(can, found).otherwise(F.array().cast("array<string>"))


def replaced(text: Column, pattern: str, by: str) -> Column:
    out = lambda t: F.regexp_replace(t, P.java(pattern), by)
    if _can_match(text, pattern) is None:
        return out(text)
    # bound by a lambda, so that a chain of replacements evaluates each text once
    return F.get(F.transform(F.array(text), lambda t: F.when(_can_match(t, pattern), out(t)).otherwise(t)), F.lit(0))


def clean_text(value: str | Column, limit: int = 256) -> Column:
    """Control characters and runs of white space as one blank, trimmed, cut to `limit`."""
    return F.substring(F.trim(F.regexp_replace(as_col(value), r"(?U)[\x00-\x1f\x7f\s]+", " ")), 1, limit)


def mask(kind: str, value: str | Column) -> Column:
    """Hide so much of a matched value that its owner can find it and nobody can rebuild it."""
    text = F.trim(F.regexp_replace(as_col(value), r"(?U)\s+", " "))
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "phone":
        return F.concat(F.left(digits, F.lit(3)), F.lit("-"), F.repeat(F.lit("*"), F.length(digits) - 7), F.lit("-"), F.right(digits, F.lit(4)))
    if kind in ("plate", "business"):
        return F.regexp_replace(text, "[0-9]([^0-9]*)[0-9]([^0-9]*)$", r"*$1*$2")
    if kind == "resident":
        return F.concat(F.left(digits, F.lit(6)), F.lit("-"), F.substring(digits, 7, 1), F.lit("******"))
    if kind == "email":
        local = F.substring_index(text, "@", 1)
        domain = F.substring(text, F.length(local) + 2, F.length(text))
        return F.concat(F.left(local, F.lit(2)), F.repeat(F.lit("*"), F.greatest(F.lit(1), F.length(local) - 2)), F.lit("@"), domain)
    return F.repeat(F.lit("*"), F.length(text))


def masked_examples(kind: str, values: Column) -> Column:
    """The first three different masked values, in order of appearance."""
    return F.slice(F.array_distinct(F.transform(values, lambda v: mask(kind, v))), 1, MAX_EXAMPLES)


def tax_number_valid(value: Column) -> Column:
    """Check digit of a ten-digit business number; ten equal digits are not one."""
    digits = F.transform(F.split(F.regexp_replace(value, "[^0-9]", ""), ""), lambda c: c.cast("int"))
    weighted = sum((F.get(digits, F.lit(i)) * w for i, w in enumerate(P.TAX_WEIGHTS)), F.lit(0))
    carry = F.floor(F.get(digits, F.lit(8)) * 5 / 10)
    check = (10 - (weighted + carry) % 10) % 10
    return (F.size(digits) == 10) & (F.size(F.array_distinct(digits)) > 1) & (check == F.get(digits, F.lit(9)))


def redact(text: str | Column, canaries: list[str] = ()) -> Column:
    """Known values in a text replaced by labels, in a fixed order of rules."""
    out = as_col(text)
    for canary in canaries:
        out = F.replace(out, F.lit(canary), F.lit("[REDACTED_CANARY]"))
    out = replaced(out, P.PRIVATE_KEY_BLOCK, "[REDACTED_PRIVATE_KEY]")
    for code, pattern in P.SECRETS.items():
        out = replaced(out, pattern, f"[REDACTED_{code}]")
    out = replaced(out, P.ASSIGNMENT, "$1=[REDACTED]")
    out = replaced(out, P.QUERY_SECRET, "$1[REDACTED]")
    for label, pattern in (("EMAIL", P.EMAIL), ("PHONE", P.PHONE), ("RESIDENT", P.RESIDENT), ("BUSINESS_NUMBER", P.BUSINESS), ("VEHICLE_PLATE", P.PLATE)):
        out = replaced(out, pattern, f"[REDACTED_{label}]")
    return out


def key_words(key: str | Column) -> Column:
    """A field name as lower-case words between blanks, camel case split."""
    spaced = F.regexp_replace(as_col(key), "([a-z])([A-Z])", "$1 $2")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(spaced), r"(?U)[_\-\s]+", " ")), F.lit(" "))


def key_categories(key: str | Column) -> Column:
    """All categories with one of whose terms the field name agrees, sorted."""
    words = key_words(key)
    one = lambda terms: F.exists(F.array(*[F.lit(f" {t.replace('_', ' ')} ") for t in terms]), lambda t: F.contains(words, t))
    return F.array_sort(F.array_compact(F.array(*[F.when(one(terms), F.lit(name)) for name, terms in P.CATEGORY_TERMS.items()])))


def value_state(value: str | Column) -> Column:
    """field_name_only, template, calculation or value, for a scalar field's text."""
    v = as_col(value)
    empty = v.isNull() | v.isin("", "[]", "{}")
    return F.when(empty, "field_name_only").when(v.rlike(P.java(f"(?s)^(?:{P.PLACEHOLDER})$", True)), "template").when(v.rlike(P.java(P.CALCULATION, True)), "calculation").otherwise("value")


def suffix_class(path: str | Column) -> Column:
    suffix = F.lower(F.regexp_extract(as_col(path), r"[^/]\.([A-Za-z0-9]+)$", 1))
    out = F.lit("other")
    for name, suffixes in P.SUFFIX_CLASSES.items():
        out = F.when(suffix.isin(suffixes), F.lit(name)).otherwise(out)
    return out
