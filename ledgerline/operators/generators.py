"""Candidate names and queries from names, affixes and templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerline.functions.ids import as_col
from ledgerline.operators.joins import small

#: Romanisation of Hangul jamo by index. Fixed values.
INITIAL = ["g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h"]
VOWEL = ["a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i"]
FINAL = ["", "k", "k", "k", "n", "n", "n", "t", "l", "l", "l", "l", "l", "l", "l", "l", "m", "p", "p", "t", "t", "ng", "t", "t", "k", "t", "p", "t"]
JOINERS = ["", "-", "_"]  # Fixed values
PLAIN = "".join(chr(c) for c in range(0x21, 0x7F))
WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))  # full-width forms


def _syllables(text: Column, one) -> Column:
    """Apply `one` to (initial, vowel, final) of every Hangul syllable; other characters are left out."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c.rlike("^[\\uac00-\\ud7a3]$")), lambda c: F.ascii(c) - 0xAC00)
    return F.array_join(F.transform(codes, lambda n: one(F.floor(n / 588).cast("int"), F.floor(n % 588 / 28).cast("int"), (n % 28).cast("int"))), "")


def romanize(text: str | Column) -> Column:
    table = lambda v, i: F.get(F.array(*map(F.lit, v)), i)
    return _syllables(as_col(text), lambda c, v, t: F.concat(table(INITIAL, c), table(VOWEL, v), table(FINAL, t)))


def initials(text: str | Column) -> Column:
    """One letter per syllable: the initial, or the vowel's first letter where the initial is mute."""
    table = lambda v, i: F.get(F.array(*map(F.lit, v)), i)
    return _syllables(as_col(text), lambda c, v, t: F.when(table(INITIAL, c) == "", F.left(table(VOWEL, v), F.lit(1))).otherwise(table(INITIAL, c)))


def ascii_term(text: str | Column) -> Column:
    """Lower-case ASCII letters and digits of a term; full-width forms count as their plain ones."""
    return F.regexp_replace(F.lower(F.translate(as_col(text), WIDE, PLAIN)), "[^a-z0-9]", "")


#: Legal forms and places that carry no identity, and tails of compound names. Fixed values.
LEGAL_TAILS = ["inc", "llc", "ltd", "co", "corp", "corporation", "company", "group", "holdings"]
HANGUL_PREFIXES = ["주식회사", "(주)", "유한회사"]
HANGUL_SUFFIXES = ["주식회사", "(주)", "유한회사", "그룹", "홀딩스", "코리아", "컴퍼니"]
HANGUL_TAILS = [
    "렌트카", "렌터카", "모빌리티", "시스템즈", "시스템", "테크놀로지", "테크", "솔루션", "네트웍스", "네트워크", "파트너스", "물류",
    "유통", "산업", "건설", "전자", "화학", "제약", "식품", "미디어", "커머스", "에너지", "바이오",
]
#: How a stem comes about, in order of preference, with its weight. Fixed values.
STEM_KINDS = {
    "name": 0, "compound": 0, "leading-word": 0, "word": 1, "initialism": 1, "hangul-original": 1, "hangul-original-initials": 2, "hangul-stem": 1, "hangul-stem-initials": 2,
    "hangul-tail": 3, "hangul-whole": 2, "hangul-whole-initials": 3, "devowelled": 4, "truncated": 4,
}


def _any_of(words: list[str]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")"


def stems(names: DataFrame) -> DataFrame:
    """name -> (name, stem, why, weight), each stem once, by the first of STEM_KINDS that gives it.

    Latin names: without legal forms at the end, whole, joined at each word boundary, by word, and their initialism.
    Hangul names: as they are, and without legal forms at either end, split at a known tail; romanised and as initials.
    Of all stems of five letters and more also the devowelled and the truncated form. Null names have none.
    """
    name = F.lower(F.replace(F.translate("name", WIDE, PLAIN), F.lit("㈜"), F.lit("(주)")))
    words = F.regexp_extract_all(name, F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.reverse(F.aggregate(F.reverse(words), F.array().cast("array<string>"), lambda acc, w: F.when((F.size(acc) == 0) & w.isin(LEGAL_TAILS), acc).otherwise(F.concat(acc, F.array(w)))))
    body = F.regexp_replace(name, r"(?U)\s+", "")
    hangul = body.rlike("[가-힣]")
    bare = F.regexp_replace(F.regexp_replace(body, f"^{_any_of(HANGUL_PREFIXES)}(?=.)", ""), f"(?<=.){_any_of(HANGUL_SUFFIXES)}$", "")
    rows = names.where("name is not null").select("name", kept.alias("w"), F.when(hangul, body).alias("h"), F.when(hangul, bare).alias("bare"))
    tail = F.array_compact(F.array(*[F.when(F.endswith("bare", F.lit(t)) & (F.length("bare") > len(t)), F.lit(t)) for t in HANGUL_TAILS]))
    rows = rows.withColumn("tail", F.get(tail, F.lit(0))).withColumn("head", F.expr("substr(bare, 1, length(bare) - length(tail))"))
    one = lambda why, stem: F.struct(F.lit(why).alias("why"), stem.alias("stem"))
    several = F.size("w") > 1
    latin = [one("name", F.array_join("w", "")), one("initialism", F.when(several, F.array_join(F.transform("w", lambda x: F.left(x, F.lit(1))), "")))]
    splits = F.when(several, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda n: one("compound", F.concat(F.array_join(F.slice("w", 1, n), ""), F.lit("-"), F.array_join(F.slice("w", n + 1, F.size("w")), "")))))
    each = F.transform("w", lambda x, i: F.struct(F.when(i == 0, "leading-word").otherwise("word").alias("why"), x.alias("stem")))
    korean = [one("hangul-original", romanize("h")), one("hangul-original-initials", initials("h")), one("hangul-stem", romanize("head")), one("hangul-stem-initials", initials("head")), one("hangul-tail", romanize("tail")), one("hangul-whole", romanize("bare")), one("hangul-whole-initials", initials("bare"))]
    empty = F.array().cast("array<struct<why:string,stem:string>>")
    made = rows.select("name", F.explode(F.concat(F.array(*latin, *korean), F.coalesce(splits, empty), each)).alias("s")).select("name", "s.*").where("length(stem) >= 2")
    short = F.concat(F.left("stem", F.lit(1)), F.regexp_replace(F.substring("stem", 2, 1000), "[aeiou]", ""))
    from_ = made.where("why <> 'initialism' and length(stem) >= 5")
    devowelled = from_.select("name", F.lit("devowelled").alias("why"), short.alias("d"), "stem").where("length(d) > 2 and length(d) < length(stem)").select("name", "why", F.col("d").alias("stem"))
    both = made.unionByName(devowelled).unionByName(from_.select("name", F.lit("truncated").alias("why"), F.left("stem", F.lit(4)).alias("stem")))
    kinds = F.array(*map(F.lit, STEM_KINDS))
    best = both.groupBy("name", "stem").agg(F.min(F.array_position(kinds, F.col("why"))).cast("int").alias("k"))
    return best.select("name", "stem", kinds[F.col("k") - 1].alias("why"), F.array(*map(F.lit, STEM_KINDS.values()))[F.col("k") - 1].alias("weight"))


def combine(stem_rows: DataFrame, words: DataFrame, cap: int) -> DataFrame:
    """Stem, joiner and affix put together, ranked per name and cut to `cap`: name, candidate, position.

    words: word, word_no - an operator-supplied list, broadcast if counted small. A candidate that arises twice keeps
    its best rank; an affix that is part of the stem or contains it makes none; initialisms stay bare. Bare stems that
    fall beyond the cap take the last places from what is ranked lowest within it.
    """
    affixes = small(words)
    made = stem_rows.where("why <> 'initialism'").join(affixes, ~F.contains(F.col("stem"), F.col("word")) & ~F.contains(F.col("word"), F.col("stem")))
    made = made.select("name", "stem", "weight", "word", "word_no", F.posexplode(F.array(*map(F.lit, JOINERS))).alias("joiner_no", "joiner"))
    made = made.select("name", F.concat("stem", "joiner", "word").alias("candidate"), "weight", (F.col("word_no") + 1).alias("round"), "joiner_no")
    bare = stem_rows.select("name", F.col("stem").alias("candidate"), "weight", F.lit(0).alias("round"), F.lit(0).alias("joiner_no"))
    best = bare.unionByName(made).where("length(candidate) between 2 and 39").groupBy("name", "candidate").agg(F.min(F.struct("weight", "round", "joiner_no")).alias("r"))
    order = W.partitionBy("name").orderBy("r", F.length("candidate"), "candidate")
    ranked = best.withColumn("n", F.row_number().over(order))
    reserved = (F.col("n") > cap) & (F.col("r.round") == 0)
    ranked = ranked.withColumn("reserved", reserved).withColumn("held", F.sum(reserved.cast("int")).over(W.partitionBy("name")))
    kept = ranked.where(F.col("reserved") | (F.col("n") <= cap - F.col("held")))
    return kept.select("name", "candidate", F.row_number().over(order).cast("bigint").alias("position"))


def word_prefixes(names: DataFrame, roles: list[str]) -> DataFrame:
    """Proper prefixes of at least two words, bare and with a role: name, candidate."""
    words = F.filter(F.split(F.lower("name"), "[^a-z0-9]+"), lambda w: w != "")
    rows = names.select("name", words.alias("w")).where("size(w) >= 3").select("name", F.explode(F.expr("transform(sequence(2, least(size(w), 5) - 1), n -> slice(w, 1, n))")).alias("p"))
    rows = rows.select("name", "p", F.explode(F.array(*map(F.lit, JOINERS))).alias("sep")).select("name", "p", F.array_join("p", "", None).alias("flat"), F.expr("array_join(p, sep)").alias("base"))
    role = F.explode(F.concat(F.array(F.lit("")), F.flatten(F.array(*[F.array(*[F.lit(j + r) for j in JOINERS]) for r in roles]))))
    out = rows.where("length(flat) >= 4").select("name", "p", "base", role.alias("role"))
    out = out.where(~F.expr("exists(p, x -> x = regexp_replace(role, '^[-_]', ''))")).select("name", F.concat("base", "role").alias("candidate"))
    return out.where("length(candidate) between 2 and 39").distinct()


def from_templates(candidates: DataFrame, templates: DataFrame) -> DataFrame:
    """Addresses of every candidate on every platform: the template's {c} replaced."""
    return candidates.select("candidate").distinct().join(small(templates)).select("candidate", "platform", F.replace(F.col("template"), F.lit("{c}"), F.col("candidate")).alias("url"))
