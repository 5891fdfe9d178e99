"""Evaluation texts leaking into training text (problem 7)."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

RUN = 12  #: so many successive words of an item are a leak
BLOCK = 50_000_000  #: characters of the items of one automaton; a larger test set takes several
INLINE = "a abbr b big cite code del em font i ins kbd mark q s small span strike strong sub sup tt u var wbr"  # Fixed values: tags within words

_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>|<!--.*?-->", re.S)
_BROKEN = re.compile(r"(?<=[^\W\d_])-\r?\n[ \t]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_INLINE = frozenset(INLINE.split())
#: Characters without a glyph, as ranges of code points. Fixed values.
HIDDEN = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]
_HIDDEN = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in HIDDEN) + "]")


def _tag(m: re.Match) -> str:
    return "" if m.group(1) and m.group(1).lower() in _INLINE else " "


def _reference(m: re.Match) -> str:
    return html.unescape(m.group())


def _nothing(m: re.Match) -> str:
    return ""


def _steps(text: str, rejoin: bool) -> list:
    """(pattern, replacement) of what is taken out of a normalised text, in order."""
    out = []
    if "<" in text:
        out.append((_TAG, _tag))
    if "&" in text:
        out.append((_REFERENCE, _reference))
    return [*out, (_BROKEN, _nothing)] if rejoin else out


def plain(text: str, rejoin: bool = True) -> str:
    """Text without mark-up, invisible characters, glyph variants, case and (if rejoin) line-end hyphens."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    for pattern, made in _steps(text, rejoin):
        text = pattern.sub(made, text)
    return _folded(text)


def _folded(text: str) -> str:
    text = text.casefold()
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def _opens(c: str) -> bool:
    """Whether a character begins anew, whatever stands before it."""
    head = unicodedata.normalize("NFKC", c)[:1]
    return not head or not (unicodedata.combining(head) or 0x1160 <= ord(head) <= 0x11FF)


def _clusters(text: str, begin: np.ndarray, end: np.ndarray, made) -> tuple[str, np.ndarray, np.ndarray]:
    """`made` of each character with its marks, and the places it came from."""
    starts = [i for i, c in enumerate(text) if i == 0 or c.isascii() or _opens(c)]
    bounds = [*starts, len(text)]
    parts = [made(text[a:b]) for a, b in zip(bounds, bounds[1:])]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    first, last = np.array(bounds[:-1], dtype=np.int64), np.array(bounds[1:], dtype=np.int64) - 1
    return "".join(parts), np.repeat(begin[first], sizes), np.repeat(end[last], sizes)


def placed(text: str, rejoin: bool = True) -> tuple[str, np.ndarray, np.ndarray]:
    """plain(), and where in the original each of its characters begins and ends; only for texts with a leak."""
    begin = np.arange(len(text))
    end = begin + 1
    if not text.isascii():
        keep = np.array([_HIDDEN.match(c) is None for c in text], dtype=bool)
        text, begin, end = "".join(c for c, k in zip(text, keep) if k), begin[keep], end[keep]
        if text:
            text, begin, end = _clusters(text, begin, end, lambda c: unicodedata.normalize("NFKC", c))
    for pattern, made in _steps(text, rejoin):
        parts, firsts, lasts, at = [], [], [], 0
        for m in pattern.finditer(text):
            new = made(m)
            parts += [text[at : m.start()], new]
            firsts += [begin[at : m.start()], np.full(len(new), begin[m.start()])]
            lasts += [end[at : m.start()], np.full(len(new), end[m.end() - 1])]
            at = m.end()
        text, begin, end = "".join([*parts, text[at:]]), np.concatenate([*firsts, begin[at:]]), np.concatenate([*lasts, end[at:]])
    return _clusters(text, begin, end, _folded) if text else (text, begin, end)


def words(text: str, rejoin: bool = True) -> list[str]:
    return _WORD.findall(plain(text, rejoin))


def _lcs(masks: dict[int, int], n: int, stretch) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's n words."""
    full = (1 << n) - 1
    v = full
    for w in stretch:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


class LeakAutomaton:
    """One Aho-Corasick automaton over the normalised items: their single words and their runs of RUN words."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN):
        import ahocorasick

        self.run, self.ids, self.vocabulary = run, [], {}
        automaton, runs, self.items = ahocorasick.Automaton(), {}, []
        for item_id, text in items:
            seq = words(text or "")
            if not seq:
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            coded = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in seq]
            masks: dict[int, int] = {}
            for i, w in enumerate(coded):
                masks[w] = masks.get(w, 0) | 1 << i
            n = len(coded)
            self.items.append((n, -(-3 * n // 4), 4 * n // 3, masks))
            for i in range(n - run + 1):
                runs.setdefault(" " + " ".join(seq[i : i + run]) + " ", []).append(k)
        for w, number in self.vocabulary.items():
            automaton.add_word(f" {w} ", number)
        for number, (pattern, owners) in enumerate(runs.items()):
            automaton.add_word(pattern, -1 - number)
        self.owners = list(runs.values())
        self.empty = not self.ids
        if self.empty:
            return
        automaton.make_automaton()
        self.automaton = automaton
        # an item needs so many different words of its own in a text, at least
        self.need = np.array([max(1, len(masks) - (n - least)) for n, least, _, masks in self.items])
        self.least = int(self.need.min())
        holders: list[list[int]] = [[] for _ in self.vocabulary]
        for k, (_, _, _, masks) in enumerate(self.items):
            for w in masks:
                holders[w].append(k)
        self.holders = [np.array(h, dtype=np.int32) for h in holders]
        self.reach = max(run, max(most for _, _, most, _ in self.items))  # words of the longest stretch

    def _near(self, coded: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Stretches of words that have three quarters of item k's words in order: (first word, one past the last)."""
        n, least, most, masks = self.items[k]
        at = np.flatnonzero(np.isin(coded, np.fromiter(masks, dtype=coded.dtype)))
        out: list[tuple[int, int]] = []
        if len(at) < least:
            return out
        ends = np.searchsorted(at, at + most)  # words of the item within the stretch that starts at each of them
        for i in np.flatnonzero(ends - np.arange(len(at)) >= least):
            if (not out or at[i] >= out[-1][1]) and _lcs(masks, n, coded[at[i : ends[i]]].tolist()) >= least:
                out.append((int(at[i]), int(at[ends[i] - 1]) + 1))
        return out

    def scan(self, text: str) -> list[tuple[int, int, int, bool]]:
        """The passages of items in a text: (item number, first word, one past the last, rejoin); words are those of words(text, rejoin).

        A text whose lines end in hyphens is scanned with the words put together again, and once more as it stands,
        but only around those places.
        """
        found = [(*x, True) for x in self._scan(words(text, True), 0)]
        if "-\n" in text or "-\r\n" in text:  # a line may also end in a hyphen of its own
            apart = plain(text, False)
            spans = [m.span() for m in _WORD.finditer(apart)]
            breaks = np.searchsorted(np.array([a for a, _ in spans]), [m.start() for m in _BROKEN.finditer(apart)])
            windows: list[list[int]] = []
            for at in breaks.tolist():
                lo, hi = max(0, at - self.reach), min(len(spans), at + self.reach)
                if windows and lo <= windows[-1][1]:
                    windows[-1][1] = hi
                else:
                    windows.append([lo, hi])
            for lo, hi in windows:
                found += [(*x, False) for x in self._scan([apart[a:b] for a, b in spans[lo:hi]], lo)]
        return found

    def _scan(self, seq: list[str], offset: int) -> list[tuple[int, int, int]]:
        line = " " + " ".join(seq) + " "
        seen, runs, ends = set(), {}, None
        for end, number in self.automaton.iter(line):
            if number >= 0:
                seen.add(number)
                continue
            if ends is None:
                ends = np.cumsum([len(w) + 1 for w in seq])
            last = int(np.searchsorted(ends, end)) + 1
            for k in self.owners[-1 - number]:
                own = runs.setdefault(k, [])
                if own and last - self.run <= own[-1][1]:  # the passage goes on
                    own[-1] = (own[-1][0], last)
                else:
                    own.append((last - self.run, last))
        out = [(k, offset + a, offset + b) for k, own in runs.items() for a, b in own]
        if len(seen) < self.least:
            return out
        counts = np.bincount(np.concatenate([self.holders[w] for w in seen]), minlength=len(self.ids))
        coded = None
        for k in np.flatnonzero(counts >= self.need).tolist():
            if coded is None:
                coded = np.array([self.vocabulary.get(w, -1) for w in seq], dtype=np.int32)
            own = runs.get(k, [])
            out += [(k, offset + a, offset + b) for a, b in self._near(coded, k) if not any(a < y and x < b for x, y in own)]
        return out


def original_spans(text: str, passages: list[tuple[int, int, int, bool]]) -> list[tuple[int, int, int]]:
    """(item number, start, end) in code points of the original text; what overlaps of one item is one passage."""
    found: dict[int, list[tuple[int, int]]] = {}
    for rejoin in {p[3] for p in passages}:
        made, begin, end = placed(text, rejoin)
        spans = [m.span() for m in _WORD.finditer(made)]
        for k, first, last, how in passages:
            if how == rejoin and spans:
                a, b = spans[min(first, len(spans) - 1)][0], spans[min(last, len(spans)) - 1][1]
                found.setdefault(k, []).append((int(begin[a]), int(end[b - 1])))
    out = []
    for k, own in found.items():
        own.sort()
        start, stop = own[0]
        for a, b in own[1:]:
            if a < stop:
                stop = max(stop, b)
            else:
                out.append((k, start, stop))
                start, stop = a, b
        out.append((k, start, stop))
    return out


def _blocks(items: DataFrame, block: int) -> Iterator[list[tuple]]:
    """The items in lists of at most about `block` characters; one list for any usual test set."""
    sound = items.select("item_id", "text").where("item_id is not null").distinct()
    n = max(1, -(-(sound.agg(F.sum(F.length("text"))).first()[0] or 0) // block))
    for k in range(n):
        yield sorted((r[0], r[1]) for r in sound.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect())


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, start_char, end_char: every passage of an item in a document, and where.

    A document contains an item if it has `run` successive words of it, or three quarters of its words in their order
    within a stretch at most a third longer than the item. The items are a stated query set: one automaton over all of
    them, built once and broadcast, scans the documents where they lie, without a shuffle. Its size follows the items'
    characters; beyond `block` of them there are several automata of that size. Null texts contain nothing; an item
    without words is contained nowhere; repeated document rows give repeated results. Positions are code points of the
    original text and take in all of a passage's words.
    """
    out = None
    kinds = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, start_char bigint, end_char bigint"
    for part in _blocks(items, block):
        held = documents.sparkSession.sparkContext.broadcast(LeakAutomaton(part, run))

        def scan(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            automaton = held.value
            for frame in frames:
                found = []
                if not automaton.empty:
                    for doc, text in zip(frame["doc_id"], frame["text"]):
                        if text and (passages := automaton.scan(text)):
                            found += [(doc, automaton.ids[k], a, b) for k, a, b in original_spans(text, passages)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "start_char", "end_char"])

        one = documents.select("doc_id", "text").mapInPandas(scan, kinds)
        out = one if out is None else out.unionByName(one)
    return out
