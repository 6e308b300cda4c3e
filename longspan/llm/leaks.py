"""Held-out evaluation passages inside a training corpus.

One Aho-Corasick automaton holds every short run of words of every held-out passage, reduced to its letters
and digits. Each document is reduced alike (mark-up, entities, case, spacing, punctuation, hyphens at line
ends and the encoding of characters vanish) and scanned once; hits are chained along the passage into
stretches, which may step over a replaced word, and mapped back to the offsets of the original text.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from longspan.llm.text import HAN

#: Words (characters in Chinese) of one pattern, and the most that a stretch steps over, in the passage and (words that a line end broke may count twice) in the document.
RUN_WORDS, RUN_CHARS, STEP_WORDS, STEP_CHARS = 3, 6, 2, 2
#: Share of a passage that makes a case, in at most two stretches of at least so many units.
SHARE, LEAST_WORDS, LEAST_CHARS = 0.4, 5, 12
#: Held-out items, and characters of them, that one automaton holds; further ones get automata and scans of their own.
BLOCK_ITEMS, BLOCK_CHARS = 50_000, 50_000_000

_UNIT = re.compile(f"[{HAN}]|[^\\W_{HAN}]+")
_KEPT = re.compile(r"[^\W_]+")
#: A tag of any length, which holds no blank line, or the address of a link.
_TAG = re.compile(r"<[/!a-zA-Z][^<>\n]*(?:\n(?!\s*\n|>)[^<>\n]*)*>|\]\([^()\s]*\)")
_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_HAN = re.compile(f"[{HAN}]")


def plain(text: str) -> str:
    """The text without tags and entities, its characters in one encoding, in lower case."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text or "](" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.replace("\xad", ""))
    return text.lower()


def stream(text: str) -> str:
    """Letters and digits of the text, nothing else."""
    return "".join(_KEPT.findall(plain(text)))


@lru_cache(1)
def _second_halves() -> frozenset[str]:
    """Characters that no combining mark is, and that yet melt into the one before them."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0xC0, 0x1FFFF))
    return frozenset([chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"] + [chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))])


def _melts(c: str) -> bool:
    first = unicodedata.normalize("NFKD", c)[:1]
    return unicodedata.combining(first) != 0 or first in _second_halves()


def _replaced(pattern: re.Pattern, text: str, at: list[int], by: object) -> tuple[str, list[int]]:
    """``pattern.sub`` with the place in the original of each character."""
    out, places, last = [], [], 0
    for m in pattern.finditer(text):
        put = by(m[0])  # type: ignore[operator]
        out += [text[last : m.start()], put]
        places += at[last : m.start()] + [at[m.start()]] * len(put)
        last = m.end()
    return "".join(out) + text[last:], places + at[last:]


def stream_offsets(text: str) -> list[int]:
    """For each character of ``stream(text)`` its place in the original; used for texts with hits only.

    Each step of ``plain`` is made again with the places beside it; characters that normalisation melts together are taken as one.
    """
    at = list(range(len(text)))
    if "&" in text:
        text, at = _replaced(_ENTITY, text, at, html.unescape)
    if "<" in text or "](" in text:
        text, at = _replaced(_TAG, text, at, lambda _: " ")
    out, i, n = [], 0, len(text)
    while i < n:
        j = i + 1
        while j < n and text[j] > "\x7f" and (text[j] == "\xad" or _melts(text[j])):
            j += 1
        part = text[i:j]
        kept = _KEPT.findall((part if part.isascii() else unicodedata.normalize("NFKC", part.replace("\xad", ""))).lower())
        out += [at[i]] * sum(map(len, kept))
        i = j
    return out


class Items:
    """Units of the held-out passages and the automaton over their runs."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        import ahocorasick

        self.units: dict[int, list[str]] = {}
        self.starts: dict[int, list[int]] = {}
        self.chars: dict[int, bool] = {}
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item, passage in items:
            units = _UNIT.findall(plain(passage or ""))
            if not units:
                continue
            by_char = 2 * len(_HAN.findall(passage)) > len(units)
            run = min(RUN_CHARS if by_char else RUN_WORDS, len(units))
            self.units[item], self.chars[item] = units, by_char
            for k in range(len(units) - run + 1):
                where["".join(units[k : k + run])].append((item, k))
        self.automaton = ahocorasick.Automaton()
        for pattern, at in where.items():
            self.automaton.add_word(pattern, (len(pattern), at))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def hits(self, s: str) -> dict[int, list[tuple[int, int, int]]]:
        """By item: (start in the stream, end in the stream, first unit of the passage)."""
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for end, (length, at) in self.automaton.iter(s):
            for item, k in at:
                found[item].append((end + 1 - length, end + 1, k))
        return found

    def stretches(self, item: int, hits: list[tuple[int, int, int]], s: str, words: list[int]) -> list[tuple[int, int, int, int]]:
        """Runs along the passage, (first unit, unit after the last, start, end), each as long as it gets.

        ``words`` tells where in the stream the document's units start. A hit goes on the stretch that it overlaps or touches, else the last one that ends
        a step before it, both in the passage and in the document; stretches are found by the unit and the place at which they end.
        """
        units, by_char = self.units[item], self.chars[item]
        run = min(RUN_CHARS if by_char else RUN_WORDS, len(units))
        step = STEP_CHARS if by_char else STEP_WORDS
        upto = [0, *accumulate(map(len, units))]
        ends: dict[tuple[int, int], list[int]] = {}
        last_end: dict[int, int] = {}
        out: list[list[int]] = []
        for a, b, k in sorted(hits):
            t, at = None, a - upto[k]
            for u in range(k + run - 1, k - 1, -1):
                t = ends.pop((u, at + upto[u]), None)
                if t is not None:
                    break
            else:
                for u in range(k - 1, k - 1 - step, -1):
                    end = last_end.get(u, a)
                    if end < a and (u, end) in ends and bisect_left(words, a) - bisect_left(words, end) <= 2 * step:
                        t = ends.pop((u, end))
                        break
            if t is None:
                out.append(t := [k, k + run, a, b])
            t[1], t[3] = k + run, b
            ends[k + run, b] = t
            last_end[k + run] = b
        return [self.extend(units, t, s, step, by_char, words) for t in out]

    @staticmethod
    def extend(units: list[str], t: list[int], s: str, step: int, by_char: bool, words: list[int]) -> tuple[int, int, int, int]:
        """On beyond a replaced word at either end, where too few units follow it for a whole run."""
        first, last, a, b = t
        if by_char:
            return first, last, a, b
        while last < len(units) and s.startswith(units[last], b):
            b += len(units[last])
            last += 1
        while first > 0 and s.endswith(units[first - 1], 0, a):
            first -= 1
            a -= len(units[first])
        nxt = "".join(units[last + 1 : last + 3])
        if len(nxt) >= 5 and s.find(nxt, b) >= 0:
            w = bisect_left(words, b)
            for at in words[w + 1 : w + 1 + 2 * step]:
                if s.startswith(nxt, at):
                    last, b = min(last + 3, len(units)), at + len(nxt)
                    break
        prev = "".join(units[max(0, first - 3) : max(0, first - 1)])
        if len(prev) >= 5 and s.find(prev, 0, a) >= 0:
            w = bisect_left(words, a)
            for at in words[max(0, w - 2 * step) : w][::-1]:
                if s.endswith(prev, 0, at):
                    first, a = max(0, first - 3), at - len(prev)
                    break
        return first, last, a, b

    def leaked(self, item: int, hits: list[tuple[int, int, int]], s: str, words: list[int]) -> tuple[float, list[tuple[int, int]]]:
        """Share of the passage in its best one or two stretches in order, and their places in the stream."""
        n = len(self.units[item])
        least = min(LEAST_CHARS if self.chars[item] else LEAST_WORDS, n)
        runs = sorted({t for t in self.stretches(item, hits, s, words) if t[1] - t[0] >= least}, key=lambda t: (t[0] - t[1], t))
        best, parts = 0, []
        for i, x in enumerate(runs):  # longest first, so a pair that cannot beat the best ends the search
            long_ = x[1] - x[0]
            if long_ > best:
                best, parts = long_, [x[2:]]
            if 2 * long_ <= best:
                break
            for y in runs[i + 1 :]:
                if long_ + y[1] - y[0] <= best:
                    break
                p, q = (x, y) if x[0] <= y[0] else (y, x)
                size = (p[1] - p[0]) + (q[1] - q[0]) - max(0, p[1] - q[0])
                if p[2] < q[2] and p[3] <= q[2] + 1 and size > best:
                    best, parts = size, [p[2:], q[2:]]
        return best / n, parts


def unit_starts(text: str) -> list[int]:
    """Where in the stream of a text the units of its ``plain`` form start."""
    return [0, *accumulate(map(len, _UNIT.findall(text)))][:-1]


_BUILT: dict[str, Items] = {}


def items_of(name: str, held: list[tuple[int, str]]) -> Items:
    """The automaton of a block, built once in each worker process."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Items(held)
    return _BUILT[name]


def leaks(documents: DataFrame, items: DataFrame, share: float = SHARE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``(doc_id, item_id, share, start_char, end_char)`` of each held-out passage in each document.

    A row for every document and item of which at least ``share`` of the passage's words (characters in Chinese)
    stand in the document, in their order, in at most two stretches. Offsets are those of the original text,
    from the first stretch to the end of the last. Null, empty or blank texts and passages make no rows;
    repeated documents repeat their rows; a passage shorter than a run is sought whole. The items are the held-out set, of fixed size; should it hold more than one
    automaton may (``block_items``, ``BLOCK_CHARS``), the documents are scanned once for each block of it. The documents pass in narrow stages without a shuffle.
    """
    rows = items.select("item_id", "passage").where("item_id is not null and passage is not null").distinct().orderBy("item_id", "passage")
    passes: list[DataFrame] = []
    block: list[tuple[int, str]] = []
    chars = 0
    for r in rows.toLocalIterator():
        if block and (len(block) >= block_items or chars + len(r[1]) > BLOCK_CHARS):
            passes.append(_scan(documents, block, share))
            block, chars = [], 0
        block.append((r[0], r[1]))
        chars += len(r[1])
    passes.append(_scan(documents, block, share))
    return reduce(DataFrame.unionByName, passes)


def _scan(documents: DataFrame, held: list[tuple[int, str]], share: float) -> DataFrame:
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items_of(name, held)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text or doc is None or known.empty:
                    continue
                bare = plain(text)
                s = "".join(_KEPT.findall(bare))
                offsets = words = None
                for item, at in known.hits(s).items():
                    run_ = min(RUN_CHARS if known.chars[item] else RUN_WORDS, len(known.units[item]))
                    if len({k for *_, k in at}) * (run_ + STEP_WORDS + 2) + 6 < share * len(known.units[item]):
                        continue  # the hits cannot add up to the share, whatever they step over
                    words = unit_starts(bare) if words is None else words
                    got, parts = known.leaked(item, at, s, words)
                    if got >= share:
                        offsets = stream_offsets(text) if offsets is None else offsets
                        rows.append((doc, item, got, offsets[parts[0][0]], offsets[parts[-1][1] - 1] + 1))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "share", "start_char", "end_char"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint, share double, start_char int, end_char int")
