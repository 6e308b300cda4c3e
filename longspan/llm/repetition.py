"""Repetition inside one text: the share of its words that only repeat earlier words.

A word (a character in Chinese) repeats if it lies in a later occurrence of a phrase of three or more words
(six or more characters), of a sentence or of a paragraph. Whether the share reaches a threshold is decided by
a cascade of cheap rules, each of which only rejects texts that cannot reach it; a bounded sample tells what
each rule costs and rejects of what the rules before it leave, and the rules run in the order of rejection per cost. Splitting a text into
words is paid by the first rule that asks for them. The order changes the
time, never the result.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from longspan.llm.text import HAN, HAN_RE

PHRASE_WORDS, PHRASE_CHARS, SHARE = 3, 6, 0.5
#: Texts read to order the rules; the result does not depend on them.
SAMPLE_ROWS = 2_000

_WORD = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)*")
_HAN_UNIT = re.compile(f"[{HAN}]|[^\\W_{HAN}]+")
_LIST_MARK = re.compile(r"(?m)^[ \t]*(?:[-*•·>]+[ \t]+)?(?:\(?\d{1,3}[.):、][ \t]*(?!\d)|[-*•·][ \t]+)")
_SENTENCE_END = re.compile(r"(?<=[.!?;:。！？；…।؟])[\"'”’»)\]」』]*\s+|(?<=[。！？；…])[”’」』]*|\n+")


def is_chinese(text: str) -> bool:
    """More han characters than words of other scripts."""
    if text.isascii():
        return False
    han = len(HAN_RE.findall(text))
    return han > 0 and 2 * han > len(_HAN_UNIT.findall(text))


class Text:
    """A text with what the rules ask of it, each computed at the first use."""

    __slots__ = ("raw", "_plain", "_chinese", "_words")

    def __init__(self, raw: str | None) -> None:
        self.raw = raw or ""
        self._plain: str | None = None
        self._chinese: bool | None = None
        self._words: list[str] | None = None

    @property
    def plain(self) -> str:
        if self._plain is None:
            self._plain = _LIST_MARK.sub("", self.raw)
        return self._plain

    @property
    def chinese(self) -> bool:
        if self._chinese is None:
            self._chinese = is_chinese(self.plain)
        return self._chinese

    @property
    def words(self) -> list[str]:
        if self._words is None:
            self._words = (_HAN_UNIT if self.chinese else _WORD).findall(self.plain.lower())
        return self._words

    @property
    def phrase(self) -> int:
        return PHRASE_CHARS if self.chinese else PHRASE_WORDS

    def sentences(self) -> list[list[str]]:
        find = (_HAN_UNIT if self.chinese else _WORD).findall
        return [w for part in _SENTENCE_END.split(self.plain.lower()) if part and (w := find(part))]


def covered(t: Text) -> int:
    """Words inside later occurrences of phrases and sentences; occurrences may overlap."""
    w, k = t.words, t.phrase
    n = len(w)
    again = bytearray(n)
    seen: set = set()
    grams = zip(*(w[i:] for i in range(k)), strict=False)
    until = 0  # marked so far
    for i, g in enumerate(grams):
        if g in seen:
            lo = max(i, until)
            until = i + k
            again[lo:until] = b"\1" * (until - lo)
        else:
            seen.add(g)
    sentences = t.sentences()
    if len(sentences) > 1 and sum(map(len, sentences)) == n:
        first: set = set()
        at = 0
        for s in sentences:
            key = tuple(s)
            if key in first:
                again[at : at + len(s)] = b"\1" * len(s)
            first.add(key)
            at += len(s)
    return sum(again)


def share_of(raw: str | None) -> float:
    """Share of repeated words; 0 for null, empty or blank texts."""
    t = Text(raw)
    return covered(t) / len(t.words) if t.words else 0.0


def too_short(t: Text, share: float) -> bool:
    """Fewer than two words: told by the raw text, without splitting it, where it is short and holds no separator."""
    raw = t.raw
    if len(raw) <= 64 and raw.isascii() and (raw.isalnum() or not raw.strip()):
        return True
    return t._words is not None and len(t.words) < 2


def mostly_distinct(t: Text, share: float) -> bool:
    """The first occurrence of a word never repeats, so at most the words beyond the distinct ones do."""
    n = len(t.words)
    return (n - len(set(t.words))) < share * n


def few_phrases_again(t: Text, share: float) -> bool:
    """Each later phrase covers its own length at most, each repeated sentence its words."""
    w, k, n = t.words, t.phrase, len(t.words)
    grams = list(zip(*(w[i:] for i in range(k)), strict=False))
    bound = k * (len(grams) - len(set(grams)))
    if bound < share * n:
        counts = Counter(map(tuple, t.sentences()))
        bound += sum(len(s) * (c - 1) for s, c in counts.items() if len(s) < k)
    return bound < share * n


def below_share(t: Text, share: float) -> bool:
    """Exact, so it decides what is left."""
    n = len(t.words)
    return n == 0 or covered(t) < share * n


RULES: dict[str, Callable[[Text, float], bool]] = {f.__name__: f for f in (few_phrases_again, mostly_distinct, too_short)}


def order_rules(sample: list[str | None], share: float = SHARE) -> list[str]:
    """Names of the rules, each next one that of the most rejected texts per second among those that the rules before leave; the exact rule comes after all."""
    left = [Text(x) for x in sample]
    order: list[str] = []
    while len(order) < len(RULES):
        worth: dict[str, tuple[float, list[Text]]] = {}
        for name in sorted(set(RULES) - set(order)):
            tried = [Text(t.raw) for t in left]
            for t, known in zip(tried, left, strict=True):  # words that a rule before has split are free
                t._plain, t._chinese, t._words = known._plain, known._chinese, known._words
            began = time.perf_counter()
            kept = [t for t in tried if not RULES[name](t, share)]
            worth[name] = ((len(tried) - len(kept)) / max(time.perf_counter() - began, 1e-9), kept)
        best = max(sorted(worth), key=lambda n: worth[n][0])
        order.append(best)
        left = worth[best][1]
    return order


def repeats(raw: str | None, order: list[str], share: float = SHARE) -> bool:
    t = Text(raw)
    return not any(RULES[r](t, share) for r in order) and not below_share(t, share)


def measured_order(texts: DataFrame, share: float, sample_rows: int) -> list[str]:
    """The order of the rules by a sample that is measured where it lies: only names come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [x for b in batches for x in b.column(0).to_pylist()]
        order = order_rules(sample, share)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(order)), pa.int32()), pa.array(order)], names=["at", "rule"])

    found = texts.limit(sample_rows).coalesce(1).mapInArrow(run, "at int, rule string").collect()
    return [r.rule for r in sorted(found, key=lambda r: r["at"])] or sorted(RULES)


def repetitive(df: DataFrame, id_col: str, text_col: str, share: float = SHARE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Ids of the texts of which at least ``share`` repeats, by the cascade.

    Null, empty and blank texts are no cases, rows with a null id none either; an id with several texts stands
    once. One narrow stage and a distinct over the found ids.
    """
    order = measured_order(df.select(text_col), share, sample_rows)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [repeats(x, order, share) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_()))], names=[id_col])

    found = df.select(id_col, text_col).where(df[id_col].isNotNull()).mapInArrow(run, f"`{id_col}` {kind}")
    return found.distinct()


def repetition_shares(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, n_words, repeated_share)`` for every row; share 0 for null, empty and blank texts."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, s = [], []
            for x in b.column(1).to_pylist():
                t = Text(x)
                n.append(len(t.words))
                s.append(covered(t) / len(t.words) if t.words else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(s, pa.float64())], names=[id_col, "n_words", "repeated_share"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words int, repeated_share double")
