"""Alignment of sentence ends with token offsets, with self-correction; the one Python boundary for a tokenizer.

Tokenizers and splitters are duck-typed: ``encode(text) -> list`` and ``decode(tokens) -> str``; ``split(text) -> list[str]``.
They are made once a task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.functions.text import SENTENCE_PATTERN, TOKEN_PATTERN
from longspan.operators.report import distances, quality
from longspan.sources.tables import slices

TOLERANCE = 30


class Tokenizer(Protocol):
    def encode(self, text: str) -> list: ...

    def decode(self, ids: list) -> str: ...


class WordTokenizer:
    """The default: words with the blanks before them, and the blanks at the end."""

    _rx = re.compile(TOKEN_PATTERN + r"|[ \t\n\r\f]+$")

    def encode(self, text: str) -> list[str]:
        return self._rx.findall(text)

    def decode(self, ids: list[str]) -> str:
        return "".join(ids)

    def counter(self) -> _WordCounter:
        return _WordCounter()


class _WordCounter:
    """Tokens of a text that grows, without encoding it anew."""

    def __init__(self) -> None:
        self.runs, self.open, self.blank = 0, False, False

    def add(self, more: str) -> int:
        if more:
            words = re.findall(r"[^ \t\n\r\f]+", more)
            self.runs += len(words) - (self.open and bool(words) and more[0] not in " \t\n\r\f")
            self.open = more[-1] not in " \t\n\r\f"
            self.blank = not self.open
        return self.runs + self.blank


class FixedTokenizer:
    """Pieces of a fixed width, which do not end where sentences end: it exercises the self-correction."""

    def __init__(self, width: int = 4) -> None:
        self.width = width

    def encode(self, text: str) -> list[str]:
        return [text[i : i + self.width] for i in range(0, len(text), self.width)]

    def decode(self, ids: list[str]) -> str:
        return "".join(ids)


class _EncodingCounter:
    """For tokenizers that need not be stable under a longer text: the whole text so far is encoded each time."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer, self.text = tokenizer, ""

    def add(self, more: str) -> int:
        self.text += more
        return len(self.tokenizer.encode(self.text))


class _PieceCounter:
    """Tokens of a text that grows, for vocabularies that split it by a pattern first: further text changes none but the last two pieces, so only they are encoded anew."""

    def __init__(self, encode: Callable[[str], list], pattern: str) -> None:
        import regex

        self.encode, self.pattern = encode, regex.compile(pattern)
        self.done, self.tail = 0, ""

    def add(self, more: str) -> int:
        self.tail += more
        pieces = list(self.pattern.finditer(self.tail))
        if len(pieces) > 2:
            self.done += sum(len(self.encode(p[0])) for p in pieces[:-2])  # each alone: white space is split by what follows it
            self.tail = self.tail[pieces[-2].start() :]
        return self.done + len(self.encode(self.tail))


class BytePairTokenizer:
    """A public byte-level vocabulary file."""

    def __init__(self, path: str, pattern: str) -> None:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self._own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._pattern = pattern

    def encode(self, text: str) -> list[int]:
        return self._own.encode_ordinary(text)

    def counter(self) -> _PieceCounter:
        return _PieceCounter(self.encode, self._pattern)

    def decode(self, ids: list[int]) -> str:
        return self._own.decode(ids)


def split_sentences(text: str | None) -> list[str]:
    """The default splitter, as the SQL expression of the same name does it."""
    return [s for x in re.findall(SENTENCE_PATTERN, text or "") if (s := x.strip(" \n\t\r"))]


def _clean(sentence: str) -> str:
    return sentence.replace(" .", ".").replace(" ,", ",")


def settle(seen: Callable[[int], str], target: str, first: int, n_tokens: int, tolerance: int) -> int:
    """The end offset near ``first`` at which the decoded text is the target.

    Steps back while the target lies inside the decoded text and forward while it does not; what circles,
    leaves the text or strays further than the tolerance falls back to ``first``.
    """
    at, been = first, set()
    while at not in been and at <= n_tokens and abs(at - first) <= tolerance:
        been.add(at)
        decoded = seen(at)
        if decoded == target:
            return at
        at += -1 if target in decoded else 1
    return first


def align(context: str, sentences: list[str | None], tokenizer: Tokenizer, tolerance: int = TOLERANCE) -> dict:
    """Offsets of the ends of all non-empty sentences in the tokens of the context, and how well they decode.

    A tokenizer with a ``counter`` tells the tokens of the growing text as it goes; for any other the text so far is encoded
    anew for each sentence, since it need not be stable under a longer text. The last offset is the end of the
    text, and offsets never fall. Without sentences the one offset is 0.
    """
    ids = tokenizer.encode(context)
    wanted = [s for s in sentences if s]
    counter = tokenizer.counter() if hasattr(tokenizer, "counter") else _EncodingCounter(tokenizer)
    offsets, decoded_all = [0], []
    at = 0
    for i, target in enumerate(wanted):
        more = target
        at += len(target)
        if i + 1 < len(wanted):
            stop = context.find(wanted[i + 1][0], at)
            between = context[at : stop if stop >= 0 else len(context)]
            more += between
            at += len(between)
        first = counter.add(more)
        last = offsets[-1]
        goal = _clean(target)
        decoded = tokenizer.decode(ids[last:first]).strip(" \n")
        if decoded and goal not in decoded:
            cut = goal.find(decoded[0])
            goal = goal[cut:] if cut >= 0 else ""

        def seen(at: int, last: int = last) -> str:
            return tokenizer.decode(ids[last:at]).strip(" \n\t").strip()

        end = max(last, settle(seen, goal, first, len(ids), tolerance))
        decoded_all.append(seen(end))
        offsets.append(end)
    if wanted:
        offsets = [min(x, len(ids)) for x in offsets[:-1]] + [len(ids)]
    good = sum(tokenizer.decode(ids[a:b]).strip(" \n\t") == _clean(s) for a, b, s in zip(offsets, offsets[1:], wanted, strict=False))
    return {
        "n_tokens": len(ids),
        "sentence_quant_indices": offsets,
        "target_sentences": wanted,
        "sentences": decoded_all,
        "n_sentence": len(wanted),
        "n_sentence_quant_success": good,
    }


FIELDS = {
    "n_tokens": pa.int32(),
    "sentence_quant_indices": pa.list_(pa.int32()),
    "target_sentences": pa.list_(pa.string()),
    "sentences": pa.list_(pa.string()),
    "n_sentence": pa.int32(),
    "n_sentence_quant_success": pa.int32(),
}


def align_corpus(rows: DataFrame, key: list[str], make_tokenizer: Callable[[], Tokenizer] = WordTokenizer, tolerance: int = TOLERANCE, with_tokens: bool = False) -> DataFrame:
    """Alignment record of each row with ``context`` and ``target_sentences``, plus success rate and edit distances.

    Null contexts have no tokens; null or empty sentence lists give the one offset 0 and a rate of 0. Narrow:
    each row is aligned where it lies. With ``with_tokens`` the tokens themselves come along, as texts.
    """
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = make_tokenizer()
        for b in slices(batches):
            n = len(key)
            texts = b.column(n).to_pylist()
            found = [align(c or "", s or [], tokenizer, tolerance) for c, s in zip(texts, b.column(n + 1).to_pylist(), strict=True)]
            cols = [*[b.column(i) for i in range(n)], *[pa.array([x[f] for x in found], t) for f, t in FIELDS.items()]]
            if with_tokens:
                cols.append(pa.array([[t if isinstance(t, str) else tokenizer.decode([t]) for t in tokenizer.encode(c or "")] for c in texts], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(cols, names=[*key, *FIELDS, *["tokens"] * with_tokens])

    ddl = f"{kinds}, n_tokens int, sentence_quant_indices array<int>, target_sentences array<string>, sentences array<string>, n_sentence int, n_sentence_quant_success int" + ", tokens array<string>" * with_tokens
    aligned = rows.select(*key, "context", "target_sentences").mapInArrow(run, ddl)
    return with_quality(aligned)


def with_quality(aligned: DataFrame) -> DataFrame:
    """Adds ``success_rate``, ``mean_dist`` and ``non_zero_mean_dist``."""
    mean, non_zero = quality(F.col("_d"))
    rate = F.when(F.col("n_sentence") > 0, F.bround(100.0 * F.col("n_sentence_quant_success") / F.col("n_sentence"), 2)).otherwise(F.lit(0.0))
    measured = aligned.withColumn("_d", distances(F.col("target_sentences"), F.col("sentences")))
    return measured.withColumns({"success_rate": rate, "mean_dist": mean, "non_zero_mean_dist": non_zero}).drop("_d")
