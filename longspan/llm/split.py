"""Splitting contexts that are longer than a model's window at sentence ends, with overlap."""

from __future__ import annotations

import os
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.llm.encode import TOKENIZERS, Pieces, cut_table, load_ranks, pieces_of
from longspan.llm.sentences import Model, units


def clean_bounds(bounds: list[int | None] | None, n_tokens: int | None) -> list[int]:
    """Sorted offsets from 0 to the end; nulls and offsets outside are left out."""
    kept = sorted({b for b in (bounds or []) if b is not None and b >= 0 and (n_tokens is None or b <= n_tokens)})
    end = n_tokens if n_tokens is not None and n_tokens > 0 else (kept[-1] if kept else 0)
    if end <= 0:
        return []
    return sorted({0, end, *(b for b in kept if b <= end)})


def cut_pieces(bounds: list[int], window: int, overlap: int) -> list[tuple[int, int, bool, bool]]:
    """Pieces ``(left, right, hard_left, hard_right)`` of at most ``window`` tokens that cover ``bounds[0]..bounds[-1]``.

    Each piece ends at the last boundary within the window, found by binary search; where a sentence alone is
    longer, it is cut inside (hard). The next piece begins exactly ``overlap`` tokens before that end, so
    neighbours share that many tokens; a cut must go on beyond the overlap.
    """
    if not bounds or window <= 0:
        return []
    overlap = max(0, min(overlap, window - 1))
    at = set(bounds)
    left, end, out = bounds[0], bounds[-1], []
    hard_left = False
    while True:
        limit = left + window
        if limit >= end:
            out.append((left, end, hard_left, False))
            return out
        right = bounds[bisect_right(bounds, limit) - 1]
        hard = right <= left + overlap
        if hard:
            right = limit
            hard = right not in at
        out.append((left, right, hard_left, hard))
        left = right - overlap
        hard_left = left not in at


def oversize(bounds: list[int | None], window: int) -> list[tuple[int, int, int]]:
    """(left, right, position) of each sentence that alone spans more than the window; its position is that of its left entry, nulls counted."""
    own = [(b, i) for i, b in enumerate(bounds) if b is not None]
    return [(a, b, i) for (a, i), (b, _) in zip(own, own[1:], strict=False) if b - a > window]


def split_items(alignments: DataFrame, models: DataFrame) -> DataFrame:
    """``(ds_name, q_index, model_name, piece, left, right, hard_left, hard_right, oversize_sentences)`` of each record longer than its model's window.

    ``piece`` counts from 0. ``oversize_sentences`` names the sentences that alone span more tokens than
    the window and that this piece holds a part of, by the 0-based position of their first entry in ``sentence_quant_indices`` (a null entry keeps its position and
    bounds nothing). Records whose keys, model or boundaries are null, without an entry in ``models`` or with no tokens
    have no pieces; repeated records (same key, same boundaries) count once, while records of one key that
    differ in their boundaries each have theirs. Boundaries are taken in order; zero-length sentences and
    one-entry arrays are allowed. Records are split where they lie: one shuffle, on the key, drops repeats;
    ``models`` is a dimension of a few rows and joins by the optimizer's own choice.
    """
    limits = models.select("model_name", "window_tokens", "overlap_tokens").where("model_name is not null and window_tokens > 0").distinct()
    src = (
        alignments.select("ds_name", "q_index", "model_name", "sentence_quant_indices", "n_tokens")
        .where("ds_name is not null and q_index is not null and model_name is not null")
        .join(limits, "model_name")
        .where(F.greatest(F.coalesce("n_tokens", F.lit(0)), F.coalesce(F.array_max("sentence_quant_indices"), F.lit(0))) > F.col("window_tokens"))
        .distinct()
        .select("ds_name", "q_index", "model_name", "sentence_quant_indices", "n_tokens", "window_tokens", "overlap_tokens")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for ds, q, model, idx, n, window, overlap in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                large = sorted(oversize(idx or [], window))
                at = 0
                for k, (left, right, hl, hr) in enumerate(cut_pieces(clean_bounds(idx, n), window, overlap or 0)):
                    while at < len(large) and large[at][1] <= left:  # both go on in order, so each sentence is met by its own pieces only
                        at += 1
                    last = at
                    while last < len(large) and large[last][0] < right:
                        last += 1
                    rows.append((ds, q, model, k, left, right, hl, hr, [i for _, b, i in large[at:last] if left < b]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["ds_name", "q_index", "model_name", "piece", "left", "right", "hard_left", "hard_right", "oversize_sentences"])

    return src.mapInArrow(run, "ds_name string, q_index int, model_name string, piece int, left int, right int, hard_left boolean, hard_right boolean, oversize_sentences array<int>")


def oversize_sentences(pieces: DataFrame) -> DataFrame:
    """``(ds_name, q_index, model_name, sent_index)``: sentences that the split had to cut inside."""
    return pieces.select("ds_name", "q_index", "model_name", F.explode("oversize_sentences").alias("sent_index")).distinct()


class TextCutter:
    """Cuts texts by the tokens of a byte-level vocabulary, at sentence ends where possible."""

    def __init__(self, vocabulary: str, model: Model) -> None:
        ranks = load_ranks(vocabulary)
        self.table, self.known, self.model = cut_table(ranks), Pieces(ranks), model
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)

    def cut(self, text: str | None, window: int, overlap: int) -> list[tuple[int, int, int, bool, bool]]:
        """``(start_char, end_char, n_tokens, hard_left, hard_right)``; a text within the window is one piece, a null or empty one none.

        Token ends are prefix sums of the tokens' bytes; a sentence end is the first token end at or behind it.
        """
        if not text:
            return []
        data = text.encode("utf-8", "replace")
        ids = np.frombuffer(b"".join(self.known[p] for p in pieces_of(data, self.table)), "<i4")
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        raw = np.frombuffer(data, np.uint8)
        starts = np.flatnonzero((raw & 0xC0) != 0x80)  # bytes that begin a character
        at = [int(starts[b]) if b < len(starts) else len(data) for _, b in units(text, self.model)]
        bounds = sorted({0, len(ids), *np.searchsorted(ends, at).tolist()})
        out = []
        for left, right, hl, hr in cut_pieces(bounds, window, overlap):
            a, b = (int(np.searchsorted(starts, ends[x], "right")) - (1 if ends[x] < len(data) else 0) for x in (left, right))
            out.append((a, b, right - left, hl, hr))
        return out


def split_texts(rows: DataFrame, key: list[str], text_col: str, window: int, overlap: int, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS, model: Model | None = None) -> DataFrame:
    """``key..., piece, start_char, end_char, n_tokens, hard_left, hard_right, text`` of every text, in pieces of at most ``window`` tokens.

    A cut inside a character moves back to its beginning. Null and empty texts have no piece, repeated rows repeat
    theirs. One narrow stage.
    """
    if window <= 0:
        raise ValueError("window must be positive")
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)
    own = model or Model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = TextCutter(os.path.join(folder, vocabulary), own)
        for b in batches:
            texts = b.column(len(key)).to_pylist()
            found = [(i, k, *p, texts[i][p[0] : p[1]]) for i, t in enumerate(texts) for k, p in enumerate(cutter.cut(t, window, overlap))]
            cols = list(zip(*found, strict=True)) if found else [[]] * 8
            types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string())
            index = pa.array(cols[0], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(j).take(index) for j in range(len(key))], *[pa.array(c, t) for c, t in zip(cols[1:], types, strict=True)]],
                names=[*key, "piece", "start_char", "end_char", "n_tokens", "hard_left", "hard_right", "text"],
            )

    return rows.select(*key, text_col).mapInArrow(run, f"{kinds}, piece int, start_char int, end_char int, n_tokens int, hard_left boolean, hard_right boolean, text string")
