"""Attention providers and reaction vectors: how much a question changes the attention on each token of a window.

A provider is duck-typed: ``attend(window: list[str], query: list[str]) -> list[float]``, one value for each token
of the window. The default needs no model. Providers are made once a task; a bounded cache lets the pass with
and the pass without the question share what they compute for a window.
"""

from __future__ import annotations

import json
import math
from collections import OrderedDict
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.sources.tables import slices

#: File that tells that a folder of states is complete.
MARK = "complete.txt"
#: Windows whose state a provider keeps, first in first out.
CACHE_ENTRIES = 10
BLANKS = " \t\n\r\f"
#: Vectors that a provider keeps before it begins anew.
KNOWN_TOKENS = 100_000
#: Tokens at its left end that a window is kept by: windows that begin alike share a state.
FIRST = 16


class Provider(Protocol):
    def attend(self, window: list[str], query: list[str]) -> list[float]: ...


class WindowCache:
    """Bounded cache of window states by key.

    A state is known by the window that it was made of: the same window returns it as it is; a shorter one that it begins with is cut from it;
    a longer one that begins with its window is extended; otherwise the state is made anew.
    """

    def __init__(self, make: Callable[[list[str]], np.ndarray], extend: Callable[[np.ndarray, list[str]], np.ndarray] | None = None, entries: int = CACHE_ENTRIES) -> None:
        self.make, self.extend, self.entries = make, extend, entries
        self.kept: OrderedDict[tuple, tuple[list[str], np.ndarray]] = OrderedDict()
        self.hits = {"exact": 0, "cut": 0, "extended": 0, "made": 0}

    def get(self, key: tuple, window: list[str]) -> np.ndarray:
        own, state = self.kept.get(key, ([], None))
        n = len(window)
        if state is not None and own == window:
            self.hits["exact"] += 1
            return state
        if state is not None and own[:n] == window:
            self.hits["cut"] += 1
            return state[:n]
        if state is not None and self.extend and window[: len(own)] == own:
            self.hits["extended"] += 1
            state = self.extend(state, window)
        else:
            self.hits["made"] += 1
            state = self.make(window)
        self.kept[key] = (list(window), state)
        self.kept.move_to_end(key)
        while len(self.kept) > self.entries:
            self.kept.popitem(last=False)
        return state

    def save(self, folder: str) -> None:
        """Writes the kept states; a folder that is already complete is left alone, and the mark comes last."""
        root = Path(folder)
        if (root / MARK).exists():
            return
        root.mkdir(parents=True, exist_ok=True)
        for i, (key, (window, state)) in enumerate(self.kept.items()):
            np.savez(root / f"{i}.npz", key=np.array(json.dumps(key)), window=np.array(json.dumps(window)), state=state)
        (root / MARK).touch()

    def load(self, folder: str) -> bool:
        """Reads states back; False where the folder is not complete."""
        root = Path(folder)
        if not (root / MARK).exists():
            return False
        for f in sorted(root.glob("*.npz"), key=lambda f: int(f.stem)):
            with np.load(f) as z:
                self.kept[tuple(json.loads(str(z["key"])))] = (json.loads(str(z["window"])), z["state"])
        return True


def in_blocks(make: Callable[[list[str]], np.ndarray], size: int) -> Callable[[list[str]], np.ndarray]:
    """Makes the state of a window block by block, so that no more than ``size`` tokens are worked on at once."""
    if size <= 0:
        raise ValueError("size must be positive")

    def run(window: list[str]) -> np.ndarray:
        return np.concatenate([make(window[i : i + size]) for i in range(0, max(len(window), 1), size)])

    return run


class LexicalProvider:
    """Default: softmax over positions of hashed-embedding similarity to the mean of the query; deterministic and offline."""

    def __init__(self, width: int = 32, block: int = 1024) -> None:
        self.width = width
        self._row: dict[str, int] = {}
        self._vectors = np.zeros((1024, width))
        self.cache = WindowCache(in_blocks(self._embed, block), lambda s, w: np.concatenate([s, self._embed(w[len(s) :])]))

    def _hashed(self, token: str) -> np.ndarray:
        h = 1469598103934665603
        for c in token.strip().lower().strip(".,;:!?\"'()").encode():
            h = ((h ^ c) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
        return np.random.default_rng(h).standard_normal(self.width) / math.sqrt(self.width)

    def _place(self, token: str) -> int:
        """Row of the token's vector, made at its first use."""
        row = self._row.get(token)
        if row is None:
            row = self._row[token] = len(self._row)
            if row == len(self._vectors):
                self._vectors = np.concatenate([self._vectors, np.zeros_like(self._vectors)])
            self._vectors[row] = self._hashed(token)
        return row

    def _embed(self, window: list[str]) -> np.ndarray:
        if len(self._row) > KNOWN_TOKENS:
            self._row.clear()
        rows = list(map(self._row.get, window))
        if None in rows:
            rows = [self._place(t) for t in window]
        return self._vectors[np.array(rows, np.int64)]

    def attend(self, window: list[str], query: list[str]) -> list[float]:
        if not window:
            return []
        keys = self.cache.get(tuple(window[:FIRST]), window)
        q = self._embed(query or window[-1:]).mean(0)
        s = keys @ q * math.sqrt(self.width)
        e = np.exp(s - s.max())
        return (e / e.sum()).tolist()


class OverlapProvider:
    """Attention of two heads, one even over the window and one twice as strong on the tokens that the question holds, pooled to one value a token; without a question both are even.

    Plain enough to be computed in SQL, which the tests of whole plans need.
    """

    def __init__(self, how: str = "mean") -> None:
        self.how = how

    def attend(self, window: list[str], query: list[str]) -> list[float]:
        if not window:
            return []
        asked = {t.strip(BLANKS).lower() for t in query}
        weight = np.array([2.0 if t.strip(BLANKS).lower() in asked else 1.0 for t in window])
        heads = np.array([np.full(len(window), 1.0 / len(window)), weight / weight.sum()])
        return pool(heads[None, :, None, :], self.how).tolist()


def pool(attention: np.ndarray, how: str = "mean") -> np.ndarray:
    """Attention ``[batch, head, query, token]`` to one value a token."""
    if how not in ("mean", "sum"):
        raise ValueError(f"no pooling named {how!r}")
    return getattr(attention, how)(axis=(0, 1, 2))


def _attend(provider: Provider, window: list[str] | None, query: list[str] | None, roots: list[dict] | None) -> tuple[list[float], list[float]]:
    """Attention without and with the question; each root by itself, joined in root order."""
    w = window or []
    parts = [w] if roots is None else [w[x["left"] : x["right"]] for x in roots]
    if sum(map(len, parts)) != len(w):
        raise ValueError("roots do not cover the window")
    pairs = [(provider.attend(p, []), provider.attend(p, query or [])) for p in parts]
    return [x for p, _ in pairs for x in p], [x for _, p in pairs for x in p]


def attend_windows(windows: DataFrame, key: list[str], make_provider: Callable[[], Provider] = LexicalProvider) -> DataFrame:
    """``key..., before, after``: attention on each token of ``window`` without and with ``query`` (arrays of tokens); null windows count as empty.

    Where there is a column ``roots`` (``array<struct<left,right>>``, from 0 on), each root is attended to by itself and the vectors are joined in
    root order; roots that do not cover the window are an error, a null array takes the window as one root.
    """
    kinds = ", ".join(f"`{k}` {windows.schema[k].dataType.simpleString()}" for k in key)
    packed = "roots" in windows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make_provider()
        n = len(key)
        for b in slices(batches):
            roots = b.column(n + 2).to_pylist() if packed else [None] * b.num_rows
            found = [_attend(provider, w, q, r) for w, q, r in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), roots, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n)], *[pa.array([x[i] for x in found], pa.list_(pa.float64())) for i in (0, 1)]], names=[*key, "before", "after"])

    return windows.select(*key, "window", "query", *(["roots"] if packed else [])).mapInArrow(run, f"{kinds}, before array<double>, after array<double>")


def slice_scores(reaction: np.ndarray, offsets: list[int], how: str) -> np.ndarray:
    """Score of each slice between neighbouring offsets, as ``stats.aggregate_score`` gives it: 0 for empty slices and NaN."""
    if how not in ("gmean", "mean", "max", "min"):
        raise ValueError(f"no aggregation named {how!r}")
    at = np.clip(np.array(offsets, np.int64), 0, len(reaction))
    if (np.diff(at) < 0).any():
        raise ValueError("offsets fall")
    sizes = np.diff(at)
    out = np.zeros(len(sizes))
    full = np.flatnonzero(sizes)
    if len(full):
        values, starts = reaction[: at[-1]], at[full]
        with np.errstate(divide="ignore", invalid="ignore"):
            if how in ("max", "min"):
                out[full] = (np.maximum if how == "max" else np.minimum).reduceat(values, starts)
            elif how == "mean":
                out[full] = np.add.reduceat(values, starts) / sizes[full]
            else:
                out[full] = np.exp(np.add.reduceat(np.log(values), starts) / sizes[full])
    return np.nan_to_num(out, nan=0.0)


def score_windows(windows: DataFrame, key: list[str], make_provider: Callable[[], Provider] = LexicalProvider, how: str = "gmean") -> DataFrame:
    """``key..., scores``: one score for each sentence of ``sentence_quant_indices``, how the question changes the attention on its tokens.

    ``attend_windows``, ``check_vectors``, the reaction and its slices in one pass: the attention is made in Python, so what goes back is a number for each sentence
    and not two for each token.
    """
    kinds = ", ".join(f"`{k}` {windows.schema[k].dataType.simpleString()}" for k in key)
    packed = "roots" in windows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make_provider()
        n = len(key)
        for b in slices(batches):
            roots = b.column(n + 3).to_pylist() if packed else [None] * b.num_rows
            scores = []
            for w, q, o, r in zip(*(b.column(n + i).to_pylist() for i in range(3)), roots, strict=True):
                before, after = map(np.array, _attend(provider, w, q, r))
                if len(before) != len(after) or (len(before) and not before.any()):
                    raise ValueError(BAD_VECTORS)
                scores.append(slice_scores(np.abs(after - before), o or [0], how))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n)], pa.array(scores, pa.list_(pa.float64()))], names=[*key, "scores"])

    return windows.select(*key, "window", "query", "sentence_quant_indices", *(["roots"] if packed else [])).mapInArrow(run, f"{kinds}, scores array<double>")


#: What is said of vectors that are no attention.
BAD_VECTORS = "attention vectors differ in length or are zero"


def check_vectors(attended: DataFrame) -> DataFrame:
    """Fails on vectors of different length or an all-zero one before the question."""
    bad = (F.size("before") != F.size("after")) | ((F.size("before") > 0) & ~F.exists("before", lambda x: x != 0))
    return attended.withColumn("before", F.when(bad, F.raise_error(F.lit(BAD_VECTORS)).cast("array<double>")).otherwise(F.col("before")))
