"""Retrieval of sentences within a token budget, merging of adjacent survivors, and nearest vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspan.functions.stats import aggregate_score, cosine_distance, normal_cdf
from longspan.sources.tables import materialise


def score_slices(spans: DataFrame, vectors: DataFrame, key: list[str], how: str = "gmean", per: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Scores each span ``[left, right)`` by its slice of its key's reaction vector; empty slices score 0.

    ``per`` names columns that tell several vectors of a key apart: a span then has one row for each. ``digits`` rounds the scores, so that what differs only by the
    order of a sum ties. The spans of a key are those of one text: they meet the vector as one row, and the slices are taken inside it, so a vector is
    never copied to its spans.
    """
    own = [c for c in spans.columns if c not in key]
    together = spans.groupBy(*key).agg(F.collect_list(F.struct(*own)).alias("_spans"))
    joined = together.join(vectors.select(*key, *(per or []), "reaction"), key)

    def scored(s: Column) -> Column:
        score = aggregate_score(F.slice("reaction", s["left"] + 1, F.greatest(s["right"] - s["left"], F.lit(0))), how)
        return F.struct(*[s[c].alias(c) for c in own], (F.round(score, digits) if digits is not None else score).alias("score"))

    return joined.select(*key, *(per or []), F.inline(F.transform("_spans", scored)))


def with_scores(spans: DataFrame, scores: DataFrame, key: list[str], per: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Gives each span of a key the score at its ``sent_index``, a row for each value of ``per``; the spans of a key meet the scores as one row."""
    own = [c for c in spans.columns if c not in key]
    together = spans.groupBy(*key).agg(F.collect_list(F.struct(*own)).alias("_spans"))
    joined = together.join(scores.select(*key, *(per or []), "scores"), key)

    def scored(s: Column) -> Column:
        score = F.get("scores", s["sent_index"])
        return F.struct(*[s[c].alias(c) for c in own], (F.round(score, digits) if digits is not None else score).alias("score"))

    return joined.select(*key, *(per or []), F.inline(F.transform("_spans", scored)))


def rank_and_cut(
    spans: DataFrame,
    key: list[str],
    budget: Column | int,
    compression_ratio: float | None = None,
    concat_len: int = 0,
    order: str = "sent_index",
) -> DataFrame:
    """Adds ``rank``, ``cum_tokens``, ``n_cap`` and ``picked`` to spans with ``score`` and ``ntokens``.

    Ranks by score, ties in document order. Picked are the first ranks whose running tokens stay strictly below
    the budget; with a ratio also at most ``floor(sentences / ratio)``, and the budget is lessened by what joining
    as many pieces costs. NaN and null scores count as 0. One shuffle on the key, which the ranking, the running sum and the count share.
    """
    score = F.when(F.col("score").isNull() | F.isnan("score"), F.lit(0.0)).otherwise(F.col("score"))
    by_key = Window.partitionBy(*key)
    ranked = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc(order))
    out = spans.withColumn("score", score).withColumn("rank", F.row_number().over(ranked) - 1).withColumn("cum_tokens", F.sum("ntokens").over(ranked.rowsBetween(Window.unboundedPreceding, 0)))
    limit = F.lit(budget) if isinstance(budget, int) else budget
    if compression_ratio is None:
        return out.withColumn("n_cap", F.count("*").over(by_key)).withColumn("picked", F.col("cum_tokens") < limit)
    out = out.withColumn("n_cap", F.floor(F.count("*").over(by_key) / F.lit(float(compression_ratio))))
    return out.withColumn("picked", (F.col("cum_tokens") < limit - concat_len * F.col("n_cap")) & (F.col("rank") < F.col("n_cap")))


def score_distribution(spans: DataFrame, key: list[str]) -> DataFrame:
    """Adds population ``mean``, ``std`` (both 0 where all scores sum to 0) and the normal ``cdf`` of each score."""
    w = Window.partitionBy(*key)
    zero = F.sum("score").over(w) == 0
    out = spans.withColumn("mean", F.when(zero, 0.0).otherwise(F.avg("score").over(w))).withColumn("std", F.when(zero, 0.0).otherwise(F.stddev_pop("score").over(w)))
    return out.withColumn("cdf", normal_cdf(F.col("score"), F.col("mean"), F.col("std")))


def compression(cut: DataFrame, key: list[str]) -> DataFrame:
    """Tokens before and after retrieval and their ratio; infinite where nothing was picked."""
    got = F.coalesce(F.sum(F.when(F.col("picked"), F.col("ntokens"))), F.lit(0))
    out = cut.groupBy(*key).agg(F.sum("ntokens").alias("ntokens"), got.alias("retrieved_ntokens"), F.count(F.when(F.col("picked"), 1)).alias("n_picked"))
    return out.withColumn("compression_rate", F.when(F.col("retrieved_ntokens") > 0, F.col("ntokens") / F.col("retrieved_ntokens")).otherwise(F.lit(float("inf"))))


def merge_adjacent(picked: DataFrame, key: list[str], text: str = "sentence", compat_last_join: bool = False) -> DataFrame:
    """Stitches spans that touch: one row a run, with its text.

    Spans are taken by (left, right). A span that begins where the one before ends goes on its run; one that overlaps only
    widens it (its text is dropped); a gap begins a new run. Texts of a run are joined by a blank; with ``compat_last_join``
    those of the last run of a key are joined by nothing.
    """
    w = Window.partitionBy(*key).orderBy("left", "right", text)
    before = F.max("right").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = picked.withColumn("_before", before).withColumn("_new", (F.col("_before").isNull() | (F.col("left") > F.col("_before"))).cast("int"))
    runs = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    kept = F.when((F.col("left") == F.col("_before")) | (F.col("_new") == 1), F.struct("left", "right", F.col(text).alias("t")))
    texts = F.transform(F.array_sort(F.collect_list(kept)), lambda s: s["t"])
    out = runs.groupBy(*key, "run").agg(F.min("left").alias("left"), F.max("right").alias("right"), texts.alias("_t"))
    joined = F.array_join("_t", " ")
    if compat_last_join:
        last = F.max("run").over(Window.partitionBy(*key))
        out = out.withColumn("_last", last)
        joined = F.when(F.col("run") == F.col("_last"), F.array_join("_t", "")).otherwise(joined)
    return out.withColumn(text, joined).select(*key, "run", "left", "right", text)


def nearest(queries: DataFrame, items: DataFrame, k: int, query_id: str, item_id: str, vector: str, chunk: int = 20_000, block: int = 64) -> DataFrame:
    """``(query_id, item_id, distance, rank)`` of the ``k`` items of least cosine distance to each query vector; ties by item id.

    The queries stream through the driver ``chunk`` at a time; each chunk is set against all items where they lie, ``block``
    queries at once, each task keeping its own best ``k`` per query, and only those are shuffled. With more
    chunks than one each pass is written to the shared folder. A query meets the items of its own length; vectors that are null or of no
    length match nothing; repeated queries count once. A query id of the same name as the item's gets ``query_`` before it.
    """
    kq, ki = queries.schema[query_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    named = query_id if query_id != item_id else f"query_{query_id}"
    source = queries.select(query_id, vector).where(F.col(vector).isNotNull() & (F.size(vector) > 0)).distinct().toLocalIterator()
    passes: list[DataFrame] = []
    while part := list(islice(source, chunk)):
        found = _one_pass(sorted((r[0], r[1]) for r in part), items.select(item_id, vector), k, block)
        top = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "i"))).where(F.col("rank") <= k)
        top = top.select(F.col("q").cast(kq).alias(named), F.col("i").cast(ki).alias(item_id), "distance", "rank")
        passes.append(materialise(top, "nearest") if passes or len(part) == chunk else top)
    if not passes:
        return items.sparkSession.createDataFrame([], f"`{named}` {kq}, `{item_id}` {ki}, distance double, rank int")
    return reduce(DataFrame.unionByName, passes)


def _one_pass(queries: list[tuple[int, list[float]]], items: DataFrame, k: int, block: int) -> DataFrame:
    by_length: dict[int, list[tuple[int, list[float]]]] = {}
    for i, v in queries:
        by_length.setdefault(len(v), []).append((i, v))
    asked = {n: ([i for i, _ in own], np.array([v for _, v in own], dtype=np.float64)) for n, own in by_length.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = {n: np.linalg.norm(mat, axis=1) for n, (_, mat) in asked.items()}
        best: dict[int, list[list[tuple[float, int]]]] = {n: [[] for _ in ids] for n, (ids, _) in asked.items()}
        for b in batches:
            given: dict[int, list[tuple[int, list[float]]]] = {}
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if v is not None and len(v) in asked and any(v):
                    given.setdefault(len(v), []).append((i, v))
            for n, rows in given.items():
                ids, mat = asked[n]
                x = np.array([v for _, v in rows], dtype=np.float64)
                xn = np.linalg.norm(x, axis=1)
                for lo in range(0, len(ids), block):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        dist = 1 - (mat[lo : lo + block] @ x.T) / (norms[n][lo : lo + block, None] * xn[None])
                    cut = np.partition(dist, min(k, len(rows)) - 1, axis=1)[:, min(k, len(rows)) - 1]
                    for a, row in enumerate(dist):
                        near = [(float(row[j]), rows[j][0]) for j in np.flatnonzero(row <= cut[a])]
                        best[n][lo + a] = sorted(best[n][lo + a] + near)[:k]
        out = [(asked[n][0][a], i, d) for n, own in best.items() for a, found in enumerate(own) for d, i in found]
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["q", "i", "distance"])

    return items.mapInArrow(run, "q bigint, i bigint, distance double")


def nearest_to_one(items: DataFrame, query: Column, k: int, item_id: str, vector: str) -> DataFrame:
    """The ``k`` items of least cosine distance to one vector, as expressions."""
    return items.select(item_id, cosine_distance(F.col(vector), query).alias("distance")).orderBy("distance", item_id).limit(k)
