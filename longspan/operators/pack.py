"""Windows over sentence offsets: intervals, quantised intervals, packing into roots, and the two-level graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def intervals(offsets: Column) -> Column:
    """``array<struct<left,right>>`` of neighbouring offsets."""
    n = F.greatest(F.size(offsets) - 1, F.lit(0))
    return F.zip_with(F.slice(offsets, 1, n), F.slice(offsets, 2, n), lambda a, b: F.struct(a.alias("left"), b.alias("right")))


def quantize_enclosing(left: Column, right: Column, offsets: Column) -> Column:
    """Smallest interval of sentence offsets that holds ``[left, right)``."""
    return F.struct(F.array_max(F.filter(offsets, lambda x: x <= left)).alias("left"), F.array_min(F.filter(offsets, lambda x: x >= right)).alias("right"))


def quantize_naive(left: Column, right: Column, end: Column, step: int) -> Column:
    """Both ends down to a multiple of ``step``, but an end at the end of the text stays."""
    if step <= 0:
        raise ValueError("step must be positive")
    return F.struct((F.floor(left / step) * step).cast("int").alias("left"), F.when(right == end, right).otherwise((F.floor(right / step) * step).cast("int")).alias("right"))


def root_windows(offsets: Column, max_len: Column) -> Column:
    """Roots ``array<struct<left,right>>`` that pack sentences greedily into windows of at most ``max_len`` tokens.

    A sentence longer than the window becomes a root of its own. A fold inside the row: no shuffle, no Python.
    """
    root = "struct<left:int,right:int>"
    start = F.element_at(offsets, 1).cast("int")
    init = F.struct(start.alias("root"), start.alias("prev"), F.array().cast(f"array<{root}>").alias("roots"))

    def step(acc: Column, right: Column) -> Column:
        full = (right - acc["root"] > max_len) & (acc["prev"] > acc["root"])
        closed = F.array(F.struct(acc["root"].alias("left"), acc["prev"].alias("right")))
        return F.struct(F.when(full, acc["prev"]).otherwise(acc["root"]).alias("root"), right.cast("int").alias("prev"), F.when(full, F.concat(acc["roots"], closed)).otherwise(acc["roots"]).alias("roots"))

    def last(acc: Column) -> Column:
        return F.when(acc["prev"] > acc["root"], F.concat(acc["roots"], F.array(F.struct(acc["root"].alias("left"), acc["prev"].alias("right"))))).otherwise(acc["roots"])

    packed = F.aggregate(F.slice(offsets, 2, F.greatest(F.size(offsets) - 1, F.lit(0))), init, step, last)
    return F.when(F.size(offsets) > 1, packed).otherwise(F.array().cast(f"array<{root}>"))


def with_roots(alignments: DataFrame, models: DataFrame, policy: str = "split") -> DataFrame:
    """Adds ``max_root_len`` and ``roots`` to alignment records; ``policy`` is ``split`` or ``no_split`` (one root).

    The window is the model's, less the offset that it keeps for the query.
    """
    if policy not in ("split", "no_split"):
        raise ValueError(f"no policy named {policy!r}")
    limit = models.select("model_name", (F.col("window_tokens") - F.col("root_split_offset")).alias("max_root_len"))
    rows = alignments.join(limit, "model_name")
    if policy == "no_split":
        one = F.array(F.struct(F.element_at("sentence_quant_indices", 1).alias("left"), F.element_at("sentence_quant_indices", -1).alias("right")))
        return rows.withColumn("roots", F.when(F.size("sentence_quant_indices") > 1, one))
    return rows.withColumn("roots", root_windows(F.col("sentence_quant_indices"), F.col("max_root_len")))


def root_rows(packed: DataFrame, key: list[str]) -> DataFrame:
    """One row a root, with ``oversize`` where a lone sentence is longer than the window."""
    one = packed.select(*key, "max_root_len", F.posexplode("roots").alias("root_index", "r"))
    return one.select(*key, "root_index", F.col("r.left").alias("left"), F.col("r.right").alias("right"), (F.col("r.right") - F.col("r.left") > F.col("max_root_len")).alias("oversize"))


def leaf_rows(packed: DataFrame, key: list[str]) -> DataFrame:
    """One row a sentence with the root that contains its left end; a zero-length sentence at the end goes to the last root."""
    one = packed.select(*key, "roots", F.posexplode(intervals(F.col("sentence_quant_indices"))).alias("sent_index", "s"))
    inside = F.filter("roots", lambda r: (r["left"] <= F.col("s.left")) & (F.col("s.left") < r["right"]))
    parent = F.coalesce(F.get(inside, F.lit(0)), F.when(F.size("roots") > 0, F.element_at("roots", -1)))
    return one.withColumn("p", parent).select(*key, "sent_index", F.col("s.left").alias("left"), F.col("s.right").alias("right"), F.col("p.left").alias("parent_left"), F.col("p.right").alias("parent_right"))


def graph(packed: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of the two-level graph: roots at level -1, sentences at level 0."""
    roots = root_rows(packed, key).select(*key, "left", "right", F.lit(-1).alias("hierarchy_index"), F.lit(-1).alias("sent_index"))
    leaves = leaf_rows(packed, key)
    nodes = roots.unionByName(leaves.select(*key, "left", "right", F.lit(0).alias("hierarchy_index"), "sent_index"))
    return nodes, leaves.where("parent_left is not null").select(*key, "parent_left", "parent_right", F.col("left").alias("child_left"), F.col("right").alias("child_right"), "sent_index")
