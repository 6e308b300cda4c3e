"""Keyed lookups as joins: selection, pending work, reuse, uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def record_id(ds_name: str = "ds_name", q_index: str = "q_index") -> Column:
    """``name`` and the index in at least three digits."""
    return F.concat(F.col(ds_name), F.lpad(F.col(q_index).cast("string"), F.greatest(F.lit(3), F.length(F.col(q_index).cast("string"))), F.lit("0")))


def select_questions(rows: DataFrame, q_index: int = -1, chosen: list[int] | None = None) -> DataFrame:
    """One question, all (-1), or a list (-2); an index and a list exclude each other."""
    if chosen and q_index != -2:
        raise ValueError("a list of questions needs q_index=-2")
    if q_index == -2:
        if not chosen:
            raise ValueError("q_index=-2 needs a list of questions")
        return rows.where(F.col("q_index").isin(chosen))
    return rows if q_index == -1 else rows.where(F.col("q_index") == q_index)


def with_targets(corpus: DataFrame, targets: DataFrame, key: list[str]) -> DataFrame:
    """Left join of a splitter's sentences; an empty list where there are none. One list a key: the longest, ties in order."""
    one = targets.groupBy(*key).agg(F.max_by("target_sentences", F.struct(F.size("target_sentences"), "target_sentences")).alias("target_sentences"))
    return corpus.join(one, key, "left").withColumn("target_sentences", F.coalesce("target_sentences", F.array().cast("array<string>")))


def pending(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(*key).distinct(), key, "left_anti")


def already_done(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(done.select(*key).distinct(), key, "left_semi")


def unique_lookup(rows: DataFrame, table: DataFrame, key: list[str], value: str, required: bool = False) -> DataFrame:
    """Left join of a table that must hold each key once; several values for a key are an error, none give null or, where ``required``, are an error too."""
    n = F.count_distinct(value)
    named = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    one = table.groupBy(*key).agg(F.when(n > 1, F.raise_error(F.concat(F.lit("several values for "), named))).otherwise(F.lit(0)).alias("_n"), F.first(value, ignorenulls=True).alias(value))
    kind = table.schema[value].dataType
    out = rows.join(one.withColumn(value, F.when(F.col("_n") == 0, F.col(value))).drop("_n"), key, "left")
    return out.withColumn(value, F.coalesce(value, F.raise_error(F.concat(F.lit(f"no {value} for "), named)).cast(kind))) if required else out


def for_each(rows: DataFrame, dimension: DataFrame, name: str) -> DataFrame:
    """Each row once for every distinct value of a column of a dimension table, which is a fixed list (models, datasets): an explode where the rows lie. Null values count nothing."""
    values = sorted(r[0] for r in dimension.select(name).where(F.col(name).isNotNull()).distinct().collect())
    kind = dimension.schema[name].dataType
    return rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values]) if values else F.array().cast(T.ArrayType(kind))))


def duplicates(offsets: Column) -> Column:
    return F.size(offsets) != F.size(F.array_distinct(offsets))


def is_sorted(offsets: Column) -> Column:
    return offsets == F.array_sort(offsets)


def require_parts(result: DataFrame, names: list[str]) -> DataFrame:
    """The contract of a stage: its columns must be there."""
    missing = [n for n in names if n not in result.columns]
    if missing:
        raise ValueError(f"the stage gives no {', '.join(missing)}")
    return result
