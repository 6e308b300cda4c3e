"""Reports: describes, pivots, melts, macro means and throughput."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspan.functions.stats import gmean
from longspan.sources.tables import materialise

QUARTILES = (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))


#: How far around a quantile its exact value is sought, and the accuracy of the sketch that brackets it; groups up to SMALL rows are searched whole. A bracket is cut into so many PARTS, of which one or two are ranked.
BRACKET, ACCURACY, SMALL, PARTS = 0.01, 1_000, 2_000, 1_024


def describe(df: DataFrame, columns: list[str], by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """``by..., metric, count, mean, std, min, p25, p50, p75, max`` of numeric columns; std over n - 1, quartiles linear.

    The quartiles are exact without holding a group's values in one task: a sketch brackets each, the rows of the equal parts of a bracket are counted, and only the
    values of the part (or two) that holds the quartile are counted by value and ranked. The numbers are written once to the shared folder for these
    passes, so what they come from is computed once. ``exact=False`` takes the sketch itself.
    """
    by = by or []
    keys = [*by, "metric"]
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("m")).select(*by, "m.*")
    if exact:
        long = materialise(long, "described")
    bounds = [p for _, q in QUARTILES for p in (max(q - BRACKET, 0.0), q, min(q + BRACKET, 1.0))]
    stats = long.groupBy(*keys).agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.percentile_approx("v", bounds, ACCURACY).alias("_b"))
    out = [*keys, "count", "mean", "std", "min"]
    if not exact:
        return stats.select(*out, *[F.col("_b")[3 * i + 1].alias(name) for i, (name, _) in enumerate(QUARTILES)], "max")
    small = F.col("count") <= SMALL
    brackets = [
        F.struct(F.lit(i).alias("i"), (F.lit(q) * (F.col("count") - 1)).alias("pos"), F.when(small, F.col("min")).otherwise(F.col("_b")[3 * i]).alias("lo"), F.when(small, F.col("max")).otherwise(F.col("_b")[3 * i + 2]).alias("hi"))
        for i, (_, q) in enumerate(QUARTILES)
    ]
    want = stats.select(*[F.col(k).alias(f"_{k}") for k in keys], F.explode(F.array(*brackets)).alias("w")).select(*[f"_{k}" for k in keys], "w.*")
    part = F.when(F.col("v") < F.col("lo"), -1).when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS), F.lit(PARTS - 1))).otherwise(0)
    near = long.join(want, _same(keys)).where(F.col("v") <= F.col("hi")).select(*keys, "i", "pos", "v", part.cast("int").alias("part"))
    counted = near.groupBy(*keys, "i", "pos", "part").agg(F.count("*").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy(*keys, "i").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("before", up_to - F.col("n"))
    holds = {name: (F.col("before") <= at("pos")) & (at("pos") < F.col("before") + F.col("n")) for name, at in (("low", F.floor), ("high", F.ceil))}
    parts = ranked.where(holds["low"] | holds["high"]).select(*[F.col(k).alias(f"_{k}") for k in (*keys, "i", "part")], "before", *[c.alias(f"holds_{name}") for name, c in holds.items()])
    values = near.join(parts, _same([*keys, "i", "part"])).groupBy(*keys, "i", "pos", "part", "before", "holds_low", "holds_high", "v").agg(F.count("*").alias("n"))
    c = F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "i", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    low, high = (F.min(F.when(F.col(f"holds_{name}") & (F.col("c") > at("pos")), F.col("v"))) for name, at in (("low", F.floor), ("high", F.ceil)))
    at = values.withColumn("c", c).groupBy(*keys, "i", "pos").agg(low.alias("low"), high.alias("high")).withColumn("q", F.col("low") + (F.col("high") - F.col("low")) * (F.col("pos") - F.floor("pos")))
    wide = at.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(name) for i, (name, _) in enumerate(QUARTILES)])
    return stats.join(wide, _same(keys), "left").select(*out, *[name for name, _ in QUARTILES], "max")


def _same(keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])


def mean_by(df: DataFrame, keys: list[str], columns: list[str], digits: int | None = 2) -> DataFrame:
    return df.groupBy(*keys).agg(*[(F.bround(F.avg(c), digits) if digits is not None else F.avg(c)).alias(c) for c in columns])


def mean_int(df: DataFrame, key: str, column: str) -> DataFrame:
    """Mean cut to an integer."""
    return df.groupBy(key).agg(F.floor(F.avg(column)).cast("int").alias(column))


def pivot(df: DataFrame, rows: list[str], column: str, values: list[str], cell: Column) -> DataFrame:
    """One column for each of ``values``, in their order and kept where empty: no pass over the data to find them."""
    return df.groupBy(*rows).pivot(column, values).agg(cell)


def unique_pivot(df: DataFrame, rows: list[str], column: str, values: list[str], value: str) -> DataFrame:
    """A pivot whose cells hold one value; several for a cell are an error."""
    one = F.when(F.count(value) > 1, F.raise_error(F.lit("several values for one cell")).cast("double")).otherwise(F.max(value))
    return pivot(df, rows, column, values, one)


def melt(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "metric", "value")


def macro_mean(df: DataFrame, rows: list[str], group: str, member: str, value: str, scale: float = 1.0) -> DataFrame:
    """Mean over a group of the means of its members, not of its rows."""
    means = df.groupBy(*rows, group, member).agg((F.avg(value) * scale).alias("_m"))
    return means.groupBy(*rows, group).agg(F.avg("_m").alias(value), F.count("*").alias("n_members"))


def mean_transpose(df: DataFrame, column: str, values: list[str], metrics: list[str]) -> DataFrame:
    """Metrics as rows and the values of ``column`` as columns, missing ones kept empty."""
    return pivot(melt(df.select(column, *[F.col(m).cast("double").alias(m) for m in metrics]), [column], metrics), ["metric"], column, values, F.avg("value"))


def global_means(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in columns])


def group_gmean(df: DataFrame, by: list[str], column: str) -> DataFrame:
    return df.groupBy(*by).agg(gmean(column).alias("gmean"))


def throughput(df: DataFrame, by: list[str], elapsed: str, prompt_tokens: str, generated_tokens: str) -> DataFrame:
    """Requests and tokens for each second; null without time."""
    out = df.groupBy(*by).agg(F.count("*").alias("num_requests"), F.sum(elapsed).alias("elapsed_time"), (F.sum(prompt_tokens) + F.sum(generated_tokens)).alias("total_num_tokens"))
    return out.withColumn("requests_per_second", F.try_divide(F.col("num_requests"), F.col("elapsed_time"))).withColumn("tokens_per_second", F.try_divide(F.col("total_num_tokens"), F.col("elapsed_time")))


def non_zero_mean(distances: Column) -> Column:
    """Sum over the count of those above 0; 0 for none."""
    n = F.size(F.filter(distances, lambda d: d > 0))
    return F.when(n > 0, F.aggregate(distances, F.lit(0.0), lambda s, d: s + d) / n).otherwise(F.lit(0.0))


def distances(targets: Column, decoded: Column) -> Column:
    """Edit distance of each pair by position; equal texts cost no matrix."""
    return F.zip_with(targets, decoded, lambda t, d: F.when(t == d, F.lit(0.0)).otherwise(F.levenshtein(t, d).cast("double")))


def quality(d: Column) -> tuple[Column, Column]:
    """Mean and non-zero mean of an array of distances, which should be a column of its own: both read it."""
    return F.when(F.size(d) > 0, F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(d)), non_zero_mean(d)
