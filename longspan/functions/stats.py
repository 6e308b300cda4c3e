"""Column expressions over numbers and arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def array_gmean(a: Column) -> Column:
    """exp of the mean logarithm, in one pass; 0 if any value is 0 or less (its logarithm is null, and with it the sum)."""
    logs = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.log(x))
    return F.when(F.size(a) > 0, F.coalesce(F.exp(logs / F.size(a)), F.lit(0.0)))


def aggregate_score(a: Column, how: str) -> Column:
    """Score of a slice of reactions: ``gmean``, ``mean``, ``max`` or ``min``; 0 for an empty slice or NaN."""
    found = {"gmean": array_gmean, "mean": array_mean, "max": F.array_max, "min": F.array_min}
    if how not in found:
        raise ValueError(f"no aggregation named {how!r}; known are {', '.join(found)}")
    score = found[how](a)
    return F.when(score.isNull() | F.isnan(score), F.lit(0.0)).otherwise(score)


def gmean(col: str) -> Column:
    """Aggregate of a group: geometric mean, 0 if any value is 0."""
    return F.when(F.min(col) <= 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.log(col))))


def normal_cdf(x: Column, mean: Column, std: Column) -> Column:
    """Normal distribution function by the rational approximation of erf (Abramowitz and Stegun 7.1.26, error below 1.5e-7); a step where std is 0."""
    z = (x - mean) / (F.when(std > 0, std) * F.sqrt(F.lit(2.0)))
    t = 1 / (1 + 0.3275911 * F.abs(z))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = F.signum(z) * (1 - poly * F.exp(-z * z))
    return F.when(std > 0, (1 + erf) / 2).otherwise(F.when(x >= mean, F.lit(1.0)).otherwise(F.lit(0.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine of two arrays of one length; null where either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    return 1 - F.try_divide(dot, norm(a) * norm(b))


def reaction(before: Column, after: Column) -> Column:
    """How much the attention on each token changes: |after - before| by position."""
    return F.zip_with(after, before, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
