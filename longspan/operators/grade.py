"""Grading of answers and of retrieved evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.functions.text import answer_f1

#: Evidence that holds this mark is no evidence; fixed value.
INVALID_EVIDENCE = "<invalid_evidence>"


def grade(pairs: DataFrame, generated: str = "generated", truth: str = "truth") -> DataFrame:
    """Adds ``score``: the best token F1 over the truths. Narrow, without Python; null texts and truths score 0."""
    return pairs.withColumn("score", answer_f1(generated, truth))


def grade_best(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Best score over several generations of one key; 0 for none."""
    return grade(pairs).groupBy(*key).agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"), F.count("*").alias("n_generations"))


def valid_evidence(evidence: DataFrame, col: str = "evidence") -> DataFrame:
    return evidence.withColumn(col, F.filter(col, lambda e: e.isNotNull() & ~F.contains(e, F.lit(INVALID_EVIDENCE))))


def evidence_recall(rows: DataFrame, text: str, evidence: str) -> DataFrame:
    """Adds ``recall``: the share of evidence strings that the text holds; null without evidence."""
    e = F.filter(evidence, lambda x: x.isNotNull() & ~F.contains(x, F.lit(INVALID_EVIDENCE)))
    found = F.size(F.filter(e, lambda x: F.contains(F.coalesce(F.col(text), F.lit("")), x)))
    return rows.withColumn("recall", F.when(F.size(e) > 0, found / F.size(e)))
