import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from longspan.functions import stats, text


def one(spark, *cols):
    return spark.range(1).select(*cols).collect()[0]


def test_normalize_answer(spark):
    assert one(spark, text.normalize_answer(F.lit("The  cat-sat, on a mat!")).alias("x")).x == "catsat on mat"
    assert one(spark, text.normalize_answer(F.lit(None).cast("string")).alias("x")).x == ""


@pytest.mark.parametrize(
    ("pred", "truths", "score"),
    [("The cat sat", ["a cat"], 2 / 3), ("x x y", ["x z"], 0.4), ("", ["x"], 0.0), ("cat", ["dog", "cat"], 1.0), ("cat", [], 0.0), ("cat", [None, "cat"], 1.0), (None, ["x"], 0.0)],
)
def test_answer_f1(spark, pred, truths, score):
    row = spark.createDataFrame([(pred, truths)], "g string, t array<string>").select(text.answer_f1("g", "t").alias("f")).collect()[0]
    assert row.f == pytest.approx(score)


def test_answer_f1_null_truth(spark):
    assert spark.createDataFrame([("x", None)], "g string, t array<string>").select(text.answer_f1("g", "t").alias("f")).collect()[0].f == 0.0


def test_tokens_join_to_the_text(spark):
    row = one(spark, text.tokens(F.lit("Hi there.\n Bye")).alias("t"))
    assert row.t == ["Hi", " there.", "\n Bye"]


@pytest.mark.parametrize(("values", "want"), [([1.0, 4.0], 2.0), ([0.0, 4.0], 0.0), ([], 0.0)])
def test_gmean(spark, values, want):
    row = spark.createDataFrame([(values,)], "a array<double>").select(stats.aggregate_score(F.col("a"), "gmean").alias("g")).collect()[0]
    assert row.g == pytest.approx(want)


def test_unknown_aggregate():
    with pytest.raises(ValueError):
        stats.aggregate_score(F, "median")


def test_reaction_and_cosine(spark):
    row = one(spark, stats.reaction(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.7)), F.array(F.lit(0.3), F.lit(0.2), F.lit(0.5))).alias("r"), stats.cosine_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))).alias("c"))
    assert [round(x, 9) for x in row.r] == [0.2, 0.0, 0.2] and row.c == pytest.approx(1.0)


@given(st.floats(-5, 5))
def test_normal_cdf_polynomial(z):
    t = 1 / (1 + 0.3275911 * abs(z / math.sqrt(2)))
    p = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = math.copysign(1 - p * math.exp(-z * z / 2), z)
    assert abs((1 + erf) / 2 - 0.5 * (1 + math.erf(z / math.sqrt(2)))) < 1e-6


def test_success_rate(spark):
    assert one(spark, text.success_rate(F.lit(1), F.lit(32)).alias("r")).r == 3.12
