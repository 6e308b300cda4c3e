import math
import random

import pytest
from pyspark.sql import functions as F

from longspan.operators import pack, retrieve


def roots_of(spark, offsets, most):
    row = spark.createDataFrame([(offsets, most)], "o array<int>, m int").select(pack.root_windows(F.col("o"), F.col("m")).alias("r")).collect()[0]
    return [tuple(x) for x in row.r]


@pytest.mark.parametrize(
    ("offsets", "most", "want"),
    [([0, 3, 6, 9], 7, [(0, 6), (6, 9)]), ([0, 3, 20, 25], 10, [(0, 3), (3, 20), (20, 25)]), ([0], 5, []), ([], 5, []), ([0, 0, 4], 4, [(0, 4)])],
)
def test_root_windows(spark, offsets, most, want):
    assert roots_of(spark, offsets, most) == want


def test_roots_partition_the_text(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        o = [0]
        for _ in range(rng.randint(1, 12)):
            o.append(o[-1] + rng.randint(0, 9))
        rows.append((i, o, rng.randint(1, 15)))
    df = spark.createDataFrame(rows, "i int, o array<int>, m int").withColumn("r", pack.root_windows(F.col("o"), F.col("m")))
    for r in df.collect():
        at, prev = 0, r.o[0]
        for a, b in r.r:
            assert a == prev and (b - a <= r.m or r.o.count(a) and all(not a < x < b for x in r.o))
            prev = b
        assert prev == r.o[-1] and at == 0


def test_leaves_go_to_the_root_that_holds_them(spark):
    df = spark.createDataFrame([("m", [0, 3, 6, 6, 9, 9])], "k string, sentence_quant_indices array<int>").withColumn("max_root_len", F.lit(6))
    df = df.withColumn("roots", pack.root_windows(F.col("sentence_quant_indices"), F.col("max_root_len")))
    got = [(r.left, r.right, r.parent_left) for r in pack.leaf_rows(df, ["k"]).orderBy("sent_index").collect()]
    assert got == [(0, 3, 0), (3, 6, 0), (6, 6, 6), (6, 9, 6), (9, 9, 6)]


def test_quantize(spark):
    o = F.array(*[F.lit(x) for x in (0, 3, 6, 9)])
    r = spark.range(1).select(pack.quantize_enclosing(F.lit(2), F.lit(5), o).alias("e"), pack.quantize_naive(F.lit(13), F.lit(27), F.lit(50), 10).alias("n"), pack.quantize_naive(F.lit(13), F.lit(50), F.lit(50), 20).alias("t")).collect()[0]
    assert tuple(r.e) == (0, 6) and tuple(r.n) == (10, 20) and tuple(r.t) == (0, 50)


def spans(spark, scores, ntokens=5):
    return spark.createDataFrame([("k", i, s, ntokens) for i, s in enumerate(scores)], "k string, sent_index int, score double, ntokens int")


def test_rank_ties_keep_document_order(spark):
    got = retrieve.rank_and_cut(spans(spark, [0.5, 0.9, 0.5]), ["k"], 100).orderBy("sent_index").collect()
    assert [r["rank"] for r in got] == [1, 0, 2]


def test_budget_is_strict(spark):
    assert retrieve.rank_and_cut(spans(spark, [3.0, 2.0, 1.0]), ["k"], 10).where("picked").count() == 1


def test_ratio_cap_and_nan(spark):
    got = retrieve.rank_and_cut(spans(spark, [1.0, float("nan"), None]), ["k"], 1000, 1.2)
    assert got.where("picked").count() == 2 and got.where("score is null or isnan(score)").count() == 0


def test_nothing_retrieved_is_infinite(spark):
    cut = retrieve.rank_and_cut(spans(spark, [1.0], 50), ["k"], 10, 1.0)
    assert math.isinf(retrieve.compression(cut, ["k"]).collect()[0].compression_rate)


ROWS = [("k", 0, 3, "A"), ("k", 3, 5, "B"), ("k", 7, 9, "C"), ("k", 9, 10, "D")]


@pytest.mark.parametrize(("compat", "want"), [(False, ["A B", "C D"]), (True, ["A B", "CD"])])
def test_merge(spark, compat, want):
    df = spark.createDataFrame(ROWS, "k string, left int, right int, sentence string")
    assert [r.sentence for r in retrieve.merge_adjacent(df, ["k"], compat_last_join=compat).orderBy("run").collect()] == want


def test_merge_overlap_and_empty(spark):
    df = spark.createDataFrame([("k", 0, 5, "A"), ("k", 3, 8, "B"), ("k", 8, 9, "C")], "k string, left int, right int, sentence string")
    r = retrieve.merge_adjacent(df, ["k"]).collect()
    assert [(x.left, x.right, x.sentence) for x in r] == [(0, 9, "A C")]
    assert retrieve.merge_adjacent(df.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("chunk", [2, 20_000])
def test_nearest_against_brute_force(spark, chunk):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(120)] + [(200, None), (201, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r.query_vec_id, r["rank"]): r.vec_id for r in retrieve.nearest(df.where("vec_id % 40 = 0"), df, 3, "vec_id", "vec_id", "embedding", chunk).collect()}

    def dist(a, b):
        return 1 - sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    v = {i: e for i, e in rows if e and len(e) == 5}
    for q in (0, 40, 80):
        want = sorted(v, key=lambda i: (dist(v[q], v[i]), i))[:3]
        assert [got[q, k + 1] for k in range(3)] == want


def test_nearest_meets_its_own_length(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.1]), (5, None), (6, [])], "vec_id bigint, embedding array<double>")
    got = {(r.query_vec_id, r["rank"]): r.vec_id for r in retrieve.nearest(df.where("vec_id in (1, 3, 5, 6)"), df, 2, "vec_id", "vec_id", "embedding").collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (3, 1): 3, (3, 2): 4}


def test_scores_of_slices_against_brute_force(spark):
    rng = random.Random(4)
    spans, vectors, want = [], [], {}
    for k in ("x", "y"):
        cuts = sorted({0, 30, *(rng.randint(0, 30) for _ in range(6))})
        spans += [(k, i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))] + [(k, 99, 5, 5)]
        for m in ("m", "n"):
            v = [rng.random() for _ in range(30)]
            vectors.append((k, m, v))
            want |= {(k, m, i): round(math.exp(sum(map(math.log, v[a:b])) / (b - a)), 6) if b > a else 0.0 for kk, i, a, b in spans if kk == k}
    s = spark.createDataFrame(spans, "k string, i int, left int, right int")
    v = spark.createDataFrame(vectors, "k string, m string, reaction array<double>")
    assert {(r.k, r.m, r.i): r.score for r in retrieve.score_slices(s, v, ["k"], "gmean", ["m"], 6).collect()} == pytest.approx(want)
