import json

import pytest
from pyspark.sql import functions as F

from longspan.operators import lookup, prompt, report
from longspan.operators.generate import ExtractiveGenerator, generate
from longspan.operators.grade import evidence_recall, grade_best, valid_evidence
from longspan.operators.react import LexicalProvider, WindowCache, attend_windows, check_vectors, pool
from longspan.sources import readers, sinks


def test_selection(spark):
    df = spark.createDataFrame([(i,) for i in range(4)], "q_index int")
    assert lookup.select_questions(df).count() == 4 and lookup.select_questions(df, 2).count() == 1 and lookup.select_questions(df, -2, [0, 3]).count() == 2
    for bad in ((1, [0]), (-2, None)):
        with pytest.raises(ValueError):
            lookup.select_questions(df, *bad)


def test_record_id(spark):
    df = spark.createDataFrame([("a", 7), ("a", 1234)], "ds_name string, q_index int").select(lookup.record_id().alias("i"))
    assert [r.i for r in df.collect()] == ["a007", "a1234"]


def test_unique_lookup(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    good = spark.createDataFrame([(1, "x"), (1, "x")], "k int, v string")
    assert sorted((r.k, r.v) for r in lookup.unique_lookup(rows, good, ["k"], "v").collect()) == [(1, "x"), (2, None)]
    with pytest.raises(Exception, match="several values"):
        lookup.unique_lookup(rows, good.union(spark.createDataFrame([(1, "y")], "k int, v string")), ["k"], "v").collect()


def test_pending_and_targets(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2)], "ds_name string, q_index int")
    done = spark.createDataFrame([("a", 1)], "ds_name string, q_index int")
    assert lookup.pending(rows, done, ["ds_name", "q_index"]).collect()[0].q_index == 2
    t = spark.createDataFrame([("a", 1, ["x"]), ("a", 1, ["x", "y"])], "ds_name string, q_index int, target_sentences array<string>")
    got = {r.q_index: r.target_sentences for r in lookup.with_targets(rows, t, ["ds_name", "q_index"]).collect()}
    assert got == {1: ["x", "y"], 2: []}


def test_prompt_is_filled_once(spark):
    r = spark.range(1).select(prompt.fill("A {context} B {input}", context=F.lit("{input}"), input=F.lit("q")).alias("p"), prompt.query_text(F.lit("q"), "append_prompt", "P ").alias("t")).collect()[0]
    assert r.p == "A {input} B q" and r.t == "P q\n\nAnswer: "
    with pytest.raises(ValueError):
        prompt.query_text(None, "other")


def test_augment_needs_pieces(spark):
    r = spark.range(1).select(prompt.augment(F.array().cast("array<string>"), F.lit("q")).alias("p"), prompt.augment(F.array(F.lit("x"), F.lit("y")), F.lit("q"), "{context}|{input}").alias("f")).collect()[0]
    assert r.p is None and r.f == "x\ny|q"


def test_macro_mean_and_pivot(spark):
    rows = [("m", "t", "a", 10.0)] * 4 + [("m", "t", "b", 20.0)]
    df = spark.createDataFrame(rows, "m string, t string, ds string, v double")
    assert report.macro_mean(df, ["m"], "t", "ds", "v").collect()[0].v == 15.0
    p = report.pivot(df, ["m"], "ds", ["a", "b", "c"], F.avg("v")).collect()[0]
    assert (p.a, p.b, p.c) == (10.0, 20.0, None)
    with pytest.raises(Exception, match="several values"):
        report.unique_pivot(df, ["m"], "ds", ["a"], "v").collect()


def test_describe(spark):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "v double")
    r = report.describe(df, ["v"]).collect()[0]
    assert (r["count"], r["mean"], r.p25, r.p50, r.max) == (4, 2.5, 1.75, 2.5, 4.0) and r["std"] == pytest.approx(1.2909944)


@pytest.mark.parametrize("exact", [True, False])
def test_quartiles_of_large_groups(spark, exact):
    import random

    import numpy as np

    rng = random.Random(4)
    rows = [(g, float(rng.choice([7.0, rng.gauss(0, 50), rng.randint(0, 9)]))) for g in ("a", None) for _ in range(6001)] + [("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in report.describe(df, ["v"], ["g"], exact).collect()}
    assert got["b"]["count"] == 0 and got["b"].p50 is None
    for g in ("a", None):
        want = np.quantile([v for k, v in rows if k == g], [0.25, 0.5, 0.75])
        assert [got[g].p25, got[g].p50, got[g].p75] == pytest.approx(want.tolist(), abs=1e-9 if exact else 2.0)


def test_throughput_without_time(spark):
    df = spark.createDataFrame([("m", 0.0, 1, 2)], "m string, e double, p int, g int")
    assert report.throughput(df, ["m"], "e", "p", "g").collect()[0].requests_per_second is None


def test_evidence(spark):
    df = spark.createDataFrame([("a b c", ["a", "x", "<invalid_evidence> b"]), (None, [])], "t string, evidence array<string>")
    assert [r.recall for r in evidence_recall(df, "t", "evidence").collect()] == [0.5, None]
    assert [len(r.evidence) for r in valid_evidence(df).collect()] == [2, 0]


def test_grade_best(spark):
    df = spark.createDataFrame([("k", "x", ["y"]), ("k", "y", ["y"])], "k string, generated string, truth array<string>")
    r = grade_best(df, ["k"]).collect()[0]
    assert (r.score, r.n_generations) == (1.0, 2)


def test_window_cache():
    import numpy as np

    c = WindowCache(lambda w: np.zeros((len(w), 1)), lambda s, w: np.zeros((len(w), 1)), entries=2)
    for key, n in (("a", 3), ("a", 3), ("a", 2), ("a", 5), ("b", 1), ("c", 1), ("a", 5)):
        assert len(c.get((key,), ["x"] * n)) == n
    assert c.hits == {"exact": 1, "cut": 1, "extended": 1, "made": 4} and len(c.kept) == 2


def test_window_states_on_disk(tmp_path):
    import numpy as np

    from longspan.operators.react import in_blocks

    make = in_blocks(lambda w: np.arange(len(w), dtype=float).reshape(-1, 1), 2)
    a = WindowCache(make)
    assert a.get(("k", 1), ["x"] * 5)[:, 0].tolist() == [0, 1, 0, 1, 0] and len(make([])) == 0
    b = WindowCache(make)
    assert not b.load(str(tmp_path / "s"))
    a.save(str(tmp_path / "s"))
    a.save(str(tmp_path / "s"))
    assert b.load(str(tmp_path / "s")) and b.get(("k", 1), ["x"] * 5).shape == (5, 1) and b.hits["exact"] == 1
    with pytest.raises(ValueError):
        in_blocks(make, 0)


def test_attention(spark):
    df = spark.createDataFrame([(1, ["the", "cat", "sat"], ["cat"]), (2, None, None)], "k int, window array<string>, query array<string>")
    got = {r.k: r for r in check_vectors(attend_windows(df, ["k"])).collect()}
    assert abs(sum(got[1].after) - 1) < 1e-9 and max(range(3), key=lambda i: got[1].after[i]) == 1 and got[2].before == []
    assert LexicalProvider().attend(["a", "b"], ["a"]) == LexicalProvider().attend(["a", "b"], ["a"])
    import numpy as np

    assert pool(np.ones((1, 2, 2, 3)), "sum").tolist() == [4, 4, 4]
    with pytest.raises(ValueError):
        pool(np.ones((1, 1, 1, 1)), "max")


def test_generate(spark):
    assert ExtractiveGenerator().generate(["Text: A cat sat. A dog ran.\nQuestion: who ran?\nAnswer:"], [2]) == ["A dog"]
    df = spark.createDataFrame([(1, None, 3), (2, "", None)], "k int, prompt string, max_gen_len int")
    assert [r.purely_generated_ntokens for r in generate(df, ["k"]).collect()] == [0, 0]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", [1, 2])], "k int, a string, b array<int>")
    docs = sinks.to_document(df, ["k"])
    assert sinks.from_document(docs, ["k"], "a string, b array<int>").collect() == df.collect()
    calls = []
    for _ in range(2):
        got = sinks.read_or_compute(spark, str(tmp_path), "s", lambda: (calls.append(1), df)[1])
    assert len(calls) == 1 and got.collect() == df.collect()
    sinks.append_jsonl(df, str(tmp_path / "o.jsonl"))
    sinks.append_jsonl(df, str(tmp_path / "o.jsonl"))
    assert readers.read_json(spark, str(tmp_path / "o.jsonl"), "k int, a string, b array<int>").count() == 2
    sinks.write_csv(df.drop("b"), str(tmp_path / "c"))
    assert readers.read_csv(spark, str(tmp_path / "c"), "k int, a string").collect()[0].a == "x"
    with pytest.raises(ValueError):
        readers.read_json(spark, "x.csv", "k int")


def test_result_files(spark, tmp_path):
    f = tmp_path / "m1" / "full"
    f.mkdir(parents=True)
    (f / "qasper.json").write_text(json.dumps({"elapsed_time": 1.0, "num_requests": 2, "generated": ["a", "b"], "truth": [["a"], ["c", "b"]]}))
    got = [tuple(r)[:5] for r in readers.read_results(spark, f"{tmp_path}/*/*/*.json").orderBy("q_index").collect()]
    assert got == [("m1", "full", "qasper", 0, "a"), ("m1", "full", "qasper", 1, "b")]
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev" / "qasper.json").write_text('{"3": ["x", "y"]}')
    e = readers.read_evidence(spark, f"{tmp_path}/ev").collect()[0]
    assert (e.ds_name, e.q_index, e.evidence) == ("qasper", 3, ["x", "y"])


def test_config(tmp_path):
    c = readers.RunConfig.from_dict({"model_name": "m", "seed": 7, "other": 1})
    c.save(str(tmp_path / "c.json"))
    assert readers.RunConfig.from_file(str(tmp_path / "c.json")) == c and readers.spark_type("bfloat16") == "float"
    with pytest.raises(ValueError):
        readers.spark_type("complex64")
    assert readers.git_hash(str(tmp_path)) == ""
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "HEAD").write_text("ref: refs/heads/x")
    (tmp_path / ".git" / "packed-refs").write_text("# pack\nabc refs/heads/x\n")
    assert readers.git_hash(str(tmp_path)) == "abc"


def test_run_columns(spark):
    r = readers.with_run(spark.range(1), readers.RunConfig(model_name="m", git_hash="abc")).collect()[0]
    assert (r.model_name, r.seed, r.git_hash) == ("m", 42, "abc") and r.run_at is not None


def test_sinks_and_dictionaries(spark, tmp_path):
    from longspan.sources import readers, sinks

    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.append_csv(df, f"{tmp_path}/r.csv")
    sinks.append_csv(df, f"{tmp_path}/r.csv")
    assert sorted(tuple(r) for r in spark.read.schema("k string, v int").csv(f"{tmp_path}/r.csv").collect()) == [("a", 1)] * 2 + [("b", 2)] * 2
    sinks.write_json(df, f"{tmp_path}/g.json", ["k"])
    assert sorted((r.k, r.v) for r in spark.read.json(f"{tmp_path}/g.json").collect()) == [("a", 1), ("b", 2)]
    (tmp_path / "d.json").write_text('{"qasper": 128, "musique": "32"}')
    assert sorted(tuple(r) for r in readers.read_dictionary(spark, f"{tmp_path}/d.json", "ds_name", "n").collect()) == [("musique", "32"), ("qasper", "128")]


def test_upsert_replaces_by_key(spark, tmp_path):
    from longspan.sources import sinks

    ddl = "k string, i int, v int"
    sinks.upsert(spark.createDataFrame([("a", 1, 10), ("a", 2, 20), (None, 3, 30)], ddl), str(tmp_path), "t", ["k", "i"])
    got = sinks.upsert(spark.createDataFrame([("a", 2, 21), ("b", 1, 5), (None, 3, 31)], ddl), str(tmp_path), "t", ["k", "i"])
    assert sorted((r.k or "", r.i, r.v) for r in got.collect()) == [("", 3, 31), ("a", 1, 10), ("a", 2, 21), ("b", 1, 5)]
    assert sinks.write_stage(spark.createDataFrame([("z", 1, 1)], ddl), str(tmp_path), "t").count() == 1
    sinks.write_stage(spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], ddl), str(tmp_path), "p", ["k"])
    assert sorted(r.v for r in sinks.write_stage(spark.createDataFrame([("b", 1, 9)], ddl), str(tmp_path), "p", ["k"]).collect()) == [1, 9]


def test_for_each_and_required_lookup(spark):
    import pytest

    from longspan.operators import lookup

    rows = spark.createDataFrame([(1,), (2,)], "i int")
    models = spark.createDataFrame([("m",), ("n",), ("m",), (None,)], "name string")
    assert sorted((r.i, r.name) for r in lookup.for_each(rows, models, "name").collect()) == [(1, "m"), (1, "n"), (2, "m"), (2, "n")]
    assert lookup.for_each(rows, models.limit(0), "name").count() == 0
    table = spark.createDataFrame([(1, [3])], "i int, v array<int>")
    assert [r.v for r in lookup.unique_lookup(rows.where("i = 1"), table, ["i"], "v", required=True).collect()] == [[3]]
    assert [r.v for r in lookup.unique_lookup(rows, table, ["i"], "v").orderBy("i").collect()] == [[3], None]
    with pytest.raises(Exception, match="no v for 2"):
        lookup.unique_lookup(rows, table, ["i"], "v", required=True).collect()


def test_written_steps_can_be_released(spark):
    from longspan.sources.tables import materialise, release

    release(spark)
    df = materialise(spark.range(3), "step")
    assert df.count() == 3 and release(spark) == 1 and release(spark) == 0


def test_geometric_mean_in_one_pass(spark):
    from longspan.functions.stats import array_gmean

    rows = spark.createDataFrame([([1.0, 4.0],), ([0.0, 4.0],), ([-1.0, 4.0],), ([],), (None,)], "a array<double>")
    assert [r[0] for r in rows.select(array_gmean(F.col("a"))).collect()] == [2.0, 0.0, 0.0, None, None]


@pytest.mark.parametrize("how", ["gmean", "mean", "max", "min"])
def test_scores_in_one_pass_equal_those_of_the_steps(spark, how):
    from longspan.functions.stats import reaction
    from longspan.operators.react import OverlapProvider, score_windows
    from longspan.operators.retrieve import score_slices, with_scores

    words = [f" w{i % 7}" for i in range(30)]
    rows = [("a", words, [" w1", " w3"], [0, 4, 4, 20, 30], [(0, 20), (20, 30)]), ("b", words[:5], [], [0, 5], [(0, 5)]), ("c", [], None, [0], []), ("d", None, [" w1"], None, None)]
    windows = spark.createDataFrame(rows, "k string, window array<string>, query array<string>, sentence_quant_indices array<int>, roots array<struct<left:int,right:int>>")
    spans = spark.createDataFrame([("a", i, x, y) for i, (x, y) in enumerate([(0, 4), (4, 4), (4, 20), (20, 30)])] + [("b", 0, 0, 5)], "k string, sent_index int, left int, right int")
    attended = check_vectors(attend_windows(windows, ["k"], OverlapProvider))
    steps = score_slices(spans, attended.select("k", reaction(F.col("before"), F.col("after")).alias("reaction")), ["k"], how)
    one = with_scores(spans, score_windows(windows, ["k"], OverlapProvider, how), ["k"])
    want = {(r.k, r.sent_index): r.score for r in steps.collect()}
    assert {(r.k, r.sent_index): r.score for r in one.collect()} == pytest.approx(want) and len(want) == 5
