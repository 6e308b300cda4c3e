import pytest
from pyspark.sql import functions as F


def test_entry_and_names(spark, small):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and "p3_found" in q
    assert e.entry(spark).count() > 0


def test_nothing_outside_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "longspan"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "longspan.llm" in p.read_text()]


def test_pipeline(spark):
    from longspan.plans.pipeline import Settings, evaluate

    rows = [("a", 0, "Who ran?", "A cat sat. The dog ran. It rained.", ["the dog"]), ("a", 0, "Who ran?", "A cat sat. The dog ran. It rained.", ["the dog"]), ("a", 1, None, "One.", None), ("a", 2, "q", "  ", ["x"]), ("b", 3, "q", None, [])]
    df = spark.createDataFrame(rows, "ds_name string, q_index int, input string, context string, answers array<string>")
    out = evaluate(df, Settings(budget=50, compression_ratio=1.0))
    graded = {r.q_index: r for r in out["graded"].collect()}
    assert set(graded) == {0, 1} and 0 <= graded[0].score <= 1
    again = evaluate(df, Settings(budget=50, compression_ratio=1.0), reuse={"cut": out["cut"], "generated": out["generated"]})["graded"]
    assert {(r.q_index, r.score) for r in again.collect()} == {(r.q_index, r.score) for r in out["graded"].collect()}
    for bad in ({"cut": None}, {"other": df}):
        with pytest.raises(ValueError):
            evaluate(df, reuse=bad)
    deferred = evaluate(df, Settings(deferred=True))["graded"].collect()
    assert {r.purely_generated_str for r in deferred} == {""}


def test_pipeline_packs_into_the_windows_of_each_model(spark):
    from longspan.plans.pipeline import Settings, evaluate

    class RootLength:
        """Attention by which the reaction of a token tells the length of the root it was read in."""

        def attend(self, window, query):
            return [float(len(window)) if query else 0.5] * len(window)

    df = spark.createDataFrame([("a", 0, "Who ran?", "A cat sat. The dog ran. It rained hard. One two three four five six seven.", ["the dog"])], "ds_name string, q_index int, input string, context string, answers array<string>")
    models = spark.createDataFrame([("small", 16, 10), ("large", 110, 10)], "model_name string, window_tokens int, root_split_offset int")
    out = evaluate(df, Settings(budget=50, compression_ratio=1.0), RootLength, models=models)
    got = {(r.model_name, r.sent_index): r.score for r in out["cut"].collect()}
    assert got == pytest.approx({("small", 0): 5.5, ("small", 1): 5.5, ("small", 2): 2.5, ("small", 3): 6.5} | {("large", i): 15.5 for i in range(4)})
    assert {r.model_name for r in out["graded"].collect()} == {"small", "large"}
    with pytest.raises(ValueError, match="other models"):
        evaluate(df, reuse={"cut": out["cut"]})


def test_pipeline_limits_and_fills_by_dataset(spark):
    from longspan.plans.pipeline import Settings, evaluate

    words = " ".join(f"w{i}" for i in range(60)) + "."
    df = spark.createDataFrame([(d, 0, "w1", words, [words]) for d in ("long", "short", "unknown")], "ds_name string, q_index int, input string, context string, answers array<string>")
    datasets = spark.createDataFrame([("long", 128), ("short", 5), ("empty", None)], "ds_name string, max_gen_len int")
    out = evaluate(df, Settings(compression_ratio=1.0, max_gen_len=7, templates={"short": "{context}|{input}"}), datasets=datasets)
    # the default template puts "Text:" before the 60 words
    assert {r.ds_name: r.purely_generated_ntokens for r in out["generated"].collect()} == {"long": 61, "short": 5, "unknown": 7}
    prompts = {r.ds_name: r.prompt for r in out["prompts"].collect()}
    assert prompts["short"] == f"{words}|w1" and prompts["long"] == prompts["unknown"] and prompts["long"].startswith("Read the text")


def test_attention_pipeline_keeps_the_models_apart(spark, small):
    from longspan.plans import reference_queries as r

    got = r.attention_pipeline(spark, small)
    assert got.count() == got.select(*r.MODEL_KEY).distinct().count() == 3 * got.select(*r.KEY).distinct().count() > 0


@pytest.mark.parametrize("name", ["qa_f1_multi_truth", "root_windows", "retrieve_ratio_budget", "stream_grades", "attention_pipeline", "align_success", "pipeline_roots", "reaction_teaser", "stream_windows"])
def test_queries_run(spark, small, name):
    import __spark_entry__ as e

    df = e.queries()[name](spark, small)
    assert df.where(F.lit(True)).count() > 0


def test_edit_distances_in_every_script(spark, tmp_path):
    import __spark_entry__ as e

    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rows = [("zh", "北京大学", ["南京大厦"]), ("zh", "北京", ["北京"]), ("ru", "да", ["нет", "да"]), ("ar", "نعم", ["لا"]), ("fr", "été", ["ete"]), ("fr", "e\u0301", ["é"]), ("emoji", "😀a", ["😁a"]), ("en", "cat", ["cart"]), ("en", None, ["ab"]), ("en", "x", None)]
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "gen_id bigint, ds_name string, generated string, truth array<string>").write.parquet(f"{tmp_path}/generations.parquet")
    want = {}
    for ds, g, t in rows:
        want.setdefault(ds, []).append(brute((t or [""])[0], g or ""))
    got = {r.ds_name: (r.mean_dist, r.non_zero_mean_dist) for r in e.queries()["edit_distance_exact"](spark, str(tmp_path)).collect()}
    assert got == {ds: pytest.approx((sum(x) / len(x), sum(x) / sum(d > 0 for d in x)), abs=1e-6) for ds, x in want.items()}


def test_stream_matches_batch(spark, small):
    from longspan.plans import reference_queries as r

    a = {tuple(x) for x in r.stream_grades(spark, small).collect()}
    b = {tuple(x) for x in r.qa_f1_multi_truth(spark, small).select("gen_id", "score").collect()}
    assert a == b


EVAL = "ds_name string, q_index int, input string, context string, answers array<string>"


def test_pipeline_by_alignment_keeps_tokens_and_sentences_together(spark):
    from longspan.operators.align import FixedTokenizer, WordTokenizer
    from longspan.plans.pipeline import Settings, evaluate

    text = "A cat sat.  The dog ran.\nIt rained hard. "
    df = spark.createDataFrame([("a", 0, "Who ran?", text, ["the dog"]), ("a", 1, "q", None, None), ("a", 2, "q", " ", ["x"])], EVAL)
    plain = evaluate(df, Settings(budget=50, compression_ratio=1.0))
    words = evaluate(df, Settings(budget=50, compression_ratio=1.0), make_tokenizer=WordTokenizer)
    spans = lambda out: [(r.sent_index, r.left, r.right, r.sentence) for r in out["spans"].orderBy("sent_index").collect()]
    assert [x[:2] + x[3:] for x in spans(plain)] == [x[:2] + x[3:] for x in spans(words)] and spans(words)[-1][2] == 10  # the blanks at the end are a token
    fixed = evaluate(df, Settings(budget=50, compression_ratio=1.0), make_tokenizer=FixedTokenizer)
    assert spans(fixed)[-1][2] == len(FixedTokenizer().encode(text)) and {r.q_index for r in fixed["graded"].collect()} == {0}
    given = spark.createDataFrame([("a", 0, ["A cat sat.", "The dog ran."]), ("z", 9, ["x"])], "ds_name string, q_index int, target_sentences array<string>")
    assert [x[3] for x in spans(evaluate(df, make_tokenizer=WordTokenizer, targets=given))] == ["A cat sat.", "The dog ran."]


def test_pipeline_takes_alignments_and_misses_none(spark):
    from longspan.operators.align import align_corpus
    from longspan.plans.pipeline import KEY, evaluate

    df = spark.createDataFrame([("a", 0, "Who ran?", "A cat sat. The dog ran.", ["the dog"]), ("b", 1, "q", "One.", ["x"])], EVAL)
    made = align_corpus(df.withColumn("target_sentences", F.expr("array('A cat sat.', 'The dog ran.')")).where("q_index = 0"), KEY)
    out = evaluate(df.where("q_index = 0"), alignments=made)
    assert [(r.left, r.right) for r in out["spans"].orderBy("sent_index").collect()] == [(0, 3), (3, 6)]
    with pytest.raises(Exception, match="no alignment for b/1"):
        evaluate(df, alignments=made)
    other = made.withColumn("sentence_quant_indices", F.expr("array(0, 6)"))
    with pytest.raises(Exception, match="several values for a/0"):
        evaluate(df.where("q_index = 0"), alignments=made.unionByName(other))


def test_pipeline_exchanges_its_stages_and_tells_how_far_it_came(spark):
    from longspan.operators.react import OverlapProvider
    from longspan.plans.pipeline import Settings, evaluate

    df = spark.createDataFrame([("a", 0, "Who ran?", "A cat sat. The dog ran.", ["the dog"]), ("a", 0, "Who sat?", "B. The dog ran.", ["x"]), ("a", 1, "q", " ", None)], EVAL)
    evidence = spark.createDataFrame([("a", 0, ["cat", "horse"])], "ds_name string, q_index int, evidence array<string>")
    first = lambda scored, key, settings: scored.withColumn("picked", F.col("sent_index") == 0)
    same = lambda rows, g, t: rows.withColumn("score", F.lit(7.0))
    out = evaluate(df, Settings(query_kind="append_prompt", query_prompt="Say: "), OverlapProvider, retriever=first, grader=same, evidence=evidence)
    assert [tuple(r) for r in out["questions"].orderBy("q_index").collect()] == [("a", 0, "Who ran?", "A cat sat. The dog ran.", ["the dog"]), ("a", 1, "q", " ", None)]
    assert [r.cleaned_strlist for r in out["retrieved"].collect()] == [["A cat sat."]] and [r.recall for r in out["evidence"].collect()] == [0.5]
    assert {r.score for r in out["graded"].collect()} == {7.0} and {(r.q_index, r.status) for r in out["status"].collect()} == {(0, "graded"), (1, "no context")}
    assert {r.stage: r.status for r in out["stages"].collect()} == dict.fromkeys(["questions", "spans", "cut", "generated"], "done") and all(r.seconds > 0 for r in out["stages"].collect())
    with pytest.raises(ValueError, match="no query kind"):
        evaluate(df, Settings(query_kind="other"))

    class Silent:
        def attend(self, window, query):
            return [0.0] * len(window)

    with pytest.raises(Exception, match="attention vectors"):
        evaluate(df, make_provider=Silent)


def test_command_line(spark, tmp_path, monkeypatch):
    import longspan.session
    from longspan.__main__ import main

    monkeypatch.setattr(longspan.session, "session", lambda *a, **k: spark)
    data, out = tmp_path / "data", tmp_path / "out"
    tables = {
        "corpus": spark.createDataFrame([("a", 0, "Who ran?", "A cat sat. The dog ran.", ["the dog"]), ("a", 1, "q", None, None)], EVAL),
        "target_sentences": spark.createDataFrame([("a", 0, ["A cat sat.", "The dog ran."])], "ds_name string, q_index int, target_sentences array<string>"),
        "alignments": spark.createDataFrame([("a", "m", 50.0, 1.0, 2.0), ("a", "m", 100.0, 3.0, None)], "ds_name string, model_name string, success_rate double, mean_dist double, non_zero_mean_dist double"),
        "models": spark.createDataFrame([("m", 16, 10)], "model_name string, window_tokens int, root_split_offset int"),
        "datasets": spark.createDataFrame([("a", "single", 8)], "ds_name string, ds_class string, max_gen_len int"),
        "generations": spark.createDataFrame([(1, "m", "base", "a", 0, "the dog", ["the dog"]), (1, "m", "base", "a", 0, "the dog", ["the dog"])], "gen_id bigint, model_name string, exp_type string, ds_name string, q_index int, generated string, truth array<string>"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{data}/{name}.parquet")
    for command in ("count", "split", "align", "align-report", "grade"):
        main([command, "--data", str(data), "--out", str(out)])
    main(["evaluate", "--data", str(data), "--out", str(out), "--deferred", "--questions", "0", "--q-index", "-2"])
    read = lambda name: spark.read.option("header", True).csv(f"{out}/{name}.csv").collect()
    assert [tuple(r) for r in read("mean_tokens")] == [("a", "6")] and [tuple(r) for r in read("alignment_report")] == [("m", "a", "75.0", "2.0", "2.0")]
    assert [tuple(r)[-2:] for r in read("macro_means")] == [("100.0", "1")]
    assert [r.target_sentences for r in spark.read.json(f"{out}/target_sentences.json").where("q_index = 0").collect()] == [["A cat sat.", "The dog ran."]]
    assert {r.q_index: r.success_rate for r in spark.read.parquet(f"{out}/alignments.parquet").collect()} == {0: 100.0, 1: 0.0}
    asked = spark.read.json(f"{out}/requests.jsonl").collect()
    assert [(r.q_index, r.model_name, r.truth) for r in asked] == [(0, "m", ["the dog"])] and spark.read.parquet(f"{out}/graded.parquet").count() == 1


def test_stream_windows_count_each_generation_once(spark, tmp_path):
    from longspan.plans import reference_queries as r

    rows = [(1, "e", "a", "x y", ["x y"], "2024-01-01 10:00:00"), (1, "e", "a", "x y", ["x y"], "2024-01-01 10:00:00"), (2, "e", "a", "z", ["x"], "2024-01-01 23:00:00"), (3, "e", "b", None, None, "2024-01-02 00:00:00"), (4, None, None, "x", ["x"], None)]
    df = spark.createDataFrame(rows, "gen_id bigint, exp_name string, ds_name string, generated string, truth array<string>, created_at string")
    df.withColumn("created_at", F.to_timestamp("created_at")).repartition(3).write.parquet(f"{tmp_path}/generations.parquet")
    assert sorted(tuple(x) for x in r.stream_windows(spark, str(tmp_path)).collect()) == [("2024-01-01", "a", 0.5, 2), ("2024-01-02", "b", 0.0, 1)]
