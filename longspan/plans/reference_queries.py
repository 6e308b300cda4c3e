"""Named queries of the evaluation pipeline over the test tables, and their SQL. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.functions import stats, text
from longspan.operators import align, grade, lookup, pack, prompt, react, report, retrieve
from longspan.plans import pipeline
from longspan.sources.tables import keep_until_exit, shared_dir, table
from longspan.streaming import grade_stream

DATASETS = ["narrativeqa", "qasper", "multifieldqa_en", "hotpotqa", "2wikimqa", "musique", "multifieldqa_zh", "gov_report", "qmsum", "multi_news"]
KEY = ["ds_name", "q_index"]
MODEL_KEY = ["ds_name", "q_index", "model_name"]
BUDGET, RATIO, CONCAT = 120, 1.2, 1


def r6(col: str) -> Column:
    return F.round(col, 6).alias(col)


# ---- counting and splitting --------------------------------------------------------------------------------


def counted_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "ds_name", "lang", "source", "text").withColumn("ntokens", F.size(text.tokens("text"))).where("text is not null").drop("text")


def token_count_by_dataset(spark: SparkSession, d: str) -> DataFrame:
    return report.mean_int(counted_documents(spark, d), "ds_name", "ntokens")


def token_count_describe(spark: SparkSession, d: str) -> DataFrame:
    out = report.describe(counted_documents(spark, d), ["ntokens"])
    return out.select("metric", "count", F.round("mean", 9).alias("mean"), *[r6(c) for c in ("std", "min", "p25", "p50", "p75", "max")])


def token_count_describe_by_dataset(spark: SparkSession, d: str) -> DataFrame:
    out = report.describe(counted_documents(spark, d), ["ntokens"], ["ds_name"])
    return out.select("ds_name", "metric", "count", F.round("mean", 9).alias("mean"), *[r6(c) for c in ("std", "min", "p25", "p50", "p75", "max")])


def sentence_split_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "lang", "text").where("text is not null").withColumn("n", F.size(text.sentences("text")))
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_sentences"), F.max("n").alias("most"))


def record_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus", *KEY).distinct().select(*KEY, lookup.record_id().alias("record_id"))


# ---- offsets, windows, graphs ------------------------------------------------------------------------------


def alignments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "alignments", *MODEL_KEY, "sentence_quant_indices", "n_tokens").where("size(sentence_quant_indices) > 1").distinct()


def sentence_intervals(spark: SparkSession, d: str) -> DataFrame:
    one = alignments(spark, d).select(*MODEL_KEY, F.posexplode(pack.intervals(F.col("sentence_quant_indices"))).alias("sent_index", "s"))
    return one.select(*MODEL_KEY, "sent_index", "s.left", "s.right")


def quantize_enclosing(spark: SparkSession, d: str) -> DataFrame:
    """The middle half of each record's tokens, widened to sentences."""
    left, right = F.floor(F.col("n_tokens") / 4).cast("int"), F.floor(F.col("n_tokens") / 2).cast("int")
    return alignments(spark, d).withColumn("e", pack.quantize_enclosing(left, right, F.col("sentence_quant_indices"))).select(*MODEL_KEY, F.col("e.left").alias("left"), F.col("e.right").alias("right"))


def quantize_naive(spark: SparkSession, d: str) -> DataFrame:
    left, right = F.floor(F.col("n_tokens") / 4).cast("int"), F.floor(F.col("n_tokens") / 2).cast("int")
    return alignments(spark, d).withColumn("e", pack.quantize_naive(left, right, F.col("n_tokens"), 10)).select(*MODEL_KEY, F.col("e.left").alias("left"), F.col("e.right").alias("right"))


def packed(spark: SparkSession, d: str) -> DataFrame:
    return pack.with_roots(alignments(spark, d), table(spark, d, "models"))


def root_windows(spark: SparkSession, d: str) -> DataFrame:
    return pack.root_rows(packed(spark, d), MODEL_KEY)


def dag_edges(spark: SparkSession, d: str) -> DataFrame:
    return pack.leaf_rows(packed(spark, d), MODEL_KEY)


def dag_nodes(spark: SparkSession, d: str) -> DataFrame:
    return pack.graph(packed(spark, d), MODEL_KEY)[0].groupBy("model_name", "hierarchy_index").agg(F.count("*").alias("n_nodes"), F.sum(F.col("right") - F.col("left")).alias("tokens"))


def offset_checks(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("sentence_quant_indices")
    rows = table(spark, d, "alignments", *MODEL_KEY, "sentence_quant_indices", "n_sentence").where(q.isNotNull()).distinct()
    return rows.select(*MODEL_KEY, lookup.duplicates(q).alias("has_duplicates"), lookup.is_sorted(q).alias("is_sorted"), (F.size(q) == F.col("n_sentence") + 1).alias("size_fits"))


# ---- reactions ---------------------------------------------------------------------------------------------


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding beside the next one: attention before and after."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    return e.join(nxt, "vec_id").select("vec_id", stats.reaction(F.col("embedding"), F.col("after")).alias("reaction"))


def reaction_vector(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("vec_id", F.posexplode("reaction").alias("tok_pos", "reaction")).select("vec_id", "tok_pos", r6("reaction"))


def reaction_scores(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("vec_id", *[F.round(stats.aggregate_score(F.col("reaction"), how), 6).alias(how) for how in ("gmean", "mean", "max", "min")])


def span_scores(spark: SparkSession, d: str) -> DataFrame:
    """Spans of eight tokens of each vector, scored by their mean reaction."""
    v = vectors(spark, d)
    spans = v.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("sent_index")).withColumn("left", F.col("sent_index") * 8).withColumn("right", F.col("sent_index") * 8 + 8)
    return retrieve.score_slices(spans, v, ["vec_id"], "mean")


def reaction_rank_cdf(spark: SparkSession, d: str) -> DataFrame:
    s = span_scores(spark, d).withColumn("ntokens", F.col("right") - F.col("left"))
    ranked = retrieve.rank_and_cut(retrieve.score_distribution(s, ["vec_id"]), ["vec_id"], 1_000_000)
    return ranked.select("vec_id", "sent_index", "rank", r6("score"), r6("mean"), r6("std"), F.round("cdf", 5).alias("cdf"))


def group_gmean(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "generations", "ds_name", "elapsed_time").where("elapsed_time is not null")
    return report.group_gmean(e, ["ds_name"], "elapsed_time").select("ds_name", r6("gmean"))


# ---- retrieval ---------------------------------------------------------------------------------------------


def lexical_spans(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each context with the share of their words that the question holds."""
    corpus = table(spark, d, "corpus", *KEY, "input", "context").where("context is not null and ds_name is not null and q_index is not null").dropDuplicates(KEY)
    spans = pipeline.sentence_spans(corpus.withColumn("q", text.normalized_tokens("input")), "q")
    share = lambda words: F.when(F.size(words) > 0, F.round(F.size(F.filter(words, lambda w: F.array_contains("q", w))) / F.size(words), 6)).otherwise(0.0)
    return spans.withColumn("score", text.let(text.normalized_tokens("sentence"), share)).drop("q")


def retrieve_ratio_budget(spark: SparkSession, d: str) -> DataFrame:
    cut = retrieve.rank_and_cut(lexical_spans(spark, d), KEY, BUDGET, RATIO, CONCAT)
    return cut.select(*KEY, "sent_index", "left", "right", "score", "rank", "cum_tokens", "picked")


def retrieve_max_budget(spark: SparkSession, d: str) -> DataFrame:
    cut = retrieve.rank_and_cut(lexical_spans(spark, d), KEY, BUDGET)
    return cut.select(*KEY, "sent_index", "rank", "cum_tokens", "picked")


def compression_rate(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.compression(retrieve.rank_and_cut(lexical_spans(spark, d), KEY, BUDGET, RATIO, CONCAT), KEY).withColumn("compression_rate", F.round("compression_rate", 6))


def merge_adjacent(spark: SparkSession, d: str) -> DataFrame:
    cut = retrieve.rank_and_cut(lexical_spans(spark, d), KEY, BUDGET, RATIO, CONCAT)
    return retrieve.merge_adjacent(cut.where("picked"), KEY)


def top_sentence(spark: SparkSession, d: str) -> DataFrame:
    """The one sentence of each context of the highest score."""
    cut = retrieve.rank_and_cut(lexical_spans(spark, d), KEY, 1_000_000_000)
    return cut.where("rank = 0").select(*KEY, "sent_index", "sentence", "score")


def retrieve_by_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest other vectors of every vector whose id is divisible by 100."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    near = retrieve.nearest(e.where("vec_id % 100 = 0"), e, 6, "vec_id", "vec_id", "embedding")
    own = near.where("query_vec_id <> vec_id")
    w = F.row_number().over(retrieve.Window.partitionBy("query_vec_id").orderBy("distance", "vec_id"))
    return own.withColumn("rank", w).where("rank <= 5").select("query_vec_id", "vec_id", "rank", r6("distance"))


# ---- prompts -----------------------------------------------------------------------------------------------

TEMPLATE = "Text: {context}\n\nQuestion: {input}\nAnswer:"


def prompts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corpus", *KEY, "input", "context").where("context is not null").distinct()
    return c.select(*KEY, prompt.fill(TEMPLATE, context=F.col("context"), input=F.coalesce("input", F.lit(""))).alias("prompt"))


def prompt_fill(spark: SparkSession, d: str) -> DataFrame:
    return prompts(spark, d)


def chat_wrap(spark: SparkSession, d: str) -> DataFrame:
    return prompts(spark, d).select(*KEY, prompt.chat_wrap(F.col("prompt")).alias("prompt"))


def deferred_requests(spark: SparkSession, d: str) -> DataFrame:
    out = prompt.deferred_requests(prompts(spark, d)).join(table(spark, d, "datasets", "ds_name", "max_gen_len"), "ds_name", "left")
    return out.select(*KEY, F.length("generated_str").alias("n_chars"), "generated_ntokens", "purely_generated_str", "purely_generated_ntokens", "max_gen_len")


# ---- grading -----------------------------------------------------------------------------------------------


def pairs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "generations", "gen_id", "generated", "truth", *more).distinct()


def normalize_answer(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("gen_id", text.normalize_answer("generated").alias("normalized"))


def qa_f1(spark: SparkSession, d: str) -> DataFrame:
    one = pairs(spark, d).select("gen_id", "generated", F.posexplode("truth").alias("truth_index", "t")).where("t is not null")
    return one.select("gen_id", "truth_index", F.round(text.let(text.normalized_tokens("generated"), lambda p: text.let(text.normalized_tokens("t"), lambda t: text.token_f1(p, t))), 6).alias("f1"))


def qa_f1_multi_truth(spark: SparkSession, d: str) -> DataFrame:
    return grade.grade(pairs(spark, d)).select("gen_id", r6("score"))


def best_of_generations(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs(spark, d, "model_name", "ds_name", "q_index")
    return grade.grade_best(rows, MODEL_KEY).select(*MODEL_KEY, r6("score"), "n_generations")


def graded(spark: SparkSession, d: str) -> DataFrame:
    rows = grade.grade(pairs(spark, d, "model_name", "exp_type", "ds_name", "q_index"))
    return rows.join(table(spark, d, "datasets", "ds_name", "ds_class"), "ds_name")


def score_pivot(spark: SparkSession, d: str) -> DataFrame:
    out = report.pivot(graded(spark, d), ["model_name", "exp_type"], "ds_name", DATASETS, F.avg("score") * 100)
    return out.select("model_name", "exp_type", *[F.round(c, 6).alias(f"ds_{c}") for c in DATASETS])


def macro_mean_by_class(spark: SparkSession, d: str) -> DataFrame:
    return report.macro_mean(graded(spark, d), ["model_name", "exp_type"], "ds_class", "ds_name", "score", 100.0).select("model_name", "exp_type", "ds_class", r6("score"), "n_members")


def mean_transpose(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs(spark, d, "ds_name", "elapsed_time", "generated_ntokens")
    out = report.mean_transpose(grade.grade(rows), "ds_name", DATASETS, ["score", "elapsed_time", "generated_ntokens"])
    return out.select("metric", *[F.round(c, 9).alias(f"ds_{c}") for c in DATASETS])


def token_bag(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select(F.explode(text.normalized_tokens("generated")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def edit_distances(spark: SparkSession, d: str, plain: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    texts = [plain(F.coalesce(c, F.lit(""))) for c in (F.get("truth", F.lit(0)), F.col("generated"))]
    rows = pairs(spark, d, "ds_name").select("ds_name", F.levenshtein(*texts).alias("dist"))
    out = rows.groupBy("ds_name").agg(F.avg("dist").alias("mean_dist"), F.coalesce(F.sum("dist") / F.nullif(F.count(F.when(F.col("dist") > 0, 1)), F.lit(0)), F.lit(0.0)).alias("non_zero_mean_dist"))
    return out.select("ds_name", r6("mean_dist"), r6("non_zero_mean_dist"))


def edit_distance_quality(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance of each answer to its first truth, other than ASCII characters taken alike as in its SQL; ``edit_distance_exact`` compares the texts themselves."""
    return edit_distances(spark, d, lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?"))


def edit_distance_exact(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance of each answer to its first truth in code points, in every script. No SQL: DuckDB's function counts bytes."""
    return edit_distances(spark, d)


def evidence_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "corpus", *KEY, "context", "answers").where("answers is not null").distinct()
    return grade.evidence_recall(rows, "context", "answers").select(*KEY, r6("recall"))


# ---- reports -----------------------------------------------------------------------------------------------

METRICS = ["success_rate", "mean_dist", "non_zero_mean_dist"]


def reports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "alignments", *MODEL_KEY, "git_hash", *METRICS).distinct()


def alignment_report(spark: SparkSession, d: str) -> DataFrame:
    return report.mean_by(reports(spark, d), ["model_name", "ds_name"], METRICS, 10)


def alignment_pivot(spark: SparkSession, d: str) -> DataFrame:
    means = report.mean_by(reports(spark, d), ["model_name", "ds_name"], ["success_rate"], 10)
    out = report.unique_pivot(means, ["model_name"], "ds_name", DATASETS, "success_rate")
    return out.select("model_name", *[F.col(c).alias(f"ds_{c}") for c in DATASETS])


def metric_melt_pivot(spark: SparkSession, d: str) -> DataFrame:
    means = report.mean_by(reports(spark, d), ["model_name", "ds_name"], METRICS[1:], 10)
    out = report.unique_pivot(report.melt(means, ["model_name", "ds_name"], METRICS[1:]), ["model_name", "metric"], "ds_name", DATASETS, "value")
    return out.select("model_name", "metric", *[F.col(c).alias(f"ds_{c}") for c in DATASETS])


def global_means(spark: SparkSession, d: str) -> DataFrame:
    return report.global_means(reports(spark, d), METRICS).select(*[r6(c) for c in METRICS])


def success_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "alignments", *MODEL_KEY, "n_sentence", "n_sentence_quant_success").distinct()
    return rows.select(*MODEL_KEY, text.success_rate(F.col("n_sentence_quant_success"), F.col("n_sentence")).alias("rate"))


def elapsed_describe(spark: SparkSession, d: str) -> DataFrame:
    out = report.describe(pairs(spark, d, "ds_name", "elapsed_time", "generated_ntokens"), ["elapsed_time", "generated_ntokens"], ["ds_name"])
    return out.select("ds_name", "metric", "count", F.round("mean", 9).alias("mean"), *[r6(c) for c in ("std", "min", "p25", "p50", "p75", "max")])


def throughput_report(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs(spark, d, "query", "model_name", "ds_name", "elapsed_time", "generated_ntokens").withColumn("prompt_tokens", F.size(text.tokens(F.coalesce("query", F.lit("")))))
    out = report.throughput(rows, ["model_name", "ds_name"], "elapsed_time", "prompt_tokens", "generated_ntokens")
    return out.select("model_name", "ds_name", "num_requests", r6("elapsed_time"), "total_num_tokens", F.round("requests_per_second", 4).alias("requests_per_second"), F.round("tokens_per_second", 4).alias("tokens_per_second"))


def token_count_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "token_counts", "ds_name", "q_index", "model_name", "ntokens").where("ntokens > 0").withColumn("ds_name", F.lower(F.trim("ds_name"))).distinct()
    return rows.groupBy("model_name", "ds_name").agg(F.floor(F.avg("ntokens")).cast("int").alias("ntokens"), F.count("*").alias("n"))


def dataset_classes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the corpus by class, the class decided by name, beside the dimension's own."""
    single = F.when(F.col("ds_name").isin("narrativeqa", "qasper", "multifieldqa_en"), "SDoc").when(F.col("ds_name").isin("hotpotqa", "musique", "2wikimqa"), "MDoc").otherwise("other")
    rows = table(spark, d, "corpus", "ds_name").join(table(spark, d, "datasets", "ds_name", "ds_class", "ord"), "ds_name", "left")
    return rows.groupBy("ord", "ds_name", "ds_class", single.alias("by_name")).agg(F.count("*").alias("n"))


# ---- keyed lookups -----------------------------------------------------------------------------------------


def corpus_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus", *KEY).distinct()


def pending_questions(spark: SparkSession, d: str) -> DataFrame:
    return lookup.pending(corpus_keys(spark, d), table(spark, d, "alignments", *KEY), KEY)


def done_questions(spark: SparkSession, d: str) -> DataFrame:
    return lookup.already_done(corpus_keys(spark, d), table(spark, d, "alignments", *KEY), KEY)


def target_join(spark: SparkSession, d: str) -> DataFrame:
    out = lookup.with_targets(corpus_keys(spark, d), table(spark, d, "target_sentences", *KEY, "target_sentences").where("target_sentences is not null"), KEY)
    return out.select(*KEY, F.size("target_sentences").alias("n_target"))


# ---- Python boundaries, checked by rows --------------------------------------------------------------------


def align_success(spark: SparkSession, d: str) -> DataFrame:
    corpus = table(spark, d, "corpus", *KEY, "context").where("context is not null").distinct()
    rows = corpus.select(*KEY, "context", text.sentences("context").alias("target_sentences"))
    return align.align_corpus(rows, KEY).select(*KEY, "n_tokens", "n_sentence", "n_sentence_quant_success", "success_rate", "mean_dist", "non_zero_mean_dist")


def align_fixed_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The same with a tokenizer whose pieces do not end where sentences do."""
    rows = lookup.with_targets(table(spark, d, "corpus", *KEY, "context").where("context is not null").distinct(), table(spark, d, "target_sentences", *KEY, "target_sentences"), KEY)
    return align.align_corpus(rows, KEY, align.FixedTokenizer).select(*KEY, "n_tokens", "n_sentence", "n_sentence_quant_success", "success_rate")


def model_windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "models", "model_name", "window_tokens", "root_split_offset")


def attention_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """All stages from corpus to score with the offline providers: sentences aligned with tokens, in the root windows of each model and to the answer length of each dataset."""
    corpus = table(spark, d, "corpus", *KEY, "input", "context", "answers").where("context is not null")
    out = pipeline.evaluate(corpus, models=model_windows(spark, d), datasets=table(spark, d, "datasets", "ds_name", "max_gen_len"), make_tokenizer=align.WordTokenizer)
    return out["graded"].select(*MODEL_KEY, "purely_generated_str", "purely_generated_ntokens", F.round("score", 6).alias("score"))


def reacted(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each context, ranked by how the question changes the attention on them within the root windows of each model."""
    corpus = table(spark, d, "corpus", *KEY, "input", "context", "answers").where("context is not null")
    settings = pipeline.Settings(budget=BUDGET, compression_ratio=RATIO, concat_len=CONCAT, score="mean", score_digits=9)
    return pipeline.retrieved_sentences(corpus, settings, pipeline.Stages(None), react.OverlapProvider, model_windows(spark, d))[2]


def off_ties(col: str) -> Column:
    """Six of the nine digits of a score; what lies just between two values goes up in every engine."""
    return F.round(F.col(col) + 1e-12, 6).alias(col)


def pipeline_roots(spark: SparkSession, d: str) -> DataFrame:
    return reacted(spark, d).select(*MODEL_KEY, "sent_index", off_ties("score"), "rank", "cum_tokens", "picked")


def reaction_teaser(spark: SparkSession, d: str) -> DataFrame:
    """The one sentence of each context and model that the question moves most."""
    return reacted(spark, d).where("rank = 0").select(*MODEL_KEY, "sent_index", "sentence", off_ties("score"))


def streamed(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """The generations as a stream of files, and a folder for its results and state, which goes with the process."""
    import uuid

    schema = spark.read.parquet(f"{d}/generations.parquet").schema
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    keep_until_exit(spark, out)
    return spark.readStream.schema(schema).parquet(f"{d}/generations.parquet*"), out


def stream_grades(spark: SparkSession, d: str) -> DataFrame:
    """Generations graded as a stream of files, read back from the sink."""
    stream, out = streamed(spark, d)
    grade_stream.start(grade.grade(stream).select("gen_id", "score"), f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.schema("gen_id bigint, score double").parquet(f"{out}/rows").select("gen_id", r6("score")).distinct()


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Mean score by dataset and day of creation over the stream, each generation graded once."""
    stream, out = streamed(spark, d)
    once = grade_stream.grade_once(stream.where("created_at is not null"), "365 days", "created_at")
    grade_stream.run_updates(grade_stream.mean_by_window(once, "1 day", "created_at"), f"{out}/rows", f"{out}/state")
    rows = spark.read.schema("window struct<start:timestamp,end:timestamp>, ds_name string, score double, n bigint, batch bigint").parquet(f"{out}/rows")
    last = grade_stream.last_state(rows.select("window.start", "ds_name", "score", "n", "batch"), ["start", "ds_name"])
    return last.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "ds_name", off_ties("score"), "n")


_NAMES = (
    "token_count_by_dataset token_count_describe token_count_describe_by_dataset sentence_split_stats record_ids sentence_intervals quantize_enclosing quantize_naive root_windows dag_edges dag_nodes offset_checks "
    "reaction_vector reaction_scores reaction_rank_cdf group_gmean retrieve_ratio_budget retrieve_max_budget compression_rate merge_adjacent top_sentence retrieve_by_cosine prompt_fill chat_wrap deferred_requests "
    "normalize_answer qa_f1 qa_f1_multi_truth best_of_generations score_pivot macro_mean_by_class mean_transpose token_bag edit_distance_quality edit_distance_exact evidence_recall alignment_report alignment_pivot metric_melt_pivot "
    "global_means success_rates elapsed_describe throughput_report token_count_report dataset_classes pending_questions done_questions target_join align_success align_fixed_pieces attention_pipeline pipeline_roots reaction_teaser stream_grades stream_windows"
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: globals()[n] for n in _NAMES.split()}


# ---- SQL ---------------------------------------------------------------------------------------------------


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TOKENS = "regexp_extract_all({0}, '[ \\t\\n\\r\\f]*[^ \\t\\n\\r\\f]+')"
_SENTENCES = "list_filter(list_transform(regexp_extract_all({0}, '[^.!?。！？]+[.!?。！？]*'), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '')"


def _norm(col: str) -> str:
    plain = f"translate(lower(coalesce({col}, '')), {_quote(text.PUNCTUATION)}, '')"
    return f"list_filter(string_split(regexp_replace({plain}, '{text.WHITE_SPACE}', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the'))"


def _f1(p: str, t: str) -> str:
    same = f"coalesce(list_sum(list_transform(list_distinct(list_intersect({p}, {t})), lambda w: least(len(list_filter({p}, lambda x: x = w)), len(list_filter({t}, lambda x: x = w))))), 0)"
    return f"CASE WHEN {same} = 0 THEN 0.0 ELSE 2 * ({same}::DOUBLE / len({p})) * ({same}::DOUBLE / len({t})) / (({same}::DOUBLE / len({p})) + ({same}::DOUBLE / len({t}))) END"


_PAIRS = f"""g AS (SELECT DISTINCT gen_id, generated, truth, model_name, exp_type, ds_name, q_index, query, elapsed_time, generated_ntokens FROM generations),
    e AS (SELECT gen_id, p, {_norm("t")} AS t, i FROM (SELECT gen_id, {_norm("generated")} AS p, unnest(truth) AS t, unnest(range(len(truth))) AS i FROM g) WHERE t IS NOT NULL),
    f AS (SELECT gen_id, i, {_f1("p", "t")} AS f1 FROM e),
    s AS (SELECT g.*, coalesce(m.score, 0.0) AS score FROM g LEFT JOIN (SELECT gen_id, max(f1) AS score FROM f GROUP BY gen_id) m USING (gen_id))"""
_ALIGNED = "a AS (SELECT DISTINCT ds_name, q_index, model_name, sentence_quant_indices AS s, n_tokens AS n FROM alignments WHERE len(sentence_quant_indices) > 1)"
_LEAVES = f"{_ALIGNED}, k AS (SELECT ds_name, q_index, model_name, s, n, unnest(range(len(s) - 1)) AS i FROM a), l AS (SELECT ds_name, q_index, model_name, s, CAST(i AS INTEGER) AS sent_index, s[i + 1] AS l, s[i + 2] AS r FROM k)"
_ROOTS = f"""{_LEAVES}, m AS (SELECT l.*, window_tokens - root_split_offset AS w, row_number() OVER (PARTITION BY ds_name, q_index, model_name, s ORDER BY sent_index) AS pos, count(*) OVER (PARTITION BY ds_name, q_index, model_name, s) AS last FROM l JOIN models USING (model_name)),
    p AS (
        SELECT ds_name, q_index, model_name, s, w, pos, last, l AS root, r AS prev, NULL::INTEGER AS el, NULL::INTEGER AS er FROM m WHERE pos = 1
        UNION ALL
        SELECT m.ds_name, m.q_index, m.model_name, m.s, m.w, m.pos, m.last, CASE WHEN m.r - p.root > m.w AND p.prev > p.root THEN p.prev ELSE p.root END, m.r,
            CASE WHEN m.r - p.root > m.w AND p.prev > p.root THEN p.root END, CASE WHEN m.r - p.root > m.w AND p.prev > p.root THEN p.prev END
        FROM p JOIN m ON m.ds_name = p.ds_name AND m.q_index = p.q_index AND m.model_name = p.model_name AND m.s = p.s AND m.pos = p.pos + 1),
    roots AS (SELECT ds_name, q_index, model_name, s, w, el AS l, er AS r FROM p WHERE el IS NOT NULL UNION ALL SELECT ds_name, q_index, model_name, s, w, root, prev FROM p WHERE pos = last AND prev > root)"""
_SPANS = f"""c AS (SELECT DISTINCT ds_name, q_index, input, context FROM corpus WHERE context IS NOT NULL AND ds_name IS NOT NULL AND q_index IS NOT NULL),
    x AS (SELECT ds_name, q_index, {_norm("input")} AS q, {_SENTENCES.format("context")} AS ss FROM c),
    y AS (SELECT ds_name, q_index, q, unnest(ss) AS sentence, CAST(unnest(range(len(ss))) AS INTEGER) AS sent_index FROM x),
    z AS (SELECT *, len({_TOKENS.format("sentence")}) AS ntokens, {_norm("sentence")} AS ws FROM y),
    sp AS (SELECT ds_name, q_index, sent_index, sentence, ntokens, coalesce(sum(ntokens) OVER (PARTITION BY ds_name, q_index ORDER BY sent_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
        CASE WHEN len(ws) > 0 THEN round(len(list_filter(ws, lambda w: list_contains(q, w)))::DOUBLE / len(ws), 6) ELSE 0.0 END AS score FROM z),
    rk AS (SELECT *, row_number() OVER (PARTITION BY ds_name, q_index ORDER BY score DESC, sent_index) - 1 AS rank, count(*) OVER (PARTITION BY ds_name, q_index) AS n,
        sum(ntokens) OVER (PARTITION BY ds_name, q_index ORDER BY score DESC, sent_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM sp),
    cut AS (SELECT *, cum < {BUDGET} - {CONCAT} * floor(n / {RATIO}) AND rank < floor(n / {RATIO}) AS picked FROM rk)"""
_WORDS_OF = "list_transform({0}, lambda t: lower(trim(t, ' ' || chr(9) || chr(10) || chr(12) || chr(13))))"
_WINDOWS = f"""c AS (SELECT DISTINCT ds_name, q_index, input, context FROM corpus WHERE context IS NOT NULL AND ds_name IS NOT NULL AND q_index IS NOT NULL),
    x AS (SELECT ds_name, q_index, {_WORDS_OF.format(_TOKENS.format("coalesce(input, '')"))} AS q, {_SENTENCES.format("context")} AS ss FROM c),
    y AS (SELECT ds_name, q_index, q, unnest(ss) AS sentence, CAST(unnest(range(len(ss))) AS INTEGER) AS sent_index FROM x),
    z AS (SELECT ds_name, q_index, sent_index, sentence, len({_TOKENS.format("sentence")}) AS ntokens, len(list_filter({_WORDS_OF.format(_TOKENS.format("sentence"))}, lambda w: list_contains(q, w))) AS same FROM y),
    sp AS (SELECT *, CAST(sum(ntokens) OVER (PARTITION BY ds_name, q_index ORDER BY sent_index) AS INTEGER) AS r FROM z),
    a AS (SELECT ds_name, q_index, model_name, list_prepend(0, list(r ORDER BY sent_index)) AS s, max(r) AS n FROM sp CROSS JOIN models GROUP BY ds_name, q_index, model_name)"""
_REACTED = f"""{_ROOTS.replace(_ALIGNED, _WINDOWS)},
    inside AS (SELECT o.ds_name, o.q_index, o.model_name, o.l AS root, o.r - o.l AS n, sp.sent_index, sp.sentence, sp.ntokens, sp.same, sum(sp.same) OVER (PARTITION BY o.ds_name, o.q_index, o.model_name, o.l) AS m
        FROM roots o JOIN sp ON sp.ds_name = o.ds_name AND sp.q_index = o.q_index AND sp.r - sp.ntokens >= o.l AND sp.r <= o.r),
    rs AS (SELECT *, round((same * abs(2.0::DOUBLE / (n + m) - 1.0::DOUBLE / n) + (ntokens - same) * abs(1.0::DOUBLE / (n + m) - 1.0::DOUBLE / n)) / 2 / ntokens, 9) AS score FROM inside),
    rr AS (SELECT *, row_number() OVER w - 1 AS rank, count(*) OVER (PARTITION BY ds_name, q_index, model_name) AS all_, sum(ntokens) OVER (PARTITION BY ds_name, q_index, model_name ORDER BY score DESC, sent_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
        FROM rs WINDOW w AS (PARTITION BY ds_name, q_index, model_name ORDER BY score DESC, sent_index))"""
_VECTORS = """v AS (SELECT a.vec_id, list_transform(range(1, len(a.embedding) + 1), lambda i: abs(CAST(b.embedding[i] AS DOUBLE) - CAST(a.embedding[i] AS DOUBLE))) AS r
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""
_DESCRIBE = "count({0}) AS count, round(avg({0}), 9) AS mean, round(stddev_samp({0}), 6) AS std, round(min({0})::DOUBLE, 6) AS min, round(quantile_cont({0}::DOUBLE, 0.25), 6) AS p25, round(quantile_cont({0}::DOUBLE, 0.5), 6) AS p50, round(quantile_cont({0}::DOUBLE, 0.75), 6) AS p75, round(max({0})::DOUBLE, 6) AS max"


def _cells(value: str, digits: str = "6") -> str:
    return ", ".join(f"round(avg(CASE WHEN ds_name = '{c}' THEN {value} END), {digits}) AS ds_{c}" for c in DATASETS)


_MEANS = "m AS (SELECT model_name, ds_name, round_even(avg(success_rate), 10) AS success_rate, round_even(avg(mean_dist), 10) AS mean_dist, round_even(avg(non_zero_mean_dist), 10) AS non_zero_mean_dist FROM (SELECT DISTINCT ds_name, q_index, model_name, git_hash, success_rate, mean_dist, non_zero_mean_dist FROM alignments) GROUP BY ALL)"
_PROMPT = "SELECT DISTINCT ds_name, q_index, 'Text: ' || context || chr(10) || chr(10) || 'Question: ' || coalesce(input, '') || chr(10) || 'Answer:' AS prompt FROM corpus WHERE context IS NOT NULL"
_ERF = "(1 - (0.254829592 * t + -0.284496736 * t * t + 1.421413741 * t * t * t + -1.453152027 * t * t * t * t + 1.061405429 * t * t * t * t * t) * exp(-z * z))"

ORACLE_SQL: dict[str, str] = {
    "token_count_by_dataset": f"SELECT ds_name, CAST(floor(avg(len({_TOKENS.format('text')}))) AS INTEGER) AS ntokens FROM documents WHERE text IS NOT NULL GROUP BY ds_name",
    "token_count_describe": f"SELECT 'ntokens' AS metric, {_DESCRIBE.format('n')} FROM (SELECT len({_TOKENS.format('text')}) AS n FROM documents WHERE text IS NOT NULL)",
    "token_count_describe_by_dataset": f"SELECT ds_name, 'ntokens' AS metric, {_DESCRIBE.format('n')} FROM (SELECT ds_name, len({_TOKENS.format('text')}) AS n FROM documents WHERE text IS NOT NULL) GROUP BY ds_name",
    "sentence_split_stats": f"SELECT lang, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_sentences, CAST(max(n) AS INTEGER) AS most FROM (SELECT lang, len({_SENTENCES.format('text')}) AS n FROM documents WHERE text IS NOT NULL) GROUP BY lang",
    "record_ids": "SELECT DISTINCT ds_name, q_index, ds_name || CASE WHEN q_index < 1000 THEN lpad(CAST(q_index AS VARCHAR), 3, '0') ELSE CAST(q_index AS VARCHAR) END AS record_id FROM corpus",
    "sentence_intervals": f'WITH {_LEAVES} SELECT ds_name, q_index, model_name, sent_index, l AS "left", r AS "right" FROM l',
    "quantize_enclosing": f'WITH {_ALIGNED} SELECT ds_name, q_index, model_name, list_max(list_filter(s, lambda x: x <= floor(n / 4.0))) AS "left", list_min(list_filter(s, lambda x: x >= floor(n / 2.0))) AS "right" FROM a',
    "quantize_naive": f'WITH {_ALIGNED} SELECT ds_name, q_index, model_name, CAST(floor(floor(n / 4.0) / 10) * 10 AS INTEGER) AS "left", CASE WHEN floor(n / 2.0) = n THEN n ELSE CAST(floor(floor(n / 2.0) / 10) * 10 AS INTEGER) END AS "right" FROM a',
    "root_windows": f'WITH RECURSIVE {_ROOTS} SELECT ds_name, q_index, model_name, CAST(row_number() OVER (PARTITION BY ds_name, q_index, model_name, s ORDER BY l) - 1 AS INTEGER) AS root_index, l AS "left", r AS "right", r - l > w AS oversize FROM roots',
    "dag_edges": f"""WITH RECURSIVE {_ROOTS}, d AS (SELECT l.*, o.l AS pl, o.r AS pr FROM l LEFT JOIN roots o ON l.ds_name = o.ds_name AND l.q_index = o.q_index AND l.model_name = o.model_name AND l.s = o.s AND o.l <= l.l AND l.l < o.r),
        z AS (SELECT ds_name, q_index, model_name, s, max(struct_pack(l := l, r := r)) AS o FROM roots GROUP BY ALL)
        SELECT d.ds_name, d.q_index, d.model_name, sent_index, d.l AS "left", d.r AS "right", coalesce(pl, z.o.l) AS parent_left, coalesce(pr, z.o.r) AS parent_right
        FROM d JOIN models USING (model_name) LEFT JOIN z ON d.ds_name = z.ds_name AND d.q_index = z.q_index AND d.model_name = z.model_name AND d.s = z.s""",
    "dag_nodes": f"""WITH RECURSIVE {_ROOTS} SELECT model_name, -1 AS hierarchy_index, count(*) AS n_nodes, CAST(sum(r - l) AS BIGINT) AS tokens FROM roots GROUP BY model_name
        UNION ALL SELECT model_name, 0, count(*), CAST(sum(r - l) AS BIGINT) FROM l JOIN models USING (model_name) GROUP BY model_name""",
    "offset_checks": "SELECT DISTINCT ds_name, q_index, model_name, len(sentence_quant_indices) <> len(list_distinct(sentence_quant_indices)) AS has_duplicates, sentence_quant_indices = list_sort(sentence_quant_indices) AS is_sorted, len(sentence_quant_indices) = n_sentence + 1 AS size_fits FROM alignments WHERE sentence_quant_indices IS NOT NULL",
    "reaction_vector": f"WITH {_VECTORS} SELECT vec_id, CAST(unnest(range(len(r))) AS INTEGER) AS tok_pos, round(unnest(r), 6) AS reaction FROM v",
    "reaction_scores": f"WITH {_VECTORS} SELECT vec_id, round(CASE WHEN list_min(r) <= 0 THEN 0.0 ELSE exp(list_avg(list_transform(list_filter(r, lambda x: x > 0), lambda x: ln(x)))) END, 6) AS gmean, round(list_avg(r), 6) AS mean, round(list_max(r), 6) AS max, round(list_min(r), 6) AS min FROM v",
    "reaction_rank_cdf": f"""WITH {_VECTORS}, k AS (SELECT vec_id, unnest(range(8)) AS i, r FROM v), s AS (SELECT vec_id, CAST(i AS INTEGER) AS sent_index, list_avg(list_slice(r, i * 8 + 1, i * 8 + 8)) AS score FROM k),
        d AS (SELECT *, avg(score) OVER w AS mean, stddev_pop(score) OVER w AS std, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, sent_index) - 1 AS rank FROM s WINDOW w AS (PARTITION BY vec_id)),
        h AS (SELECT *, (score - mean) / (std * sqrt(2.0)) AS z, 1 / (1 + 0.3275911 * abs((score - mean) / (std * sqrt(2.0)))) AS t FROM d)
        SELECT vec_id, sent_index, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, round(mean, 6) AS mean, round(std, 6) AS std, round((1 + sign(z) * {_ERF}) / 2, 5) AS cdf FROM h""",
    "group_gmean": "SELECT ds_name, round(CASE WHEN min(elapsed_time) <= 0 THEN 0.0 ELSE exp(avg(ln(CASE WHEN elapsed_time > 0 THEN elapsed_time END))) END, 6) AS gmean FROM generations WHERE elapsed_time IS NOT NULL GROUP BY ds_name",
    "retrieve_ratio_budget": f'WITH {_SPANS} SELECT ds_name, q_index, sent_index, CAST(l AS INTEGER) AS "left", CAST(l + ntokens AS INTEGER) AS "right", score, CAST(rank AS INTEGER) AS rank, CAST(cum AS BIGINT) AS cum_tokens, picked FROM cut',
    "retrieve_max_budget": f"WITH {_SPANS} SELECT ds_name, q_index, sent_index, CAST(rank AS INTEGER) AS rank, CAST(cum AS BIGINT) AS cum_tokens, cum < {BUDGET} AS picked FROM cut",
    "compression_rate": f"WITH {_SPANS} SELECT ds_name, q_index, CAST(sum(ntokens) AS BIGINT) AS ntokens, CAST(coalesce(sum(ntokens) FILTER (picked), 0) AS BIGINT) AS retrieved_ntokens, count(*) FILTER (picked) AS n_picked, CASE WHEN count(*) FILTER (picked) > 0 AND sum(ntokens) FILTER (picked) > 0 THEN round(sum(ntokens)::DOUBLE / sum(ntokens) FILTER (picked), 6) ELSE CAST('inf' AS DOUBLE) END AS compression_rate FROM cut GROUP BY ds_name, q_index",
    "merge_adjacent": f"""WITH {_SPANS}, b AS (SELECT ds_name, q_index, l, l + ntokens AS r, sentence, coalesce(l > max(l + ntokens) OVER (PARTITION BY ds_name, q_index ORDER BY l, l + ntokens, sentence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM cut WHERE picked),
        i AS (SELECT *, sum(new::INT) OVER (PARTITION BY ds_name, q_index ORDER BY l, r, sentence) - 1 AS run FROM b)
        SELECT ds_name, q_index, CAST(run AS BIGINT) AS run, CAST(min(l) AS INTEGER) AS "left", CAST(max(r) AS INTEGER) AS "right", string_agg(sentence, ' ' ORDER BY l, r, sentence) AS sentence FROM i GROUP BY ds_name, q_index, run""",
    "top_sentence": f"WITH {_SPANS} SELECT ds_name, q_index, sent_index, sentence, score FROM cut WHERE rank = 0",
    "retrieve_by_cosine": """WITH d AS (SELECT q.vec_id AS query_vec_id, i.vec_id, 1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) AS distance FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_vec_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d) SELECT query_vec_id, vec_id, rank, round(distance, 6) AS distance FROM r WHERE rank <= 5""",
    "prompt_fill": _PROMPT,
    "chat_wrap": f"SELECT ds_name, q_index, '[INST] ' || prompt || ' [/INST]' AS prompt FROM ({_PROMPT})",
    "deferred_requests": f"SELECT p.ds_name, q_index, CAST(length(prompt) AS INTEGER) AS n_chars, -1 AS generated_ntokens, '' AS purely_generated_str, 0 AS purely_generated_ntokens, max_gen_len FROM ({_PROMPT}) p LEFT JOIN datasets USING (ds_name)",
    "normalize_answer": f"SELECT DISTINCT gen_id, coalesce(list_aggregate({_norm('generated')}, 'string_agg', ' '), '') AS normalized FROM generations",
    "qa_f1": f"WITH {_PAIRS} SELECT gen_id, CAST(i AS INTEGER) AS truth_index, round(f1, 6) AS f1 FROM f",
    "qa_f1_multi_truth": f"WITH {_PAIRS} SELECT gen_id, round(score, 6) AS score FROM s",
    "best_of_generations": f"WITH {_PAIRS} SELECT ds_name, q_index, model_name, round(max(score), 6) AS score, count(*) AS n_generations FROM s GROUP BY ALL",
    "score_pivot": f"WITH {_PAIRS} SELECT model_name, exp_type, {_cells('score * 100')} FROM s JOIN datasets USING (ds_name) GROUP BY model_name, exp_type",
    "macro_mean_by_class": f"WITH {_PAIRS}, m AS (SELECT model_name, exp_type, ds_class, ds_name, avg(score) * 100 AS v FROM s JOIN datasets USING (ds_name) GROUP BY ALL) SELECT model_name, exp_type, ds_class, round(avg(v), 6) AS score, count(*) AS n_members FROM m GROUP BY ALL",
    "mean_transpose": f"WITH {_PAIRS}, u AS (SELECT ds_name, 'score' AS metric, score AS v FROM s UNION ALL SELECT ds_name, 'elapsed_time', elapsed_time FROM s UNION ALL SELECT ds_name, 'generated_ntokens', generated_ntokens FROM s) SELECT metric, {_cells('v', '9')} FROM u GROUP BY metric",
    "token_bag": f"SELECT token, count(*) AS n FROM (SELECT unnest({_norm('generated')}) AS token FROM (SELECT DISTINCT gen_id, generated, truth FROM generations)) GROUP BY token",
    "edit_distance_quality": """WITH g AS (SELECT DISTINCT gen_id, generated, truth, ds_name FROM generations),
        d AS (SELECT ds_name, levenshtein(regexp_replace(coalesce(truth[1], ''), '[^\\x00-\\x7F]', '?', 'g'), regexp_replace(coalesce(generated, ''), '[^\\x00-\\x7F]', '?', 'g')) AS dist FROM g)
        SELECT ds_name, round(avg(dist), 6) AS mean_dist, round(coalesce(sum(dist)::DOUBLE / nullif(count(*) FILTER (dist > 0), 0), 0.0), 6) AS non_zero_mean_dist FROM d GROUP BY ds_name""",
    "evidence_recall": """WITH c AS (SELECT DISTINCT ds_name, q_index, coalesce(context, '') AS context, list_filter(answers, lambda x: x IS NOT NULL AND NOT contains(x, '<invalid_evidence>')) AS e FROM corpus WHERE answers IS NOT NULL)
        SELECT ds_name, q_index, CASE WHEN len(e) > 0 THEN round(len(list_filter(e, lambda x: contains(context, x)))::DOUBLE / len(e), 6) END AS recall FROM c""",
    "alignment_report": f"WITH {_MEANS} SELECT * FROM m",
    "alignment_pivot": f"WITH {_MEANS} SELECT model_name, " + ", ".join(f"max(CASE WHEN ds_name = '{c}' THEN success_rate END) AS ds_{c}" for c in DATASETS) + " FROM m GROUP BY model_name",
    "metric_melt_pivot": f"WITH {_MEANS}, u AS (SELECT model_name, ds_name, 'mean_dist' AS metric, mean_dist AS v FROM m UNION ALL SELECT model_name, ds_name, 'non_zero_mean_dist', non_zero_mean_dist FROM m) SELECT model_name, metric, " + ", ".join(f"max(CASE WHEN ds_name = '{c}' THEN v END) AS ds_{c}" for c in DATASETS) + " FROM u GROUP BY model_name, metric",
    "global_means": "SELECT round(avg(success_rate), 6) AS success_rate, round(avg(mean_dist), 6) AS mean_dist, round(avg(non_zero_mean_dist), 6) AS non_zero_mean_dist FROM (SELECT DISTINCT ds_name, q_index, model_name, git_hash, success_rate, mean_dist, non_zero_mean_dist FROM alignments)",
    "success_rates": "SELECT ds_name, q_index, model_name, CASE WHEN n > 0 THEN round_even(100.0::DOUBLE * k / n, 2) ELSE 0.0 END AS rate FROM (SELECT DISTINCT ds_name, q_index, model_name, n_sentence AS n, n_sentence_quant_success AS k FROM alignments)",
    "elapsed_describe": f"WITH g AS (SELECT DISTINCT gen_id, generated, truth, ds_name, elapsed_time, generated_ntokens FROM generations), u AS (SELECT ds_name, 'elapsed_time' AS metric, elapsed_time AS v FROM g UNION ALL SELECT ds_name, 'generated_ntokens', generated_ntokens FROM g) SELECT ds_name, metric, {_DESCRIBE.format('v')} FROM u GROUP BY ds_name, metric",
    "throughput_report": f"""WITH g AS (SELECT DISTINCT gen_id, generated, truth, query, model_name, ds_name, elapsed_time, generated_ntokens FROM generations),
        t AS (SELECT model_name, ds_name, count(*) AS n, sum(elapsed_time) AS e, sum(len({_TOKENS.format("coalesce(query, '')")})) + sum(generated_ntokens) AS k FROM g GROUP BY ALL)
        SELECT model_name, ds_name, n AS num_requests, round(e, 6) AS elapsed_time, CAST(k AS BIGINT) AS total_num_tokens, round(n / nullif(e, 0), 4) AS requests_per_second, round(k / nullif(e, 0), 4) AS tokens_per_second FROM t""",
    "token_count_report": "SELECT model_name, ds_name, CAST(floor(avg(ntokens)) AS INTEGER) AS ntokens, count(*) AS n FROM (SELECT DISTINCT lower(trim(ds_name)) AS ds_name, q_index, model_name, ntokens FROM token_counts WHERE ntokens > 0) GROUP BY model_name, ds_name",
    "dataset_classes": "SELECT ord, ds_name, ds_class, CASE WHEN ds_name IN ('narrativeqa', 'qasper', 'multifieldqa_en') THEN 'SDoc' WHEN ds_name IN ('hotpotqa', 'musique', '2wikimqa') THEN 'MDoc' ELSE 'other' END AS by_name, count(*) AS n FROM corpus LEFT JOIN datasets USING (ds_name) GROUP BY ALL",
    "pending_questions": "SELECT DISTINCT ds_name, q_index FROM corpus c WHERE NOT EXISTS (SELECT 1 FROM alignments a WHERE a.ds_name = c.ds_name AND a.q_index = c.q_index)",
    "done_questions": "SELECT DISTINCT ds_name, q_index FROM corpus c WHERE EXISTS (SELECT 1 FROM alignments a WHERE a.ds_name = c.ds_name AND a.q_index = c.q_index)",
    "target_join": "SELECT DISTINCT c.ds_name, c.q_index, CAST(coalesce(t.n, 0) AS INTEGER) AS n_target FROM corpus c LEFT JOIN (SELECT ds_name, q_index, max(len(target_sentences)) AS n FROM target_sentences WHERE target_sentences IS NOT NULL GROUP BY ALL) t ON c.ds_name = t.ds_name AND c.q_index = t.q_index",
    "pipeline_roots": f"WITH RECURSIVE {_REACTED} SELECT ds_name, q_index, model_name, sent_index, round(score + 1e-12, 6) AS score, CAST(rank AS INTEGER) AS rank, CAST(cum AS BIGINT) AS cum_tokens, cum < {BUDGET} - {CONCAT} * floor(all_ / {RATIO}) AND rank < floor(all_ / {RATIO}) AS picked FROM rr",
    "reaction_teaser": f"WITH RECURSIVE {_REACTED} SELECT ds_name, q_index, model_name, sent_index, sentence, round(score + 1e-12, 6) AS score FROM rr WHERE rank = 0",
    "stream_grades": f"WITH {_PAIRS} SELECT gen_id, round(score, 6) AS score FROM s",
    "stream_windows": f"WITH {_PAIRS}, t AS (SELECT gen_id, any_value(created_at) AS created_at FROM generations WHERE created_at IS NOT NULL GROUP BY gen_id) SELECT strftime(created_at, '%Y-%m-%d') AS day, ds_name, round(avg(score) + 1e-12, 6) AS score, count(*) AS n FROM s JOIN t USING (gen_id) GROUP BY day, ds_name",
}
