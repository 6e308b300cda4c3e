"""The whole evaluation as one plan over all questions and models: chunk, pack, retrieve, augment, generate, grade, each stage a table.

Every stage can be exchanged: tokenizer, attention provider and generator are made once a task; retriever and grader are functions of DataFrames.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longspan.functions.text import sentences as default_sentences
from longspan.functions.text import tokens, word_tokens
from longspan.operators.align import Tokenizer, align_corpus
from longspan.operators.generate import ExtractiveGenerator, Generator, generate
from longspan.operators.grade import evidence_recall, grade
from longspan.operators.lookup import for_each, require_parts, unique_lookup, with_targets
from longspan.operators.pack import intervals, with_roots
from longspan.operators.prompt import DEFAULT_TEMPLATE, deferred_requests, fill_by_dataset, query_text
from longspan.operators.react import LexicalProvider, Provider, score_windows
from longspan.operators.retrieve import compression, merge_adjacent, rank_and_cut, with_scores
from longspan.sources.tables import materialise

KEY = ["ds_name", "q_index"]


@dataclass(frozen=True)
class Settings:
    """Parameters of a run. ``compression_ratio=None`` retrieves up to the budget alone.

    ``max_gen_len`` and ``template`` are for datasets that the datasets table and ``templates`` do not name. ``query_kind`` and ``query_prompt`` tell what text the
    attention is read for (see ``prompt.query_text``); ``score_digits`` rounds scores before they are ranked.
    """

    budget: int = 200
    compression_ratio: float | None = 1.2
    score: str = "gmean"
    score_digits: int | None = None
    concat_len: int = 0
    merge: bool = True
    max_gen_len: int = 32
    template: str = DEFAULT_TEMPLATE
    templates: dict[str, str] = field(default_factory=dict, hash=False)
    concat_str: str = "\n"
    query_kind: str = "last_token"
    query_prompt: str = ""
    deferred: bool = False


def by_budget(scored: DataFrame, key: list[str], settings: Settings) -> DataFrame:
    """The default retriever: the best sentences within the budget."""
    return rank_and_cut(scored, key, settings.budget, settings.compression_ratio, settings.concat_len)


Retriever = Callable[[DataFrame, list[str], Settings], DataFrame]
Grader = Callable[[DataFrame, str, str], DataFrame]


def one_question_a_key(corpus: DataFrame) -> DataFrame:
    """``key, input, context, answers``: of several rows of one key the least, those with a context first. Rows with a null key are left out."""
    row = F.struct(F.col("context").isNull().alias("_none"), "context", "input", "answers")
    one = corpus.where("ds_name is not null and q_index is not null").groupBy(*KEY).agg(F.min(row).alias("r"))
    return one.select(*KEY, "r.input", "r.context", "r.answers")


def sentence_spans(corpus: DataFrame, *keep: str) -> DataFrame:
    """``key, keep..., sent_index, sentence, left, right, ntokens``: sentences with their token offsets; columns to ``keep`` go along instead of being joined back.

    Each text is split once and each sentence tokenized once; the offsets are a running sum by key, which shares the key's partitioning with
    what made the rows distinct.
    """
    one = corpus.select(*KEY, *keep, F.posexplode(default_sentences("context")).alias("sent_index", "sentence"))
    sized = one.withColumn("ntokens", F.size(tokens("sentence")))
    right = F.sum("ntokens").over(Window.partitionBy(*KEY).orderBy("sent_index").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return sized.withColumn("right", right).select(*KEY, *keep, "sent_index", "sentence", (F.col("right") - F.col("ntokens")).alias("left"), "right", "ntokens")


def window_tokens(spans: DataFrame) -> DataFrame:
    """``key, window, sentence_quant_indices``: all tokens of the sentences in order and the offsets of the sentences."""
    ordered = spans.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("sent_index", "right", tokens("sentence").alias("t")))).alias("s"))
    offsets = F.concat(F.array(F.lit(0)), F.transform("s", lambda x: x["right"]))
    return ordered.select(*KEY, F.flatten(F.transform("s", lambda x: x["t"])).alias("window"), offsets.alias("sentence_quant_indices"))


def aligned_windows(questions: DataFrame, targets: DataFrame | None, make_tokenizer: Callable[[], Tokenizer]) -> DataFrame:
    """``key, window, sentence_quant_indices, target_sentences``: the tokenizer's own tokens of each context, aligned with the splitter's sentences (those of the default splitter where ``targets`` has none)."""
    rows = questions.where("context is not null").select(*KEY, "context")
    own = default_sentences("context")
    if targets is None:
        rows = rows.withColumn("target_sentences", own)
    else:
        rows = with_targets(rows, targets, KEY).withColumn("target_sentences", F.when(F.size("target_sentences") > 0, F.col("target_sentences")).otherwise(own))
    aligned = align_corpus(rows, KEY, make_tokenizer, with_tokens=True)
    return aligned.where("n_sentence > 0").select(*KEY, F.col("tokens").alias("window"), "sentence_quant_indices", "target_sentences")


def known_windows(questions: DataFrame, alignments: DataFrame) -> DataFrame:
    """The same of alignment records that were made before with the default tokenizer; a context without a record, or with several that differ, is an error."""
    rows = questions.where(F.size(default_sentences("context")) > 0).select(*KEY, word_tokens("context").alias("window"))
    record = alignments.select(*KEY, F.struct("sentence_quant_indices", "target_sentences").alias("alignment"))
    return unique_lookup(rows, record, KEY, "alignment", required=True).select(*KEY, "window", "alignment.*")


def aligned_spans(windows: DataFrame) -> DataFrame:
    """Spans of aligned windows."""
    s = F.arrays_zip("target_sentences", intervals(F.col("sentence_quant_indices")).alias("i"))
    one = windows.select(*KEY, F.posexplode(s).alias("sent_index", "s"))
    return one.select(*KEY, "sent_index", F.col("s.target_sentences").alias("sentence"), "s.i.left", "s.i.right", (F.col("s.i.right") - F.col("s.i.left")).alias("ntokens"))


class Stages:
    """Tables of a run as they are made: those that are written at once with their seconds, those that are reused without."""

    def __init__(self, reuse: dict[str, DataFrame | None] | None) -> None:
        self.reuse = reuse or {}
        self.times: list[tuple[str, float | None, str]] = []
        for stage, earlier in self.reuse.items():
            if stage not in ("spans", "cut", "generated") or earlier is None:
                raise ValueError(f"no table to reuse for stage {stage!r}")

    def table(self, stage: str, make: Callable[[], DataFrame]) -> DataFrame:
        if stage in self.reuse:
            self.times.append((stage, None, "reused"))
            return self.reuse[stage]
        began = time.perf_counter()
        made = materialise(make(), stage)
        self.times.append((stage, time.perf_counter() - began, "done"))
        return made


def retrieved_sentences(
    corpus: DataFrame,
    settings: Settings,
    stages: Stages,
    make_provider: Callable[[], Provider] = LexicalProvider,
    models: DataFrame | None = None,
    make_tokenizer: Callable[[], Tokenizer] | None = None,
    targets: DataFrame | None = None,
    alignments: DataFrame | None = None,
    retriever: Retriever = by_budget,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, spans and the cut: chunk, pack, react, score and rank."""
    for stage, earlier in stages.reuse.items():
        if stage != "spans" and ("model_name" in earlier.columns) != (models is not None):
            raise ValueError(f"the table to reuse for stage {stage!r} is of a run with other models")
    run = [] if models is None else ["model_name"]
    questions = stages.table("questions", lambda: one_question_a_key(corpus))
    windows = None
    if "cut" not in stages.reuse and (make_tokenizer or alignments is not None):
        windows = stages.table("aligned", lambda: known_windows(questions, alignments) if alignments is not None else aligned_windows(questions, targets, make_tokenizer))
    spans = stages.table("spans", lambda: sentence_spans(questions) if windows is None else aligned_spans(windows))

    def cut() -> DataFrame:
        asked = tokens(query_text(F.coalesce("input", F.lit("")), settings.query_kind, settings.query_prompt))
        packed = (window_tokens(spans) if windows is None else windows).join(questions.select(*KEY, asked.alias("query")), KEY)
        if models is not None:
            packed = with_roots(for_each(packed, models, "model_name"), models.where("model_name is not null").dropDuplicates(["model_name"]))
        scores = score_windows(packed, KEY + run, make_provider, settings.score)
        return retriever(with_scores(spans, scores, KEY, run, settings.score_digits), KEY + run, settings)

    return questions, spans, stages.table("cut", cut)


def evaluate(
    corpus: DataFrame,
    settings: Settings = Settings(),  # noqa: B008
    make_provider: Callable[[], Provider] = LexicalProvider,
    make_generator: Callable[[], Generator] = ExtractiveGenerator,
    reuse: dict[str, DataFrame | None] | None = None,
    models: DataFrame | None = None,
    datasets: DataFrame | None = None,
    make_tokenizer: Callable[[], Tokenizer] | None = None,
    targets: DataFrame | None = None,
    alignments: DataFrame | None = None,
    retriever: Retriever = by_budget,
    grader: Grader = grade,
    evidence: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Tables of all stages. The questions, the spans, the cut and the generations are written once and read by what follows, so a lost executor repeats no model call.

    One question row a key is taken (see ``one_question_a_key``); rows with null keys or blank contexts retrieve nothing.
    ``reuse`` gives tables of earlier runs for the stages ``spans``, ``cut`` or ``generated``, which are then not computed.
    With ``models`` (``model_name, window_tokens, root_split_offset``) sentences are packed into the root windows of each model, each root is attended to by
    itself, and all tables but the questions and spans have a row for each model; without, there is no window to keep to and a context is one root.
    With ``make_tokenizer`` the sentences of ``targets`` (or of the default splitter) are aligned with the tokens of the context; with ``alignments`` records of
    an earlier alignment are taken. Without either, the offsets count the words of each sentence. ``datasets`` (``ds_name, max_gen_len``) limits the answers of each dataset; with ``evidence``
    (key and a list of texts) there is a table of how much of it was retrieved. ``retriever`` and ``grader`` exchange how sentences are picked and answers scored.
    ``stages`` tells the seconds and state of each written stage, ``status`` how far each question came.
    """
    stages = Stages(reuse)
    key = KEY + ([] if models is None else ["model_name"])
    questions, spans, cut = retrieved_sentences(corpus, settings, stages, make_provider, models, make_tokenizer, targets, alignments, retriever)
    picked = cut.where("picked")
    pieces = merge_adjacent(picked, key) if settings.merge else picked
    retrieved = pieces.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("left", "sentence"))), lambda x: x["sentence"]).alias("cleaned_strlist"))
    retrieved = compression(cut, key).join(retrieved, key, "left")
    require_parts(retrieved, ["ntokens", "retrieved_ntokens", "compression_rate", "cleaned_strlist"])
    asked = questions.select(*KEY, "input", "answers").join(retrieved, KEY)
    limit = F.lit(settings.max_gen_len)
    if datasets is not None:
        limits = datasets.groupBy("ds_name").agg(F.max("max_gen_len").alias("_limit"))
        asked, limit = asked.join(limits, "ds_name", "left"), F.coalesce("_limit", limit)
    filled = fill_by_dataset(asked, settings.templates, default=settings.template, context=F.array_join("cleaned_strlist", settings.concat_str), input=F.coalesce("input", F.lit("")))
    prompts = asked.withColumn("prompt", F.when(F.size("cleaned_strlist") > 0, filled)).withColumn("max_gen_len", limit).drop("_limit")
    if settings.deferred and "generated" not in stages.reuse:
        made = deferred_requests(prompts.select(*key, "prompt")).drop("prompt")
    else:
        made = stages.table("generated", lambda: generate(prompts, key, make_generator))
    graded = require_parts(grader(made.join(questions.select(*KEY, "answers"), KEY), "purely_generated_str", "answers"), [*key, "score"])
    out = {"questions": questions, "spans": spans, "cut": cut, "retrieved": retrieved, "prompts": prompts, "generated": made, "graded": graded}
    if evidence is not None:
        found = retrieved.join(evidence.select(*KEY, "evidence"), KEY).withColumn("_text", F.array_join(F.coalesce("cleaned_strlist", F.array().cast("array<string>")), settings.concat_str))
        out["evidence"] = evidence_recall(found, "_text", "evidence").select(*key, "recall")
    reached = graded.select(*key, F.lit("deferred" if settings.deferred else "graded").alias("status"))
    every = questions.select(*KEY) if models is None else for_each(questions.select(*KEY), models, "model_name")
    out["status"] = every.join(reached, key, "left").withColumn("status", F.coalesce("status", F.lit("no context")))
    out["stages"] = corpus.sparkSession.createDataFrame(stages.times, "stage string, seconds double, status string")
    return out
