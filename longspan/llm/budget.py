"""Token budgets: counts by source, language, domain and model, with gaps filled by estimates.

Whole texts are hashed and deduplicated, each distinct text is tokenized once with a public tokenizer, and
the counts go back to every row of that text before they are summed.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.llm.encode import TOKENIZERS, Pieces, cut_table, load_ranks, pieces_of, text_slices
from longspan.operators.lookup import for_each
from longspan.sources.tables import materialise

#: Primary subtag of a language tag in lower case; what is no tag at all (or undetermined) becomes null.
LANG_TAG = r"^([a-z]{2,3})(?:[-_].*)?$"
OUTER_BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def clean_lang(col: str) -> Column:
    tag = F.regexp_extract(F.lower(F.trim(col)), LANG_TAG, 1)
    tag = F.when(tag == "eng", "en").otherwise(tag)
    return F.when(tag.isin("", "und"), None).otherwise(tag)


def token_lengths(texts: DataFrame, key: str, text_col: str, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """``(key, n)``: exact tokens of each row's text by the vocabulary; 0 for null and empty texts."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(os.path.join(folder, vocabulary))
        cuts, known = cut_table(ranks), Pieces(ranks)
        for b in batches:
            n = [sum(len(known[p]) for p in pieces_of(t, cuts)) // 4 if t else 0 for t in text_slices(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[key, "n"])

    return texts.select(key, text_col).mapInArrow(run, f"`{key}` {kind}, n bigint")


def distinct_counts(docs: DataFrame, text_col: str, **tokenizer: str) -> DataFrame:
    """``(h1, h2, n)``: each distinct text, told apart by two 64-bit hashes, tokenized once.

    A text that recurs in a third of the rows costs a row of partial aggregation per task, not a hot key.
    """
    keyed = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit(7), text_col).alias("h2"), text_col)
    once = keyed.groupBy("h1", "h2").agg(F.first(text_col).alias(text_col)).select(F.struct("h1", "h2").alias("k"), text_col)
    kind = "struct<h1:bigint,h2:bigint>"
    assert once.schema["k"].dataType.simpleString() == kind
    return token_lengths(once, "k", text_col, **tokenizer).select("k.h1", "k.h2", "n")


def document_budget(docs: DataFrame, by: list[str], text_col: str = "text", **tokenizer: str) -> DataFrame:
    """``by..., n_docs, n_distinct, tokens, distinct_tokens``: totals for each slice over all rows.

    Rows are first reduced to (slice, text) with their multiplicity, so that copies are counted and not moved. Null
    texts count as documents of no tokens; null slice values form a slice of their own.
    """
    h = [F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit(7), text_col).alias("h2")]
    copies = docs.select(*by, F.col(text_col).isNull().alias("gone"), *h).groupBy(*by, "gone", "h1", "h2").agg(F.count("*").alias("m"))
    counted = copies.join(distinct_counts(docs, text_col, **tokenizer), ["h1", "h2"], "left")
    n = F.when(F.col("gone"), 0).otherwise(F.coalesce("n", F.lit(0)))
    return counted.groupBy(*by).agg(
        F.sum("m").alias("n_docs"),
        F.count(F.when(~F.col("gone"), 1)).alias("n_distinct"),
        F.sum(n * F.col("m")).alias("tokens"),
        F.sum(n).alias("distinct_tokens"),
    )


def corpus_texts(corpus: DataFrame, **tokenizer: str) -> DataFrame:
    """``(ds_name, q_index, lang, most, n)``: language, UTF-8 bytes and exact tokens of the context of each key; none for null and blank contexts.

    Repeated rows count once; of differing contexts of one key the longest stands, ties by its hashes. Each distinct context is tokenized
    once and its count joined back by its hashes; the rows of a text copied into many keys are numbers by then, and split by the
    skew handling of the join.
    """
    said = corpus.select("ds_name", "q_index", "lang", "context").where(F.rlike("context", F.lit(r"[^\s\p{Z}\x{FEFF}\x{200B}]")) & F.col("ds_name").isNotNull() & F.col("q_index").isNotNull())
    own = said.select("ds_name", "q_index", F.struct(F.octet_length("context").alias("most"), F.xxhash64("context").alias("h1"), F.xxhash64(F.lit(7), "context").alias("h2"), clean_lang("lang").alias("lang")).alias("r"))
    own = own.groupBy("ds_name", "q_index").agg(F.max("r").alias("r")).select("ds_name", "q_index", "r.*")
    return own.join(distinct_counts(said, "context", **tokenizer), ["h1", "h2"]).select("ds_name", "q_index", "lang", "most", "n")


def usable_counts(texts: DataFrame, token_counts: DataFrame, models: DataFrame) -> DataFrame:
    """The rows of ``corpus_texts`` for every model, with ``model_name`` and ``ntokens``, which is null where no count is usable.

    ``ds_name`` is compared without case and outer blanks and returned as in the corpus. A count is usable if it is positive and not above the
    UTF-8 bytes of the context. Of several usable counts of one key the latest loaded stands, ties by the
    larger. The models are a fixed dimension table: each row is exploded over their names, not joined pair by pair. The join by (dataset, question, model) and the
    sum after it share one shuffle; a key counted again and again is one row before the join.
    """
    wanted = for_each(texts, models, "model_name").withColumn("ds", F.lower(F.regexp_replace("ds_name", OUTER_BLANKS, "")))
    counts = token_counts.where("ntokens > 0").select(
        F.lower(F.regexp_replace("ds_name", OUTER_BLANKS, "")).alias("ds"), "q_index", "model_name", "ntokens", "loaded_at"
    )
    counts = counts.groupBy("ds", "q_index", "model_name", "ntokens").agg(F.max("loaded_at").alias("loaded_at"))
    same = [wanted[c] == counts[c] for c in ("ds", "q_index", "model_name")]
    joined = wanted.join(counts, same[0] & same[1] & same[2] & (counts.ntokens <= wanted.most), "left")
    keep = ["ds_name", "lang", "most", "n"]
    last = F.max(F.when(counts.ntokens.isNotNull(), F.struct(counts.loaded_at, counts.ntokens)))
    out = joined.groupBy(wanted.ds, wanted.q_index, wanted.model_name, *[wanted[c] for c in keep]).agg(last["ntokens"].alias("ntokens"))
    return out.select("ds_name", "q_index", "model_name", "lang", "most", "n", "ntokens")


def corpus_token_counts(corpus: DataFrame, token_counts: DataFrame, models: DataFrame, **tokenizer: str) -> DataFrame:
    """``(ds_name, q_index, model_name, lang, ntokens, estimated)`` of every corpus row with a non-blank context and every model.

    A usable count stands; a gap is filled by the exact count of the context by the public tokenizer, times the ratio of all usable counts
    of that model and language to the public counts of the same texts (that of the model where a language has
    none, 1 where the model has none). The counts are written once to the shared folder: the ratios are summed from them and, as they are only models
    times languages, broadcast to them, so that no row moves to a task of its model.
    """
    rows = materialise(usable_counts(corpus_texts(corpus, **tokenizer), token_counts, models), "counted")
    by_lang = rows.where("ntokens is not null and n > 0").groupBy("model_name", "lang").agg(F.sum("ntokens").alias("a"), F.sum("n").alias("b"))
    ratios = by_lang.groupBy("model_name").agg(
        F.map_from_entries(F.collect_list(F.struct(F.coalesce("lang", F.lit("")), F.col("a") / F.col("b")))).alias("ratios"), (F.sum("a") / F.sum("b")).alias("ratio")
    )
    filled = rows.join(F.broadcast(ratios), "model_name", "left")
    ratio = F.coalesce(F.try_element_at("ratios", F.coalesce("lang", F.lit(""))), "ratio", F.lit(1.0))
    estimate = F.greatest(F.lit(1), F.round(F.col("n") * ratio)).cast("int")
    return filled.select("ds_name", "q_index", "model_name", "lang", F.coalesce("ntokens", estimate).alias("ntokens"), F.col("ntokens").isNull().alias("estimated"))


def corpus_budget(counts: DataFrame, datasets: DataFrame) -> DataFrame:
    """Totals by model, dataset, language and domain of the counts and of what is estimated among them."""
    dims = datasets.select("ds_name", "domain").distinct()
    return counts.join(dims, "ds_name", "left").groupBy("model_name", "ds_name", "lang", "domain").agg(
        F.count("*").alias("n_contexts"), F.sum("ntokens").alias("tokens"), F.sum(F.col("estimated").cast("int")).alias("n_estimated"), F.sum(F.when(F.col("estimated"), F.col("ntokens")).otherwise(0)).alias("tokens_estimated")
    )
