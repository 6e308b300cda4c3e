"""Named queries of the training-data operators over the test tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.llm import budget, encode, leaks, pairs, reading, repetition, sentences, split
from longspan.sources.tables import spread, table


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    pieces = split.split_items(table(spark, d, "alignments"), table(spark, d, "models"))
    return pieces.drop("oversize_sentences")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split.oversize_sentences(split.split_items(table(spark, d, "alignments"), table(spark, d, "models")))


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every context in pieces of at most 256 tokens of the public vocabulary, neighbours sharing 32, cut at the units of ``p6_found``."""
    corpus = table(spark, d, "corpus", "ds_name", "q_index", "context")
    model = sentences.train_sentences(spread(corpus), table(spark, d, "target_sentences"))
    return split.split_texts(corpus.distinct(), ["ds_name", "q_index"], "context", 256, 32, model=model)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.judge_pairs(spread(table(spark, d, "generations", "gen_id", "query", "generated", "truth")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(spread(table(spark, d, "generations", "gen_id", "generated")), "gen_id", "generated")


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition_shares(spread(table(spark, d, "generations", "gen_id", "generated")), "gen_id", "generated").distinct()


def counted_corpus(spark: SparkSession, d: str) -> DataFrame:
    return budget.corpus_token_counts(table(spark, d, "corpus"), table(spark, d, "token_counts"), table(spark, d, "models"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return counted_corpus(spark, d).where("estimated").select("ds_name", "q_index", "model_name")


def p5_corpus(spark: SparkSession, d: str) -> DataFrame:
    return budget.corpus_budget(counted_corpus(spark, d), table(spark, d, "datasets"))


def p5_usable(spark: SparkSession, d: str) -> DataFrame:
    """Contexts, gaps and the tokens that are counted, not estimated, by model and dataset."""
    known = F.when(~F.col("estimated"), F.col("ntokens"))
    return counted_corpus(spark, d).groupBy("model_name", "ds_name").agg(F.count("*").alias("n_contexts"), F.count(F.when(F.col("estimated"), 1)).alias("n_estimated"), F.coalesce(F.sum(known), F.lit(0)).alias("tokens_counted"))


def p5_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "text", "source", "lang", "domain").withColumn("lang", budget.clean_lang("lang"))
    return budget.document_budget(docs, ["source", "lang", "domain"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    corpus = spread(table(spark, d, "corpus", "ds_name", "q_index", "context"))
    return sentences.sentence_units(corpus, sentences.train_sentences(corpus, table(spark, d, "target_sentences")))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(spread(table(spark, d, "documents", "doc_id", "text")), "doc_id", "text")


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(spread(table(spark, d, "documents", "doc_id", "text")), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_spans(spark, d).select("doc_id", "item_id").distinct()


def graded(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents", "doc_id", "text", "source"))
    return reading.reading_levels(docs, reading.train_grader(docs, table(spark, d, "reading_labels")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return graded(spark, d).select("doc_id", "level")


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each level by source and language."""
    sources = table(spark, d, "documents", "doc_id", "source")
    return graded(spark, d).join(sources, "doc_id").groupBy("source", "lang").agg(
        *[F.count(F.when(F.col("level") == name, 1)).alias(f"n_{name}") for name in reading.LEVELS]
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pieces, p1_texts, p2_found, p4_found, p4_shares, p5_found, p5_corpus, p5_usable, p5_documents, p6_found, p7_ids, p8_found, p8_spans, p9_found, p9_profile)
}

_HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"


def _words(col: str) -> str:
    return rf"regexp_extract_all({col}, CASE WHEN zh THEN '[{_HAN}]|(?:[^\P{{L}}{_HAN}]|\p{{N}})+' ELSE '[\p{{L}}\p{{N}}]+(?:[''’]\p{{L}}+)*' END)"


_LIST_MARK = r"(?m)^[ \t]*(?:[-*•·>]+[ \t]+)?(?:\(?\p{Nd}{1,3}[.):、](?:[ \t]+|([^\p{Nd} \t\n])|$)|[-*•·][ \t]+)"
_BLANK = r"[\s\p{Z}\x0B\x1c-\x1f\x{85}]+"
#: Words of each text, which of them lie in a later occurrence of a phrase, and which in a sentence that stood before.
_REPEATED = rf"""
    g AS (SELECT DISTINCT gen_id, generated FROM generations),
    p AS (SELECT gen_id, regexp_replace(coalesce(generated, ''), '{_LIST_MARK}', '\1', 'g') AS t FROM g),
    c AS (SELECT *, 2 * len(regexp_extract_all(t, '[{_HAN}]')) > len(regexp_extract_all(t, '[{_HAN}]|(?:[^\P{{L}}{_HAN}]|\p{{N}})+')) AS zh FROM p),
    w AS (SELECT gen_id, CASE WHEN zh THEN 6 ELSE 3 END AS k, {_words("lower(t)")} AS ws,
        list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(lower(t), '([.!?;:。！？；…।؟]["''”’»)\]」』]*){_BLANK}', '\1' || chr(31), 'g'), '([。！？；…][”’」』]*)', '\1' || chr(31), 'g'), '\n+', chr(31), 'g'), chr(31)), lambda x: {_words("x")}), lambda x: len(x) > 0) AS ss FROM c),
    n AS (SELECT *, len(ws) AS n, list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], chr(31))) AS grams, list_transform(ss, lambda x: array_to_string(x, chr(31))) AS keys FROM w),
    m AS (SELECT gen_id, k, n, list_transform(range(1, len(grams) + 1), lambda i: list_position(grams, grams[i]) < i) AS again,
        CASE WHEN len(ss) > 1 AND list_sum(list_transform(ss, lambda x: len(x))) = n THEN flatten(list_transform(range(1, len(ss) + 1), lambda j: list_transform(ss[j], lambda x: list_position(keys, keys[j]) < j))) ELSE [] END AS said FROM n),
    r AS (SELECT gen_id, CAST(n AS INTEGER) AS n_words, CASE WHEN n > 0 THEN len(list_filter(range(1, n + 1), lambda q: list_contains(again[greatest(1, q - k + 1):least(q, len(again))], true) OR coalesce(said[q], false)))::DOUBLE / n ELSE 0.0 END AS repeated_share FROM m)"""

_COUNTED = r"""c AS (SELECT ds_name, q_index, max(strlen(context)) AS most FROM corpus
            WHERE context IS NOT NULL AND regexp_replace(context, '[\s\p{Z}\x{FEFF}\x{200B}]+', '', 'g') <> '' AND ds_name IS NOT NULL AND q_index IS NOT NULL GROUP BY ALL)"""

ORACLE_SQL: dict[str, str] = {
    "p1_found": """
        WITH a AS (SELECT DISTINCT ds_name, q_index, model_name, sentence_quant_indices AS s FROM alignments),
        k AS (SELECT a.*, m.window_tokens AS w, unnest(range(len(s) - 1)) AS i FROM a JOIN models m USING (model_name) WHERE len(s) > 1)
        SELECT DISTINCT ds_name, q_index, model_name, CAST(i AS INTEGER) AS sent_index FROM k
        WHERE s[i + 2] - s[i + 1] > w AND ds_name IS NOT NULL AND q_index IS NOT NULL""",
    "p1_pieces": """
        WITH RECURSIVE a AS (
            SELECT DISTINCT ds_name, q_index, model_name, n_tokens AS n, window_tokens AS w, overlap_tokens AS o,
                list_sort(list_distinct(list_concat([0, n_tokens], list_filter(coalesce(sentence_quant_indices, []), lambda x: x >= 0 AND x <= n_tokens)))) AS s
            FROM alignments JOIN models USING (model_name) WHERE n_tokens > window_tokens),
        p AS (
            SELECT ds_name, q_index, model_name, n, w, o, s, 0 AS piece, 0 AS l, NULL::INTEGER AS r FROM a
            UNION ALL
            SELECT ds_name, q_index, model_name, n, w, o, s, piece + 1, e - o, e FROM (
                SELECT *, CASE WHEN l + w >= n THEN n
                    WHEN list_max(list_filter(s, lambda x: x <= l + w)) > l + o THEN list_max(list_filter(s, lambda x: x <= l + w))
                    ELSE l + w END AS e FROM p WHERE r IS NULL OR r < n)),
        q AS (SELECT *, lead(r) OVER (PARTITION BY ds_name, q_index, model_name, s ORDER BY piece) AS e FROM p)
        SELECT ds_name, q_index, model_name, CAST(piece AS INTEGER) AS piece, CAST(l AS INTEGER) AS left, CAST(e AS INTEGER) AS right,
            NOT list_contains(s, l) AS hard_left, NOT list_contains(s, e) AS hard_right
        FROM q WHERE e IS NOT NULL""",
    "p4_found": f"WITH {_REPEATED} SELECT DISTINCT gen_id FROM r WHERE gen_id IS NOT NULL AND n_words > 0 AND repeated_share >= 0.5",
    "p4_shares": f"WITH {_REPEATED} SELECT DISTINCT gen_id, n_words, repeated_share FROM r",
    "p5_usable": f"""
        WITH {_COUNTED}, u AS (
            SELECT c.ds_name, c.q_index, m.model_name, t.ntokens, row_number() OVER (PARTITION BY c.ds_name, c.q_index, m.model_name ORDER BY t.loaded_at DESC NULLS LAST, t.ntokens DESC NULLS LAST) AS i
            FROM c CROSS JOIN models m LEFT JOIN token_counts t ON t.q_index = c.q_index AND t.model_name = m.model_name AND lower(trim(t.ds_name)) = lower(trim(c.ds_name)) AND t.ntokens > 0 AND t.ntokens <= c.most)
        SELECT model_name, ds_name, count(*) AS n_contexts, count(*) FILTER (ntokens IS NULL) AS n_estimated, CAST(coalesce(sum(ntokens), 0) AS BIGINT) AS tokens_counted FROM u WHERE i = 1 GROUP BY model_name, ds_name""",
    "p5_found": f"""
        WITH {_COUNTED}
        SELECT c.ds_name, c.q_index, m.model_name FROM c CROSS JOIN models m
        WHERE NOT EXISTS (SELECT 1 FROM token_counts t WHERE t.q_index = c.q_index AND t.model_name = m.model_name
            AND lower(trim(t.ds_name)) = lower(trim(c.ds_name)) AND t.ntokens > 0 AND t.ntokens <= c.most)""",
}
