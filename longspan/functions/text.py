"""Column expressions over text: the default tokenizer and splitter, answer normalisation and token-level F1.

All are built-in expressions, so they stay in the JVM; none of them shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a run of other characters with the blanks before it, so tokens join to the text (but for blanks at its end).
TOKEN_PATTERN = r"[ \t\n\r\f]*[^ \t\n\r\f]+"
#: A sentence ends with end marks; free of look-around, so that any engine can run it.
SENTENCE_PATTERN = r"[^.!?。！？]+[.!?。！？]*"
#: Fixed values of the answer normalisation: ASCII punctuation, articles, white space.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")
WHITE_SPACE = r"[\t\n\x0B\f\r \x1c-\x1f\x{85}\p{Z}]+"


def tokens(text: Column | str) -> Column:
    """Tokens of a text; null for null, empty for blank."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def word_tokens(text: Column | str) -> Column:
    """Tokens that join to the whole text: the blanks at its end are one of their own."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN + r"|[ \t\n\r\f]+$"), F.lit(0))


def sentences(text: Column | str) -> Column:
    """Sentences by end marks, trimmed, blank ones left out."""
    found = F.regexp_extract_all(text, F.lit(SENTENCE_PATTERN), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.btrim(s, F.lit(" \n\t\r"))), lambda s: s != "")


def normalized_tokens(text: Column | str) -> Column:
    """Lower case, no ASCII punctuation, no articles, split at white space; empty for null."""
    col = F.col(text) if isinstance(text, str) else text
    plain = F.translate(F.lower(F.coalesce(col, F.lit(""))), PUNCTUATION, "")
    return F.filter(F.split(F.regexp_replace(plain, WHITE_SPACE, " "), " "), lambda w: (w != "") & ~w.isin(*ARTICLES))


def normalize_answer(text: Column | str) -> Column:
    return F.array_join(normalized_tokens(text), " ")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _occurrences(words: Column, word: Column) -> Column:
    return F.size(F.filter(words, lambda x: x == word))


def token_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection; only words in both are counted, so the cost follows the shorter side."""
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, w: n + F.least(_occurrences(a, w), _occurrences(b, w)))


def _f1(same: Column, n_prediction: Column, n_truth: Column) -> Column:
    p, r = same / n_prediction, same / n_truth
    return F.when(same == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def token_f1(prediction: Column, truth: Column) -> Column:
    """F1 of two token arrays; 0 where they share nothing."""
    return let(token_overlap(prediction, truth).cast("double"), lambda same: _f1(same, F.size(prediction), F.size(truth)))


def answer_f1(generated: Column | str, truth: Column | str) -> Column:
    """Best F1 over all truths; 0 for null or empty truths. A row whose text contains nothing scores 0.

    The answer is normalised once for each row, each truth once.
    """
    col = F.col(truth) if isinstance(truth, str) else truth
    truths = F.filter(F.coalesce(col, F.array().cast("array<string>")), lambda t: t.isNotNull())
    best = let(normalized_tokens(generated), lambda p: F.array_max(F.transform(F.transform(truths, normalized_tokens), lambda t: token_f1(p, t))))
    return F.coalesce(best, F.lit(0.0))


def success_rate(n_success: Column, n: Column) -> Column:
    """Percentage with two digits, half to even; 0 for none."""
    return F.when(n > 0, F.bround(100.0 * n_success / n, 2)).otherwise(F.lit(0.0))
