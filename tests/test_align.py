import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from longspan.operators.align import FixedTokenizer, WordTokenizer, align, align_corpus


def test_align_words():
    got = align("Hi there. Bye now.", ["Hi there.", "Bye now."], WordTokenizer())
    assert got["sentence_quant_indices"] == [0, 2, 4] and got["n_sentence_quant_success"] == 2


def test_align_empty():
    assert align("", [], WordTokenizer())["sentence_quant_indices"] == [0]
    assert align("a b", [None, ""], WordTokenizer())["n_sentence"] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc ", min_size=1, max_size=8).map(lambda s: s.strip() + "."), min_size=1, max_size=6), st.integers(1, 5))
def test_offsets_never_fall(sentences, width):
    text = " ".join(sentences)
    for tok in (WordTokenizer(), FixedTokenizer(width)):
        got = align(text, sentences, tok)
        q = got["sentence_quant_indices"]
        assert q == sorted(q) and q[0] == 0 and q[-1] == got["n_tokens"] and len(q) == got["n_sentence"] + 1


def test_align_corpus_handles_nulls(spark):
    df = spark.createDataFrame([(1, "Hi there. Bye now.", ["Hi there.", "Bye now."]), (2, None, None), (3, "x", [])], "id int, context string, target_sentences array<string>")
    got = {r.id: r for r in align_corpus(df, ["id"]).collect()}
    assert got[1].success_rate == 100.0 and got[1].mean_dist == 0.0 and got[2].n_tokens == 0 and got[2].success_rate == 0.0 and got[3].n_sentence == 0


def test_edit_distances(spark):
    from longspan.operators.report import distances, non_zero_mean, quality

    assert spark.range(1).select(non_zero_mean(F.array(F.lit(0.0), F.lit(2.0), F.lit(4.0))).alias("x")).collect()[0].x == 3.0
    mean, nz = quality(distances(F.array(F.lit("ab"), F.lit("ab")), F.array(F.lit("ab"), F.lit("abcd"))))
    r = spark.range(1).select(mean.alias("m"), nz.alias("z")).collect()[0]
    assert (r.m, r.z) == (1.0, 2.0)


def test_byte_pair_tokenizer():
    pytest.importorskip("tiktoken")
    import os

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary")
    from longspan.operators.align import BytePairTokenizer

    tok = BytePairTokenizer(path, r" ?\w+|\s+|[^\s\w]+")
    assert tok.decode(tok.encode("Hi there, you.")) == "Hi there, you."


def test_byte_pair_counter_counts_as_the_whole_text_does():
    import os

    from hypothesis import given, settings
    from hypothesis import strategies as st

    from longspan.operators.align import BytePairTokenizer, _EncodingCounter

    path = os.path.join(os.environ.get("LONGSPAN_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
    if not os.path.exists(path):
        pytest.skip("no vocabulary")
    tokenizer = BytePairTokenizer(path, r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(alphabet="ab1 .'s\n\té一", max_size=12), max_size=8))
    def check(parts):
        own, whole = tokenizer.counter(), _EncodingCounter(tokenizer)
        for p in parts:
            assert own.add(p) == whole.add(p)

    check()
