import json
import os
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from longspan.llm import budget, encode, leaks, pairs, reading, repetition, sentences, split, unmarked
from longspan.llm.trees import BoostedTrees

VOCAB = os.path.join(encode.TOKENIZERS, "byte_bpe_50k.tiktoken")
needs_vocab = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary")


# ---- 1 splitting -------------------------------------------------------------------------------------------


@settings(max_examples=300)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=15), st.integers(1, 10), st.integers(0, 8))
def test_pieces(lengths, window, overlap):
    bounds = [0]
    for n in lengths:
        bounds.append(bounds[-1] + n)
    clean = split.clean_bounds(bounds, bounds[-1])
    got = split.cut_pieces(clean, window, overlap)
    if bounds[-1] == 0:
        assert got == []
        return
    own = min(overlap, window - 1)
    assert got[0][0] == 0 and got[-1][1] == bounds[-1] and all(0 < b - a <= window for a, b, *_ in got)
    for (a, b, _, hard), (c, d, *_) in zip(got, got[1:]):
        assert b - c == own and d > b
        best = [x for x in clean if a + own < x <= a + window]
        assert b == (max(best) if best else a + window) and hard == (b not in clean)


def test_split_items(spark):
    a = [("d", 1, "m", [0, 3, 20, 25], 25), ("d", 1, "m", [0, 3, 20, 25], 25), ("d", 2, "m", [0, 5], 5), ("d", 3, "m", None, 30), ("d", 4, "m", [7], None), (None, 5, "m", [0, 90], 90), ("d", 6, "x", [0, 90], 90), ("d", 7, "m", [0, None, 12], 12)]
    al = spark.createDataFrame(a, "ds_name string, q_index int, model_name string, sentence_quant_indices array<int>, n_tokens int")
    mo = spark.createDataFrame([("m", 10, 2), ("n", None, 1)], "model_name string, window_tokens int, overlap_tokens int")
    p = split.split_items(al, mo)
    got = {(r.q_index, r.piece): (r.left, r.right) for r in p.collect()}
    assert got[1, 0] == (0, 3) and got[1, 1] == (1, 11) and max(b for (q, _), (a, b) in got.items() if q == 1) == 25
    assert {q for q, _ in got} == {1, 3, 7}
    assert sorted(tuple(r) for r in split.oversize_sentences(p).collect()) == [("d", 1, "m", 1), ("d", 7, "m", 0)]
    assert split.split_items(al.limit(0), mo).count() == 0
    nulls = spark.createDataFrame([("d", 8, "m", [0, None, 4, 5, 30, 31, 60], 60)], al.schema)
    p = split.split_items(nulls, mo)
    assert sorted(r.sent_index for r in split.oversize_sentences(p).collect()) == [3, 5]
    assert all(r.oversize_sentences == [i for i, a, b in ((3, 5, 30), (5, 31, 60)) if a < r.right and r.left < b] for r in p.collect())


@needs_vocab
@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab. é一。😀\n", max_size=60), st.integers(1, 9), st.integers(0, 8))
def test_text_pieces(text, window, overlap):
    global _CUT
    if "_CUT" not in globals():
        _CUT = split.TextCutter(VOCAB, sentences.Model())
    got = _CUT.cut(text, window, overlap)
    if not text:
        assert got == []
        return
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(n <= window for *_, n, _, _ in got)
    assert all(c <= b for (_, b, *_), (c, *_) in zip(got, got[1:]))


@needs_vocab
def test_split_texts(spark):
    df = spark.createDataFrame([(1, "One two. Three four. Five six."), (2, None), (3, ""), (4, "word " * 30_000)], "id int, context string").selectExpr("*", "'x' as text")
    got = {}
    for r in split.split_texts(df, ["id"], "context", 8, 2).collect():
        got.setdefault(r.id, []).append(r)
    assert set(got) == {1, 4} and [r.text for r in got[1]][0] == "One two. Three four." and got[4][-1].end_char == 150_000
    assert split.split_texts(df.limit(0), ["id"], "context", 8, 2).count() == 0


@needs_vocab
def test_texts_are_cut_at_learnt_units(spark, tmp_path):
    from longspan.llm import queries

    label = "They all met Bo."  # untrained, a short name before a full stop ends no unit
    spark.createDataFrame([("a", i, " ".join([label] * 200)) for i in range(3)], "ds_name string, q_index int, context string").write.parquet(f"{tmp_path}/corpus.parquet")
    spark.createDataFrame([("a", i, [label] * 200) for i in range(3)], "ds_name string, q_index int, target_sentences array<string>").write.parquet(f"{tmp_path}/target_sentences.parquet")
    got = queries.p1_texts(spark, str(tmp_path)).collect()
    assert len(got) > 9 and not any(r.hard_right for r in got) and all(r.text.strip().endswith("Bo.") for r in got)


# ---- 2 pairs -----------------------------------------------------------------------------------------------

Q = "Who opened the wooden door before noon?"


@pytest.mark.parametrize(
    ("query", "answer", "truth", "want"),
    [
        (Q, None, ["Ann"], "empty"), (Q, " ... ", ["Ann"], "empty"), (Q, "<pad></s>", None, "empty"), (None, "", None, "empty"),
        (Q, "Question: " + Q, ["Ann"], "copied_question"), (Q, (Q + "\n") * 3, ["Ann"], "copied_question"), (Q, Q.upper(), None, "copied_question"), (Q, Q + " Ann", ["Ann"], None),
        (Q, "I cannot answer this question", ["Ann"], "refusal"), (Q, "I cannot answer this question.", ["unanswerable"], None), (Q, "unanswerable", ["Ann"], "refusal"), (Q, "Lo siento, no lo sé.", ["Ann"], "refusal"),
        (Q, "La mujer del puente abría la puerta con el martillo.", ["Ann"], "other_language"), (Q, "die Frau", ["die Frau"], None), (Q, "农夫昨天打开了门。", ["Ann"], "other_language"),
        (Q, "It was Ann. The farmer opened the doo", ["Ann"], "truncated"), (Q, "The answer is Ann, which", ["Ann"], "truncated"), (Q, "about 12 peo", ["about 12 people"], "truncated"), (Q, "Ann (", ["Ann"], "truncated"),
        (Q, 'It was Ann. The farmer opened the door "', ["Ann"], "truncated"), (Q, 'He said "yes" and "no"', ["Ann"], None), (Q, "The farmer (who was old opened it.", ["Ann"], "truncated"), (Q, "The farmer (an old man) opened it.", ["Ann"], None), (Q, "Look (here. It was Ann.", ["Ann"], None),
        (Q, "The baker saw the door which was", ["Ann"], "truncated"), ("Qui dort ?", "La réponse est la gare, parce que", ["la gare"], "truncated"), ("Was suchte Ann so lange?", "The answer is the old lamp.", ["das Tal"], "other_language"),
        (Q, "申し訳ありませんが、わかりません。", ["Ann"], "refusal"), (Q, "لا أعرف.", ["Ann"], "refusal"), (Q, "मुझे नहीं पता।", ["Ann"], "refusal"), (Q, "ฉันไม่ทราบ", ["Ann"], "refusal"), (Q, "모르겠습니다.", ["Ann"], "refusal"), (Q, "Não sei.", ["Ann"], "refusal"), (Q, "I won’t comment on it.", ["Ann"], "refusal"),
        (Q, "Ann", ["Ann"], None), (Q, "the farmer's wife.", ["Ann"], None), (Q, "It was the baker.", ["Ann"], None), (None, "Ann", None, None),
    ],
)
def test_defects(query, answer, truth, want):
    assert pairs.Judge().defect(query, answer, truth) == want


def test_judge_pairs(spark):
    rows = [(1, Q, "It was Ann.", ["Ann"]), (2, Q, "wooden door noo", ["Ann"]), (3, Q, "wooden door noon", ["Ann"]), (4, None, None, None), (None, Q, None, None), (4, None, None, None), (5, Q, "x" * 50_000 + ".", [None])]
    df = spark.createDataFrame(rows, "gen_id bigint, query string, generated string, truth array<string>").selectExpr("*", "1 as defect", "2 as word")
    assert sorted(tuple(r) for r in pairs.judge_pairs(df).collect()) == [(2, "truncated"), (4, "empty")]
    assert pairs.judge_pairs(df.limit(0)).count() == 0


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_suffix_automaton(text, other):
    sub = {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}
    want = [max(k for k in range(i + 2) if tuple(other[i + 1 - k : i + 1]) in sub or k == 0) for i in range(len(other))]
    assert pairs.SuffixAutomaton(text).runs(other) == want


def test_long_words_break_off_too(spark):
    word = "".join(chr(97 + i * i % 23) for i in range(150))
    q = f"Who wrote {word} before noon?"
    rows = [(1, q, f"it was {word[:130]}", ["Ann"]), (2, q, f"it was {word}", ["Ann"]), (3, q, f"it was {word[:100]}{'z' * 30}", ["Ann"]), (4, q, f"it was {word[:60]}", ["Ann"]), (5, q, f"it was {word[:100]}", ["Ann"]), (6, q, f"it was {word[:101]}", ["Ann"])]
    got = pairs.judge_pairs(spark.createDataFrame(rows, "gen_id bigint, query string, generated string, truth array<string>")).collect()
    assert {(r.gen_id, r.defect) for r in got} == {(i, "truncated") for i in (1, 4, 5, 6)}


@pytest.mark.parametrize("n", [150, 600])
def test_a_fragment_is_no_word_at_any_size(spark, n):
    whole = [(i, "Who opened the door?", "the door", ["the door"]) for i in range(n)]
    cut_off = [(2000 + i, Q, "old lamp", ["a doo", "a doorway"]) for i in range(n // 150)]  # truths that were themselves cut off grow with the corpus
    rows = [(1000, Q, "old doo", ["Ann"]), (1001, Q, "old door", ["Ann"]), (1002, Q, "old lamp", ["a lamp"])]
    df = spark.createDataFrame(whole + cut_off + rows, "gen_id bigint, query string, generated string, truth array<string>")
    assert {r.gen_id: r.defect for r in pairs.judge_pairs(df).collect()} == {1000: "truncated"}


# ---- 4 repetition ------------------------------------------------------------------------------------------


def brute_share(words, k):
    n = len(words)
    again = [False] * n
    for i in range(n):
        for j in range(i):
            m = 0
            while i + m < n and words[i + m] == words[j + m]:
                m += 1
            if m >= k:
                for x in range(i, i + m):
                    again[x] = True
    return sum(again) / n if n else 0.0


@settings(max_examples=200)
@given(st.lists(st.sampled_from(["aa", "bb", "cc", "dd"]), max_size=14))
def test_repeated_share(words):
    assert repetition.share_of(" ".join(words)) == pytest.approx(brute_share(words, 3))


@settings(max_examples=200)
@given(st.text("ab .\n1", max_size=40))
def test_rules_only_reject(text):
    case = repetition.share_of(text) >= 0.5 and bool(repetition.Text(text).words)
    for order in (list(repetition.RULES), list(repetition.RULES)[::-1]):
        assert repetition.repeats(text, order) == case


def test_rules_are_priced_on_what_is_left():
    texts = ["word"] * 50 + ["one two three four five six"] * 30 + ["na na na na na na"] * 20
    order = repetition.order_rules(texts)
    assert sorted(order) == sorted(repetition.RULES) and order[0] == "too_short"  # it rejects half of them without splitting one
    assert repetition.order_rules([]) and repetition.order_rules([None, ""])


def test_repetition_cases(spark):
    rows = [(1, "the cat sat. The CAT sat!"), (2, "one two three four"), (3, None), (4, ""), (5, "1. a b c\n2. a b c"), (6, "测量员打开了地图。测量员打开了地图。"), (None, "a a a a a"), (1, "the cat sat. The CAT sat!"), (7, "na " * 40_000)]
    df = spark.createDataFrame(rows, "gen_id bigint, generated string")
    assert sorted(r.gen_id for r in repetition.repetitive(df, "gen_id", "generated").collect()) == [1, 5, 6, 7]
    assert repetition.repetitive(df.limit(0), "gen_id", "generated").count() == 0
    shares = {r.gen_id: r.repeated_share for r in repetition.repetition_shares(df, "gen_id", "generated").collect()}
    assert shares[3] == 0.0 and shares[2] == 0.0 and shares[1] == 0.5


# ---- 5 budgets ---------------------------------------------------------------------------------------------


@needs_vocab
def test_budgets(spark):
    docs = spark.createDataFrame([("a b", "s", "en"), ("a b", "s", "en"), ("c", "s", None), (None, "s", "en"), ("", None, "en")], "text string, source string, lang string")
    got = {(r.source, r.lang): (r.n_docs, r.n_distinct, r.tokens, r.distinct_tokens) for r in budget.document_budget(docs, ["source", "lang"]).collect()}
    assert got[("s", "en")] == (3, 1, 4, 2) and got[("s", None)] == (1, 1, 1, 1) and got[(None, "en")] == (1, 1, 0, 0)


@needs_vocab
def test_usable_counts(spark):
    corpus = spark.createDataFrame([("qasper", 1, "abc def", "en"), ("qasper", 1, "abc def", "en"), ("qasper", 2, " \n", "en"), ("musique", 3, "xyz", None), (None, 4, "x", "en")], "ds_name string, q_index int, context string, lang string")
    tc = [(" Qasper", 1, "m", 3, "2024-01-01"), ("qasper", 1, "m", 4, "2024-01-02"), ("qasper", 1, "n", 99, "2024-01-02"), ("musique", 3, "m", 0, "2024-01-01"), ("musique", 3, "n", None, "2024-01-01")]
    counts = spark.createDataFrame(tc, "ds_name string, q_index int, model_name string, ntokens int, loaded_at string")
    models = spark.createDataFrame([("m",), ("n",)], "model_name string")
    got = {(r.ds_name, r.q_index, r.model_name): r.ntokens for r in budget.usable_counts(budget.corpus_texts(corpus), counts, models).collect()}
    assert got == {("qasper", 1, "m"): 4, ("qasper", 1, "n"): None, ("musique", 3, "m"): None, ("musique", 3, "n"): None}
    full = budget.corpus_token_counts(corpus, counts, models).collect()
    assert len(full) == 4 and all(r.ntokens > 0 for r in full) and sum(r.estimated for r in full) == 3


# ---- 6 sentences -------------------------------------------------------------------------------------------


def cut(text, model=None):
    return [text[a:b] for a, b in sentences.units(text, model or sentences.Model())]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []), (" \n ", []), ("One is here. Two is there!", ["One is here.", "Two is there!"]), ("Passage 1:\n\nA Title\n\nText here\ngoes on.", ["Passage 1:", "A Title", "Text here\ngoes on."]),
        ("- one\n- two. Three", ["- one", "- two. Three"]), ('He saw "the cat!" running. Then left.', ['He saw "the cat!" running.', "Then left."]), ("«Uno está aquí. Otro está allí.» Fin ya.", ["«Uno está aquí.", "Otro está allí.»", "Fin ya."]),
        ("(All in brackets.) Next one.", ["(All in brackets.)", "Next one."]), ("一二三。四五六！", ["一二三。", "四五六！"]), ("他说：“一二。三四。”五六。", ["他说：“一二。", "三四。”", "五六。"]), ("ครูเปิด ครูปิด", ["ครูเปิด", "ครูปิด"]), ("It weighs 3.5 kilos today. Yes.", ["It weighs 3.5 kilos today.", "Yes."]),
        ("See note_1.txt now. Good.", ["See note_1.txt now.", "Good."]), ("The council.This goes on.", ["The council.", "This goes on."]),
    ],
)
def test_units(text, want):
    assert cut(text) == want


@settings(max_examples=200)
@given(st.text(alphabet="aB 1.!?\n\"()“”。ก一,-", max_size=60))
def test_units_cover_the_text(text):
    got = sentences.units(text, sentences.Model())
    last = 0
    for a, b in got:
        assert a >= last and text[a:b] == text[a:b].strip() and text[a:b] and not text[last:a].strip()
        last = b
    assert not text[last:].strip()


def test_training_learns_abbreviations(spark):
    ctx = "Dr. Smith came. Mrs. Jones left. Dr. Brown slept."
    corpus = spark.createDataFrame([("d", i, ctx) for i in range(5)] + [("d", 9, None)], "ds_name string, q_index int, context string")
    t = spark.createDataFrame([("d", i, ["Dr. Smith came.", None, "Mrs. Jones left.", "", "Dr. Brown slept."]) for i in range(5)], "ds_name string, q_index int, target_sentences array<string>")
    m = sentences.train_sentences(corpus, t)
    assert cut(ctx, m) == ["Dr. Smith came.", "Mrs. Jones left.", "Dr. Brown slept."]
    got = sentences.sentence_units(corpus, m).where("q_index = 1").orderBy("start_char").collect()
    assert [(r.start_char, r.end_char) for r in got] == [(0, 15), (16, 32), (33, 49)]
    assert sentences.sentence_units(corpus.limit(0), sentences.train_sentences(corpus.limit(0), t.limit(0))).count() == 0


WRITTEN = {
    "en": ["The farmer opened the door.", "A cat slept on the warm mat.", "The painter watched the valley.", "It rained on the hill."],
    "zh": ["农夫打开了木门。", "画家看见了小桥。", "村长记录了地图。", "医生收集了样本。"],
    "th": ["ครูเปิดแผนที่", "ชาวนาเก็บกุญแจทองแดง", "หมอวาดสะพานไม้", "กัปตันซ่อมโคมเก่า"],
}


def unmarked_model():
    from collections import Counter

    rng, total = random.Random(1), Counter()
    for said in WRITTEN.values():
        for _ in range(60):
            chosen = [rng.choice(said) for _ in range(6)]
            total.update(sentences.label_counts(" ".join(chosen), chosen))
    counts = {}
    for (k, e), n in total.items():
        counts[k] = tuple(x + n * (i == e) for i, x in enumerate(counts.get(k, (0.0, 0.0))))
    return sentences.Model(counts)


@pytest.mark.parametrize(("lang", "between"), [("en", " "), ("zh", ""), ("th", "")])
def test_boundaries_between_words_without_marks(lang, between):
    model = unmarked_model()
    plain = [s.rstrip(".。") for s in WRITTEN[lang]]
    for said in (plain, plain[::-1], plain[1:3], plain[:1]):
        assert cut(between.join(said), model) == said
    if lang == "en":
        assert cut(" ".join(plain).lower(), model) == [s.lower() for s in plain]
        assert cut("The farmer opened the door. " + " ".join(plain[1:]), model)[0] == "The farmer opened the door."
        assert cut("The farmer", model) == ["The farmer"] and cut("one, two, three", model) == ["one, two, three"]


def test_posteriors_between_words_are_exact():
    """Against the sum over all ways of cutting."""
    from itertools import product

    from longspan.llm import unmarked

    w = unmarked_model().words
    text = "the farmer opened the door it rained"
    toks = unmarked.tokens(text)
    words = [t[2] for t in toks]
    bare = 0.5
    total, gap, whole = 0.0, [0.0] * (len(words) - 1), 0.0
    for events in product((0, 1), repeat=len(words) - 1):
        p, run = 1.0, 0
        for i, e in enumerate(events):
            h = unmarked.histories(words, i, run == 0)
            p *= w.chance(unmarked.END, *h) * w.opening(words[i + 1]) * w.hazard[0][run] if e else w.chance(words[i + 1], *h) * w.goes_on[0][run]
            run = 0 if e else run + 1
        p *= w.chance(unmarked.END, *unmarked.histories(words, len(words) - 1, run == 0)) * w.hazard[0][run]
        total += p
        gap = [g + p * e for g, e in zip(gap, events)]
    whole = np.prod([w.chance(words[i + 1], *unmarked.histories(words, i, i == 0)) for i in range(len(words) - 1)]) * w.chance(unmarked.END, *unmarked.histories(words, len(words) - 1, False)) * w.reach[0][len(words)]
    share = bare * total / (bare * total + (1 - bare) * whole)
    assert w.posteriors(toks, bare) == pytest.approx([share * g / total for g in gap], rel=1e-6)
    for block in (1, 2, 3, 100):
        assert w.posteriors(toks, bare) == pytest.approx(_with(unmarked, "BLOCK", block, lambda: w.posteriors(toks, bare)))
    long_ = unmarked.tokens("the farmer opened the door it rained on the hill " * 2_000)
    got = w.posteriors(long_, bare)
    assert len(got) == len(long_) - 1 and sum(p > 0.5 for p in got) >= 1_999


def _with(module, name, value, f):
    old = getattr(module, name)
    setattr(module, name, value)
    try:
        return f()
    finally:
        setattr(module, name, old)


def test_ordinals_and_glued_sentences(spark):
    ctx = "Es war am 19. Juni. Er kam um 5 p.m.Dann schlief er. Es kostet 19. Danach ging er."
    said = ["Es war am 19. Juni.", "Er kam um 5 p.m.", "Dann schlief er.", "Es kostet 19.", "Danach ging er."]
    corpus = spark.createDataFrame([("d", i, ctx) for i in range(30)], "ds_name string, q_index int, context string")
    t = spark.createDataFrame([("d", i, said) for i in range(30)], "ds_name string, q_index int, target_sentences array<string>")
    assert cut(ctx, sentences.train_sentences(corpus, t)) == said
    few = sentences.train_sentences(corpus, t, sample=3)
    assert max(sum(n) for n in few.counts.values()) < max(sum(n) for n in sentences.train_sentences(corpus, t).counts.values())


def test_every_labelled_context_counts(spark):
    n, said = 4_200, ["It rained.", "Then she left."]
    corpus = spark.range(n).selectExpr("'d' as ds_name", "cast(id as int) as q_index", "'It rained. Then she left.' as context")
    t = corpus.select("ds_name", "q_index", F.array(*map(F.lit, said)).alias("target_sentences"))
    m = sentences.train_sentences(corpus.union(corpus.limit(9)), t.union(t.limit(9)))  # repeated rows count once
    once = sentences.label_counts(" ".join(said), said)
    assert m.counts == {k: (n * once[k, 0], n * once[k, 1]) for k, _ in once if k[0] in "1234t"}
    assert m.words.sentences == 2 * n and m.words.words == 5 * n


def _sentence_counts(sentence, found):
    """The n-grams word by word, as they are defined."""
    toks = unmarked.tokens(sentence)
    words = [t[2] for t in toks]
    for i, w in enumerate(words):
        following = words[i + 1] if i + 1 < len(words) else unmarked.END
        for h in {*unmarked.histories(words, i, i == 0)}:
            found[f"u\t{h}", 1] += 1
            found[f"b\t{h}\t{following}", 1] += 1
        found[f"c\t{int(i == 0)}\t{int(toks[i][3])}", 1] += 1
    if words:
        found[f"s\t{words[0]}", 1] += 1
        found[f"l\t{int(unmarked.unspaced(words[0]))}\t{min(len(words), unmarked.RUN)}", 1] += 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aBİ 1.,一二ก้ข\x02\x03", max_size=30), max_size=5))
def test_grams_equal_word_by_word(said):
    grams, got, want = unmarked.Grams(), Counter(), Counter()
    for s in said:
        grams.add(s)
        _sentence_counts(s, want)
    grams.into(got)
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB .\n\t\u3000", max_size=12), max_size=5), st.text(alphabet=" \n\u3000", max_size=3), st.text(alphabet=" \n", max_size=2))
def test_labels_cover_what_they_say(said, before, after):
    text = before + " \n ".join(said) + after
    where = [i for i, c in enumerate(text) if not c.isspace()]
    placed = sentences.place_labels("".join(text.split()), [x for s in said if (x := "".join(s.split()))])
    want = Counter()
    for a, b in placed:
        part = text[where[a] : where[b - 1] + 1]
        if part[-1] in sentences.MARKS and not sentences.candidates(part):
            _sentence_counts(part, want)
    got = sentences.label_counts(text, said)
    assert {k: n for k, n in got.items() if k[0][0] not in "1234t"} == want


def test_labels_are_found_again_after_a_loss():
    lost = "x" * 900 + "."
    flat = "Itrained." + lost + "Shecame.Heleft." + lost + "Itsnowed."
    placed = lambda *labels: [flat[a:b] for a, b in sentences.place_labels(flat, list(labels))]
    assert placed("Itrained.", "Shecame.", "Heleft.", "Itsnowed.") == ["Itrained.", "Shecame.", "Heleft.", "Itsnowed."]
    assert placed("Itrained.", "altered", "Shecame.", "Itsnowed.") == ["Itrained.", "Shecame.", "Itsnowed."]
    # a label altered where it lies isn't taken from far behind, or the ones between would be lost
    flat = "Yes.Itrained.Shecame." + lost + "No."
    assert placed("Yes.", "No.", "Itrained.", "Shecame.") == ["Yes.", "Itrained.", "Shecame."]


# ---- 7 encoding --------------------------------------------------------------------------------------------


@needs_vocab
@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="a'sЖ€ \n\t\xa0　1!é<|>endoftx", max_size=40))
def test_encoding_equals_the_tokenizer(text):
    import tiktoken

    global _ENC
    if "_ENC" not in globals():
        ranks = encode.load_ranks(VOCAB)
        _ENC = (tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={}), encode.cut_table(ranks), encode.Pieces(ranks))
    enc, table, known = _ENC
    data = text.encode("utf-8", "replace")
    if not data:
        return
    got = np.frombuffer(b"".join(known[p] for p in encode.pieces_of(data, table)), "<i4").tolist()
    assert got == enc.encode_ordinary(data.decode())


@given(st.lists(st.none() | st.text(max_size=5)), st.integers(0, 3))
def test_slices_of_arrow_strings(texts, cut):
    import pyarrow as pa

    want = [t.encode("utf-8", "surrogatepass") if t is not None else None for t in texts]
    arr = pa.array(texts, pa.string())
    assert list(encode.text_slices(arr)) == want and list(encode.text_slices(arr[cut:])) == want[cut:]


@needs_vocab
def test_encode_texts(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello <|endoftext|>", "x"), (4, "a" * 100_000, "x")], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in encode.encode_texts(df, "doc_id", "text").collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) > 3 and 50256 not in got[3] and len(got[4]) > 100
    assert encode.encode_texts(df.limit(0), "doc_id", "text").count() == 0


# ---- 8 leaks -----------------------------------------------------------------------------------------------

WORDS = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]


def leak_rows(spark, texts, passage):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(7, passage), (8, None), (9, "  ")], "item_id bigint, passage string")
    return leaks.leaks(docs, items)


def test_leaks(spark):
    passage = " ".join(WORDS[:40]) + "."
    rng = random.Random(3)
    shuffled = WORDS[:40]
    rng.shuffle(shuffled)
    replaced = [w if i % 7 else "other" for i, w in enumerate(WORDS[:40])]
    texts = [
        "start " + passage + " end", "x " + " ".join(WORDS[:15]) + " x", " ".join(WORDS[:10]) + " filler text here " + " ".join(WORDS[30:40]), " ".join(shuffled), None, "",
        "<b>" + "</b> <i>".join(WORDS[:20]).upper() + "</i>", "> " + "\n> ".join(WORDS[:18]), " ".join(w[:3] + "\xad" + w[3:] for w in WORDS[:20]), " ".join(w[:3] + "-\n" + w[3:] for w in WORDS[:20]), " ".join(replaced), "&nbsp;".join(WORDS[:20]),
        " ".join(WORDS[30:40]) + " filler text here " + " ".join(WORDS[:10]),
    ]
    got = {r.doc_id: r for r in leak_rows(spark, texts, passage).collect()}
    assert set(got) == {0, 2, 6, 7, 8, 9, 10, 11} and {r.item_id for r in got.values()} == {7}
    assert got[0].share == 1.0 and texts[0][got[0].start_char : got[0].end_char] == passage[:-1]
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert leaks.leaks(docs, spark.createDataFrame([(7, passage)], "item_id bigint, passage string")).count() == 0
    long_tag = f'<a title="{"x y " * 400}">'
    far = [w if i not in (4, 9, 13) else "r" * 300 for i, w in enumerate(WORDS[:18])]  # replaced by very long words
    late = [*WORDS[:15], "q" * 90, *WORDS[16:18]]  # too few words behind a replaced one for a run
    texts = [long_tag.join(WORDS[:20]), " ".join(far), " ".join(late), " ".join(WORDS[:8]) + " a b c d e f g " + " ".join(WORDS[9:15]) + " a b c d e f g " + " ".join(WORDS[16:20])]
    got = {r.doc_id: r.share for r in leak_rows(spark, texts, passage).collect()}
    assert set(got) == {0, 1, 2} and got[1] == 0.45 and got[2] == 0.45


def test_items_in_blocks(spark):
    items = spark.createDataFrame([(i, " ".join(WORDS[i : i + 12])) for i in range(0, 60, 12)] + [(99, None)], "item_id bigint, passage string")
    docs = spark.createDataFrame([(1, " ".join(WORDS[:60])), (2, None), (3, " ".join(WORDS[12:24]))], "doc_id bigint, text string")
    whole = {tuple(r) for r in leaks.leaks(docs, items).collect()}
    assert {tuple(r) for r in leaks.leaks(docs, items, block_items=2).collect()} == whole and len(whole) == 6


def test_a_passage_that_repeats_itself_takes_linear_time():
    import time

    phrase = "word one two"
    passage, text = " ".join([phrase] * 300), " ".join([phrase] * 500)
    known = leaks.Items([(1, passage)])
    s = leaks.stream(text)
    began = time.perf_counter()
    got, _ = known.leaked(1, known.hits(s)[1], s, leaks.unit_starts(leaks.plain(text)))
    assert got == 1.0 and time.perf_counter() - began < 20


def test_no_items(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    assert leaks.leaks(docs, spark.createDataFrame([], "item_id bigint, passage string")).count() == 0


@settings(max_examples=300)
@given(st.text(alphabet="aé ́&<>b;nbsp\xad一ﬁ-#x3\n](ﾊﾞ가ᄀ\u1161Σİ", max_size=40) | st.text(max_size=30))
def test_offsets_follow_the_stream(text):
    s, at = leaks.stream(text), leaks.stream_offsets(text)
    assert len(s) == len(at) and at == sorted(at) and all(0 <= i < len(text) for i in at)
    for c, i in zip(s, at):
        if c.isascii() and text[i].isascii() and text[i] != "&":
            assert text[i].lower() == c
    assert "".join(leaks._UNIT.findall(leaks.plain(text))) == s


# ---- 9 reading level ---------------------------------------------------------------------------------------

EASY = "The cat sat on the mat. The dog ran to the hen. A boy hit the red ball. "
HARD = "Notwithstanding methodological considerations, the institutional reconfiguration of the epistemological framework problematises the multidimensional operationalisation. "


def test_levels(spark):
    rng = random.Random(5)
    docs = [(i, (EASY if i % 2 else HARD) * rng.randint(6, 12), f"s{i % 10}") for i in range(120)] + [(900, None, "s"), (901, "too short", "s"), (902, "农夫昨天打开了地图。" * 40, "s"), (903, "", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    labels = [(i, "a", "easy" if i % 2 else "hard") for i in range(80)] + [(1, "b", None), (2, "b", "odd"), (3, "a", "easy"), (None, "a", "easy")]
    grader = reading.train_grader(df, spark.createDataFrame(labels, "doc_id bigint, rater string, level string"))
    got = {r.doc_id: r.level for r in reading.reading_levels(df, grader).collect()}
    assert set(got) == set(range(120)) and all(got[i] == ("easy" if i % 2 else "hard") for i in range(120)) and grader.agreement > 0.95
    none = reading.train_grader(df.limit(0), spark.createDataFrame([], "doc_id bigint, rater string, level string"))
    assert reading.reading_levels(df, none).count() == 120


def test_trees_fit_a_step():
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (400, 3))
    y = (x[:, 1] > 0.5).astype(float)
    t = BoostedTrees(rounds=60).fit(x[:300], y[:300])
    assert np.mean((t.predict(x[300:]) > 0.5) == y[300:]) > 0.95


def test_queries_registered():
    from longspan.llm.queries import ORACLE_SQL, QUERIES

    assert {f"p{n}_" for n in (1, 2, 4, 5, 6, 7, 8, 9)} <= {q[:3] for q in QUERIES} and set(ORACLE_SQL) <= set(QUERIES)
    json.dumps(ORACLE_SQL)


# ---- columns that clash, empty tables ----------------------------------------------------------------------

CLASH = "'x' as h1, 'x' as h2, 'x' as n, 'x' as m, 'x' as gone, 'x' as k, 'x' as e, 'x' as w, 'x' as share, 'x' as item_id, 'x' as piece, 'x' as level, 'x' as grade, 'x' as f, 'x' as g, 'x' as start_char, 'x' as ids, 'x' as n_words, 'x' as defect, 'x' as word, 'x' as estimated, 'x' as ratio, 'x' as most, 'x' as ds"


def clashing(df):
    have = set(df.columns)
    return df.selectExpr("*", *[c for c in CLASH.split(", ") if c.split()[-1] not in have])


@needs_vocab
@pytest.mark.parametrize("empty", [False, True])
def test_clashing_columns_and_empty_tables(spark, empty):
    def made(rows, ddl):
        return clashing(spark.createDataFrame([] if empty else rows, ddl))

    docs = made([(1, "the plain text is here " * 20, "s", "en", "d"), (2, None, None, None, None), (2, None, None, None, None)], "doc_id bigint, text string, source string, lang string, domain string")
    corpus = made([("a", 1, "One two. Three.", "en"), (None, 2, "x", None), ("a", None, "x", "en"), ("b", 3, None, "en")], "ds_name string, q_index int, context string, lang string")
    counts = made([("a", 1, "m", 3, None), ("a", 1, "m", 3, None), (None, None, None, None, None)], "ds_name string, q_index int, model_name string, ntokens int, loaded_at string")
    models = made([("m", 10, 2), ("m", 10, 2), (None, None, None)], "model_name string, window_tokens int, overlap_tokens int")
    gens = made([(1, "Q?", "na na na na na", ["x"]), (1, "Q?", "na na na na na", ["x"]), (None, None, None, None)], "gen_id bigint, query string, generated string, truth array<string>")
    al = made([("a", 1, "m", [0, 30], 30), (None, None, None, None, None)], "ds_name string, q_index int, model_name string, sentence_quant_indices array<int>, n_tokens int")
    labels = made([(1, "r", "easy"), (None, None, None)], "doc_id bigint, rater string, level string")
    targets = made([("a", 1, ["One two.", "Three."]), ("a", 1, ["One two.", "Three."]), (None, None, None)], "ds_name string, q_index int, target_sentences array<string>")
    items = spark.createDataFrame([(5, "the plain text is here the plain text"), (None, "x"), (6, None)], "item_id bigint, passage string")
    sizes = {
        "split": split.split_items(al, models).count(),
        "texts": split.split_texts(corpus, ["ds_name", "q_index"], "context", 4, 1).where("ds_name is not null").count(),
        "pairs": pairs.judge_pairs(gens).count(),
        "repetitive": repetition.repetitive(gens, "gen_id", "generated").count(),
        "shares": repetition.repetition_shares(gens, "gen_id", "generated").count(),
        "documents": budget.document_budget(docs, ["source", "lang", "domain"]).count(),
        "counts": budget.corpus_token_counts(corpus, counts, models).count(),
        "units": sentences.sentence_units(corpus, sentences.train_sentences(corpus, targets)).count(),
        "ids": encode.encode_texts(docs, "doc_id", "text").count(),
        "leaks": leaks.leaks(docs, items).count(),
        "levels": reading.reading_levels(docs, reading.train_grader(docs, labels)).count(),
    }
    assert all(n == 0 for n in sizes.values()) if empty else (sizes["split"], sizes["units"], sizes["ids"], sizes["leaks"], sizes["levels"], sizes["counts"], sizes["repetitive"], sizes["shares"]) == (4, 2, 3, 1, 1, 1, 1, 3), sizes
