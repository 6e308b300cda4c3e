"""Reading level of each document, learnt from raters' labels.

Features are distributions over the whole text: word lengths and their long tail, sentence lengths, function
words, subordination, variety of words and cohesion between neighbouring sentences. Boosted regression trees
predict the grade (easy 0, middle 1, hard 2); folds that keep each source whole give honest predictions, on
which the two cut points between the levels are set.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.llm.text import STOP_SETS
from longspan.llm.trees import BoostedTrees

LEVELS = ("easy", "middle", "hard")
LANGUAGES = ("en", "fr", "de", "es")
#: Words set off by blanks; a shorter text has no level.
LEAST_WORDS = 60
#: Labelled documents that the trees are fitted on at most; which ones is decided by a hash of the id.
SAMPLE_LABELS = 12_000
FOLDS = 5

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|\n\s*\n")
_MARKUP = re.compile(r"<[/!a-zA-Z][^<>\n]*(?:\n(?!\s*\n|>)[^<>\n]*)*>|&#?\w{1,31};")
_SUBORDINATE = frozenset(
    "because although while whenever until unless since whereas provided irrespective notwithstanding insofar extent that which whose parce tandis lorsque puisque bien quoique mesure dont weil denn obwohl während sofern insofern dass porque aunque mientras siempre medida".split()
)


def at_share(ordered: list[float], share: float) -> float:
    return float(ordered[min(len(ordered) - 1, int(share * len(ordered)))])


_LANG_OF = {w: [lang for lang, s in STOP_SETS.items() if w in s] for w in frozenset().union(*STOP_SETS.values())}
_WIDTHS = (3, 4, 5, 6, 7, 9, 11, 13, 16, 20)


def features(text: str | None) -> tuple[str, list[float]] | None:
    """Language and features, or None for a text in another language or of fewer words."""
    if not text or len(text.split()) < LEAST_WORDS:
        return None
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    if "\xad" in text:
        text = text.replace("\xad", "")
    sentences = [w for s in _SENTENCE.split(text) if (w := _WORD.findall(s))]
    n = sum(map(len, sentences))
    if not n:
        return None
    counts = Counter()
    shared = again = 0
    before: set[str] = set()
    sizes, means = [], []
    for w in sentences:
        counts.update(w)
        if len(w) < 2:
            continue
        sizes.append(len(w))
        means.append(len("".join(w)) / len(w))
        own = set(w)
        shared += len(own & before)
        again += len(own)
        before = own
    v = dict.fromkeys(STOP_SETS, 0.0)
    sub = foreign = 0
    widths = [0] * 41
    for w, c in counts.items():
        if w[0] > "\u024f":  # no Latin letter
            foreign += c * len(w)
        widths[min(len(w), 40)] += c
        if len(w) < 16:
            w = w.lower()
            for lang in _LANG_OF.get(w, ()):
                v[lang] += c
            if w in _SUBORDINATE:
                sub += c
    lang = max(LANGUAGES, key=lambda x: v[x])
    if v[lang] < 0.05 * n or not sizes:
        return None
    total = sum(k * c for k, c in enumerate(widths))
    if 2 * foreign > total:
        return None
    mean = total / n
    spread = (sum(c * (k - mean) ** 2 for k, c in enumerate(widths) if c) / n) ** 0.5
    up_to = 0
    shares = []
    for k, c in enumerate(widths):
        up_to += c
        if k in _WIDTHS:
            shares.append(up_to / n)
    by_mean = sorted(zip(means, sizes, strict=True))
    weight = sum(sizes)
    easy = sum(s for m, s in by_mean if m < 4.2) / weight
    long_ = sum(s for m, s in by_mean if m > 6.5) / weight
    hard = sum(s for m, s in by_mean if m > 8.0) / weight
    ordered_means, ordered_sizes = [m for m, _ in by_mean], sorted(sizes)
    size = weight / len(sizes)
    f = [
        mean, spread, *shares, size, *(at_share(ordered_sizes, q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)), *(at_share(ordered_means, q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)),
        easy, long_, hard, sum(s <= 7 for s in sizes) / len(sizes), sum(s >= 18 for s in sizes) / len(sizes),
        len(counts) / n, len(counts) / n**0.5, sub / n, text.count(",") / n, text.count("\n") / n, v[lang] / n, shared / max(again, 1), n**0.5,
    ]
    return lang, [*map(float, f), *(float(lang == x) for x in LANGUAGES)]


class Grader:
    """Fitted trees with the two cut points, and how well they did on sources not seen."""

    def __init__(self, trees: BoostedTrees, cuts: tuple[float, float], agreement: float) -> None:
        self.trees, self.cuts, self.agreement = trees, cuts, agreement

    def levels(self, x: np.ndarray) -> list[str]:
        g = self.trees.predict(x)
        return [LEVELS[int(a >= self.cuts[0]) + int(a >= self.cuts[1])] for a in g]


def fit_grader(x: np.ndarray, y: np.ndarray, groups: np.ndarray) -> Grader:
    """Cut points from predictions over folds by group; then the trees on all rows."""
    if len(y) == 0:
        return Grader(BoostedTrees(rounds=0).fit(np.zeros((1, len(features("the cat of the end " * 20)[1]))), np.ones(1)), (0.5, 1.5), 0.0)
    fold = np.array([hash_of(str(g)) % FOLDS for g in groups])
    out = np.full(len(y), y.mean())
    for k in range(FOLDS):
        train = fold != k
        if train.any() and (~train).any():
            out[~train] = BoostedTrees().fit(x[train], y[train]).predict(x[~train])
    cuts = []
    for level in (0.5, 1.5):
        tries = np.unique(np.clip(np.linspace(level - 0.45, level + 0.45, 61), 0.02, 1.98))
        agree = np.array([((out >= t) == (y > level)).mean() for t in tries])
        best = tries[agree >= agree.max() - 1e-12]
        cuts.append(float(best[np.abs(best - level).argmin()]))
    cuts = (cuts[0], max(cuts))
    agreement = float(((out >= cuts[0]).astype(int) + (out >= cuts[1]) == np.round(y)).mean())
    return Grader(BoostedTrees().fit(x, y), cuts, agreement)


def hash_of(s: str) -> int:
    """A hash that is the same in each process."""
    h = 2166136261
    for b in s.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


def train_grader(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_LABELS) -> Grader:
    """Fits on at most ``sample`` labelled documents (those of the lowest hash); several labels of one are averaged.

    Labels that are null or no level are left out. The features are computed in the executors; only the
    numbers of the sample come to the driver.
    """
    grade = F.create_map(*[F.lit(v) for i, name in enumerate(LEVELS) for v in (name, float(i))])
    rated = labels.select("doc_id", "rater", "level").distinct().withColumn("g", grade[F.col("level")]).where("g is not null and doc_id is not null")
    rated = rated.groupBy("doc_id").agg(F.avg("g").alias("g")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = documents.select("doc_id", "text", "source").where("text is not null").join(F.broadcast(rated), "doc_id")  # at most `sample` rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(d, s, g, f[1]) for d, t, s, g in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True) if (f := features(t))]
            cols = list(zip(*got, strict=True)) if got else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.list_(pa.float64()))], names=["doc_id", "source", "g", "f"])

    rows = docs.select("doc_id", "text", "source", "g").mapInArrow(run, "doc_id bigint, source string, g double, f array<double>").distinct().collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, str(r.source)))
    return fit_grader(np.array([r.f for r in rows]), np.array([r.g for r in rows]), np.array([str(r.source) for r in rows]))


def reading_levels(documents: DataFrame, grader: Grader) -> DataFrame:
    """``(doc_id, level, grade, lang)`` of each document in English, French, German or Spanish of 60 or more words.

    Null, empty, short and other-language texts make no row, nor do null ids; repeated rows stand once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(d, *f) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if d is not None and (f := features(t))]
            x = np.array([g[2] for g in got]) if got else np.zeros((0, 1))
            grades = grader.trees.predict(x) if got else []
            levels = grader.levels(x) if got else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.int64()), pa.array(levels, pa.string()), pa.array(list(grades), pa.float64()), pa.array([g[1] for g in got], pa.string())],
                names=["doc_id", "level", "grade", "lang"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, level string, grade double, lang string").distinct()
