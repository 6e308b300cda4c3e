"""Sentence units of texts in any language or script, by a hidden-event n-gram model.

Between the words of a text a boundary may stand as a hidden event. Counts over contexts that a splitter
has cut tell, for each n-gram around an end mark (the word before it, the mark with its closing quotes, what
follows), how often the event stood there; rare n-grams back off to word shapes. Forward-backward over a text
joins these with how boundaries follow each other, and the posterior of each event decides. Where no mark stands (a text
without any, or a stretch longer than sentences are), the gaps between all words are slots, and n-grams of the words themselves decide
(``longspan.llm.unmarked``). Layout decides first: blank lines, headings and list lines bound units, and in Thai a blank does.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.llm.unmarked import BARE_STRETCH, BARE_TEXT, INNER, Grams, Words, tokens, unspaced
from longspan.sources.tables import slices

#: Words and kinds of slots that a task holds before it hands their counts on; these are summed by n-gram, so this bounds memory only.
HELD = 1_000_000
#: A label of a splitter is first sought within so many characters of the one before, and only then in all that follows (see ``place_labels``).
LABEL_REACH = 400

MARKS = ".!?…。！？।؟．"
_CLOSE = "\"'”’»)\\]」』）】》›“"
_OPEN = "\"'“‘„«(\\[「『（【《‹¿¡"
#: End marks with the closing quotes and brackets after them: those that may also open only where no word follows.
_CAND = re.compile(f"[{MARKS}]+((?:[”’»)\\]」』）】》›]|[^\\S\n][»›]|[\"'“](?![^\\W_]))*)")
_SPACE = re.compile(r"\s+")
_BLOCK = re.compile(r"[^\S\n]*\n(?:[^\S\n]*\n)+[^\S\n]*")
_LIST = re.compile(r"[^\S\n]*(?:[-*•·‣▪–—]|\(?\d{1,3}[.)]|\(?[a-zA-Z]\))[^\S\n]+(?=\S)")
_HEADING = re.compile(r"[^\S\n]*(?:[^\W\d_]+[^\S\n]+\d{1,4}[:：]|#{1,6}[^\S\n]+\S[^\n]*)[^\S\n]*$")
_NEXT = re.compile(r"\s*([^\W\d_]+)")
_BEFORE = re.compile(f"[^\\s{MARKS}{_OPEN}{_CLOSE}，,、;:；：]+$")
_UNSPACED = re.compile("[㐀-鿿豈-﫿぀-ヿ]")
_THAI = re.compile("[฀-๿]")
#: What ends a sentence wherever it stands in a text: a mark before a blank, a mark of a script that sets none, a blank in Thai.
_ENDED = re.compile(f"[.!?…．][{_CLOSE}]*\\s|[。！？।؟]|[฀-๿]\\s+[฀-๿]")
_LAST = re.compile(f"[{MARKS}{_CLOSE}\\s]+$")
_AFTER = re.compile(f"[{MARKS}{_CLOSE}]*")
_DENSE = re.compile("[㐀-鿿豈-﫿぀-ヿ฀-๿]")

#: Shapes of words before a full stop that may go on behind it.
UNSURE = ("0", "X", "Xx", "x", "xx")
#: Labels that the chance taken for granted (see ``prior``) weighs as much as.
PRIOR_WEIGHT = 2.0


def shape(word: str) -> str:
    if not word:
        return "-"
    if word[-1].isdigit():
        return "0"
    if _UNSPACED.match(word[-1]):
        return "C"
    if word[0] == ".":
        return ".x"
    if len(word) == 1:
        return "X" if word.isupper() else "x"
    if len(word) <= 4:
        return "Xx" if word[0].isupper() else "xx"
    return "WORD"


def after(text: str, at: int, closed: bool) -> str:
    """Class of what follows, with how it is set off."""
    m = _SPACE.match(text, at)
    k = m.end() if m else at
    if k >= len(text):
        return "$"
    c = text[k]
    if _UNSPACED.match(c):
        return c if closed else "C"
    kind = "d" if c.isdigit() else "l" if c.islower() else "U" if c.isupper() else "a" if c.isalpha() else c
    return kind if m else f"g{kind}"


def candidates(text: str) -> list[tuple[int, str, str, str]]:
    """Slots where an event may stand: (offset after mark and closers, word before, mark with closers, class after)."""
    out = []
    for m in _CAND.finditer(text):
        end = m.end()
        if end >= len(text):
            continue
        start = m.start() - (m.start() > 0 and text[m.start() - 1] in " \xa0\u202f")
        before = _BEFORE.search(text, max(0, start - 12), start)
        word = before[0] if before else (text[start - 1] if start else "")
        if before and len(word) <= 3 and before.start() and text[before.start() - 1] == ".":
            word = "." + word
        closers = "".join(m[1].split())
        if text[end] == '"' and text.count('"', 0, end) % 2:  # it closes, though a word follows at once
            end, closers = end + 1, closers + '"'
            if end >= len(text):
                continue
        mark = m[0][: len(m[0]) - len(m[1])]
        nxt = after(text, end, bool(closers))
        if nxt[0] == "g" and nxt not in ("gU", "ga") and not _UNSPACED.match(text[m.start() - 1 : m.start()] or " ") and nxt[1] not in "\"“«„([¿¡「『" and not (nxt == "gl" and shape(word) == "WORD"):
            continue
        if mark == "." and nxt in ("gd", "gl") and word[-1:].isdigit():
            continue
        if mark == "." and shape(word) in UNSURE:
            follows = _NEXT.match(text, end)
            nxt = f"{nxt}|{follows[1]}" if follows else nxt
        out.append((end, word, ("..." if len(mark) > 1 and set(mark) <= {".", "…"} else mark[0] if len(mark) == 1 else "!?") + closers[:1], nxt))
    return out


def gap_of(a: int, b: int) -> int:
    """Bucket of the distance between two slots in characters."""
    return 0 if b - a <= 4 else 1 if b - a <= 12 else 2 if b - a <= 30 else 3


def keys(word: str, mark: str, nxt: str) -> list[str]:
    """N-gram and its back-offs, from the longest; the word that follows counts where the one before may be an abbreviation or an ordinal."""
    s = shape(word)
    own = word if len(word) <= 6 and s not in ("0", "C") else s
    kind, _, follows = nxt.partition("|")
    shorter = [f"3\t{own}\t{mark}\t{kind}", f"2\t{s}\t{mark}\t{kind}", f"1\t{mark}\t{kind}"]
    return [f"4\t{s}\t{mark}\t{follows}", *shorter] if follows else shorter


def prior(word: str, mark: str, nxt: str) -> float:
    nxt = nxt.partition("|")[0]
    s, kind = shape(word), nxt[-1]
    if nxt == "gl" or (nxt == "gU" and s == "X"):
        return 0.1
    if mark[0] not in ".…" or mark[:3] == "...":
        return 0.1 if kind == "l" or (mark[-1] in "」』" and nxt not in "「『CUa") else 0.9
    if s in ("X", "Xx", "x", "xx") and mark == ".":
        return 0.6 if s == "xx" and kind != "l" else 0.2
    return 0.5 if kind == "l" else 0.3 if kind == "d" else 0.9


class Model:
    """Counts of events by n-gram and of how an event follows another over a distance."""

    def __init__(self, counts: dict[str, tuple[float, float]] | Iterable[tuple[str, tuple[float, float]]] | None = None) -> None:
        self.counts: dict[str, tuple[float, float]] = {}

        def others() -> Iterator[tuple[str, float]]:
            for k, n in counts.items() if isinstance(counts, dict) else counts or ():
                if k[0] in "1234t":
                    self.counts[k] = n
                else:
                    yield k, n[1]

        self.words = Words(others())
        self._known: dict[tuple[str, str, str], float] = {}
        self._follow = [self.follow(gap) for gap in range(4)]

    def chance(self, word: str, mark: str, nxt: str) -> float:
        """Of a boundary, each n-gram smoothed towards its back-off."""
        own = (word if len(word) <= 6 else shape(word), mark, nxt)
        p = self._known.get(own)
        if p is None:
            p, weight = prior(word, mark, nxt), PRIOR_WEIGHT
            for k in reversed(keys(word, mark, nxt)):
                no, yes = self.counts.get(k, (0, 0))
                p = (yes + weight * p) / (no + yes + weight)
                weight = 4.0
            if len(self._known) < 200_000:
                self._known[own] = p
        return p

    def follow(self, gap: int) -> list[list[float]]:
        """P(event now | event before, distance) over P(event now)."""
        out = [[1.0, 1.0], [1.0, 1.0]]
        total = [1.0, 1.0]
        n = [[0.0, 0.0], [0.0, 0.0]]
        for a in (0, 1):
            for b in (0, 1):
                n[a][b] = self.counts.get(f"t\t{gap}\t{a}\t{b}", (0, 0))[1] + 1.0
                total[b] += n[a][b]
        for a in (0, 1):
            for b in (0, 1):
                share = n[a][b] / sum(n[a])
                out[a][b] = max(0.2, min(5.0, share / (total[b] / sum(total))))
        return out

    def posteriors(self, slots: list[tuple[int, str, str, str]]) -> list[float]:
        n = len(slots)
        if not n:
            return []
        p = [self.chance(*s[1:]) for s in slots]
        follow = self._follow
        ahead = [(1 - p[0], p[0])]
        for i in range(1, n):
            (none, some), (a, b) = follow[gap_of(slots[i - 1][0], slots[i][0])], ahead[-1]
            x, y = (1 - p[i]) * (a * none[0] + b * some[0]), p[i] * (a * none[1] + b * some[1])
            ahead.append((x / (x + y), y / (x + y)))
        back = (1.0, 1.0)
        out = [0.0] * n
        for i in range(n - 1, -1, -1):
            x, y = ahead[i][0] * back[0], ahead[i][1] * back[1]
            out[i] = y / (x + y)
            if i:
                none, some = follow[gap_of(slots[i - 1][0], slots[i][0])]
                a, b = (1 - p[i]) * back[0], p[i] * back[1]
                x, y = none[0] * a + none[1] * b, some[0] * a + some[1] * b
                back = (x / (x + y), y / (x + y))
        return out


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Parts between blank lines."""
    at = 0
    for m in _BLOCK.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def parts(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole): headings and list lines are whole units, the rest may hold several sentences."""
    for a, b in blocks(text):
        lines, k = [], a
        for line in text[a:b].split("\n"):
            lines.append((k, k + len(line)))
            k += len(line) + 1
        marked = [bool(_LIST.match(text, s, e)) for s, e in lines]
        listed = marked[0] or sum(marked) > 1
        run = None
        for (s, e), is_list in zip(lines, marked, strict=True):
            if not text[s:e].strip():
                continue
            if (is_list and listed) or _HEADING.match(text[s:e]):
                if run:
                    yield *run, False
                run = None
                yield s, e, True
            else:
                run = (run[0], e) if run else (s, e)
        if run:
            yield *run, False


def cuts(text: str, model: Model, bare: bool = False) -> list[int]:
    """Offsets inside one part at which a unit ends; ``bare`` tells that the whole text has no end marks."""
    slots = candidates(text)
    ends = {s[0] for s, p in zip(slots, model.posteriors(slots), strict=True) if p >= 0.5}
    if _THAI.search(text):
        for m in _SPACE.finditer(text):
            if 0 < m.start() and m.end() < len(text) and (_THAI.match(text[m.start() - 1]) or _THAI.match(text[m.end()])):
                ends.add(m.start())
    found = sorted(ends)
    if not model.words.sentences:
        return found
    spaced, dense = model.words.long
    if not _DENSE.search(text):
        dense = len(text)
    for a, b in zip([0, *found], [*found, len(text)], strict=True):
        if bare or b - a > dense or (b - a > 2 * spaced and text.count(" ", a, b) >= spaced):
            ends.update(a + x for x in gaps(text[a:b], model, BARE_TEXT if bare else BARE_STRETCH))
    return sorted(ends)


def gaps(stretch: str, model: Model, bare: float) -> list[int]:
    """Offsets behind those words of a stretch after which a boundary is likelier than none; in a text that has end marks elsewhere, a stretch no longer than sentences are and one with commas or the like is whole."""
    toks = tokens(_LAST.sub("", stretch))
    if bare == BARE_STRETCH and (len(toks) <= model.words.long[2 * sum(unspaced(t[2]) for t in toks) > len(toks)] or any(t[2] in INNER for t in toks)):
        return []
    return [_AFTER.match(stretch, t[1]).end() for t, p in zip(toks, model.words.posteriors(toks, bare), strict=False) if p >= 0.5]


def units(text: str | None, model: Model) -> list[tuple[int, int]]:
    """Code point offsets of each unit, without blanks at either end; none for null and blank texts."""
    out = []
    bare = bool(text) and not _ENDED.search(text)
    for a, b, whole in parts(text) if text else ():
        part = text[a:b]
        for s, e in zip([0, *(c := [] if whole else cuts(part, model, bare))], [*c, len(part)], strict=True):
            piece = part[s:e]
            left = len(piece) - len(piece.lstrip())
            if len(piece) > left:
                out.append((a + s + left, a + s + len(piece.rstrip())))
    return out


def place_labels(flat: str, labels: list[str]) -> list[tuple[int, int]]:
    """(start, end) of the labels in a text, both without blanks, in order; labels that the text doesn't hold are passed over.

    A label that isn't near the one before it is sought in all that follows: the first place with the next label near behind it, or, where the next
    isn't near the one before either, its only place.
    """
    out, at = [], 0

    def near(s: str, at: int) -> int:
        return flat.find(s, at, at + LABEL_REACH + len(s))

    for s, following in zip(labels, [*labels[1:], ""], strict=False):
        j = near(s, at)
        if j < 0:
            first = j = flat.find(s, at)
            while j >= 0 and not (following and near(following, j + len(s)) >= 0):
                j = flat.find(s, j + 1)
            if j < 0 <= first and flat.find(s, first + 1) < 0 and not (following and near(following, at) >= 0):
                j = first
        if j >= 0:
            at = j + len(s)
            out.append((j, at))
    return out


class Events:
    """Events at the slots of texts as a splitter's sentences tell; slots and words are held as they stand, and their n-grams named once for each that was met."""

    def __init__(self) -> None:
        self.slots: Counter = Counter()
        self.follows: Counter = Counter()
        self.grams = Grams()

    def __len__(self) -> int:
        return len(self.slots) + len(self.grams)

    def add(self, text: str, labels: list[str | None] | None) -> None:
        """Counts one text; sentences that the text doesn't hold are passed over."""
        runs, blanks = text.split(), [*map(len, _SPACE.findall(text))]
        flat = "".join(runs)
        starts = [*accumulate(map(len, runs), initial=0)]  # of each word in the text without blanks
        shifts = [*accumulate(blanks if text[:1].isspace() else [0, *blanks])]  # blanks before each word
        wanted = ["".join((s or "").split()) for s in labels or []]
        known = [(a + shifts[bisect_right(starts, a) - 1], b + shifts[bisect_left(starts, b) - 1]) for a, b in place_labels(flat, [s for s in wanted if s])]
        ends = {b for _, b in known}
        covered = bytearray(len(text) + 1)
        for a, b in known:
            covered[a + 1 : b + 1] = b"\1" * (b - a)
        for a, b, whole in parts(text):
            if whole:
                continue
            last = None
            for end, word, mark, nxt in candidates(text[a:b]):
                if not covered[a + end]:
                    last = None
                    continue
                e = int(a + end in ends)
                self.slots[word, mark, nxt, e] += 1
                if last:
                    self.follows[gap_of(last[0], end), last[1], e] += 1
                last = (end, e)
        for a, b in known:
            said = text[a:b]
            first = _CAND.search(said)
            if (said[-1] in MARKS + _CLOSE or _THAI.match(said[-1])) and (not first or first.end() == len(said) or not candidates(said)):
                self.grams.add(said)

    def counts(self) -> Counter:
        found: Counter = Counter()
        for (word, mark, nxt, e), n in self.slots.items():
            for k in keys(word, mark, nxt):
                found[k, e] += n
        for (gap, a, b), n in self.follows.items():
            found[f"t\t{gap}\t{a}\t{b}", 1] += n
        self.grams.into(found)
        return found


def label_counts(text: str, labels: list[str | None] | None) -> Counter:
    """Events of one text."""
    events = Events()
    events.add(text, labels)
    return events.counts()


def train_sentences(corpus: DataFrame, target_sentences: DataFrame, sample: int | None = None) -> Model:
    """Counts of all n-grams over all contexts for which a splitter's sentences exist; with ``sample`` over so many of them, those of the lowest hash of their key.

    Texts and labels are dealt out by their key once, and repeated rows go where they meet. Counting runs in the executors and is summed by n-gram before
    anything reaches the driver: the model grows with the n-grams that differ, not with the texts.
    """
    key = ["ds_name", "q_index"]
    labels = target_sentences.select(*key, "target_sentences").where("target_sentences is not null and ds_name is not null and q_index is not null")
    texts = corpus.select(*key, "context").where("context is not null and ds_name is not null and q_index is not null")
    if sample is not None:
        chosen = F.broadcast(labels.select(*key).distinct().orderBy(F.xxhash64(*key), *key).limit(sample))
        labels, texts = labels.join(chosen, key, "left_semi"), texts.join(chosen, key, "left_semi")
    n = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.repartition(n, *key).distinct().join(labels.repartition(n, *key).distinct().hint("merge"), key).select("context", "target_sentences")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = Events()
        for b in slices(batches):
            for text, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                events.add(text, s)
                if len(events) > HELD:
                    yield counts_batch(events.counts())
                    events = Events()
        if len(events):
            yield counts_batch(events.counts())

    counted = rows.mapInArrow(run, "k string, e int, n bigint").groupBy("k").agg(F.sum(F.when(F.col("e") == 0, F.col("n")).otherwise(0)).alias("no"), F.sum(F.when(F.col("e") == 1, F.col("n")).otherwise(0)).alias("yes"))
    batches = counted.toArrow().to_batches(10_000)
    return Model((k, (float(no), float(yes))) for b in batches for k, no, yes in zip(*(c.to_pylist() for c in b.columns), strict=True))


def counts_batch(total: Counter) -> pa.RecordBatch:
    ks, n = [k for k, _ in total], list(total.values())
    return pa.RecordBatch.from_arrays([pa.array(ks, pa.string()), pa.array([e for _, e in total], pa.int32()), pa.array(n, pa.int64())], names=["k", "e", "n"])


def sentence_units(corpus: DataFrame, model: Model) -> DataFrame:
    """``(ds_name, q_index, start_char, end_char)`` of every unit of every context, offsets in code points, end exclusive.

    Null and blank contexts and rows with a null key have none; repeated rows count once; the same unit stands
    once even where one key has several contexts. Texts are cut where they lie; only offsets are shuffled.
    """
    src = corpus.select("ds_name", "q_index", "context").where("context is not null and ds_name is not null and q_index is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [units(t, model) for t in b.column(2).to_pylist()]
            index = pa.array([i for i, u in enumerate(found) for _ in u], pa.int32())
            flat = [x for u in found for x in u]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(index), b.column(1).take(index), pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32())],
                names=["ds_name", "q_index", "start_char", "end_char"],
            )

    return src.mapInArrow(run, "ds_name string, q_index int, start_char int, end_char int").distinct()
