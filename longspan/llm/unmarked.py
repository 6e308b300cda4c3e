"""Sentence boundaries between any two words, for stretches of text without end marks.

A hidden-event n-gram model: the counts of words (of characters in scripts without blanks) in labelled sentences, with a
boundary token at their ends, give the chance of the next word after the words before it, of the boundary after them, and of a word
behind a boundary; rare histories back off to shorter ones. Forward-backward over all gaps of a stretch, with the words since the
last boundary as the hidden state, gives the posterior of a boundary in each gap.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from itertools import count

import numpy as np

from longspan.llm.text import HAN, KANA, THAI, UNSPACED_RE

#: Signs in the histories: a boundary before the word, between two words, and the boundary as what follows.
BEGIN, JOIN, END = "\x01", "\x02", "\x03"
#: Words since the last boundary that are told apart; longer runs count as so many.
RUN = 80
#: Gaps whose states are held at once.
BLOCK = 1_024
#: Weight of the shorter history in that of a longer one, in occurrences.
BACK_OFF = 2.0
#: Chance taken for granted that a stretch lacks its marks: in a text without any, and in one that has marks elsewhere.
BARE_TEXT, BARE_STRETCH = 0.5, 0.001

#: Marks inside a sentence, tokens of their own.
INNER = ",;:，、；：،؛"
#: A word, one character of a script without blanks (with the marks over it), or a mark inside a sentence.
_TOKEN = re.compile(f"[{HAN}{KANA}]|[{THAI}][ัิ-ฺ็-๎]*|[{INNER}]|[^\\s{HAN}{KANA}{THAI}{INNER}.!?…。！？।؟．\"“”„«»‘’()\\[\\]{{}}（）「」『』【】《》¿¡]+")


def tokens(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, word, begins with a capital) of each token; end marks, quotes and brackets are none."""
    out = []
    for m in _TOKEN.finditer(text):
        w = m[0]
        out.append((m.start(), m.end(), norm(w), w[0].isupper()))
    return out


def norm(word: str) -> str:
    """The word as the n-grams know it."""
    return "0" if word[0].isdigit() else word.lower()


def unspaced(word: str) -> bool:
    return bool(UNSPACED_RE.match(word))


def histories(words: list[str], i: int, first: bool) -> tuple[str, str]:
    """The longer and the shorter history of what follows word ``i``; ``first`` says that a boundary stands before it."""
    w = words[i]
    if first:
        return BEGIN + w, w
    return (words[i - 1] + JOIN + w if i and unspaced(w) and unspaced(words[i - 1]) else w), w


class Grams:
    """Counts of labelled sentences. Their words are held as numbers, each sentence with a 0 behind it, and counted all at once."""

    def __init__(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count(1).__next__, {"": 0})
        self.held = array("i")

    def add(self, sentence: str) -> None:
        words = _TOKEN.findall(sentence)
        if words:
            self.held.extend(map(self.number.__getitem__, words))
            self.held.append(0)

    def __len__(self) -> int:
        return len(self.held)

    def into(self, found: Counter) -> None:
        """Adds the n-grams: words, beginnings, what follows each history, capitals, and the lengths."""
        if not self.held:
            return
        held, raw = np.array(self.held), list(self.number)[1:]
        known: dict[str, int] = {}
        own = np.array([0, *(known.setdefault(norm(w), len(known) + 1) for w in raw)])
        names = [END, *known]
        n = len(names)
        w, word = own[held], held != 0
        first = word & np.append(True, ~word[:-1])
        upper = np.array([False, *(r[0].isupper() for r in raw)])[held]
        script = np.array([False, *map(unspaced, known)])[w]

        def histories_of(chosen: np.ndarray, history: np.ndarray, name: Callable[[int], str]) -> None:
            """Counts the histories at some words, and what follows each."""
            kinds, often = np.unique(history[chosen], return_counts=True)
            for h, k in zip(kinds.tolist(), often.tolist(), strict=True):
                found[f"u\t{name(h)}", 1] += k
            kinds, often = np.unique(history[chosen] * n + w[chosen + 1], return_counts=True)
            for hw, k in zip(kinds.tolist(), often.tolist(), strict=True):
                found[f"b\t{name(hw // n)}\t{names[hw % n]}", 1] += k

        starts = np.flatnonzero(first)
        histories_of(np.flatnonzero(word), w, names.__getitem__)
        histories_of(starts, w, lambda h: BEGIN + names[h])
        both = np.flatnonzero(script & np.append(False, script[:-1]))
        if len(both):
            pairs, which = np.unique(w[both - 1] * n + w[both], return_inverse=True)
            longer = np.zeros_like(w)
            longer[both] = which
            named = [names[x // n] + JOIN + names[x % n] for x in pairs.tolist()]
            histories_of(both, longer, named.__getitem__)
        for h, k in zip(*(x.tolist() for x in np.unique(w[starts], return_counts=True)), strict=True):
            found[f"s\t{names[h]}", 1] += k
        for begins, where in ((0, word & ~first), (1, first)):
            for up, k in zip(*(x.tolist() for x in np.unique(upper[where], return_counts=True)), strict=True):
                found[f"c\t{begins}\t{int(up)}", 1] += k
        lengths = np.minimum(np.flatnonzero(~word) - starts, RUN)
        for x, k in zip(*(x.tolist() for x in np.unique(script[starts] * (RUN + 1) + lengths, return_counts=True)), strict=True):
            found[f"l\t{x // (RUN + 1)}\t{x % (RUN + 1)}", 1] += k


class Words:
    """Chances of words and boundaries from the counts, which are held in arrays: what follows a history is a run of word numbers in order, twelve bytes an n-gram."""

    def __init__(self, counts: Iterable[tuple[str, float]]) -> None:
        self.row: dict[str, int] = {}
        self.number: dict[str, int] = {}
        self.begin: dict[str, float] = {}
        total, alone = array("d"), [0.0, 0]
        rows, following, often = array("i"), array("i"), array("d")
        capital = np.ones((2, 2))
        lengths = np.zeros((2, RUN + 1))

        def row(h: str) -> int:
            i = self.row.setdefault(h, len(total))
            if i == len(total):
                total.append(0.0)
            return i

        for k, n in counts:  # all are counted as events
            kind, _, rest = k.partition("\t")
            if kind == "b":
                h, _, w = rest.partition("\t")
                rows.append(row(h))
                following.append(self.number.setdefault(w, len(self.number)))
                often.append(n)
            elif kind == "u":
                total[row(rest)] = n
                if BEGIN not in rest and JOIN not in rest:
                    alone = [alone[0] + n, alone[1] + 1]
            elif kind == "s":
                self.begin[rest] = n
            elif kind == "c":
                capital[int(rest[0]), int(rest[2])] = n + 1
            elif kind == "l":
                lengths[int(rest[0]), int(rest[2:])] = n
        order = np.lexsort((following, rows))
        self.following, self.often = array("i", np.asarray(following)[order].tobytes()), array("d", np.asarray(often)[order].tobytes())
        self.start = array("q", np.searchsorted(np.asarray(rows)[order], np.arange(len(total) + 1)).astype(np.int64).tobytes())
        self.total = total
        self.sentences = sum(self.begin.values())
        self.words, self.kinds = alone
        self.ends = self.sentences / max(self.words, 1.0)
        self.capital = capital / capital.sum(1, keepdims=True)
        #: Share of boundaries after k words over their share after any number, and of none, by whether the script has blanks.
        self.hazard, self.goes_on, self.long, self.reach = [], [], [], []
        for n in lengths:
            left = n[::-1].cumsum()[::-1]
            h = (n + 1.0) / (left + 2.0 * RUN)
            mean = (n.sum() + 1.0) / (left[1:].sum() + 2.0 * RUN)
            h[RUN] = max(h[RUN], mean)
            self.hazard.append(np.clip(h / mean, 0.02, 20.0)[1:])
            self.goes_on.append(((1 - np.clip(h, 0, 0.95)) / (1 - mean))[1:])
            up_to = n.cumsum() / max(n.sum(), 1.0)
            self.long.append(int(np.searchsorted(up_to, 0.99)))
            self.reach.append((left + 0.5) / (left[0] + 1.0))

    def word(self, w: str) -> float:
        i = self.row.get(w)
        return ((0.0 if i is None else self.total[i]) + 0.1) / (self.words + 0.1 * self.kinds + 1.0)

    def seen(self, h: str, w: str) -> tuple[float, int, float]:
        """How often ``w`` follows a history, how many words do, and how often the history stands."""
        i = self.row.get(h)
        if i is None:
            return 0.0, 0, 0.0
        lo, hi, number = self.start[i], self.start[i + 1], self.number.get(w, -1)
        j = bisect_left(self.following, number, lo, hi)
        return (self.often[j] if j < hi and self.following[j] == number else 0.0), hi - lo, self.total[i]

    def chance(self, w: str, longer: str, shorter: str) -> float:
        """Of ``w`` (or the boundary) after a history, smoothed towards the shorter one and the word alone."""
        p = self.ends if w == END else (1 - self.ends) * self.word(w)
        for h in (shorter, longer) if longer != shorter else (shorter,):
            often, kinds, total = self.seen(h, w)
            back = BACK_OFF if w == END else max(float(kinds), BACK_OFF)  # a history with many successors expects new ones
            p = (often + back * p) / (total + back)
        return p

    def opening(self, w: str) -> float:
        return (self.begin.get(w, 0.0) + BACK_OFF * self.word(w)) / (self.sentences + BACK_OFF)

    def posteriors(self, toks: list[tuple[int, int, str, bool]], bare: float) -> list[float]:
        """Of a boundary in each gap between the tokens of a stretch, which lacks its marks by a chance of ``bare`` and is one unit otherwise.

        The forward states are kept at the beginning of each block and made again, block by block, on the way back: a long text takes the memory of one block.
        """
        n = len(toks)
        if n < 2 or not self.sentences:
            return [0.0] * max(n - 1, 0)
        words = [t[2] for t in toks]
        caps = [t[3] for t in toks]
        mixed = any(caps[1:]) and not all(caps)
        script = int(sum(map(unspaced, words)) * 2 > n)
        hazard, goes_on = self.hazard[script], self.goes_on[script]
        event, none = np.zeros((n - 1, 2)), np.zeros((n - 1, 2))  # right behind a boundary, and further on
        for i in range(n - 1):
            w = words[i + 1]
            start = self.opening(w)
            cap = self.capital[:, int(caps[i + 1])] if mixed else _ONE
            for state, first in enumerate((True, False)):
                h = histories(words, i, first)
                event[i, state] = self.chance(END, *h) * start * cap[1]
                none[i, state] = self.chance(w, *h) * cap[0]
        scale = event.max(1) * hazard.max() + none.max(1) * goes_on.max()
        event, none = event / scale[:, None], none / scale[:, None]

        def block(at: int) -> tuple[np.ndarray, np.ndarray]:
            """Chances of a boundary and of none in the gaps of the block that begins there, by the words since the last boundary."""
            ev, no = event[at : at + BLOCK], none[at : at + BLOCK]
            e, o = ev[:, 1:] * hazard, no[:, 1:] * goes_on
            e[:, 0], o[:, 0] = ev[:, 0] * hazard[0], no[:, 0] * goes_on[0]
            return e, o

        def ahead(x: np.ndarray, e: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, float]:
            on = x * o
            y = np.empty(RUN)
            y[0] = x @ e
            y[1:] = on[:-1]
            y[-1] += on[-1]
            total = float(y.sum())
            return y / total, total

        x = np.zeros(RUN)
        x[0] = 1.0
        kept, whole = [], 0.0
        for at in range(0, n - 1, BLOCK):
            kept.append(x)
            for e, o in zip(*(last_block := block(at)), strict=True):
                x, total = ahead(x, e, o)
                whole += math.log(total)
        last = [self.chance(END, *histories(words, n - 1, first)) for first in (True, False)]
        back = last[1] * hazard
        back[0] = last[0] * hazard[0]
        whole += np.log(max(float(x @ back), 1e-300))
        single = np.log(np.maximum(np.append(none[:1, 0], none[1:, 1]), 1e-300)).sum() + np.log(last[1] * self.reach[script][min(n, RUN)])
        odds = np.log(bare) + whole - np.log1p(-bare) - single
        share = 1.0 / (1.0 + np.exp(-np.clip(odds, -50, 50)))
        out = [0.0] * (n - 1)
        for b in range(len(kept) - 1, -1, -1):
            events, nones = last_block if b == len(kept) - 1 else block(b * BLOCK)
            states = [kept[b]]
            for e, o in zip(events[:-1], nones[:-1], strict=True):
                states.append(ahead(states[-1], e, o)[0])
            for j in range(len(states) - 1, -1, -1):
                i, x, e, o = b * BLOCK + j, states[j], events[j], nones[j]
                at_event = float(x @ e) * back[0]
                on = o * np.append(back[1:], back[-1])
                total = at_event + float(x @ on)
                out[i] = float(share * at_event / total) if total > 0 else 0.0
                back = e * back[0] + on
                back /= back.max() or 1.0
        return out


_ONE = np.ones(2)
