"""Text helpers that several operators of this package share; plain Python, run inside Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Scripts written without spaces between words.
HAN = "㐀-䶿一-鿿豈-﫿"
KANA = "぀-ヿㇰ-ㇿｦ-ﾟ"
THAI = "฀-๿"

HAN_RE = re.compile(f"[{HAN}]")
KANA_RE = re.compile(f"[{KANA}]")
UNSPACED_RE = re.compile(f"[{HAN}{KANA}{THAI}]")
#: A word, or one character of a script without spaces.
UNIT_RE = re.compile(f"[{HAN}{KANA}{THAI}]|[^\\W_{HAN}{KANA}{THAI}]+(?:['’][^\\W\\d_]+)*")

#: Function words by language: they vote for the language of a text.
STOPWORDS = {
    "en": "the a an of and or to in on at by with from for is was were are be been that this these those it its as which who what where when why how he she they his her their not no but because before after under behind beside above near without every another one according passage answer there i you we my your do does did have has had can could would will about into past beyond against whenever while until although so",
    "fr": "le la les un une des du de et ou à au aux en dans sur sous avec sans par pour est était sont que qui quoi dont où quand pourquoi comment il elle ils elles son sa ses leur leurs ne pas mais parce avant après derrière contre vers chaque ce cet cette ces plus tard peu tandis se s'agit réponse je vous nous",
    "de": "der die das den dem des ein eine einen einem einer eines und oder zu in im an am auf bei mit von vom für ist war sind waren dass dieser diese dieses es er sie wer was wo wann warum wie nicht kein keine aber weil denn vor nach unter hinter ohne gegen durch um jedes jeder niemand lautet gemeint ich wir ihr sich als so lange",
    "es": "el la los las un una unos unas de del y o a al en sobre bajo con sin por para es era son que quien quién qué dónde cuándo cómo él ella su sus no pero porque antes después tras contra hacia cada este esta ese esa estos más tarde lo se trata respuesta yo nos mientras aunque durante",
}
STOP_SETS = {k: frozenset(v.split()) for k, v in STOPWORDS.items()}
#: How many languages' lists hold the word: a shared word votes with a share.
_STOP_LANGS: dict[str, tuple[str, ...]] = {}
for _lang, _words in STOP_SETS.items():
    for _w in _words:
        _STOP_LANGS[_w] = (*_STOP_LANGS.get(_w, ()), _lang)

_SCRIPTS = [
    ("zh", re.compile(f"[{HAN}]")),
    ("ja", re.compile(f"[{KANA}]")),
    ("th", re.compile(f"[{THAI}]")),
    ("ru", re.compile("[Ѐ-ӿ]")),
    ("ar", re.compile("[؀-ۿ]")),
    ("hi", re.compile("[ऀ-ॿ]")),
    ("ko", re.compile("[가-힯]")),
    ("el", re.compile("[Ͱ-Ͽ]")),
    ("he", re.compile("[֐-׿]")),
]
_LATIN_RE = re.compile("[A-Za-zÀ-ɏ]")


def script_of(text: str) -> str | None:
    """Language that the script alone tells (kana wins over han), ``"latin"``, or None without letters."""
    if text.isascii():
        return "latin" if _LATIN_RE.search(text) else None
    counts = {lang: len(rx.findall(text)) for lang, rx in _SCRIPTS}
    if counts["ja"] * 8 > counts["zh"] and counts["ja"]:
        counts["ja"] += counts["zh"]
        counts["zh"] = 0
    lang, n = max(counts.items(), key=lambda x: x[1])
    latin = len(_LATIN_RE.findall(text))
    if n * 2 >= latin and n:
        return lang
    return "latin" if latin else None


def votes(words: list[str]) -> dict[str, float]:
    """Votes of function words for each language with a list."""
    out = dict.fromkeys(STOP_SETS, 0.0)
    for w in words:
        langs = _STOP_LANGS.get(w)
        if langs:
            for lang in langs:
                out[lang] += 1.0 / len(langs)
    return out


def language_of(text: str) -> str | None:
    """Language by script, and by votes of function words where the script is Latin; None where nothing tells."""
    script = script_of(text)
    if script != "latin":
        return script
    v = votes([w.lower() for w in UNIT_RE.findall(text)])
    lang, n = max(v.items(), key=lambda x: x[1])
    return lang if n > 0 and sorted(v.values())[-2] < n else None


def arrow_map(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: ``make`` builds the state once a task, its result maps each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                yield f(b)

    return run
