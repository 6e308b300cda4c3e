"""Defects of question and answer pairs.

An answer is judged against its question: a suffix automaton of the question's words measures how much of the
answer is copied from it, an automaton of refusal phrases finds answers that give none, a stack of delimiters
and the last words tell a text that breaks off, and votes of function words (or the script) tell an answer in
another language.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.llm.text import HAN, KANA, STOP_SETS, THAI, UNIT_RE, script_of, votes
from longspan.sources.tables import materialise

DEFECTS = ("empty", "truncated", "refusal", "copied_question", "other_language")
#: Share of the question's words that an answer must copy in order to be the question again.
COPIED = 0.85
#: Beginnings of up to so many characters are listed; longer ones are found by as much of them and then compared whole.
MAX_WORD = 100
#: A last word is the beginning of others, and no word itself, if it occurs less than once for so many occurrences of the words that it begins.
RARER = 200

#: Questions and truths of up to so many characters are kept by a task.
KEEP_CHARS = 1_000

#: Phrases that decline an answer, in lower case without punctuation.
REFUSALS = """
unanswerable|not answerable|cannot answer|can not answer|can t answer|could not answer|cannot be answered|can not be answered
no answer can be given|has no answer|have no answer|there is no answer|cannot give an answer|can not give an answer|can t give an answer
unable to|not able to answer|not able to give|not able to help|not able to say|not able to determine|cannot help|can not help|can t help
must refuse|must decline|i refuse|i decline|refuse to answer|decline to answer|do not know|don t know|does not know|dont know
will not give an answer|will not answer|won t answer|won t give|will not give|would not answer|nobody could know|nobody can know|no one could know|no one can know|impossible to determine|impossible to say|impossible to tell|impossible to answer|impossible to know
cannot be determined|can not be determined|cannot determine|can not determine|can t determine|insufficient information|not enough information|not enough context|insufficient context
needed to answer|no mention of|cannot say anything|can not say anything|can t say anything|not able to say anything
cannot tell from|can not tell from|cannot find|can not find|could not find|does not contain the answer|do not contain the answer|does not provide|do not provide|no relevant information|no information about|not give enough|not contain enough
je ne sais pas|ne permet pas de répondre|ne peux pas répondre|impossible de répondre|impossible de donner|ne permettent pas|pas assez d informations|ne puis répondre|aucune réponse|sans réponse|je refuse|ne dit rien|ne peut être déterminée|ne peux pas vous aider|ne peux rien dire
weiß ich nicht|weiss ich nicht|ich weiß es nicht|nicht beantworten|darf ich nichts sagen|nicht beantwortbar|keine antwort|nicht genug informationen|nicht genügend|nicht möglich zu sagen|nicht bestimmen|keine angaben|keine information|gibt keine auskunft|geht aus dem text nicht hervor|unmöglich zu beantworten|kann ich nicht sagen|nicht helfen|lehne ab|gibt der text nicht her
no lo sé|no puedo responder|imposible dar una respuesta|imposible responder|información suficiente|no es posible responder|no puedo contestar|sin respuesta|no hay respuesta|no puedo ayudar|no puedo decir|no se puede responder|no se puede determinar|me niego|no contiene la respuesta
не знаю|не могу ответить|невозможно|недостаточно информации|нет ответа
无法回答|不知道|没有提供|不能确定|无法确定|不能回答|没有足够|信息不足|无法得知|没有答案|未提及|没有提到|拒绝回答|无法提供|不清楚|无可奉告|不便回答
не могу сказать|не могу помочь|не могу дать ответ|нельзя ответить|нельзя определить|не указано|не сказано|отказываюсь
わかりません|分かりません|答えられません|お答えできません|回答できません|判断できません|情報がありません|情報が不足|書かれていません|記載されていません|記載がありません|不明です
لا أعرف|لا أعلم|لا أدري|لا أستطيع الإجابة|لا يمكنني الإجابة|لا أستطيع أن أجيب|لا يمكن الإجابة|لا توجد معلومات|معلومات غير كافية|لا يذكر النص|لا توجد إجابة|أرفض الإجابة|لا يمكنني المساعدة
मुझे नहीं पता|मुझे नहीं मालूम|पता नहीं|उत्तर नहीं दे सकता|उत्तर नहीं दे सकती|जवाब नहीं दे सकता|जवाब नहीं दे सकती|उत्तर नहीं दिया जा सकता|जानकारी नहीं है|पर्याप्त जानकारी|मदद नहीं कर सकता|कोई उत्तर नहीं
ไม่ทราบ|ไม่รู้|ไม่สามารถตอบ|ตอบไม่ได้|ไม่มีข้อมูล|ข้อมูลไม่เพียงพอ|ไม่ได้ระบุ|ไม่มีคำตอบ|ขอปฏิเสธ|ช่วยไม่ได้
모르겠습니다|알 수 없습니다|대답할 수 없습니다|답할 수 없습니다|답변할 수 없습니다|정보가 없습니다|정보가 부족|도와드릴 수 없습니다
não sei|não posso responder|não é possível responder|impossível responder|sem resposta|informação suficiente|informações suficientes|não posso ajudar|recuso me a
non lo so|non posso rispondere|impossibile rispondere|non è possibile rispondere|informazioni sufficienti|nessuna risposta|non posso aiutare|mi rifiuto
weet ik niet|kan ik niet beantwoorden|niet te beantwoorden|niet genoeg informatie|onvoldoende informatie|geen antwoord|kan ik niet zeggen|niet helpen
"""
#: What a speaker denies (English, first person) and of what: each pair is a phrase beside those above.
DENIALS = ("i cannot", "i can not", "i can t", "i could not", "i couldn t", "i will not", "i won t", "i would not", "i am unable to", "i m unable to", "i am not able to", "i m not able to", "we cannot", "we can not", "we can t", "we will not")
DENIED = ("answer", "reply", "respond", "say", "tell", "help", "give", "provide", "determine", "know", "comment", "discuss", "share", "assist", "reveal", "disclose", "infer", "judge")
#: Words that may stand around a copied question: labels, not answers.
LABELS = frozenset(
    "question q query answer a you asked ask the is was i of my your asks reads here says prompt user respuesta pregunta la es frage die war lautet antwort vous demandez réponse la est était il se demande el fue preguntas usted preguntó sie fragten du fragst вопрос ответ 问 题 答 案 你 您 的 是 回 提".split()
)
#: Words after which no sentence ends: articles, prepositions, conjunctions.
OPEN_WORDS = frozenset(
    "the a an of and or to in on at by with from for is was were are be that this these those which who whose because before after under behind beside above near without every another one as its it's his her their but if whenever while until although than into past beyond against "
    "le la les un une des du de et ou à au aux en dans sur sous avec sans par pour est que qui dont mais parce derrière contre vers chaque ce cet cette l d "
    "der die das den dem des ein eine einen einem einer und oder zu im am auf bei mit von vom für ist dass weil denn aber ohne gegen durch um nach unter hinter "
    "el los las una unos unas del y o al sobre bajo con sin por para es que porque pero tras hacia cada".split()
) - {"one", "it's", "her", "his", "this", "that", "these", "those", "is", "was", "are", "be", "es", "est", "ist", "before", "after", "on", "in", "under", "by", "past", "above", "behind", "beyond", "at", "around", "que", "o", "y", "l", "d"}
#: Words that open a clause, after which an auxiliary or a second conjunction still leaves it open ("which was", "parce que").
CLAUSE_WORDS = frozenset("which who whom whose that because although while whenever until if where when than parce tandis puisque lorsque afin pendant alors welche welcher welches weil obwohl während aunque mientras porque cuyo".split())
AUXILIARIES = frozenset("is was are were be been has had have will would can could may might must shall should did does do que est était sont étaient a avait ist war sind waren hat hatte wird es era son eran ha había".split())
_OPEN_TAIL = re.compile(r"(?:[,;:(\[{«„“‘（「『《，、；：\-–—/&]|\b(?:this|that|one|every|another)|因为|但是|而且|以及|和|的|他|她|与|或|在|把|被)$")
_END = re.compile(r"[.!?。！？…।؟!?．｡]")
_CLOSERS = "\"'”’»)]}」』）】》›*_`"
_MARKUP = re.compile(r"</?[a-zA-Z|_][^<>]{0,30}>|\[/?(?:INST|SYS|PAD|UNK|CLS|SEP|MASK)\]|<<?/?(?:SYS|sys)>>?|<\|[^|<>]{0,40}\|>")
_LAST_CLAUSE = re.compile(r"[.!?。！？…:：]+\s*|\n+")
_LETTER = re.compile(r"[^\W_]")
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "《": "》", "“": "”", "«": "»", "„": "“", '"': '"'}
_DELIMITER = re.compile("[" + re.escape("".join({*_PAIRS, *_PAIRS.values()})) + "]")
_SENTENCE_END = re.compile(r"[.!?。！？…।؟]\s")
_LEAD = re.compile(r"^\s*(?:(?:question|answer|respuesta|pregunta|frage|antwort|réponse|问题|答案|回答|q|a)\s*[:：]\s*)+", re.I)
_UNITS = re.compile(f"[{HAN}{KANA}]|[^\\W_{HAN}{KANA}]+")
_UNSPACED = re.compile(f"[{HAN}{KANA}{THAI}]")


class SuffixAutomaton:
    """Of a word sequence; a traversal tells the longest run of it that ends at each word of another text."""

    def __init__(self, words: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in words:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def runs(self, words: list[str]) -> list[int]:
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            out.append(n)
        return out


def remember_short(f: Callable[[str], object], most: int) -> Callable[[str], object]:
    """``f`` with its last results for short texts, so that what a task keeps stays small."""
    known = lru_cache(most)(f)
    return lambda text: known(text) if len(text) <= KEEP_CHARS else f(text)


def units(text: str) -> list[str]:
    return _UNITS.findall(text.lower())


class Judge:
    """State of a task: the refusal automaton and the automata of the questions met last."""

    def __init__(self) -> None:
        import ahocorasick

        self.refusals = ahocorasick.Automaton()
        phrases = {p.strip() for p in REFUSALS.replace("\n", "|").split("|")} | {f"{a} {b}" for a in DENIALS for b in DENIED}
        for p in sorted(phrases - {""}):
            self.refusals.add_word(p if _UNSPACED.match(p) else f" {p} ", True)
        self.refusals.make_automaton()
        self.question = remember_short(self._question, 4096)
        self.phrase = remember_short(self._phrase, 16_384)

    @staticmethod
    def _question(query: str) -> tuple[list[str], SuffixAutomaton, str | None]:
        q = units(query)
        return q, SuffixAutomaton(q), self_language(query)

    @staticmethod
    def _phrase(truth: str) -> str:
        """The words of a truth between blanks; empty without a word."""
        return f" {' '.join(u)} " if (u := units(truth)) else ""

    def refuses(self, text: str) -> bool:
        flat = " " + " ".join(text.lower().translate(_PUNCT).split()) + " "
        if _UNSPACED.search(flat) and not re.search("[a-z]{3}", flat):
            flat = flat.replace(" ", "")
        return next(self.refusals.iter(flat), None) is not None

    def copied(self, query: str, a: list[str]) -> bool:
        """The answer of these words is the question, once or again and again, and nothing but labels beside it."""
        q, sa, _ = self.question(query)
        if len(q) < 2:
            return bool(q) and a == q
        if len(a) < COPIED * len(q):
            return False
        runs = sa.runs(a)
        taken = bytearray(len(a))
        most = 0
        least = max(3, int(0.5 * len(q)))
        for i in range(len(a) - 1, -1, -1):
            if runs[i] >= least and not taken[i]:
                taken[i - runs[i] + 1 : i + 1] = b"\1" * runs[i]
                most = max(most, runs[i])
        if most < COPIED * len(q):
            return False
        rest = [w for w, t in zip(a, taken, strict=True) if not t]
        return all(w in LABELS for w in rest)

    def defect(self, query: str | None, answer: str | None, truth: list[str | None] | None) -> str | None:
        """Type of the defect, ``"broken:WORD"`` where only the vocabulary can tell whether WORD is whole, or None."""
        text = _MARKUP.sub(" ", answer or "")
        if not _LETTER.search(text):
            return "empty"
        truths = [x for x in (truth or []) if x and _LETTER.search(x)]
        a = units(text)
        if query and self.copied(query, a):
            return "copied_question"
        joined = " " + " ".join(a) + " "
        whole = [w for t in truths if (w := self.phrase(t))]
        open_truth = any("unanswerable" in t for t in whole)
        if joined in whole:
            return "truncated" if text.rstrip()[-1:] in "([{（「『" else None
        answered = any(t in joined for t in whole if len(t) > 5)
        if not answered and self.refuses(text):
            # with no truth recorded, the label "unanswerable" may well be the right answer
            return None if open_truth or (not truths and "unanswerable" in a) else "refusal"
        body = text.strip()
        repeats_truth = answered or any(t in joined for t in whole)
        if not repeats_truth and cut_truth(body, truths):
            return "truncated"
        if not repeats_truth and query:
            ql, al = self.question(query)[2], self_language(text)
            phrase = len(a) <= 4 and ql in STOP_SETS and al in STOP_SETS  # a title or name, not yet an answer in that language
            if ql and al and ql != al and not phrase and wholly_other(text, ql, al):
                return "other_language"
        return self.breaks_off(body, a, truths, whole)

    @staticmethod
    def breaks_off(body: str, a: list[str], truths: list[str], whole: list[str]) -> str | None:
        tail = body.rstrip(_CLOSERS + " \t\r\n")
        opened = unclosed(body)
        if tail and _END.match(tail[-1]):
            # the last sentence is whole, unless it opened something that it never closed
            return "truncated" if opened is not None and not _SENTENCE_END.search(tail, opened, len(tail) - 1) else None
        if opened is not None or (_OPEN_TAIL.search(body) and body[-1:] not in _CLOSERS):
            return "truncated"
        last = a[-1]
        if body[-1:] in _CLOSERS:
            return None
        if cut_truth(body, truths) and f" {last} " not in " ".join(whole):
            return "truncated"
        if len(a) > 1 and (last in OPEN_WORDS or open_clause(a)) and f" {last} " not in [w[-len(last) - 2 :] for w in whole]:
            return "truncated"
        if len(a) < 2 or " " + " ".join(units(_LAST_CLAUSE.split(body)[-1])) + " " in whole:
            return None
        lines = [x.strip() for x in body.split("\n") if x.strip()]
        if len(lines) > 1:
            if len(lines) > 2 and lines[-1] != lines[-2] and lines[-2].startswith(lines[-1]):
                return "truncated"
            if lines[-1] in lines[:-1]:
                return None
        if re.search(r"[^\W_][.!?。！？…।؟]", body):
            return "truncated"
        if a.count(last) == 1 and any(w.startswith(last) and a.count(w) > 1 for w in set(a[:-1])):
            return "truncated"
        return None if re.match(f"[{HAN}{KANA}]", last) else f"broken:{last}"


def open_clause(words: list[str]) -> bool:
    """The words end with one that opens a clause and nothing but auxiliaries after it."""
    k = len(words)
    while k and words[k - 1] in AUXILIARIES:
        k -= 1
    return 0 < k < len(words) and words[k - 1] in CLAUSE_WORDS


def cut_truth(body: str, truths: list[str]) -> bool:
    """The text ends with the beginning of a truth, broken off inside a word."""
    low = " ".join(body.lower().split())
    for t in truths:
        t = " ".join(t.lower().split())
        for k in range(min(len(low), len(t) - 1), 2, -1):
            if low.endswith(t[:k]) and (k == len(low) or not low[-k - 1].isalnum()):
                if t[k].isalnum() and t[k - 1].isalnum() and not re.match(f"[{HAN}]", t[k]):
                    return True
                break
    return False


_PUNCT = {ord(c): " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~。，、；：？！…“”«»„‘’（）《》「」『』—–¿¡؟،؛।"}


def unclosed(text: str) -> int | None:
    """Where the innermost bracket or quote that is left open stands, by a stack; a straight quote closes one that is open and else opens."""
    stack: list[tuple[str, int]] = []
    for m in _DELIMITER.finditer(text):
        c = m[0]
        if stack and c == stack[-1][0]:
            stack.pop()
        elif c in _PAIRS:
            stack.append((_PAIRS[c], m.end()))
    return stack[-1][1] if stack else None


def self_language(text: str) -> str | None:
    """Script, or function words where they clearly tell."""
    script = script_of(text)
    if script != "latin":
        return script
    v = votes([w.lower() for w in UNIT_RE.findall(text)])
    (lang, n), (_, second) = sorted(v.items(), key=lambda x: -x[1])[:2]
    return lang if n >= 1 and n >= 1.5 * second else None


def wholly_other(text: str, query_lang: str, lang: str) -> bool:
    """No function word (or letter) of the question's language stands in the answer, beyond what it shares with the other."""
    if query_lang not in STOP_SETS or lang not in STOP_SETS:
        return True
    words = [w.lower() for w in UNIT_RE.findall(text)]
    own = sum(w in STOP_SETS[query_lang] and w not in STOP_SETS[lang] for w in words)
    return own == 0


def judge_pairs(pairs: DataFrame) -> DataFrame:
    """``(gen_id, defect)``: the defect of each pair that has one, once for each gen_id.

    Takes ``gen_id, query, generated, truth``; nulls in any column are allowed. A null, blank or markup-only
    answer is ``empty``; without a question nothing is copied and no language compared; a null gen_id makes no
    row; repeated rows count once (should contents differ under one id, the first type in alphabetical order
    stands). A short answer without an end mark is held against the words of all questions and
    truths: it breaks off if its last word begins others and is itself ``RARER`` times rarer than those. Both counts grow
    with the corpus alike, so the verdict does not change with its size, and a fragment that slipped into a truth is no word.
    Only words with their counts are shuffled, summed in each task first. The verdicts and the counts are written once to the shared folder, since
    several steps read them; a hot last word is split by the skew handling of the join.
    """
    src = pairs.select("gen_id", "query", "generated", "truth").where("gen_id is not null")
    kind = src.schema["gen_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge()
        for b in batches:
            found = [judge.defect(q, g, t) for q, g, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            keep = pa.array([x is not None for x in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), pa.array([x for x in found if x is not None], pa.string())], names=["gen_id", "defect"])

    judged = materialise(src.mapInArrow(run, f"gen_id {kind}, defect string"), "judged")
    sure = judged.where(~F.col("defect").startswith("broken:"))
    open_ = judged.where(F.col("defect").startswith("broken:")).select("gen_id", F.expr("substring(defect, 8)").alias("word")).distinct()
    said = F.concat_ws(" ", F.col("query"), F.filter(F.coalesce("truth", F.array()), lambda t: t.isNotNull()))
    words = src.select(F.explode(F.regexp_extract_all(F.lower(said), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    words = materialise(words, "words")
    asked = open_.select("word").distinct()
    # each word gives its beginnings up to MAX_WORD; the few longer words are compared with each other
    longest = F.least(F.length("w") - 1, F.lit(MAX_WORD))
    begun = words.where(F.length("w") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), longest), lambda n: F.substring("w", F.lit(1), n))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("longer"))
    same = F.substring("word", 1, MAX_WORD) == F.substring("w", 1, MAX_WORD)
    further = asked.where(F.length("word") > MAX_WORD).join(words.where(F.length("w") > MAX_WORD), same & (F.length("w") > F.length("word")) & F.col("w").startswith(F.col("word")))
    begins = asked.where(F.length("word") <= MAX_WORD).join(begun, "word").select("word", "longer").unionByName(further.groupBy("word").agg(F.sum("n").alias("longer")))
    broken = begins.join(words, F.col("word") == F.col("w"), "left").where(F.coalesce("n", F.lit(0)) * RARER < F.col("longer")).select("word")
    late = open_.join(broken, "word", "left_semi").select("gen_id", F.lit("truncated").alias("defect"))
    return sure.unionByName(late).groupBy("gen_id").agg(F.min("defect").alias("defect"))
