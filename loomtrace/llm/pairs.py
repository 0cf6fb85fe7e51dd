"""Problem 2: defective prompt and answer pairs, found by ordered rules.

The rules look for emptiness, copied prompts, refusals in nine languages, abrupt endings (unclosed code
blocks, sentences without an end, dots in place of the rest, list numbers without an item) and answers in a language
that the prompt neither uses nor asks for. ``triggered_pairs`` gives every rule that fires with its rank in the order
of ``DEFECTS``; a pair's defect is the one of the first rank.

A short answer without a full stop is either a direct answer ("About 10 percent") or the beginning of a
sentence. That is decided by the corpus: the openings (first words) that make up at least ``OPENING_SHARE``
of all finished sentences, at most 1/OPENING_SHARE of them, are gathered over all rows. They can be fitted once and
kept (``loomtrace.llm.models``), so that a pair gets the same label in any later table.

Defined results: a null or missing answer is ``empty`` whatever the prompt; a null history has no pairs; null
prompts take part with the rules that need no prompt.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import language

DEFECTS = ("empty", "copy", "refusal", "truncated", "wrong_language")
OPENING_SHARE = 0.0004
OPENING_WORDS = 4
SHORT_WORDS = 8
SHORT_CJK = 14
EXTRA_CHARS = 16
LANGUAGE_WORDS = 4
#: A short prompt may be in any language whose log-likelihood is as close as this to the best.
DOUBT = 15.0

# What a refusal says, by language; each sentence of a refusal is one of these or of the courtesies.
REFUSAL = re.compile(
    "|".join(
        (
            r"\b(?:can(?:no|')?t|cannot|can not|could not|couldn't|unable to|not able to|won't be able to|must decline to|have to decline to|decline to|not (?:allowed|permitted) to|refuse to) "
            r"(?:\w+ ){0,2}(?:help|assist|answer|do (?:that|this|it)|discuss|provide|respond|comply|do|support|talk|share|fulfil+)\b",
            r"\b(?:outside|beyond|against) (?:what i'm|what i am|my|the) (?:allowed|permitted|guidelines|scope|policy|policies|rules)\b",
            r"\bprevent(?:s)? me from\b",
            r"\bsomething i (?:won't|can't|cannot)\b",
            r"\b(?:kann|darf|möchte)\b.{0,50}\b(?:nicht|keine?n?)\b.{0,30}\b(?:helfen|beantworten|antworten|geben|sprechen|weiterhelfen|unterstützen)\b",
            r"\b(?:nicht|keine?n?)\b.{0,30}\b(?:beantworten|helfen|geben|sprechen)\b.{0,12}\b(?:kann|darf)\b",
            r"\bnicht (?:möglich|erlaubt|gestattet)\b",
            r"\b(?:ne (?:peux|puis|suis)|n'ai)\b.{0,12}\b(?:pas|point)\b.{0,60}\b(?:aider|répondre|fournir|parler|discuter|traiter|donner|autorisée?|droit)\b",
            r"\bil (?:ne m'est|m'est) (?:pas|impossible)\b",
            r"\bno (?:puedo|me es posible|tengo permitido|estoy autorizad[oa]|soy capaz)\b.{0,50}\b(?:ayudar\w*|responder|hablar|contestar|proporcionar|dar|atender)\b",
            r"\bnon (?:posso|sono in grado|mi è (?:permesso|consentito|possibile)|sono autorizzat[oa])\b.{0,50}\b(?:aiutar\w*|rispondere|parlare|fornire|dare|discutere|trattare)\b",
            r"\bnão (?:posso|me é (?:permitido|possível)|sou capaz|estou autorizad[oa]|consigo|tenho permissão)\b.{0,50}\b(?:ajudar\w*|responder|falar|fornecer|dar|discutir|atender)\b",
            r"\b(?:kan|mag|kunnen)\b.{0,50}\b(?:niet|geen)\b.{0,40}\b(?:helpen|antwoord\w*|beantwoorden|geven|bespreken|praten|ingaan)\b",
            r"\bniet\b.{0,40}\b(?:helpen|beantwoorden|bespreken|praten|ingaan|toegestaan|in staat)\b|\bgeen\b.{0,20}\b(?:antwoord|informatie|hulp)\b.{0,12}\b(?:geven|bieden)\b",
            r"\bне (?:могу|имею права|вправе|в состоянии|разрешено|смогу)\b.{0,50}(?:помочь|ответить|обсуждать|говорить|предоставить|отвечать|дать)",
            r"(?:мне|нам) (?:нельзя|запрещено)|не разрешено|не позволяют",
            r"(?:无法|不能|不可以|没有办法|不便|不被允许|无权|未被允许).{0,14}(?:帮助|回答|协助|提供|讨论|处理|谈论|回复)",
        )
    ),
    re.IGNORECASE | re.DOTALL,
)
COURTESY = re.compile(
    r"^(?:i'?m sorry|sorry|unfortunately|i apologi[sz]e|apologies|let's (?:talk|discuss)|is there (?:anything|something)|please (?:consult|contact|ask|try|see)|can i help|feel free|perhaps|thank you|"
    r"(?:es )?tut mir leid|leider|entschuldigung|désolée?|je (?:suis désolée?|regrette)|malheureusement|lo siento|por desgracia|lamentablemente|mi dispiace|purtroppo|sinto muito|infelizmente|desculpe|"
    r"(?:het )?spijt me|helaas|извините|к сожалению|простите|很抱歉|抱歉|对不起|请)",
    re.IGNORECASE,
)
LEAD = re.compile(r"^(?:q|you asked|question|prompt|user|frage|pregunta|domanda|pergunta|vraag|вопрос|问题|问)\s*[:：]\s*", re.IGNORECASE)
_END = re.compile(r"[.!?。！？…؟:](?:[\"'»”’)\]}*_]|\s)*$")
_DOTS = re.compile(r"\w(?:\.{3}|…)[\"'»”’)\]]*$")
_SENTENCE_GAP = re.compile(r"(?<=[.!?。！？…])[\"'»”)\]]*\s+|(?<=[。！？])")
_LINK_END = re.compile(r"(?:https?://|www\.)[^\s]+[)\]>]?$")
_ITEM = re.compile(r"^\s*(?:[-*•+]|\d{1,3}[.)])\s+\S")
_CJK = re.compile(r"[㐀-鿿぀-ヿ]")
_WORDS = re.compile(r"\w+")


def visible(text: str | None) -> bool:
    return bool(text) and any(not c.isspace() and unicodedata.category(c) not in ("Cf", "Cc", "Zs", "Zl", "Zp", "Cn") for c in text)


def squeezed(text: str) -> str:
    return "".join(_WORDS.findall(text.lower()))


def opening(sentence: str) -> str:
    """First words of a sentence (first six signs in Chinese) with digits made alike."""
    s = re.sub(r"\d+", "9", sentence.strip().lower())
    return s[:6] if _CJK.match(s) else " ".join(s.split()[:OPENING_WORDS])


def openings(turns: DataFrame, answers: str = "assistant_msg_history") -> frozenset[str]:
    """Openings of at least OPENING_SHARE of all finished sentences of all answers; the share bounds their number."""
    sentence = (
        turns.select(F.explode(answers).alias("a"))
        .filter("a is not null")
        .select(F.explode(F.split("a", r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n+")).alias("s"))
        .select(F.lower(F.regexp_replace(F.regexp_replace("s", r"\d+", "9"), r"(?U)^\s+|\s+$", "")).alias("s"))
        .filter(F.col("s").rlike(r"[.!?。！？]$"))
    )
    first = F.when(F.col("s").rlike(r"^[㐀-鿿]"), F.substring("s", 1, 6)).otherwise(F.array_join(F.slice(F.split("s", r"(?U)\s+"), 1, OPENING_WORDS), " "))
    counted = sentence.groupBy(first.alias("o")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row, over the same shuffle as the counts
    kept = counted.join(F.broadcast(total)).filter((F.col("n") >= OPENING_SHARE * F.col("total")) & (F.col("n") >= 3) & (F.length("o") >= 4))
    return frozenset(r.o for r in kept.select("o").collect())


def is_copy(prompt: str | None, answer: str) -> bool:
    """The answer is the prompt, perhaps quoted, announced or without its last signs, with nothing added."""
    p = squeezed(prompt or "")
    a = squeezed(LEAD.sub("", answer.strip().lstrip("> \t\"'“«*").strip()))
    if not p or not a:
        return False
    if a == p:
        return True
    if len(p) < 8:
        return False
    if p.startswith(a) and len(a) >= 0.85 * len(p):
        return True
    if p in a:
        return len(a) - len(p) <= min(EXTRA_CHARS, len(p) // 3) or not a.replace(p, "")
    return False


def is_refusal(answer: str) -> bool:
    """Every sentence declines or is a courtesy, and at least one declines."""
    parts = [s for s in _SENTENCE_GAP.split(answer.strip().replace("’", "'")) if s and s.strip()]
    said = [bool(REFUSAL.search(s)) for s in parts]
    return any(said) and all(r or COURTESY.search(s.strip()) for r, s in zip(said, parts))


def is_truncated(answer: str, begun: frozenset[str], stems: frozenset[str]) -> bool:
    text = answer.rstrip()
    if text.count("```") % 2:
        return True
    if text.endswith("```") or _LINK_END.search(text.split("\n")[-1]):
        return False
    last = text.split("\n")[-1]
    if item := _ITEM.match(last):
        body = last[item.end() - 1 :]
        if _END.search(body):
            return False
        return last.endswith((",", "，", ";", "-", ":")) or len(body.split()) > SHORT_WORDS or opening(body) in begun or opening(body) in stems
    if re.fullmatch(r"\s*(?:[-*•+]|\d{1,3}[.)])\s*", last) and last != text:
        return True
    if _DOTS.search(text):
        return True
    if _END.search(text):
        return text.endswith((":", "：")) and len(text) > 20
    if unicodedata.category(text[-1]) in ("So", "Sk", "Mn", "Cf"):
        return False
    fragments = [s for s in _SENTENCE_GAP.split(text) if s and s.strip()]
    tail = fragments[-1].strip() if fragments else text
    if len(fragments) > 1:
        return True
    if tail.endswith((",", "，", ";", "(", "、", ":", "–", "-")):
        return True
    cjk = bool(_CJK.match(tail))
    if (len(tail) > SHORT_CJK) if cjk else (len(tail.split()) > SHORT_WORDS):
        return True
    o = opening(tail)
    return o in begun or o in stems


def stems_of(begun: frozenset[str]) -> frozenset[str]:
    """Beginnings of the openings, so that a text that breaks off inside one is recognised; a single whole word is none."""
    return frozenset(o[:k] for o in begun for k in range(3, len(o)) if " " in o[:k].rstrip() or o[k] != " " or _CJK.match(o)) - {o.split(" ")[0] for o in begun}


class Rules:
    def __init__(self, model: language.Model, begun: frozenset[str]):
        self.model, self.begun, self.stems = model, begun, stems_of(begun)

    def allowed(self, prompt: str) -> set[str]:
        """Languages a prompt uses or asks for."""
        used = {s[3] for s in language.segments(prompt, self.model)}
        if not used:
            return used
        total = self.model.scores(language._WORD.findall(language._SKIP.sub(" ", prompt))).sum(axis=0)
        used |= {code for code, x in zip(language.LANGUAGES, total) if total.max() - x < DOUBT}
        asked = {language.CODE_OF[w] for w in re.findall(r"[^\W\d_]{4,}", prompt.lower()) if w in language.CODE_OF}
        asked |= {code for name, code in language.CODE_OF.items() if len(name) > 1 and _CJK.match(name) and name in prompt}
        return used | asked

    def answer_language(self, answer: str) -> str | None:
        """The language of most of an answer, or None where it has too few words."""
        size: dict[str, int] = {}
        for text, _, _, lang, _ in language.segments(answer, self.model):
            size[lang] = size.get(lang, 0) + sum(len(w) if _CJK.match(w) else 1 for w in language._WORD.findall(text))
        best = max(size, key=size.get, default=None)
        return best if best is not None and size[best] >= LANGUAGE_WORDS else None

    def triggered(self, prompt: str | None, answer: str | None) -> Iterator[str]:
        if not visible(answer):
            yield "empty"
            return
        if is_copy(prompt, answer):
            yield "copy"
        if is_refusal(answer):
            yield "refusal"
        if is_truncated(answer, self.begun, self.stems):
            yield "truncated"
        if prompt:
            allowed = self.allowed(prompt)
            if allowed and (lang := self.answer_language(answer)) is not None and lang not in allowed:
                yield "wrong_language"


def triggered_pairs(turns: DataFrame, model: language.Model, begun: frozenset[str]) -> DataFrame:
    """(row_id, pair_no, defect, rank) of every rule that fires on a pair of the two histories, ranks from 1."""
    kind = dict(turns.dtypes)["row_id"]
    shared = turns.sparkSession.sparkContext.broadcast((model, begun))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = Rules(*shared.value)
        for f in frames:
            out, known = [], {}
            for key, prompts, answers in zip(f["row_id"].tolist(), f["u"], f["a"]):
                n = 0 if answers is None else len(answers)
                for i, prompt in enumerate(prompts):
                    pair = (prompt, answers[i] if i < n else None)
                    if pair not in known:
                        known[pair] = tuple(rules.triggered(*pair))
                    out.extend((key, i + 1, defect, rank) for rank, defect in enumerate(known[pair], 1))
            yield pd.DataFrame(out, columns=["row_id", "pair_no", "defect", "rank"])

    slim = turns.select("row_id", F.col("user_msg_history").alias("u"), F.col("assistant_msg_history").alias("a")).filter("u is not null")
    return slim.mapInPandas(run, f"row_id {kind}, pair_no bigint, defect string, rank int")


def defective_pairs(turns: DataFrame, model: language.Model, begun: frozenset[str]) -> DataFrame:
    """(row_id, pair_no, defect) of every defective pair: the triggered type of the first rank."""
    return triggered_pairs(turns, model, begun).filter("rank = 1").drop("rank")
