"""Problem 1: the language of each prompt and of each of its segments.

Multinomial naive Bayes over hashed character n-grams of words. The matrix of log-probabilities (buckets x
languages) is fitted on labelled sample texts plus a bounded number of documents whose unreliable label the
first fit confirms, and is broadcast; whole batches are scored at once with numpy. A prompt is cut into sentences, a sentence into two
where that explains its words far better, and neighbours of one language are joined.

Words that begin with a capital inside a sentence do not vote (names, addresses, firms), so a sentence
without any other evidence takes the language of its neighbour and single foreign terms make no segment.

Confidences are calibrated: the log-likelihoods are tempered by the number of signs and by one temperature, fitted on
beginnings of labelled texts that the fit left out.

Defined results: a null history, an empty one and a null or wordless current prompt give no segment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "ru", "zh")
BITS = 17
GRAMS = (1, 2, 3, 4)
#: Bounds of the fit: labelled sample rows, and documents (those with the smallest hashes of doc_id).
FIT_SAMPLES = 5_000
FIT_DOCUMENTS = 800
FIT_PROMPTS = 2_000
#: Least gain in log-likelihood for a change of language inside a sentence, least words on each side, and the cost of a change between sentences.
SPLIT_GAIN = 60.0
SPLIT_WORDS = 4
CHANGE_COST = 20.0

# Names and codes of the nine languages, in lower case.
NAMES = {
    "en": ("en", "eng", "english", "anglais", "englisch", "inglés", "ingles", "inglese", "inglês", "engels", "английский", "英语", "英文"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "aleman", "tedesco", "alemão", "duits", "немецкий", "德语"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "frances", "francese", "francês", "frans", "французский", "法语"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "castilian", "spanisch", "espagnol", "spagnolo", "espanhol", "spaans", "испанский", "西班牙语"),
    "it": ("it", "ita", "italian", "italiano", "italienisch", "italien", "italiaans", "итальянский", "意大利语"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portugiesisch", "portugais", "portugués", "portoghese", "portugees", "brazilian", "португальский", "葡萄牙语"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "niederländisch", "néerlandais", "neerlandés", "olandese", "holandês", "flemish", "нидерландский", "荷兰语"),
    "ru": ("ru", "rus", "russian", "русский", "russisch", "russe", "ruso", "russo", "俄语"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "中文", "汉语", "漢語", "普通话", "mandarin", "chinesisch", "chinois", "chino", "cinese", "chinês", "chinees", "китайский"),
}
CODE_OF = {name: code for code, names in NAMES.items() for name in names}

_MAIL = r"[\w.+-]+\s*(?:\(at\)|\[at\]|\[@\]|\bat\b|@)\s*[\w-]+(?:\s*(?:\.|\bdot\b|\(dot\)|\[dot\]|\[\.\])\s*[\w-]+)+"
_SKIP = re.compile(_MAIL + r"|https?://\S+|www\.\S+|\S+@\S+|`[^`]*`|\b\w*\d\w*\b|[\w.+-]+\.(?:com|org|net|test|example)\b|\b[^\W\d_]\.|\b[A-Z]{2,4}\b")
_SENTENCE = re.compile(r"(?:[^.!?。！？…\n]|[.!?…](?=[^\s\"'»”)\]]))+(?:[.!?。！？…]+[\"'»”)\]]*|\n+|$)")
_SLASH = re.compile(r"\s+[/|]\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SPLIT_LANG = re.compile(r"[\s_\-/,;(]+")


def code_of(label: str | None) -> str | None:
    """The language a label names in any spelling, or None."""
    if not label:
        return None
    x = label.strip().lower()
    return CODE_OF.get(x) or CODE_OF.get(_SPLIT_LANG.split(x)[0])


def hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of the words (with their edges) and the word it belongs to."""
    text = " " + " ".join(words).lower() + "  "
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    space = codes == 32
    word = np.cumsum(space) - 1
    starts = np.arange(len(codes))
    ends = np.append(np.flatnonzero(space), len(codes))
    nearest = ends[np.searchsorted(ends, starts + 1)]  # first space after each place
    h = np.zeros(len(codes), dtype=np.uint64)
    buckets, owners = [], []
    for n in range(1, max(GRAMS) + 1):
        shifted = np.zeros_like(codes)
        shifted[: len(codes) - n + 1] = codes[n - 1 :]
        h = h * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(n)
        if n in GRAMS:
            ok = (starts + n - 1 <= nearest) & (word < len(words))
            if n == 1:
                ok &= ~space
            mixed = h[ok] ^ (h[ok] >> np.uint64(29))
            buckets.append(((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(word[ok])
    return np.concatenate(buckets), np.concatenate(owners)


KEEP_WORDS = 300_000


class Model:
    """logp: (2**BITS, languages). Scores of words are kept, as a corpus repeats its words; up to KEEP_WORDS of them."""

    def __init__(self, logp: np.ndarray, temperature: float = 1.0):
        self.logp, self.temperature, self.known = logp, temperature, {}

    def __reduce__(self):
        return Model, (self.logp, self.temperature)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word under each language, relative to its mean over the languages."""
        if not words:
            return np.zeros((0, len(LANGUAGES)))
        known = self.known
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if fresh:
            if len(known) > KEEP_WORDS:
                known.clear()
                fresh = list(dict.fromkeys(words))
            b, w = hashes(fresh)
            rows = self.logp[b]
            out = np.stack([np.bincount(w, weights=rows[:, k], minlength=len(fresh)) for k in range(len(LANGUAGES))], axis=1)
            known.update(zip(fresh, out - out.mean(axis=1, keepdims=True)))
        return np.stack([known[w] for w in words])


def fit(texts: list[tuple[str, str]], weight: np.ndarray | None = None) -> Model:
    """Model from (text, language) pairs; every language has the same prior."""
    counts = np.zeros((2**BITS, len(LANGUAGES)))
    for k, code in enumerate(LANGUAGES):
        words = [w for t, c in texts if c == code for w in _WORD.findall(_SKIP.sub(" ", t))]
        if words:
            counts[:, k] = np.bincount(hashes(words)[0], minlength=2**BITS)
    smooth = 0.1  # of a count, for every bucket
    logp = np.log((counts + smooth) / (counts.sum(axis=0) + smooth * 2**BITS))
    return Model(logp.astype(np.float32))


#: Beginnings of so many words stand for the shortest segments when the confidence is calibrated.
CALIBRATION_WORDS = (1, 2, 3, 5, 8)


def beginnings(texts: list[tuple[str, str]], model: Model) -> list[tuple[np.ndarray, int, int]]:
    """(score, signs, index of the language) of the beginnings of labelled texts."""
    out = []
    for text, code in texts:
        words = _WORD.findall(_SKIP.sub(" ", text))
        for n in CALIBRATION_WORDS:
            if n <= len(words):
                out.append((model.scores(words[:n]).sum(axis=0), sum(map(len, words[:n])), LANGUAGES.index(code)))
    return out


def temperature(cases: list[tuple[np.ndarray, int, int]]) -> float:
    """The temperature of the least log loss on held-out cases; 1 where there are none."""
    if not cases:
        return 1.0
    z = np.stack([s / max(1.0, np.sqrt(n)) for s, n, _ in cases])
    right = np.array([k for _, _, k in cases])

    def loss(t: float) -> float:
        p = z / t - (z / t).max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(p).sum(axis=1)) - p[np.arange(len(p)), right]))

    return min(np.geomspace(0.1, 10.0, 81), key=loss)


def trained(samples: DataFrame, documents: DataFrame | None = None, turns: DataFrame | None = None) -> Model:
    """First fit on labelled samples, second one with documents and prompts whose label the first fit confirms (all
    bounded, the rows with the smallest hashes); the temperature comes from a fit without a third of the samples."""
    picked = samples.select("text", "lang").filter("text is not null").orderBy(F.xxhash64("text"), "text", "lang").limit(FIT_SAMPLES)
    labelled = [(r.text, c) for r in picked.collect() if (c := code_of(r.lang))]
    model = fit(labelled)
    parts = []
    if documents is not None:
        parts.append((documents.select(F.xxhash64("doc_id").alias("h"), "doc_id", "lang", "text"), FIT_DOCUMENTS))
    if turns is not None:
        parts.append((turns.select(F.xxhash64("row_id").alias("h"), "row_id", F.col("language").alias("lang"), current_prompt(F.col("user_msg_history")).alias("text")), FIT_PROMPTS))
    more = []
    for part, bound in parts:
        for r in part.filter("text is not null and lang is not null").orderBy(*part.columns[:2]).limit(bound).select("lang", "text").collect():
            c = code_of(r.lang)
            more.extend((text, c) for text, _, _, lang, _ in segments(r.text, model) if lang == c)
    whole = fit(labelled * 3 + more) if more else model
    apart = fit([x for i, x in enumerate(labelled) if i % 3] * 3 + more)
    whole.temperature = temperature(beginnings(labelled[::3], apart))
    return whole


@dataclass
class Piece:
    text: str
    start: int
    end: int
    score: np.ndarray
    grams: int


def _votes(sentence: str) -> tuple[list[str], list[int], bool]:
    """Words of a sentence that may vote, their places, and whether it has words at all."""
    words, places, seen = [], [], False
    for m in _WORD.finditer(sentence):
        w = m.group()
        if not seen or not w[0].isupper() or (len(w) > 1 and w.isupper() and sentence.isupper()):
            words.append(w)
            places.append(m.start())
        seen = True
    return words, places, seen


def _split(sentence: str, words: list[str], places: list[int], s: np.ndarray) -> int | None:
    """Place at which the sentence changes its language, if two languages explain it far better than one."""
    if len(words) < 2 * SPLIT_WORDS:
        return None
    left = np.cumsum(s, axis=0)
    total = left[-1]
    a, b = left[SPLIT_WORDS - 1 : -SPLIT_WORDS], total - left[SPLIT_WORDS - 1 : -SPLIT_WORDS]
    gain = a.max(axis=1) + b.max(axis=1) - total.max()
    k = int(gain.argmax())
    x, y = int(a[k].argmax()), int(b[k].argmax())
    if gain[k] < SPLIT_GAIN or x == y or min(a[k][x] - a[k][y], b[k][y] - b[k][x]) < SPLIT_GAIN / 3:
        return None
    if not words[k + SPLIT_WORDS][0].isupper() and gain[k] < 3 * SPLIT_GAIN:
        return None
    return places[k + SPLIT_WORDS]


def pieces(text: str, model: Model) -> list[Piece]:
    out: list[Piece] = []
    text = _SKIP.sub(lambda m: " " * len(m.group()), text)
    for m in _SENTENCE.finditer(text):
        spans, at = [], m.start()
        for x in _SLASH.finditer(m.group()):
            spans.append((at, m.start() + x.start()))
            at = m.start() + x.end()
        spans.append((at, m.end()))
        stack = spans[::-1]
        while stack:
            a, b = stack.pop()
            words, places, seen = _votes(text[a:b])
            if not seen:
                continue
            s = model.scores(words)
            cut = _split(text[a:b], words, places, s)
            if cut is not None and cut > 0:
                stack.append((a + cut, b))
                stack.append((a, a + cut))
                continue
            out.append(Piece(text[a:b], a, b, s.sum(axis=0), sum(map(len, words))))
    return out


def _decode(scores: np.ndarray) -> list[int]:
    """Best sequence of languages when each change between neighbours costs CHANGE_COST."""
    best = scores[0].copy()
    back = []
    for row in scores[1:]:
        k = int(best.argmax())
        change = best[k] - CHANGE_COST
        stay = best >= change
        back.append(np.where(stay, np.arange(len(best)), k))
        best = np.where(stay, best, change) + row
    k = int(best.argmax())
    path = [k]
    for b in reversed(back):
        k = int(b[k])
        path.append(k)
    return path[::-1]


def segments(text: str | None, model: Model) -> list[tuple[str, int, int, str, float]]:
    """Maximal runs (text, start, end, language, confidence) of one language."""
    found = pieces(text, model) if text else []
    if not found:
        return []
    if not any(p.grams for p in found):
        words = _WORD.findall(_SKIP.sub(" ", text))
        k, c = _best(model.scores(words).sum(axis=0), sum(map(len, words)), model.temperature)
        return [(text, 0, len(text), LANGUAGES[k], c)]
    runs: list[list] = []
    for p, k in zip(found, _decode(np.array([p.score for p in found]))):
        if runs and runs[-1][0] == k:
            runs[-1][2], runs[-1][3], runs[-1][4] = p.end, runs[-1][3] + p.score, runs[-1][4] + p.grams
        else:
            runs.append([k, p.start, p.end, p.score.copy(), p.grams])
    return [(text[a:b], a, b, LANGUAGES[k], _best(s, g, model.temperature)[1]) for k, a, b, s, g in runs]


def _best(score: np.ndarray, grams: int, heat: float = 1.0) -> tuple[int, float]:
    """Language and confidence; n-grams overlap and are no independent evidence, so the scores are tempered."""
    z = score / (max(1.0, np.sqrt(grams)) * heat)
    p = np.exp(z - z.max())
    k = int(score.argmax())
    return k, float(p[k] / p.sum())


def current_prompt(history: Column) -> Column:
    return F.try_element_at(history, F.lit(-1))


def prompt_segments(turns: DataFrame, model: Model, key: str = "row_id", history: str = "user_msg_history", label: str = "language") -> DataFrame:
    """(key, label, seg_no, lang, start, end, confidence) of every segment of each current prompt."""
    shared = turns.sparkSession.sparkContext.broadcast(model)
    kind = dict(turns.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for f in frames:
            out, known = [], {}
            for k, label_, text in zip(f["k"].tolist(), f["l"].tolist(), f["t"].tolist()):
                if text is None:
                    continue
                found = known.get(text)
                if found is None:
                    found = known[text] = segments(text, m)
                out.extend((k, label_, i, lang, a, b, c) for i, (_, a, b, lang, c) in enumerate(found, 1))
            yield pd.DataFrame(out, columns=[key, "label", "seg_no", "lang", "start", "end", "confidence"])

    slim = turns.select(F.col(key).alias("k"), F.col(label).alias("l"), current_prompt(F.col(history)).alias("t"))
    return slim.mapInPandas(run, f"`{key}` {kind}, label string, seg_no bigint, lang string, start int, end int, confidence double")


def label_code(label: Column) -> Column:
    """``code_of`` as a column."""
    x = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    codes = F.create_map(*[F.lit(v) for pair in sorted(CODE_OF.items()) for v in pair])
    return F.coalesce(F.try_element_at(codes, x), F.try_element_at(codes, F.split(x, r"[\s_\-/,;(]+", 2)[0]))


def mislabelled(turns: DataFrame, model: Model) -> DataFrame:
    """Segments of the rows whose label is missing or wrong or whose prompt has more than one language."""
    kind = dict(turns.dtypes)["row_id"]
    shared = turns.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for f in frames:
            out, known = [], {}
            for k, code, text in zip(f["k"].tolist(), f["l"].tolist(), f["t"].tolist()):
                found = known.get(text)
                if found is None:
                    found = known[text] = [x[3] for x in segments(text, m)]
                if found and (len(set(found)) > 1 or code != found[0]):
                    out.extend((k, i, lang) for i, lang in enumerate(found, 1))
            yield pd.DataFrame(out, columns=["row_id", "seg_no", "lang"])

    slim = turns.select(F.col("row_id").alias("k"), label_code(F.col("language")).alias("l"), current_prompt(F.col("user_msg_history")).alias("t")).filter("t is not null")
    return slim.mapInPandas(run, f"row_id {kind}, seg_no bigint, lang string")
