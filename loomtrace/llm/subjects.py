"""Problem 3: subject areas of the current prompt by a classifier chain decoded with beam search.

Three sources label sentences for the fit, each bounded: the labelled samples, documents whose address names a
subject, and prompts with the unreliable topic of their turn as a weak label. A sentence is described by terms
(words, word pairs, word stems, Chinese sign pairs), structure (question, length) and source (page or prompt,
platform). Only terms of which one subject holds at least ``CONCENTRATION`` take part, so that the wording every
subject shares does not drown a rare term. Logistic units, begun at the log ratios of naive Bayes, give each
sentence a score for every subject; what a prompt holds for a subject is the best score of its sentences.

A chain over the subjects, each link seeing the ones decided before it, models which subjects occur together.
It is fitted on prompts with known sets of subjects: labelled samples alone and put together with others, partners
drawn as often as the two subjects meet in the corpus, and prompts without a subject's term. Their evidence comes
from units that never saw these samples. A held-out part of them calibrates every link (Platt), so a combination
is the likeliest one at a threshold of one half. Beam search decodes it.

Asides in brackets and greetings name things only in passing and are left out.

Defined results: null or empty histories and prompts without a sentence give no row; every row of a repeated
turn gets its own rows; a null or unknown platform is no source feature.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import pii
from loomtrace.llm.language import current_prompt

BITS = 17
#: Bounds of the fit, in rows with the smallest hashes.
FIT_SAMPLES = 5_000
FIT_DOCUMENTS = 2_000
FIT_PROMPTS = 20_000
EPOCHS = 4
BEAM = 6
#: Least share of a term's weight (with every subject made equally heavy) that one subject must hold.
CONCENTRATION = 0.5
#: Prompts put together for each labelled sample to fit and calibrate the chain, and the part held out for calibration.
COMPOSED = 6
HELD_OUT = 0.25
#: How strongly a link is drawn to what all links share, and its calibration to none.
RIDGE = 10.0
KEEP_SENTENCES = 200_000

# Topics of the export and the subject they stand for.
TOPIC_SUBJECT = {
    "finance": "finance", "law": "law", "travel": "travel", "sports": "sport", "sport": "sport", "cooking": "cooking", "music": "music", "science": "science",
    "health": "health", "mental health": "health", "programming": "software", "troubleshooting": "software", "software": "software", "cars": "cars",
}

_ASIDE = re.compile(r"\([^()]*\)|（[^（）]*）")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])\s*|\n+|\s+/\s+|\s{2,}|(?<=[a-zß-ÿ])\s+(?=(?:" + "|".join(sorted(w for w in pii._OPENERS if len(w) > 2)) + r")\b)")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_NOISE = re.compile(r"https?://\S+|\S+@\S+|\{[^{}]*\}")
_CJK = re.compile(r"[㐀-鿿]")


_NO_NAMES = pii.Lexicon({}, frozenset())


def sentences(prompt: str | None) -> list[str]:
    """Sentences without asides, addresses of all kinds, numbers of persons and names."""
    if not prompt:
        return []
    for a, b, _ in reversed(pii.find(prompt, _NO_NAMES)):
        prompt = prompt[:a] + " " + prompt[b:]
    return [s for s in _SENTENCE.split(_NOISE.sub(" ", _ASIDE.sub(" ", prompt))) if s and _TOKEN.search(s)]


MASK = (1 << BITS) - 1


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode()) & MASK


def features(sentence: str) -> tuple[list[int], list[int]]:
    """Hashed terms and hashed structure of a sentence; digits count as one sign."""
    sentence = re.sub(r"\d+", "9", sentence)
    words = [w.lower() for w in _TOKEN.findall(sentence)]
    terms: list[str] = []
    for w in words:
        if _CJK.match(w):
            terms += [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]
        else:
            terms.append(w)
            if len(w) > 6:
                terms.append("^" + w[:6])
    terms += [f"{a} {b}" for a, b in zip(words, words[1:])]
    structure = (f"~q{int(sentence.rstrip()[-1:] in '?？')}", f"~n{min(4, len(words) // 4)}")
    return list(dict.fromkeys(map(_bucket, terms))), list(map(_bucket, structure))


def source(kind: str, platform: str | None) -> list[int]:
    """Hashed source of a text: page or prompt, and its platform."""
    named = (platform or "").strip().lower()
    return [_bucket(f"~s{kind}"), *([_bucket(f"~p{named}")] if named else [])]


class Units:
    """Logistic units, one per subject, over the hashed features that ``keep`` marks."""

    def __init__(self, n: int):
        self.w = np.zeros((1 << BITS, n), dtype=np.float32)
        self.b = np.full(n, -2.0, dtype=np.float32)
        self.keep = np.zeros(1 << BITS, dtype=bool)

    def select(self, terms: list[list[int]], label: np.ndarray, weight: np.ndarray) -> None:
        """Keep the terms that one subject holds, and begin at their smoothed log ratios."""
        n = self.w.shape[1]
        flat = np.concatenate([np.array(r, dtype=np.int64) for r in terms])
        own = np.repeat(np.arange(len(terms)), [len(r) for r in terms])
        counts = np.zeros((1 << BITS, n))
        np.add.at(counts, (flat, label[own]), weight[own])
        size = np.maximum(np.bincount(label, weights=weight, minlength=n), 1e-9)
        fair = counts / (size / size.mean())
        self.keep = (fair.sum(axis=1) > 0) & (fair.max(axis=1) + 0.3 / n >= CONCENTRATION * (fair.sum(axis=1) + 0.3))
        smooth = 0.5
        here = (counts + smooth) / (size + 2 * smooth)
        there = (counts.sum(axis=1, keepdims=True) - counts + smooth * (n - 1)) / (size.sum() - size + 2 * smooth * (n - 1) + 1e-9)
        if n > 1:
            self.w[self.keep] = 0.3 * (np.log(here) - np.log(there))[self.keep]

    def fit(self, terms: list[list[int]], extra: list[list[int]], label: np.ndarray, weight: np.ndarray, rate: float = 0.3, decay: float = 2e-6) -> None:
        self.select(terms, label, weight)
        rows = [[i for i in t if self.keep[i]] + x for t, x in zip(terms, extra)]
        y = np.zeros((len(rows), self.w.shape[1]), dtype=np.float32)
        y[np.arange(len(rows)), label] = 1
        sizes = np.array([len(r) for r in rows])
        flat = np.concatenate([np.array(r, dtype=np.int64) for r in rows])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        g2, gb2 = np.full_like(self.w, 1e-3), np.full_like(self.b, 1e-3)
        rng = np.random.default_rng(7)
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 512):
                part = order[at : at + 512]
                idx = np.concatenate([flat[starts[i] : starts[i + 1]] for i in part])
                own = np.repeat(np.arange(len(part)), sizes[part])
                first = np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
                scale = 1 / np.sqrt(sizes[part])[:, None]
                z = np.add.reduceat(self.w[idx], first, axis=0) * scale + self.b
                d = (1 / (1 + np.exp(-z)) - y[part]) * weight[part][:, None]
                unique, inverse = np.unique(idx, return_inverse=True)
                contribution = (d * scale)[own]
                g = np.stack([np.bincount(inverse, weights=contribution[:, k], minlength=len(unique)) for k in range(y.shape[1])], axis=1).astype(np.float32) + decay * self.w[unique]
                g2[unique] += g * g
                self.w[unique] -= rate * g / np.sqrt(g2[unique])
                gb = d.sum(axis=0)
                gb2 += gb * gb
                self.b -= rate * gb / np.sqrt(gb2)

    def part(self, terms: list[int], structure: list[int]) -> tuple[np.ndarray, int]:
        """Sum of the weights of a sentence without its source, and their number."""
        row = [i for i in terms if self.keep[i]] + structure
        return self.w[row].sum(axis=0), len(row)

    def whole(self, part: tuple[np.ndarray, int], origin: list[int]) -> np.ndarray:
        return (part[0] + self.w[origin].sum(axis=0)) / np.sqrt(part[1] + len(origin)) + self.b


def _logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, ridge: float) -> np.ndarray:
    """Logistic regression drawn towards ``start``: Newton steps, halved until the loss falls."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * ((w - start) ** 2).sum())

    w, now = start.copy(), loss(start)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step, size = np.linalg.solve(h, x.T @ (p - y) + ridge * (w - start)), 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        if now - loss(w - size * step) < 1e-8 * (1 + now):
            break
        w = w - size * step
        now = loss(w)
    return w


class Chain:
    """Links over the subjects: evidence for the subject, the best rival, the number of sentences and the earlier decisions."""

    def __init__(self, n: int):
        self.n = n
        self.w = np.zeros((n, 4 + n))
        self.w[:, 0] = 1.0
        self.scale, self.shift = np.ones(n), np.zeros(n)

    @staticmethod
    def inputs(evidence: np.ndarray, k: int, count: np.ndarray, before: np.ndarray) -> np.ndarray:
        rest = np.delete(evidence, k, axis=-1)
        rival = rest.max(axis=-1) if rest.shape[-1] else np.full(rest.shape[:-1], -9.0)
        return np.concatenate([np.stack([evidence[..., k], rival, np.log1p(count), np.ones_like(rival)], axis=-1), before], axis=-1)

    def _links(self, evidence: np.ndarray, count: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for k in range(self.n):
            before = y.copy()
            before[:, k:] = 0
            yield k, self.inputs(evidence, k, count, before)

    def fit(self, evidence: np.ndarray, count: np.ndarray, y: np.ndarray) -> None:
        """One regression over all links settles the weights of evidence, rival, count and bias; every link is drawn to it."""
        links = list(self._links(evidence, count, y))
        shared = _logistic(np.concatenate([x[:, :4] for _, x in links]), np.concatenate([y[:, k] for k, _ in links]), np.eye(4)[0], 1.0)
        for k, x in links:
            self.w[k] = _logistic(x, y[:, k], np.concatenate([shared, np.zeros(self.n)]), RIDGE)

    def calibrate(self, evidence: np.ndarray, count: np.ndarray, y: np.ndarray) -> None:
        """Scale and shift of every link's log-odds on rows that were not fitted on."""
        for k, x in self._links(evidence, count, y):
            z = np.stack([x @ self.w[k], np.ones(len(x))], axis=1)
            self.scale[k], self.shift[k] = _logistic(z, y[:, k], np.array([1.0, 0.0]), RIDGE)

    def log_odds(self, k: int, x: np.ndarray) -> np.ndarray:
        return np.clip((x @ self.w[k]) * self.scale[k] + self.shift[k], -30, 30)

    def decode(self, evidence: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Likeliest combination of each row, by beam search along the chain."""
        n = len(evidence)
        labels = np.zeros((n, 1, self.n))
        logp = np.zeros((n, 1))
        for k in range(self.n):
            width = labels.shape[1]
            e, c = np.repeat(evidence[:, None], width, axis=1), np.repeat(count[:, None], width, axis=1)
            z = self.log_odds(k, self.inputs(e, k, c, labels))
            yes, no = -np.log1p(np.exp(-z)), -np.log1p(np.exp(z))
            on = labels.copy()
            on[:, :, k] = 1
            labels, logp = np.concatenate([labels, on], axis=1), np.concatenate([logp + no, logp + yes], axis=1)
            if labels.shape[1] > BEAM:
                keep = np.argpartition(-logp, BEAM, axis=1)[:, :BEAM]
                labels, logp = np.take_along_axis(labels, keep[:, :, None], axis=1), np.take_along_axis(logp, keep, axis=1)
        return labels[np.arange(n), logp.argmax(axis=1)]


class Model:
    def __init__(self, subjects: list[str], units: Units, chain: Chain):
        self.subjects, self.units, self.chain, self.known = subjects, units, chain, {}

    def __reduce__(self):
        return Model, (self.subjects, self.units, self.chain)

    def _part(self, s: str) -> tuple[np.ndarray, int]:
        key = re.sub(r"\d+", "9", s)
        z = self.known.get(key)
        if z is None:
            if len(self.known) > KEEP_SENTENCES:
                self.known.clear()
            z = self.known[key] = self.units.part(*features(key))
        return z

    def evidence(self, prompt: str | None, platform: str | None = None) -> tuple[np.ndarray, int]:
        origin = source("prompt", platform)
        parts = [self.units.whole(self._part(s), origin) for s in sentences(prompt)]
        return (np.max(parts, axis=0), len(parts)) if parts else (np.full(len(self.subjects), -9.0), 0)

    def predict(self, prompts: list[str | None], platforms: list[str | None] | None = None) -> list[list[str]]:
        if not prompts or not self.subjects:
            return [[] for _ in prompts]
        pairs = [self.evidence(p, q) for p, q in zip(prompts, platforms or [None] * len(prompts))]
        got = self.chain.decode(np.stack([e for e, _ in pairs]).astype(float), np.array([c for _, c in pairs], dtype=float))
        return [[s for s, on in zip(self.subjects, row) if on] if c else [] for row, (_, c) in zip(got, pairs)]


class Sentences:
    """Labelled sentences of the fit."""

    def __init__(self):
        self.terms, self.extra, self.label, self.weight = [], [], [], []

    def add(self, text: str | None, k: int, weight: float, origin: list[int], times: int = 1) -> None:
        for s in sentences(text):
            t, x = features(s)
            for _ in range(times):
                self.terms.append(t or [0])
                self.extra.append(x + origin)
                self.label.append(k)
                self.weight.append(weight)

    def units(self, n: int, *more: "Sentences") -> Units:
        """Units fitted on these sentences and more."""
        every = (self, *more)
        units = Units(n)
        if any(s.terms for s in every):
            units.fit([t for s in every for t in s.terms], [x for s in every for x in s.extra], np.array([k for s in every for k in s.label]), np.array([w for s in every for w in s.weight], dtype=np.float32))
        return units


def _together(evidence: list[np.ndarray], n: int) -> tuple[np.ndarray, float]:
    """How often two subjects stand in one prompt by the units, smoothed, and the share of prompts with several subjects."""
    on = (np.array(evidence).reshape(-1, n) > 0).astype(float)
    meet = on.T @ on + 1.0
    np.fill_diagonal(meet, 0)
    return meet, float(np.clip((on.sum(axis=1) > 1).mean() if len(on) else 0.0, 0.1, 0.5))


def composed(samples: list[tuple[str, int]], model: Model, meet: np.ndarray, several: float, rng: np.random.Generator) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """(evidence, sentences, subjects) of prompts put together from labelled samples: alone, with one or two partners
    of other subjects, and a seventh of them without any term of a subject."""
    n = len(model.subjects)
    of = [[i for i, (_, k) in enumerate(samples) if k == j] for j in range(n)]
    origin, out = source("prompt", None), []
    for _ in range(COMPOSED):
        for text, k in samples:
            chosen, truth = [text], {k}
            dice = rng.random()
            for _ in range((dice < several) + (dice < several / 6)):
                odds = meet[list(truth)].sum(axis=0) * [bool(of[j]) and j not in truth for j in range(n)]
                if odds.sum() > 0:
                    j = int(rng.choice(n, p=odds / odds.sum()))
                    chosen.append(samples[of[j][rng.integers(len(of[j]))]][0])
                    truth.add(j)
            parts = [s for t in chosen for s in sentences(t)]
            if not parts:
                continue
            y = np.zeros(n)
            if rng.random() < 1 / 7:
                scores = [model.units.whole(model.units.part([], features(s)[1]), origin) for s in parts]
            else:
                scores = [model.units.whole(model._part(s), origin) for s in parts]
                y[list(truth)] = 1
            out.append((np.max(scores, axis=0), len(parts), y))
    return out


def trained(areas: DataFrame, samples: DataFrame, documents: DataFrame, turns: DataFrame) -> Model:
    """Units and chain from the tables, with at most FIT_SAMPLES, FIT_DOCUMENTS and FIT_PROMPTS rows; texts count whole."""
    names = sorted(r.subject for r in areas.select("subject").filter("subject is not null").distinct().collect())
    place = {s: i for i, s in enumerate(names)}
    n = len(names)
    chain = Chain(n)
    if not names:
        return Model(names, Units(0), chain)
    picked = samples.select("text", "subject").filter(F.col("text").isNotNull() & F.col("subject").isin(names)).orderBy(F.xxhash64("text"), "text", "subject").limit(FIT_SAMPLES)
    labelled = [(r.text, place[r.subject]) for r in picked.collect()]
    halves = [Sentences(), Sentences()]
    for i, (text, k) in enumerate(labelled):
        halves[i % 2].add(text, k, 1.0, source("prompt", None), times=3)
    weak = Sentences()
    slug = F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)-\d+", 1)
    pages = documents.filter("text is not null and url is not null").select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "platform" if "platform" in documents.columns else F.lit(None).cast("string").alias("platform"), slug.alias("s")).filter(F.col("s").isin(names))
    for r in pages.orderBy("h", "doc_id").limit(FIT_DOCUMENTS).collect():
        weak.add(r.text, place[r.s], 0.5, source("page", r.platform))
    topic = F.lower(F.regexp_replace(F.regexp_replace("topic", r"(?i)/misc", ""), r"^\s+|\s+$", ""))
    kinds = [k for k, v in TOPIC_SUBJECT.items() if v in place]
    platform = F.col("platform") if "platform" in turns.columns else F.lit(None).cast("string")
    topical = turns.select(F.xxhash64("row_id").alias("h"), "row_id", topic.alias("t"), platform.alias("f"), current_prompt(F.col("user_msg_history")).alias("p")).filter(F.col("t").isin(kinds) & F.col("p").isNotNull())
    prompts = topical.orderBy("h", "row_id").limit(FIT_PROMPTS).collect()
    for r in prompts:
        weak.add(r.p, place[TOPIC_SUBJECT[r.t]], 1.0, source("prompt", r.f))
    model = Model(names, weak.units(n, *halves), chain)
    meet, several = _together([e for e, c in (model.evidence(r.p, r.f) for r in prompts) if c], n)
    rng = np.random.default_rng(11)
    rows = []
    for i in range(2):
        unseen = Model(names, weak.units(n, halves[1 - i]), chain)
        rows += composed(labelled[i::2], unseen, meet, several, rng)
    if rows:
        held = rng.random(len(rows)) < HELD_OUT
        e, c, y = np.stack([a for a, _, _ in rows]).astype(float), np.array([b for _, b, _ in rows], dtype=float), np.stack([t for _, _, t in rows])
        chain.fit(e[~held], c[~held], y[~held])
        if held.any():
            chain.calibrate(e[held], c[held], y[held])
    return model


def subject_rows(turns: DataFrame, model: Model) -> DataFrame:
    """(row_id, subject) of every subject of each current prompt."""
    shared = turns.sparkSession.sparkContext.broadcast(model)
    kind = dict(turns.dtypes)["row_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys, prompts, platforms, out = f["k"].tolist(), f["p"].tolist(), f["f"].tolist(), []
            for at in range(0, len(keys), 2_000):
                part = slice(at, at + 2_000)
                out += [(k, s) for k, got in zip(keys[part], shared.value.predict(prompts[part], platforms[part])) for s in got]
            yield pd.DataFrame(out, columns=["row_id", "subject"])

    platform = F.col("platform") if "platform" in turns.columns else F.lit(None).cast("string")
    slim = turns.select(F.col("row_id").alias("k"), platform.alias("f"), current_prompt(F.col("user_msg_history")).alias("p")).filter("p is not null")
    return slim.mapInPandas(run, f"row_id {kind}, subject string")
