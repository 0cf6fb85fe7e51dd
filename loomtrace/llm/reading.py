"""Problem 10: reading level of English prose from vocabulary coverage and sentence complexity.

Words are ranked by their frequency over all documents. For each sentence the smallest vocabulary, taken in
order of that rank, which covers ``COVER`` of its words is found; a document's coverage rank is the median of
these over its words' sentences, so headings, marks and borrowed passages that make up less than half of it do
not move it. Sentence complexity, that is the length of sentences and of the words in them, is taken likewise.
Labelled samples calibrate the three in SQL (means by level and one pooled covariance), and every document takes
the level of the highest discriminant.

Defined results: null texts, texts of fewer than ``LEAST_WORDS`` words and texts that are no English prose give
no row; words outside the ranked vocabulary share the rank after its last; without samples there are no levels
and no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVER = 0.75
LEAST_WORDS = 60
#: A ranked word holds at least 1/SHARE of all tokens, which bounds the vocabulary.
SHARE = 200_000
ENGLISH_SHARE = 0.15
SENTENCE_SHARE = 0.5
WORD = r"[a-z]+(?:['’-][a-z]+)*"

# Function words that mark running English text.
FUNCTION_WORDS = frozenset(
    "the and of to that with for was were is are this which it from by as at but not be have had his her their they we you on in a an or if when because so my our".split()
)
_WORD = re.compile(WORD)
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)\]]*\s+|\n+")
_NOISE = re.compile(r"[^]*|&(?:amp|nbsp|lt|gt|quot|#\d+);|<[^<>]{0,200}>|https?://\S+")


def ranks(docs: DataFrame) -> dict[str, int]:
    """Rank of each common word by its frequency over all documents."""
    words = docs.filter("text is not null").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    total = docs.filter("text is not null").select(F.sum(F.regexp_count(F.lower("text"), F.lit(WORD)))).first()[0] or 0
    kept = words.filter(F.col("n") >= max(2, total / SHARE)).collect()
    return {r.w: i for i, r in enumerate(sorted(kept, key=lambda r: (-r.n, r.w)), 1)}


def _median(values: list[float], weights: list[int]) -> float:
    order = np.argsort(values, kind="stable")
    c = np.cumsum(np.array(weights)[order])
    return float(values[order[np.searchsorted(c, c[-1] / 2)]])


def measure(text: str, rank: dict[str, int]) -> tuple[float, float, float, bool] | None:
    """(log coverage rank, log sentence length, word length, whether the text is English prose), or None without words."""
    last = len(rank) + 1
    lengths, covers, letters, said, ended, chars, functional = [], [], [], [], 0, 0, 0
    for s in _SENTENCE.split(_NOISE.sub(" ", text)):
        low = s.lower()
        w = _WORD.findall(low)
        chars += len(s)
        if re.search(r"[.!?][\"'”’)\]]*\s*$", s):
            ended += len(s)
        if not w:
            continue
        r = sorted(rank.get(x, last) for x in w)
        covers.append(math.log(r[int(COVER * (len(r) - 1))]))
        lengths.append(math.log(len(w)))
        letters.append(sum(map(len, w)) / len(w))
        said.append(len(w))
        functional += sum(x in FUNCTION_WORDS for x in w)
    if not said:
        return None
    tokens = len(text.split())
    prose = functional >= ENGLISH_SHARE * max(sum(said), tokens) and ended >= SENTENCE_SHARE * chars
    return _median(covers, said), _median(lengths, said), _median(letters, said), prose


def measures(texts: DataFrame, key: str, rank: dict[str, int]) -> DataFrame:
    """(key, coverage, sentence, prose) of each text with enough words."""
    shared = texts.sparkSession.sparkContext.broadcast(rank)
    kind = dict(texts.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, t in zip(f["k"].tolist(), f["t"].tolist()):
                if t is not None and len(t.split()) >= LEAST_WORDS and (m := measure(t, shared.value)):
                    out.append((k, *m))
            yield pd.DataFrame(out, columns=[key, "coverage", "sentence", "word", "prose"])

    return texts.select(F.col(key).alias("k"), F.col("text").alias("t")).mapInPandas(run, f"`{key}` {kind}, coverage double, sentence double, word double, prose boolean")


CALIBRATION = """
WITH s AS (SELECT reading_level, coverage AS x, sentence AS y, word AS z FROM {samples}),
     m AS (SELECT reading_level, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM s GROUP BY reading_level),
     d AS (SELECT x - mx AS dx, y - my AS dy, z - mz AS dz FROM s JOIN m USING (reading_level)),
     p AS (SELECT avg(dx * dx) + 1e-3 AS a, avg(dx * dy) AS b, avg(dx * dz) AS c, avg(dy * dy) + 1e-3 AS e, avg(dy * dz) AS f, avg(dz * dz) + 1e-3 AS i FROM d),
     q AS (SELECT a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c) AS det, e * i - f * f AS xx, c * f - b * i AS xy, b * f - c * e AS xz,
                  a * i - c * c AS yy, b * c - a * f AS yz, a * e - b * b AS zz FROM p),
     w AS (SELECT reading_level, mx, my, mz, (xx * mx + xy * my + xz * mz) / det AS wx, (xy * mx + yy * my + yz * mz) / det AS wy, (xz * mx + yz * my + zz * mz) / det AS wz FROM m, q)
SELECT reading_level, wx, wy, wz, -0.5 * (mx * wx + my * wy + mz * wz) AS w0 FROM w ORDER BY reading_level
"""


def levels(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, reading_level) of every document of English prose."""
    spark = docs.sparkSession
    rank = ranks(docs)
    labelled = measures(samples, "sample_id", rank).join(samples.select("sample_id", "reading_level"), "sample_id")
    weights = spark.sql(CALIBRATION, samples=labelled).collect()  # one row per level
    if not weights:
        return docs.select("doc_id", F.lit(None).cast("bigint").alias("reading_level")).limit(0)
    score = ", ".join(f"struct({r.wx!r}D * coverage + {r.wy!r}D * sentence + {r.wz!r}D * word + {r.w0!r}D AS score, {int(r.reading_level)}L AS level)" for r in weights)
    return measures(docs, "doc_id", rank).filter("prose").select("doc_id", F.expr(f"array_max(array({score})).level").alias("reading_level"))
