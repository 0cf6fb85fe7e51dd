"""Text and vector similarity kernels over arrays (Column -> Column)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ngrams(t: Column, n: int) -> Column:
    if n == 1:
        return t
    starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))


def clipped_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    common = F.array_intersect(F.array_distinct(a), F.array_distinct(b))
    return F.aggregate(common, F.lit(0), lambda s, w: s + F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w))))


def unigram_precision(candidate: Column, reference: Column) -> Column:
    return clipped_overlap(candidate, reference) / F.greatest(F.size(candidate), F.lit(1))


def unigram_recall(candidate: Column, reference: Column) -> Column:
    return clipped_overlap(candidate, reference) / F.greatest(F.size(reference), F.lit(1))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def brevity(candidate: Column, reference: Column) -> Column:
    c, r = F.size(candidate), F.size(reference)
    return F.when(c == 0, F.lit(0.0)).when(c > r, F.lit(1.0)).otherwise(F.exp(1 - r / F.greatest(c, F.lit(1))))


def bleu(candidate: Column, reference: Column, order: int = 1) -> Column:
    """Sentence BLEU of uniform weights; an order without a match counts 0.1 matches, no matching word at all gives 0."""
    logs = F.lit(0.0)
    for n in range(1, order + 1):
        c, r = ngrams(candidate, n), ngrams(reference, n)
        hit = clipped_overlap(c, r).cast("double")
        logs = logs + F.log(F.when(hit > 0, hit).otherwise(0.1) / F.greatest(F.size(c), F.lit(1)))
    return F.when(clipped_overlap(candidate, reference) > 0, brevity(candidate, reference) * F.exp(logs / order)).otherwise(F.lit(0.0))


def rouge_precision(page: Column, answer: Column, n: int) -> Column:
    """Share of the answer's n-grams that stand in the page."""
    a = ngrams(answer, n)
    return F.when(F.size(a) > 0, clipped_overlap(a, ngrams(page, n)) / F.greatest(F.size(a), F.lit(1))).otherwise(F.lit(0.0))


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for y in b:
        m = row & where.get(y, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count() if a else 0


@F.pandas_udf(T.DoubleType())
def rouge_l_precision(page: pd.Series, answer: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(p), list(a)) / len(a) if p is not None and a is not None and len(a) else 0.0 for p, a in zip(page, answer)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)
