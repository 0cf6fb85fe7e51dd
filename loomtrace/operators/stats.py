"""Agreement, outcome and test statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fleiss_kappa(items: DataFrame, labels: str) -> DataFrame:
    """One row (items, agreement, chance, kappa) from an array of rater labels per item; incomplete items are left out.

    kappa is null without items, with fewer than two raters and where chance agreement is 1.
    """
    whole = items.filter(F.forall(labels, lambda x: F.coalesce(x, F.lit("")) != "") & (F.size(labels) >= 2)).select(F.monotonically_increasing_id().alias("_i"), F.col(labels).alias("_l"))
    per = whole.select(
        F.size("_l").alias("n"),
        F.aggregate(F.array_distinct("_l"), F.lit(0), lambda s, x: s + F.pow(F.size(F.filter("_l", lambda y: y == x)), F.lit(2)).cast("int")).alias("squares"),
        "_l",
    )
    p = per.agg(F.count("*").alias("items"), F.avg((F.col("squares") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("p"))
    shares = whole.select(F.explode("_l").alias("label")).groupBy("label").agg(F.count("*").alias("c"))
    e = shares.agg((F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("e"))
    kappa = F.when(F.abs(1 - F.col("e")) > 1e-12, (F.col("p") - F.col("e")) / (1 - F.col("e")))
    return p.join(F.broadcast(e)).select("items", F.round("p", 6).alias("agreement"), F.round("e", 6).alias("chance"), F.round(kappa, 6).alias("kappa"))


def majority(items: DataFrame, key: str, labels: str) -> DataFrame:
    """(key, vote, n_labels): the single most frequent label, or ``tie: a|b``; blank labels do not vote."""
    said = F.filter(labels, lambda x: F.coalesce(x, F.lit("")) != "")
    kinds = F.array_sort(F.array_distinct("said"))
    counted = F.transform(kinds, lambda x: F.struct(F.size(F.filter("said", lambda y: y == x)).alias("n"), x.alias("label")))
    d = items.withColumn("said", said).filter(F.size("said") > 0).withColumn("counts", counted).withColumn("top", F.array_max(F.transform("counts", lambda c: c["n"])))
    best = F.transform(F.filter("counts", lambda c: c["n"] == F.col("top")), lambda c: c["label"])
    return d.select(key, F.when(F.size(best) == 1, best[0]).otherwise(F.concat(F.lit("tie: "), F.array_join(best, "|"))).alias("vote"), F.size("counts").cast("bigint").alias("n_labels"))


def strict_outcome(web: Column, better: Column, worse: Column, metrics: int) -> Column:
    """Right, Over or Under from the number of metrics on which calling was better and worse."""
    return (
        F.when(web & (better >= 1), "Right")
        .when(web & (worse >= 1), "Over")
        .when(web, "Right")
        .when(worse >= 1, "Right")
        .when((better == metrics) & F.lit(metrics > 0), "Under")
        .otherwise("Right")
    )


def is_close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def with_total(counts: DataFrame, n: str, total: str = "total") -> DataFrame:
    """``counts`` with the sum of column ``n`` over all rows, by a second, one-row aggregate over the same shuffle.

    The aggregate also reads the other columns, so that pruning leaves both branches alike and their shuffle is shared.
    """
    others = [c for c in counts.columns if c != n]
    one = counts.agg(F.sum(n).alias(total), *[F.max(c).alias(f"_max_{i}") for i, c in enumerate(others)])
    some = F.col(total).isNotNull()
    for i in range(len(others)):
        some = some | F.col(f"_max_{i}").isNotNull()
    return counts.join(F.broadcast(one.filter(some).select(total)))


def share_of_all(counts: DataFrame, n: str, share: str = "share") -> DataFrame:
    """``counts`` with each row's share of all of column ``n``, without a window over all rows."""
    return with_total(counts, n, "_total").withColumn(share, F.round(F.col(n) / F.col("_total"), 6)).drop("_total")


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def student_t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t by the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return min(1.0, front * _beta_fraction(a, b, x) / a)
    return min(1.0, 1 - front * _beta_fraction(b, a, 1 - x) / b)


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or a != a or b is None or not b > 0 else student_t_two_sided(a, b) for a, b in zip(t, df)], dtype="float64")


def paired_t(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, mean_diff, t, p) over complete pairs; t and p are null for fewer than two pairs or equal differences."""
    d = F.col(a) - F.col(b)
    s = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b)).agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    t = F.when(F.col("s") > 0, F.col("m") / (F.col("s") / F.sqrt("n")))
    return s.select("n", F.round("m", 6).alias("mean_diff"), t.alias("t_")).select("n", "mean_diff", F.round("t_", 4).alias("t"), F.round(t_p_value("t_", (F.col("n") - 1).cast("double")), 6).alias("p"))
