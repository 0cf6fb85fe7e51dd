"""Window sums and neighbours over groups of any size: windows run inside blocks of a group, whose results are chained.

A block is a column whose values order the rows of its group (a day, a range of positions). Only one row per block takes
part in the window over the whole group, so a huge group is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(df: DataFrame, key: list[str], block: str, order: list[str], value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """``df`` plus the sum of ``value`` over the rows of its group up to (or, if not inclusive, before) each row."""
    inner = W.partitionBy(*key, block).orderBy(*order)
    frame = inner.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    d = df.withColumn("_v", value).withColumn("_in", F.coalesce(F.sum("_v").over(frame), F.lit(0)))
    sums = d.groupBy(*key, block).agg(F.sum("_v").alias("_s"))
    before = F.sum("_s").over(W.partitionBy(*key).orderBy(block).rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*key, block, F.coalesce(before, F.lit(0)).alias("_before"))
    return d.join(sums, [*key, block]).withColumn(name, F.col("_in") + F.col("_before")).drop("_v", "_in", "_before")


def previous(df: DataFrame, key: list[str], block: str, order: list[str], column: str, name: str) -> DataFrame:
    """``df`` plus the value of ``column`` in the row before; null in the first row of a group."""
    inner = W.partitionBy(*key, block).orderBy(*order)
    d = df.withColumn("_n", F.row_number().over(inner)).withColumn("_lag", F.lag(column).over(inner))
    ends = d.groupBy(*key, block).agg(F.max_by(F.struct(F.col(column).alias("v")), F.struct(*order)).alias("_last"))
    ends = ends.select(*key, block, F.lag("_last").over(W.partitionBy(*key).orderBy(block)).alias("_prior"))
    value = F.when(F.col("_n") > 1, F.col("_lag")).otherwise(F.col("_prior.v"))
    return d.join(ends, [*key, block]).withColumn(name, value).drop("_n", "_lag", "_prior")
