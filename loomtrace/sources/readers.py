"""Readers and writers: exports, turn tables, judgements and multi-format results."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

READERS = {
    ".parquet": lambda s, p: s.read.parquet(p),
    ".csv": lambda s, p: s.read.csv(p, header=True, multiLine=True, escape='"'),
    ".jsonl": lambda s, p: s.read.json(p),
    ".json": lambda s, p: s.read.json(p, multiLine=True),
}


class MissingColumns(ValueError):
    pass


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df`` reduced to the named columns; an error names those it lacks."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise MissingColumns(", ".join(lacking))
    return df.select(*columns)


def read(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Table at a path, by the ending of its name; only the named columns where given."""
    suffix = Path(path).suffix.lower()
    if suffix not in READERS:
        raise ValueError(f"no reader for {path}")
    df = READERS[suffix](spark, path)
    return require(df, columns) if columns is not None else df


def read_first(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """The first of several places that exists."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        h = jvm.org.apache.hadoop.fs.Path(p)
        if h.getFileSystem(conf).exists(h):
            return read(spark, p)
    raise FileNotFoundError(", ".join(paths))


def read_user_exports(spark: SparkSession, base: str) -> DataFrame:
    """(user_id, conversation JSON) of ``user_<n>/conversations.json`` files; users without a file are passed over."""
    t = spark.read.option("wholetext", True).text(f"{base}/user_*/conversations.json")
    v = F.try_parse_json("value")
    return t.select(F.regexp_extract(F.input_file_name(), r"user_(\d+)/", 1).cast("bigint").alias("user_id"), F.explode(F.try_variant_get(v, "$", "array<variant>")).alias("c")).select("user_id", F.to_json("c").alias("conversation"))


def first_of_key(df: DataFrame, key: str, order: str, required: Iterable[str] = ()) -> DataFrame:
    """Rows with all required values, the first of each key in the given order."""
    kept = df
    for c in required:
        kept = kept.filter(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
    return kept.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``todo`` whose keys are not done; null keys match null keys."""
    d = done.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return todo.join(d, on, "left_anti")


def write(df: DataFrame, base: str, formats: Iterable[str] = ("parquet",)) -> list[str]:
    """Write a result in each format below ``base``; nested columns are JSON text in csv."""
    out = []
    for f in formats:
        path = f"{base}.{f}"
        if f == "csv":
            nested = [c for c, k in df.dtypes if k.startswith(("array", "struct", "map"))]
            df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").csv(path, header=True, escape='"')
        else:
            getattr(df.write.mode("overwrite"), "parquet" if f == "parquet" else "json")(path)
        out.append(path)
    return out
