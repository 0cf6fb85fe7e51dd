"""External services behind small adapters that run in mapInPandas; offline stand-ins are deterministic.

Each distinct input is asked once and joined back, and what a store already holds is not asked again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("auto", "none", "required")
# HTTP statuses of a page that can be reached.
ALIVE = frozenset({200, 201, 202, 204, 206, 301, 302, 303, 307, 308, 401, 403, 405, 406, 429})


def ask(inputs: DataFrame, column: str, answer: Callable[[str], str], store: DataFrame | None = None, tries: int = 1) -> DataFrame:
    """(column, answer, status) of the distinct values; values in ``store`` (column, answer) keep their answer.

    status: ``stored``, ``ok``, ``empty`` (the service gave nothing) or ``failed: <kind of error>`` after ``tries`` calls.
    """
    values = inputs.select(column).filter(F.col(column).isNotNull()).distinct()
    new = values.join(store.select(column), column, "left_anti") if store is not None else values

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said, status = [], []
            for v in f[column]:
                got, how = None, "empty"
                for _ in range(max(1, tries)):
                    try:
                        got = answer(v)
                        how = "empty" if got is None else "ok"
                        break
                    except Exception as e:  # noqa: BLE001 - one failing call must not end the job
                        how = f"failed: {type(e).__name__}"
                said.append(got)
                status.append(how)
            yield pd.DataFrame({column: f[column], "answer": said, "status": status})

    got = new.mapInPandas(run, f"`{column}` string, answer string, status string")
    if store is None:
        return got
    known = store.groupBy(column).agg(F.max("answer").alias("answer")).join(values, column)
    return got.unionByName(known.withColumn("status", F.lit("stored")))


def resumed(inputs: DataFrame, column: str, answer: Callable[[str], str], path: str, tries: int = 1) -> DataFrame:
    """``ask`` against a store at ``path``; new answers are appended there, so that a later run goes on from them."""
    from pyspark.errors import AnalysisException

    spark = inputs.sparkSession
    try:
        store = spark.read.parquet(path)
    except AnalysisException:
        store = None
    got = ask(inputs, column, answer, store, tries)
    got.filter("status = 'ok'").select(column, "answer").write.mode("append").parquet(path)
    kept = spark.read.parquet(path).join(inputs.select(column).distinct(), column)
    return kept.groupBy(column).agg(F.max("answer").alias("answer"))


def reachable(urls: DataFrame, statuses: DataFrame) -> DataFrame:
    """(url, alive) of the distinct urls: complete ones whose last known status (url, status) is that of a page that can be reached."""
    from loomtrace.functions.urls import with_scheme

    full = urls.select("url").filter("url is not null").distinct().withColumn("full", with_scheme(F.col("url")))
    known = statuses.groupBy(F.col("url").alias("full")).agg(F.max("status").alias("status"))
    return full.join(known, "full", "left").select("url", (F.col("full").isNotNull() & F.coalesce(F.col("status").isin(*sorted(ALIVE)), F.lit(False))).alias("alive"))


def page_cascade(urls: DataFrame, column: str, steps: list[tuple[Callable[[str], bool], Callable[[str], str | None]]], store: DataFrame | None = None) -> DataFrame:
    """Page texts by the first step that takes the url and gives text; each step is (takes, fetch), in order of preference."""

    def fetch(url: str) -> str | None:
        for takes, get in steps:
            if takes(url) and (text := get(url)):
                return text
        return None

    return ask(urls, column, fetch, store)


def stub_judge(prompt: str) -> str:
    """Deterministic judgement: a score from 1 to 5 from the prompt's hash."""
    return json.dumps({"score": int(hashlib.md5(prompt.encode()).hexdigest(), 16) % 5 + 1, "reasoning": "offline"})


def stub_entailment(pair: str) -> str:
    """Entailment where every word of the claim stands in the source; the two are parted by a tab."""
    source, _, claim = pair.partition("\t")
    words = set(source.lower().split())
    said = claim.lower().split()
    share = sum(w in words for w in said) / max(1, len(said))
    return "entailment" if said and share >= 0.8 else "neutral" if share >= 0.3 else "contradiction"


def replay_plan(prompts: DataFrame) -> DataFrame:
    """Each prompt once per mode with its result key ``source::conv::turn``, numbered from the second on."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("source", "conv_id", "turn_id").orderBy("prompt"))
    key = F.concat_ws("::", "source", "conv_id", "turn_id")
    keyed = prompts.withColumn("_n", n).withColumn("result_key", F.when(F.col("_n") > 1, F.concat_ws("::", key, F.col("_n").cast("string"))).otherwise(key)).drop("_n")
    return keyed.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in MODES])))


def pages_from_table(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Page texts of distinct urls from a table (url, text); unknown pages are empty."""
    return urls.select("url").filter("url is not null").distinct().join(pages.select("url", "text"), "url", "left").withColumn("text", F.coalesce("text", F.lit("")))
