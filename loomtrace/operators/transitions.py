"""Transitions between the queries of following search loops: edges, iterations, labels and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions import text as X

USER = "U"


def edges(starts: DataFrame, loops: DataFrame) -> DataFrame:
    """(row_id, from_id, to_id, from_loop, to_loop, from_words, to_words) from the prompt to the first loop and from each
    loop to the next. ``starts``: (row_id, q); ``loops``: (row_id, loop_idx, queries). Ids are ``U`` or ``loop.query``."""
    q = loops.select("row_id", "loop_idx", F.posexplode("queries").alias("i", "q"))
    q = q.select("row_id", F.col("loop_idx").cast("int").alias("to_loop"), F.concat_ws(".", "loop_idx", F.col("i") + 1).alias("to_id"), X.tokens(F.col("q")).alias("to_words"))
    begin = starts.filter("q is not null").select("row_id", F.lit(0).alias("from_loop"), F.lit(USER).alias("from_id"), X.tokens(F.col("q")).alias("from_words"))
    before = begin.unionByName(q.select("row_id", F.col("to_loop").alias("from_loop"), F.col("to_id").alias("from_id"), F.col("to_words").alias("from_words")))
    before = before.withColumn("to_loop", F.col("from_loop") + 1)
    return before.join(q, ["row_id", "to_loop"]).select("row_id", "from_id", "to_id", "from_loop", "to_loop", "from_words", "to_words")


def loop_of(endpoint: Column) -> Column:
    """Loop of an endpoint id; null for the prompt and for what is no id."""
    return F.regexp_extract(endpoint, r"^(\d+)(?:\.\d+)?$", 1).try_cast("int")


def iteration(from_id: Column, to_id: Column) -> Column:
    """1 from the prompt; the later loop where both are neighbours, in whichever order they are named; else null."""
    a, b = loop_of(from_id), loop_of(to_id)
    return F.when(from_id == USER, 1).when(b == a + 1, b).when(a == b + 1, a)


def kind(from_words: Column, to_words: Column) -> Column:
    """What changed in the words: same, narrowing (some left out), expansion (some added) or rewriting."""
    new, lost = F.size(F.array_except(to_words, from_words)), F.size(F.array_except(from_words, to_words))
    return F.when((new == 0) & (lost == 0), "same").when(new == 0, "narrowing").when(lost == 0, "expansion").otherwise("rewriting")


def labelled(candidates: DataFrame, said: DataFrame) -> DataFrame:
    """Candidate edges with the first label said of them; ``said``: (row_id, from_id, to_id, ord, label). Labels of pairs that are no candidates are dropped."""
    first = said.groupBy("row_id", "from_id", "to_id").agg(F.min_by("label", "ord").alias("label"))
    return candidates.join(first, ["row_id", "from_id", "to_id"], "left")


def reversed_edges(df: DataFrame) -> DataFrame:
    """The same rows with both endpoints swapped, as a validator is asked."""
    swap = {"from_id": "to_id", "to_id": "from_id", "from_loop": "to_loop", "to_loop": "from_loop", "from_words": "to_words", "to_words": "from_words"}
    return df.select(*[F.col(swap.get(c, c)).alias(c) for c in df.columns])


def validated(labelled_: DataFrame, answers: DataFrame) -> DataFrame:
    """Labels that the validator, asked of the swapped edge, confirms; ``answers``: (row_id, from_id, to_id, ok) of swapped edges."""
    back = answers.select("row_id", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "ok").groupBy("row_id", "from_id", "to_id").agg(F.bool_and("ok").alias("ok"))
    j = labelled_.join(back, ["row_id", "from_id", "to_id"], "left")
    return j.withColumn("label", F.when(F.coalesce("ok", F.lit(False)), F.col("label"))).drop("ok")
