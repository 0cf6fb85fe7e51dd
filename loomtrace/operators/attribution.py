"""Attribution cascade: which source, if any, supports a piece of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.functions import text as X
from loomtrace.operators import messages as M

# Names of the tiers in order.
TIERS = ("Marked Citations", "Other Citations", "Retrieved Sources")
NONE = "Unexplained"
#: Share of a text's distinct words that must stand in a source for entailment, and below which it contradicts.
ENTAILED = 0.3
NEUTRAL = 0.1


def cascade(checks: DataFrame, key: list[str]) -> DataFrame:
    """(key, bucket, source, checked) from candidate checks (key, source, tier 1-3, pos, entailed).

    Candidates count once, at their best place. All of tier 1 is checked, the later tiers only while nothing
    supports the piece and only up to the first support. ``checked`` counts the candidates looked at.
    """
    once = checks.groupBy(*key, "source").agg(F.min(F.struct("tier", "pos", (~F.col("entailed")).alias("not_entailed"))).alias("p"))
    c = once.select(*key, "source", "p.tier", "p.pos", (~F.col("p.not_entailed")).alias("entailed"))
    order = W.partitionBy(*key).orderBy("tier", "pos", "source")
    c = c.withColumn("n", F.row_number().over(order))
    hit = F.min(F.when(F.col("entailed"), F.struct("n", "tier", "source")))
    g = c.groupBy(*key).agg(hit.alias("hit"), F.count("*").alias("all"), F.count_if(F.col("tier") == 1).alias("first"))
    tier = F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("hit.tier"))
    checked = F.when(F.col("hit").isNull(), F.col("all")).when(F.col("hit.tier") == 1, F.col("first")).otherwise(F.col("hit.n").cast("bigint"))
    return g.select(*key, F.when(F.col("hit").isNull(), NONE).otherwise(tier).alias("bucket"), F.col("hit.source").alias("source"), checked.alias("checked"))


def latest_claims(chunks: DataFrame, sample: str, order: str, refs: str) -> DataFrame:
    """Last row of each run of equal, non-empty refs within a sample; empty refs break runs and are left out."""
    w = W.partitionBy(sample).orderBy(order)
    same = F.coalesce((F.col(refs) != "") & (F.lag(refs).over(w) == F.col(refs)), F.lit(False))
    runs = chunks.withColumn("_new", (~same).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    last = runs.withColumn("_n", F.row_number().over(W.partitionBy(sample, "_run").orderBy(F.desc(order))))
    return last.filter((F.col("_n") == 1) & (F.col(refs) != "")).drop("_new", "_run", "_n")


def support(words: Column, source: Column) -> Column:
    """Share of distinct words that stand in a source's distinct words (offline stand-in of an entailment score); null without words."""
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, source)) / F.size(words))


def label(score: Column) -> Column:
    return F.when(score >= ENTAILED, "entailment").when(score >= NEUTRAL, "neutral").otherwise("contradiction")


def turn_sources(raw: DataFrame) -> DataFrame:
    """(row_id, marks, sources) of each turn with sources, from one pass.

    ``marks``: the first ref of every marked reference in order. ``sources``: one struct per normalised url with whether
    it was cited, its refs as cited and as retrieved source, its first place (as cited source where it was cited) and its words.
    """
    k = M.keyed(M.sources(raw)).filter("kind <> 'safe' AND key <> ''").repartition("row_id")
    ref = F.when(F.col("turn_index").isNotNull() & F.col("ref_index").isNotNull(), F.concat_ws("::", "turn_index", "ref_index"))
    place = F.struct("pos", "g", "src", "e")
    is_cited = F.col("kind") == "cited"
    per = k.groupBy("row_id", "key").agg(
        F.bool_or(is_cited).alias("cited"),
        F.collect_set(F.when(is_cited, ref)).alias("cited_refs"),
        F.collect_set(F.when(~is_cited, ref)).alias("got_refs"),
        F.coalesce(F.min(F.when(is_cited, place)), F.min(place)).alias("place"),
        F.max(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))).alias("text"),
        F.collect_list(F.when(is_cited & (F.col("src") == 0), F.struct("pos", "g", ref.alias("ref")))).alias("marks"),
    )
    per = per.withColumn("words", F.array_distinct(X.tokens(F.col("text"))))
    g = per.groupBy("row_id").agg(F.flatten(F.collect_list("marks")).alias("m"), F.collect_list(F.struct("key", "cited", "cited_refs", "got_refs", "place", "words")).alias("sources"))
    return g.select("row_id", F.transform(F.array_sort("m"), lambda x: x["ref"]).alias("marks"), "sources")


def response_chunks(answers: DataFrame) -> DataFrame:
    """(row_id, chunk, text, ref) from (row_id, answer, marks): the sentences of an answer; exports keep the marks apart
    from the answer, so the i-th sentence has the i-th mark."""
    return answers.select("row_id", "marks", "sources", F.posexplode(X.sentences(F.col("answer"))).alias("chunk", "text")).withColumn("ref", F.get("marks", F.col("chunk"))).drop("marks")


def attributed(chunks: DataFrame) -> DataFrame:
    """(row_id, chunk, ref, bucket, source, checked, score): the cascade of each chunk over the sources of its turn.

    First the sources cited with the chunk's ref, and cited ones that were retrieved with it; then other cited ones;
    then those only retrieved. All of the first tier is checked, the later tiers up to the first support.
    """
    def tier(s: Column) -> Column:
        mine = F.coalesce(F.array_contains(s["cited_refs"], F.col("ref")) | F.array_contains(s["got_refs"], F.col("ref")), F.lit(False))
        return F.when(s["cited"] & mine, 1).when(s["cited"], 2).otherwise(3)

    c = chunks.withColumn("words", F.array_distinct(X.tokens(F.col("text"))))
    seen = F.transform("sources", lambda s: F.struct(tier(s).alias("tier"), s["place"].alias("place"), s["key"].alias("key"), F.coalesce(F.round(support(F.col("words"), s["words"]), 6), F.lit(0.0)).alias("score")))
    c = c.withColumn("c", F.array_sort(seen))
    c = c.withColumn("hit", F.array_position(F.transform("c", lambda x: x["score"] >= ENTAILED), True).cast("int"))
    first, found = F.size(F.filter("c", lambda x: x["tier"] == 1)), F.get("c", F.col("hit") - 1)
    bucket = F.when(F.col("hit") == 0, NONE).otherwise(F.element_at(F.array(*[F.lit(t) for t in TIERS]), found["tier"]))
    checked = F.when(F.col("hit") == 0, F.size("c")).when(found["tier"] == 1, first).otherwise(F.col("hit"))
    best = F.array_max(F.transform("c", lambda x: x["score"]))
    return c.select("row_id", "chunk", "ref", bucket.alias("bucket"), found["key"].alias("source"), checked.cast("bigint").alias("checked"), F.coalesce(found["score"], best, F.lit(0.0)).alias("score"))
