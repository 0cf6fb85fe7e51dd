"""Reports on what supports an answer: attribution of its sentences, entailment of its sources, ranks of its sources.

Entailment comes from the offline stand-in (shared words), web ranks from a hash of the domain; a live model and a
ranking table take the same places.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.functions import text as X
from loomtrace.operators import attribution as A
from loomtrace.operators import messages as M
from loomtrace.operators.stats import is_close
from loomtrace.plans.sources import _RELIABLE, _reliability
from loomtrace.plans.sql import DOMAIN, KEY, SENTENCES, SOURCES, TURNS, with_
from loomtrace.session import table

BUCKETS = (*A.TIERS, A.NONE)


def _raw(spark, d):
    return table(spark, d, "web_data_summary")


def _turns(spark, d):
    return M.turns(_raw(spark, d))


def _attributed(spark, d):
    t = _turns(spark, d).select("row_id", F.try_element_at("answers", F.lit(-1)).alias("answer")).filter("answer is not null")
    return A.attributed(A.response_chunks(t.join(A.turn_sources(_raw(spark, d)), "row_id")))


def j08_attributed_sentences(spark, d):
    """Bucket, source and number of checked sources of every sentence of every answer with sources."""
    return _attributed(spark, d)


def _modes(spark, d):
    """Sentences under both readings: every one, and the last of each run of equal refs (sentences without ref break runs and are left out)."""
    every = _attributed(spark, d).withColumn("after", F.lead("ref").over(W.partitionBy("row_id").orderBy("chunk")))
    latest = F.when(F.col("ref").isNotNull() & ~F.col("ref").eqNullSafe(F.col("after")), F.lit("latest"))
    return every.withColumn("mode", F.explode(F.array_compact(F.array(F.lit("all"), latest))))


def q48_attribution_by_platform(spark, d):
    """Share of each bucket per platform and reading, all buckets listed."""
    g = _modes(spark, d).join(_turns(spark, d).select("row_id", "platform"), "row_id").groupBy("platform", "mode", "bucket").agg(F.count("*").alias("n"))
    sums = g.groupBy("platform", "mode").agg(F.sum("n").alias("total"))
    spine = sums.withColumn("bucket", F.explode(F.array(*[F.lit(b) for b in BUCKETS])))
    j = spine.join(g, ["platform", "mode", "bucket"], "left").na.fill(0, ["n"])
    return j.select("platform", "mode", "bucket", "n", F.round(F.col("n") / F.col("total"), 6).alias("rate"))


def q49_scores_by_bucket(spark, d):
    """Number, mean and median of the scores in each bucket, all buckets listed."""
    g = _attributed(spark, d).groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("mean"), F.round(F.median("score"), 5).alias("median"))
    spine = spark.range(1).select(F.explode(F.array(*[F.lit(b) for b in BUCKETS])).alias("bucket"))
    return spine.join(g, "bucket", "left").na.fill(0, ["n", "mean", "median"])


def source_scores(spark, d):
    """(row_id, kind, key, score, label): the long form of every source of a turn scored once against the last answer."""
    a = _turns(spark, d).select("row_id", F.array_distinct(X.tokens(F.try_element_at("answers", F.lit(-1)))).alias("a")).filter(F.size("a") > 0)
    k = M.keyed(M.sources(_raw(spark, d)))
    per = k.groupBy("row_id", "key").agg(F.collect_set("kind").alias("kinds"), F.max(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))).alias("text"))
    s = per.join(a, "row_id").withColumn("score", F.round(A.support(F.col("a"), F.array_distinct(X.tokens(F.col("text")))), 6))
    return s.select("row_id", "key", "score", A.label(F.col("score")).alias("label"), F.explode("kinds").alias("kind"))


def m07_source_scores(spark, d):
    return source_scores(spark, d).select("row_id", "kind", "key", "score", "label")


def a46_label_rates(spark, d):
    """Share of each entailment label among a turn's sources of a kind, averaged over turns; each url counts as cited before safe before retrieved."""
    order = F.when(F.col("kind") == "cited", 1).when(F.col("kind") == "safe", 2).otherwise(3)
    own = source_scores(spark, d).groupBy("row_id", "key").agg(F.min(order).alias("o"), F.max("label").alias("label"))
    kind = F.element_at(F.array(F.lit("cited"), F.lit("safe"), F.lit("retrieved")), F.col("o"))
    r = own.groupBy("row_id", kind.alias("kind")).agg(*[F.avg((F.col("label") == x).cast("int")).alias(x) for x in ("entailment", "neutral", "contradiction")])
    return r.groupBy("kind").agg(F.count("*").alias("turns"), *[F.round(F.avg(x), 5).alias(x) for x in ("entailment", "neutral", "contradiction")])


def web_rank(domain):
    """Rank of a domain in a web ranking, -1 where it is unranked: a hash stands in for the table."""
    h = F.conv(F.substring(F.md5(domain), 1, 4), 16, 10).cast("int")
    return F.when(h % 16 == 15, -1).otherwise(h)


def _ranked(spark, d):
    """Turns with their retrieved and cited sources in order, and the ranks of these as parallel lists."""
    k = M.keyed(M.sources(_raw(spark, d))).filter("kind <> 'safe'")
    at = F.struct("pos", "g", "src", "e", "turn_index", "ref_index", "key", web_rank(F.col("domain")).alias("rank"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, at)))
    g = k.groupBy("row_id").agg(of("retrieved").alias("retrieved"), of("cited").alias("cited"))
    return g.select("row_id", "retrieved", "cited", *[F.transform(x, lambda s: s["rank"]).alias(f"{x}_ranks") for x in ("retrieved", "cited")])


def q39_rank_positions(spark, d):
    """How often sources of each loop have a rank of each size (tens of thousands); lists and ranks are paired by position."""
    t = _ranked(spark, d)

    def paired(kind):
        return F.transform(F.arrays_zip(kind, f"{kind}_ranks"), lambda z: F.struct(F.lit(kind).alias("kind"), z[kind]["turn_index"].alias("turn_index"), z[f"{kind}_ranks"].alias("rank")))

    long = t.select(F.explode(F.concat(paired("retrieved"), paired("cited"))).alias("x")).select("x.*").filter("turn_index is not null and rank >= 0")
    return long.groupBy("kind", "turn_index", F.floor(F.col("rank") / 10_000).alias("rank_bucket")).agg(F.count("*").alias("n"))


def q43_web_rank_by_kind(spark, d):
    """Mean valid rank of a turn's retrieved and cited sources over turns with both, and how often each is better."""
    t = _ranked(spark, d)

    def mean(ranks):
        ok = F.filter(ranks, lambda r: r > 0)
        return F.try_divide(F.aggregate(ok, F.lit(0).cast("bigint"), lambda s, r: s + r), F.size(ok))

    m = t.select(mean("retrieved_ranks").alias("r"), mean("cited_ranks").alias("c")).filter("r is not null and c is not null")
    return m.agg(F.count("*").alias("n"), F.round(F.avg("r"), 4).alias("retrieved"), F.round(F.avg("c"), 4).alias("cited"), F.round(F.min(F.least("r", "c")), 4).alias("low"), F.round(F.max(F.greatest("r", "c")), 4).alias("high"), F.count_if(F.col("c") < F.col("r")).alias("cited_better"), F.count_if(F.col("c") > F.col("r")).alias("retrieved_better"))


def q44_reliability_diagonal(spark, d):
    """Mean reliability of a turn's cited against its retrieved sources: above, below or on the diagonal."""
    k = M.source_keys(_raw(spark, d)).filter("kind <> 'safe'").select("row_id", "kind", "key").distinct()
    s = k.join(_turns(spark, d).select("row_id", "topic"), "row_id").join(_reliability(spark, d), ["topic", "key"])
    p = s.groupBy("row_id").agg(*[F.avg(F.when(F.col("kind") == x, F.col("score"))).alias(x) for x in ("cited", "retrieved")]).filter("cited is not null and retrieved is not null")
    side = F.when(is_close(F.col("cited"), F.col("retrieved")), "on").when(F.col("cited") > F.col("retrieved"), "above").otherwise("below")
    return p.groupBy(side.alias("side")).agg(F.count("*").alias("n"), F.round(F.min(F.least("cited", "retrieved")), 5).alias("low"), F.round(F.max(F.greatest("cited", "retrieved")), 5).alias("high"))


def q45_rank_correlation(spark, d):
    """Order of a turn's retrieved sources in the answer's list against their web ranks: correlation and exact agreement."""
    t = _ranked(spark, d).select("row_id", F.posexplode(F.arrays_zip("retrieved", "retrieved_ranks")).alias("i", "z"))
    r = t.select("row_id", "i", F.when(F.col("z.retrieved.ref_index") >= 0, F.col("z.retrieved.ref_index") + 1).otherwise(F.col("i") + 1).alias("own"), F.col("z.retrieved_ranks").alias("web")).filter("web >= 1")
    a = F.row_number().over(W.partitionBy("row_id").orderBy("own", "i"))
    b = F.row_number().over(W.partitionBy("row_id").orderBy("web", "i"))
    g = r.select("row_id", a.alias("a"), b.alias("b")).groupBy("row_id").agg(F.count("*").alias("n"), F.corr("a", "b").alias("r"), F.bool_and(F.col("a") == F.col("b")).alias("same"))
    return g.agg(F.count("*").alias("turns"), F.count("r").alias("compared"), F.round(F.avg("r"), 5).alias("mean"), F.round(F.median("r"), 5).alias("median"), F.round(F.avg(F.when(F.col("n") >= 2, F.col("same").cast("int"))), 6).alias("exact"))


_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '(\\p{{L}}+|\\d+)')"
_EVERY = (
    "every AS (SELECT row_id, 'retrieved' AS kind, pos, g, 0 AS src, e, url, title, snippet, turn_index, ref_index FROM retrieved UNION ALL SELECT row_id, 'safe', pos, 0, 0, e, url, NULL, NULL, NULL, NULL FROM safe UNION ALL SELECT row_id, 'cited', pos, c, src, i, url, title, snippet, turn_index, ref_index FROM cited_all WHERE url <> ''),\n"
    "every_key AS (SELECT *, " + KEY.format("url") + " AS key, " + DOMAIN.format("url") + " AS domain FROM every)"
)
_CASCADE = with_(
    TURNS, SOURCES, _EVERY,
    "cand AS (SELECT row_id, key, bool_or(kind = 'cited') AS cited, coalesce(list(turn_index || '::' || ref_index) FILTER (WHERE kind = 'cited' AND turn_index IS NOT NULL AND ref_index IS NOT NULL), []) AS cr, coalesce(list(turn_index || '::' || ref_index) FILTER (WHERE kind <> 'cited' AND turn_index IS NOT NULL AND ref_index IS NOT NULL), []) AS gr, coalesce(min((pos, g, src, e)) FILTER (WHERE kind = 'cited'), min((pos, g, src, e))) AS place, list_distinct(" + _TOK.format("max(coalesce(title, '') || ' ' || coalesce(snippet, ''))") + ") AS words FROM every_key WHERE kind <> 'safe' AND key <> '' GROUP BY 1, 2)",
    "mark AS (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY pos, g) - 1 AS chunk, turn_index || '::' || ref_index AS ref FROM every_key WHERE kind = 'cited' AND src = 0 AND key <> '')",
    "said AS (SELECT row_id, " + SENTENCES.format("answers[-1]") + " AS s FROM turns WHERE answers[-1] IS NOT NULL AND row_id IN (SELECT row_id FROM cand))",
    "chunks AS (SELECT s.row_id, s.chunk, s.words, mark.ref FROM (SELECT row_id, generate_subscripts(s, 1) - 1 AS chunk, list_distinct(" + _TOK.format("unnest(s)") + ") AS words FROM said) s LEFT JOIN mark ON mark.row_id = s.row_id AND mark.chunk = s.chunk)",
    "checks AS (SELECT c.row_id, c.chunk, c.ref, key, CASE WHEN cited AND coalesce(list_contains(cr, ref) OR list_contains(gr, ref), false) THEN 1 WHEN cited THEN 2 ELSE 3 END AS tier, place, coalesce(round(len(list_filter(c.words, lambda x: list_contains(cand.words, x))) / nullif(len(c.words), 0), 6), 0) AS score FROM chunks c JOIN cand ON cand.row_id = c.row_id)",
    f"numbered AS (SELECT *, row_number() OVER (PARTITION BY row_id, chunk ORDER BY tier, place, key) AS n, score >= {A.ENTAILED} AS hit FROM checks)",
    "att AS (SELECT row_id, chunk, any_value(ref) AS ref, min(n) FILTER (WHERE hit) AS h, arg_min(tier, n) FILTER (WHERE hit) AS tier, arg_min(key, n) FILTER (WHERE hit) AS source, arg_min(score, n) FILTER (WHERE hit) AS own, max(score) AS best, count(*) AS total, count(*) FILTER (WHERE tier = 1) AS first FROM numbered GROUP BY 1, 2)",
    "attributed AS (SELECT row_id, chunk, ref, CASE tier WHEN 1 THEN 'Marked Citations' WHEN 2 THEN 'Other Citations' WHEN 3 THEN 'Retrieved Sources' ELSE 'Unexplained' END AS bucket, source, CASE WHEN h IS NULL THEN total WHEN tier = 1 THEN first ELSE h END AS checked, coalesce(own, best, 0) AS score FROM att)",
)
_DOMAIN_OF_BUCKETS = "(SELECT unnest(['Marked Citations', 'Other Citations', 'Retrieved Sources', 'Unexplained']) AS bucket)"
_SCORED = with_(
    TURNS, SOURCES, _EVERY,
    "per AS (SELECT row_id, key, list_distinct(" + _TOK.format("max(coalesce(title, '') || ' ' || coalesce(snippet, ''))") + ") AS words, list(DISTINCT kind) AS kinds FROM every_key GROUP BY 1, 2)",
    "ans AS (SELECT row_id, list_distinct(" + _TOK.format("answers[-1]") + ") AS a FROM turns)",
    "sc AS (SELECT row_id, key, kinds, round(len(list_filter(a, lambda x: list_contains(words, x))) / len(a), 6) AS score FROM per JOIN ans USING (row_id) WHERE len(a) > 0)",
    f"scored AS (SELECT *, CASE WHEN score >= {A.ENTAILED} THEN 'entailment' WHEN score >= {A.NEUTRAL} THEN 'neutral' ELSE 'contradiction' END AS label FROM sc)",
)
_RANK = with_(SOURCES, _EVERY, "ranked AS (SELECT *, CASE WHEN h % 16 = 15 THEN -1 ELSE h END AS rank, row_number() OVER (PARTITION BY row_id, kind ORDER BY pos, g, src, e, turn_index NULLS FIRST, ref_index NULLS FIRST, key) - 1 AS i FROM (SELECT *, ('0x' || substr(md5(domain), 1, 4))::INT AS h FROM every_key WHERE kind <> 'safe'))")
ORACLES = {
    "j08_attributed_sentences": _CASCADE + "SELECT * FROM attributed",
    "q48_attribution_by_platform": _CASCADE + ", b AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY chunk) AS o, lead(ref) OVER (PARTITION BY row_id ORDER BY chunk) AS after FROM attributed), modes AS (SELECT row_id, 'all' AS mode, bucket FROM attributed UNION ALL SELECT row_id, 'latest', bucket FROM b WHERE ref IS NOT NULL AND after IS DISTINCT FROM ref), g AS (SELECT platform, mode, bucket, count(*) AS n FROM modes JOIN turns USING (row_id) GROUP BY 1, 2, 3), s AS (SELECT platform, mode, sum(n) AS total FROM g GROUP BY 1, 2) SELECT s.platform, s.mode, x.bucket, coalesce(n, 0) AS n, round(coalesce(n, 0) / total, 6) AS rate FROM s CROSS JOIN " + _DOMAIN_OF_BUCKETS + " x LEFT JOIN g ON g.platform = s.platform AND g.mode = s.mode AND g.bucket = x.bucket",
    "q49_scores_by_bucket": _CASCADE + "SELECT x.bucket, count(score) AS n, coalesce(round(avg(score), 5), 0) AS mean, coalesce(round(median(score), 5), 0) AS median FROM " + _DOMAIN_OF_BUCKETS + " x LEFT JOIN attributed USING (bucket) GROUP BY 1",
    "m07_source_scores": _SCORED + "SELECT row_id, unnest(kinds) AS kind, key, score, label FROM scored",
    "a46_label_rates": _SCORED + "SELECT kind, count(*) AS turns, round(avg(e), 5) AS entailment, round(avg(n), 5) AS neutral, round(avg(c), 5) AS contradiction FROM (SELECT row_id, CASE WHEN list_contains(kinds, 'cited') THEN 'cited' WHEN list_contains(kinds, 'safe') THEN 'safe' ELSE 'retrieved' END AS kind, avg((label = 'entailment')::INT) AS e, avg((label = 'neutral')::INT) AS n, avg((label = 'contradiction')::INT) AS c FROM scored GROUP BY 1, 2) GROUP BY 1",
    "q39_rank_positions": _RANK + "SELECT kind, turn_index, floor(rank / 10000)::BIGINT AS rank_bucket, count(*) AS n FROM ranked WHERE turn_index IS NOT NULL AND rank >= 0 GROUP BY 1, 2, 3",
    "q43_web_rank_by_kind": _RANK + "SELECT count(*) AS n, round(avg(r), 4) AS retrieved, round(avg(c), 4) AS cited, round(min(least(r, c)), 4) AS low, round(max(greatest(r, c)), 4) AS high, count(*) FILTER (WHERE c < r) AS cited_better, count(*) FILTER (WHERE c > r) AS retrieved_better FROM (SELECT avg(rank) FILTER (WHERE kind = 'retrieved' AND rank > 0) AS r, avg(rank) FILTER (WHERE kind = 'cited' AND rank > 0) AS c FROM ranked GROUP BY row_id) WHERE r IS NOT NULL AND c IS NOT NULL",
    "q44_reliability_diagonal": with_(TURNS, SOURCES, _RELIABLE, "p AS (SELECT avg(score) FILTER (WHERE kind = 'cited') AS c, avg(score) FILTER (WHERE kind = 'retrieved') AS r FROM (SELECT DISTINCT row_id, kind, key FROM source_keys) JOIN turns USING (row_id) JOIN rel USING (topic, key) GROUP BY row_id)") + "SELECT CASE WHEN abs(c - r) <= 1e-8 + 1e-5 * abs(r) THEN 'on' WHEN c > r THEN 'above' ELSE 'below' END AS side, count(*) AS n, round(min(least(c, r)), 5) AS low, round(max(greatest(c, r)), 5) AS high FROM p WHERE c IS NOT NULL AND r IS NOT NULL GROUP BY 1",
    "q45_rank_correlation": _RANK + ", o AS (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY CASE WHEN ref_index >= 0 THEN ref_index + 1 ELSE i + 1 END, i) AS a, row_number() OVER (PARTITION BY row_id ORDER BY rank, i) AS b FROM ranked WHERE kind = 'retrieved' AND rank >= 1), g AS (SELECT count(*) AS n, CASE WHEN count(*) > 1 THEN corr(a, b) END AS r, bool_and(a = b) AS same FROM o GROUP BY row_id) SELECT count(*) AS turns, count(r) AS compared, round(avg(r), 5) AS mean, round(median(r), 5) AS median, round(avg(CASE WHEN n >= 2 THEN same::INT END), 6) AS exact FROM g",
}
QUERIES = {f.__name__: f for f in (j08_attributed_sentences, q48_attribution_by_platform, q49_scores_by_bucket, m07_source_scores, a46_label_rates, q39_rank_positions, q43_web_rank_by_kind, q44_reliability_diagonal, q45_rank_correlation)}
