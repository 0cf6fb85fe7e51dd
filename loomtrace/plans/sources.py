"""Reports on retrieved, safe and cited sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.functions import urls
from loomtrace.operators import messages as M
from loomtrace.operators.stats import paired_t, share_of_all
from loomtrace.plans.sql import DOMAIN, KEY, SOURCES, TURN_SETS, TURNS, with_
from loomtrace.session import table

TOP = 20
# Topics of the reports by topic.
TOPICS = ("Travel", "Cars", "Finance", "Health", "Science", "Law")


def _raw(spark, d):
    return table(spark, d, "web_data_summary")


def _turns(spark, d):
    t = M.turns(_raw(spark, d))
    return t.select("row_id", "topic", "platform", "month", M.primary_model(F.col("models")).alias("primary_model"))


def _sets(spark, d):
    return M.url_sets(_raw(spark, d))


def c15_retrieved(spark, d):
    return M.retrieved(_raw(spark, d)).select("row_id", "pos", "g", "e", "url", "turn_index", "ref_index")


def c15_safe(spark, d):
    return M.safe(_raw(spark, d)).select("row_id", "pos", "e", "url")


def c16_cited(spark, d):
    return M.cited(_raw(spark, d)).select("row_id", "url", "turn_index", "ref_index", F.coalesce("title", F.lit("")).alias("title"))


def q29_turns_with_sources(spark, d):
    return _sets(spark, d).agg(*[F.count_if(F.size(x) > 0).alias(x) for x in ("retrieved", "safe", "cited")])


def _all_sets(spark, d):
    """Every turn with its sets, also turns without sources."""
    return M.turn_sets(_turns(spark, d), _raw(spark, d))


def _within(a: str, b: str) -> Column:
    return F.size(F.array_except(a, b)) == 0


def q30_subset_relations(spark, d):
    """Turns by which of their sets of urls lie in one another; empty sets lie in all."""
    s = _all_sets(spark, d).select(_within("safe", "retrieved").alias("safe_in_retrieved"), _within("cited", "safe").alias("cited_in_safe"), _within("cited", "retrieved").alias("cited_in_retrieved"))
    return s.groupBy(*s.columns).agg(F.count("*").alias("n"))


def q30_cited_in_retrieved(spark, d):
    """Turns whose cited urls, and whose cited domains, were all retrieved; both answers always have a row."""
    s = _all_sets(spark, d).select(_within("cited", "retrieved").alias("urls"), F.size(F.array_except(F.array_remove("cited_domains", ""), "retrieved_domains")).alias("rest"))
    long = s.select(F.explode(F.array(F.struct(F.lit("urls").alias("of"), F.col("urls").alias("within")), F.struct(F.lit("domains").alias("of"), (F.col("rest") == 0).alias("within")))).alias("x"))
    g = long.groupBy("x.of", "x.within").agg(F.count("*").alias("n"))
    spine = spark.range(1).select(F.explode(F.array(F.lit("urls"), F.lit("domains"))).alias("of")).withColumn("within", F.explode(F.array(F.lit(True), F.lit(False))))
    return spine.join(g, ["of", "within"], "left").na.fill(0, ["n"])


def q31_topic_domains(spark, d):
    """Distinct domains of each topic over all kinds of source, one row each."""
    k = M.source_keys(_raw(spark, d)).select("row_id", "domain").filter("domain <> ''").join(_turns(spark, d).select("row_id", "topic"), "row_id").filter(~F.lower("topic").isin("other", "nan"))
    return k.select("topic", "domain").distinct()


def _citations(spark, d):
    """(row_id, domain, external): every citation of a turn once per (url, place), and whether the turn retrieved the url."""
    k = M.keyed(M.sources(_raw(spark, d)))
    got = F.collect_set(F.when(F.col("kind") == "retrieved", F.col("key")))
    said = F.collect_set(F.when(F.col("kind") == "cited", F.struct("url", "turn_index", "ref_index", "key", "domain")))
    c = k.groupBy("row_id").agg(got.alias("got"), said.alias("said")).select("row_id", "got", F.explode("said").alias("c"))
    return c.select("row_id", "c.domain", F.array_contains("got", F.col("c.key")).alias("external")).filter("domain <> ''")


def _top(counted: DataFrame, *by: str) -> DataFrame:
    """The most cited domains (of each group) with their share of all citations (of the group)."""
    g = counted.groupBy(*by, "domain").agg(F.count("*").alias("n"), F.count_if("external").alias("external")).withColumn("internal", F.col("n") - F.col("external"))
    if not by:
        return share_of_all(g, "n").orderBy(F.desc("n"), "domain").limit(TOP)
    sums = g.groupBy(*by).agg(F.sum("n").alias("_all"))
    ranked = g.join(sums, list(by)).withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "domain"))).filter(F.col("k") <= TOP)
    return ranked.withColumn("share", F.round(F.col("n") / F.col("_all"), 6)).drop("_all")


def q32_top_domains(spark, d):
    """The twenty most cited domains with their share of all citations, split by whether the turn retrieved the url."""
    return _top(_citations(spark, d))


def q32_top_domains_by_topic(spark, d):
    t = _turns(spark, d).select("row_id", "topic").filter(F.col("topic").isin(*TOPICS))
    return _top(_citations(spark, d).join(t, "row_id"), "topic")


def q32_top_domains_by_model(spark, d):
    t = _turns(spark, d).select("row_id", "primary_model").filter("primary_model <> 'Unknown'")
    return _top(_citations(spark, d).join(t, "row_id"), "primary_model")


def q32_top_domains_by_platform(spark, d):
    r = M.retrieved(_raw(spark, d)).select("row_id", urls.plain_domain(urls.domain(F.col("url"))).alias("domain")).filter("domain <> ''").join(_turns(spark, d).select("row_id", "platform"), "row_id")
    g = r.groupBy("platform", "domain").agg(F.count("*").alias("n"))
    ranked = g.withColumn("k", F.row_number().over(W.partitionBy("platform").orderBy(F.desc("n"), "domain")))
    return ranked.filter(F.col("k") <= 5)


def _reliability(spark, d):
    """Mean valid score of each (topic, url); scores of the export repeat and hold NaN."""
    r = table(spark, d, "source_reliability").filter("topic is not null and url is not null and score is not null and not isnan(score)")
    return r.groupBy(F.trim("topic").alias("topic"), urls.match_key(F.col("url")).alias("key")).agg(F.max("score").alias("score"))


def q33_reliability_paired_t(spark, d):
    """Mean reliability of cited against retrieved sources of the same turn, paired t-test."""
    k = M.source_keys(_raw(spark, d)).join(_turns(spark, d).select("row_id", "topic"), "row_id").join(_reliability(spark, d), ["topic", "key"])
    p = k.groupBy("row_id").agg(F.avg(F.when(F.col("kind") == "cited", F.col("score"))).alias("cited"), F.avg(F.when(F.col("kind") == "retrieved", F.col("score"))).alias("retrieved"))
    return paired_t(p, "cited", "retrieved").select("n", "mean_diff", "t")


def q46_scored_sources(spark, d):
    """Scores of a turn's retrieved sources in order, unknown ones as -1."""
    r = M.retrieved(_raw(spark, d)).select("row_id", "pos", "g", "e", urls.match_key(F.col("url")).alias("key")).join(_turns(spark, d).select("row_id", "topic"), "row_id")
    s = r.join(_reliability(spark, d), ["topic", "key"], "left")
    g = s.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("pos", "g", "e", F.coalesce("score", F.lit(-1.0)).alias("score")))).alias("x"))
    return g.select("row_id", F.array_join(F.transform("x", lambda x: F.format_string("%.3f", x["score"])), ",").alias("scores"))


def _sem(c: Column) -> Column:
    return F.round(F.stddev_samp(c) / F.sqrt(F.count(c)), 6)


def q34_url_counts_by_month(spark, d):
    """Mean number of distinct urls a turn by month with its standard error; a turn without sources counts as 0."""
    t = _all_sets(spark, d).filter("month is not null")
    n = {x: F.size(x) for x in M.KINDS}
    return t.groupBy(F.date_format("month", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(f"{x}_mean") for x, c in n.items()], *[_sem(c).alias(f"{x}_sem") for x, c in n.items()])


def q34_cited_split_by_month(spark, d):
    """The same for cited urls the turn retrieved (external) and those it did not (internal)."""
    t = _all_sets(spark, d).filter("month is not null")
    n = {"retrieved": F.size("retrieved"), "external": F.size(F.array_intersect("cited", "retrieved")), "internal": F.size(F.array_except("cited", "retrieved"))}
    return t.groupBy(F.date_format("month", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(f"{x}_mean") for x, c in n.items()], *[_sem(c).alias(f"{x}_sem") for x, c in n.items()])


def q35_grounding_rate(spark, d):
    """Share of cited urls that were retrieved, by every second month, with its spread cut to [0, 1]."""
    t = _all_sets(spark, d).filter("month is not null AND size(cited) > 0")
    t = t.select("month", (F.size(F.array_intersect("cited", "retrieved")) / F.size("cited")).alias("g"))
    m = t.groupBy("month").agg(F.count("*").alias("n"), F.avg("g").alias("m"), F.coalesce(F.stddev_samp("g"), F.lit(0.0)).alias("s"))
    m = m.withColumn("k", F.dense_rank().over(W.orderBy("month"))).filter("k % 2 = 1")
    return m.select(F.date_format("month", "yyyy-MM").alias("month"), "n", F.round("m", 6).alias("grounding"), F.round(F.greatest(F.lit(0.0), F.col("m") - F.col("s")), 6).alias("low"), F.round(F.least(F.lit(1.0), F.col("m") + F.col("s")), 6).alias("high"))


def q36_counts_by_month_and_model(spark, d):
    """Retrieved urls a turn by month and model, models with most turns first."""
    t = _all_sets(spark, d).filter("lower(primary_model) <> 'unknown' AND month is not null")
    g = t.groupBy(F.date_format("month", "yyyy-MM").alias("month"), "primary_model").agg(F.count("*").alias("n"), F.round(F.avg(F.size("retrieved")), 6).alias("mean"), _sem(F.size("retrieved")).alias("sem"))
    turns = g.groupBy("primary_model").agg(F.sum("n").alias("turns"))
    return g.join(turns, "primary_model").orderBy(F.desc("turns"), "primary_model", "month")


def q36_counts_by_model(spark, d):
    t = _all_sets(spark, d).filter("lower(primary_model) <> 'unknown'")
    return t.groupBy("primary_model").agg(F.count("*").alias("n"), F.sum(F.size("retrieved")).cast("bigint").alias("urls"), F.round(F.avg(F.size("retrieved")), 6).alias("mean"), F.round(F.avg(F.size("cited")), 6).alias("cited"), _sem(F.size("retrieved")).alias("sem")).orderBy(F.desc("urls"), "primary_model")


def q36_counts_by_topic(spark, d):
    t = _all_sets(spark, d).filter(~F.lower("topic").isin("other", "nan", "misc"))
    return t.groupBy("topic").agg(F.count("*").alias("n"), F.round(F.avg(F.size("retrieved")), 6).alias("retrieved"), F.round(F.avg(F.size("cited")), 6).alias("cited"), _sem(F.size("retrieved")).alias("sem"))


def q38_positions(spark, d):
    """How often each place of a result list is cited; ranks from 1, buckets beyond ten together."""
    rank = F.least(F.col("ref_index") + 1, F.lit(11))
    c = M.cited(_raw(spark, d)).filter("ref_index >= 0 and turn_index is not null")
    return c.groupBy("turn_index", rank.alias("rank")).agg(F.count("*").alias("n"))


def q38_mean_rank(spark, d):
    r = M.retrieved(_raw(spark, d)).select("row_id", (F.col("ref_index") + 1).alias("rank")).filter("rank > 0")
    g = r.groupBy("row_id").agg(F.avg("rank").alias("r"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean"), F.round(F.median("r"), 6).alias("median"), F.round(F.min("r"), 6).alias("low"), F.round(F.max("r"), 6).alias("high"))


def q40_novel_citations(spark, d):
    """Cited sources of which neither url nor domain was retrieved, by month on a full spine."""
    k = M.keyed(M.sources(_raw(spark, d)))
    of = lambda kind, c: F.collect_set(F.when(F.col("kind") == kind, c))
    sets = k.groupBy("row_id").agg(of("retrieved", F.col("key")).alias("urls"), of("retrieved", F.col("domain")).alias("domains"), of("cited", F.struct("key", "domain")).alias("cited"))
    new = F.filter("cited", lambda c: ~F.array_contains("urls", c["key"]) & ~F.array_contains("domains", c["domain"]))
    sets = sets.filter("size(cited) > 0").select("row_id", F.size("cited").alias("cited"), F.size(new).alias("novel"))
    t = _turns(spark, d).filter("month is not null").select("row_id", "month").join(sets, "row_id")
    m = t.groupBy("month").agg(F.sum("cited").alias("cited"), F.sum("novel").alias("novel"))
    # one row of all months, so that the spine needs no second pass
    one = m.agg(F.map_from_entries(F.collect_list(F.struct("month", F.struct("cited", "novel")))).alias("by"), F.min("month").alias("a"), F.max("month").alias("b")).filter("a is not null")
    j = one.select("by", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    j = j.select("month", *[F.coalesce(F.try_element_at("by", F.col("month"))[c], F.lit(0)).alias(c) for c in ("cited", "novel")])
    return j.select(F.date_format("month", "yyyy-MM").alias("month"), "cited", "novel", F.round(F.coalesce(F.try_divide("novel", "cited"), F.lit(0.0)), 6).alias("rate"))


def q41_citation_rounds(spark, d):
    c = M.cited(_raw(spark, d)).filter("turn_index is not null")
    return c.groupBy("turn_index").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("turns"))


def q42_source_venn(spark, d):
    """Distinct urls of the whole export by the exact set of kinds they occur in."""
    k = M.source_keys(_raw(spark, d)).select("key", "kind").distinct().groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("kind")), "+").alias("kinds"))
    return k.groupBy("kinds").agg(F.count("*").alias("n"))


def x04_exclusive_kind(spark, d):
    """Each url of a turn counted once, as cited before safe before retrieved."""
    order = F.when(F.col("kind") == "cited", 1).when(F.col("kind") == "safe", 2).otherwise(3)
    k = M.source_keys(_raw(spark, d)).groupBy("row_id", "key").agg(F.min(order).alias("p"))
    return k.groupBy(F.element_at(F.array(F.lit("cited"), F.lit("safe"), F.lit("retrieved")), F.col("p")).alias("kind")).agg(F.count("*").alias("n"))


def f01_url_functions(spark, d):
    p = table(spark, d, "documents").filter("url is not null")
    u = F.col("url")
    return p.select("doc_id", urls.domain(u).alias("domain"), urls.plain_domain(urls.domain(u)).alias("plain"), urls.match_key(u).alias("key"), urls.is_image(u).alias("image"))


_CITES = "c AS (SELECT c.row_id, " + KEY.format("url") + " AS key, " + DOMAIN.format("url") + " AS domain FROM cited c)"
_WITHIN = "len(list_filter({0}, lambda x: NOT list_contains({1}, x))) = 0"
_RELIABLE = "rel AS (SELECT trim(topic) AS topic, " + KEY.format("url") + " AS key, max(score) AS score FROM source_reliability WHERE topic IS NOT NULL AND url IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2)"
ORACLES = {
    "c15_retrieved": with_(SOURCES) + "SELECT row_id, pos, g, e, url, turn_index, ref_index FROM retrieved",
    "c15_safe": with_(SOURCES) + "SELECT row_id, pos, e, url FROM safe",
    "c16_cited": with_(SOURCES) + "SELECT row_id, url, turn_index, ref_index, coalesce(title, '') AS title FROM cited",
    "q29_turns_with_sources": with_(SOURCES) + "SELECT count(*) FILTER (WHERE len(retrieved) > 0) AS retrieved, count(*) FILTER (WHERE len(safe) > 0) AS safe, count(*) FILTER (WHERE len(cited) > 0) AS cited FROM url_sets",
    "q30_subset_relations": with_(TURNS, SOURCES, TURN_SETS) + f"SELECT {_WITHIN.format('safe', 'retrieved')} AS safe_in_retrieved, {_WITHIN.format('cited', 'safe')} AS cited_in_safe, {_WITHIN.format('cited', 'retrieved')} AS cited_in_retrieved, count(*) AS n FROM turn_sets GROUP BY 1, 2, 3",
    "q30_cited_in_retrieved": with_(TURNS, SOURCES, "dom AS (SELECT t.row_id, (SELECT count(*) FROM source_keys c WHERE c.row_id = t.row_id AND c.kind = 'cited' AND NOT EXISTS (SELECT 1 FROM source_keys r WHERE r.row_id = c.row_id AND r.kind = 'retrieved' AND r.key = c.key)) AS u, (SELECT count(*) FROM source_keys c WHERE c.row_id = t.row_id AND c.kind = 'cited' AND c.domain <> '' AND NOT EXISTS (SELECT 1 FROM source_keys r WHERE r.row_id = c.row_id AND r.kind = 'retrieved' AND r.domain = c.domain)) AS m FROM turns t)") + "SELECT x.of, x.within, CASE WHEN x.of = 'urls' THEN (SELECT count(*) FROM dom WHERE (u = 0) = x.within) ELSE (SELECT count(*) FROM dom WHERE (m = 0) = x.within) END AS n FROM (VALUES ('urls', true), ('urls', false), ('domains', true), ('domains', false)) x(of, within)",
    "q31_topic_domains": with_(TURNS, SOURCES) + "SELECT DISTINCT topic, domain FROM source_keys JOIN turns USING (row_id) WHERE domain <> '' AND lower(topic) NOT IN ('other', 'nan')",
    "q32_top_domains_by_topic": with_(TURNS, SOURCES, _CITES, "g AS (SELECT topic, domain, count(*) AS n, count(*) FILTER (WHERE list_contains(retrieved, key)) AS external FROM c LEFT JOIN url_sets USING (row_id) JOIN turns USING (row_id) WHERE domain <> '' AND topic IN ('Travel', 'Cars', 'Finance', 'Health', 'Science', 'Law') GROUP BY 1, 2)") + "SELECT * FROM (SELECT topic, domain, n, external, n - external AS internal, row_number() OVER (PARTITION BY topic ORDER BY n DESC, domain) AS k, round(n / sum(n) OVER (PARTITION BY topic), 6) AS share FROM g) WHERE k <= 20",
    "q32_top_domains_by_model": with_(TURNS, SOURCES, _CITES, "g AS (SELECT primary_model, domain, count(*) AS n, count(*) FILTER (WHERE list_contains(retrieved, key)) AS external FROM c LEFT JOIN url_sets USING (row_id) JOIN turns USING (row_id) WHERE domain <> '' AND primary_model <> 'Unknown' GROUP BY 1, 2)") + "SELECT * FROM (SELECT primary_model, domain, n, external, n - external AS internal, row_number() OVER (PARTITION BY primary_model ORDER BY n DESC, domain) AS k, round(n / sum(n) OVER (PARTITION BY primary_model), 6) AS share FROM g) WHERE k <= 20",
    "q32_top_domains": with_(SOURCES, "c AS (SELECT c.row_id, " + KEY.format("url") + " AS key, " + DOMAIN.format("url") + " AS domain FROM cited c)", "g AS (SELECT domain, count(*) AS n, count(*) FILTER (WHERE list_contains(retrieved, key)) AS external FROM c LEFT JOIN url_sets USING (row_id) WHERE domain <> '' GROUP BY 1)") + "SELECT domain, n, external, n - external AS internal, round(n / sum(n) OVER (), 6) AS share FROM g ORDER BY n DESC, domain LIMIT 20",
    "q32_top_domains_by_platform": with_(TURNS, SOURCES, "r AS (SELECT platform, " + DOMAIN.format("url") + " AS domain FROM retrieved JOIN turns USING (row_id))") + "SELECT * FROM (SELECT platform, domain, count(*) AS n, row_number() OVER (PARTITION BY platform ORDER BY count(*) DESC, domain) AS k FROM r WHERE domain <> '' GROUP BY 1, 2) WHERE k <= 5",
    "q33_reliability_paired_t": with_(TURNS, SOURCES, _RELIABLE, "p AS (SELECT row_id, avg(score) FILTER (WHERE kind = 'cited') - avg(score) FILTER (WHERE kind = 'retrieved') AS d FROM source_keys JOIN turns USING (row_id) JOIN rel USING (topic, key) GROUP BY row_id)") + "SELECT count(d) AS n, round(avg(d), 6) AS mean_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 4) AS t FROM p",
    "q46_scored_sources": with_(TURNS, SOURCES, _RELIABLE, "r AS (SELECT row_id, pos, g, e, topic, " + KEY.format("url") + " AS key FROM retrieved JOIN turns USING (row_id))") + "SELECT row_id, string_agg(printf('%.3f', coalesce(score, -1.0)), ',' ORDER BY pos, g, e) AS scores FROM r LEFT JOIN rel USING (topic, key) GROUP BY row_id",
    "q34_url_counts_by_month": with_(TURNS, SOURCES, TURN_SETS) + "SELECT strftime(month, '%Y-%m') AS month, count(*) AS n, " + ", ".join(f"round(avg(len({x})), 6) AS {x}_mean, round(stddev_samp(len({x})) / sqrt(count(*)), 6) AS {x}_sem" for x in ("retrieved", "safe", "cited")) + " FROM turn_sets WHERE month IS NOT NULL GROUP BY 1",
    "q34_cited_split_by_month": with_(TURNS, SOURCES, TURN_SETS, "k AS (SELECT month, len(retrieved) AS retrieved, len(list_filter(cited, lambda x: list_contains(retrieved, x))) AS external, len(list_filter(cited, lambda x: NOT list_contains(retrieved, x))) AS internal FROM turn_sets WHERE month IS NOT NULL)") + "SELECT strftime(month, '%Y-%m') AS month, count(*) AS n, " + ", ".join(f"round(avg({x}), 6) AS {x}_mean, round(stddev_samp({x}) / sqrt(count(*)), 6) AS {x}_sem" for x in ("retrieved", "external", "internal")) + " FROM k GROUP BY 1",
    "q35_grounding_rate": with_(TURNS, SOURCES, "g AS (SELECT month, len(list_filter(cited, lambda x: list_contains(retrieved, x))) / len(cited) AS g FROM turns JOIN url_sets USING (row_id) WHERE month IS NOT NULL AND len(cited) > 0)", "m AS (SELECT month, count(*) AS n, avg(g) AS m, coalesce(stddev_samp(g), 0) AS s, dense_rank() OVER (ORDER BY month) AS k FROM g GROUP BY month)") + "SELECT strftime(month, '%Y-%m') AS month, n, round(m, 6) AS grounding, round(greatest(0, m - s), 6) AS low, round(least(1, m + s), 6) AS high FROM m WHERE k % 2 = 1",
    "q36_counts_by_month_and_model": with_(TURNS, SOURCES, TURN_SETS) + "SELECT *, sum(n) OVER (PARTITION BY primary_model)::BIGINT AS turns FROM (SELECT strftime(month, '%Y-%m') AS month, primary_model, count(*) AS n, round(avg(len(retrieved)), 6) AS mean, round(stddev_samp(len(retrieved)) / sqrt(count(*)), 6) AS sem FROM turn_sets WHERE month IS NOT NULL AND lower(primary_model) <> 'unknown' GROUP BY 1, 2)",
    "q36_counts_by_model": with_(TURNS, SOURCES, TURN_SETS) + "SELECT primary_model, count(*) AS n, sum(len(retrieved))::BIGINT AS urls, round(avg(len(retrieved)), 6) AS mean, round(avg(len(cited)), 6) AS cited, round(stddev_samp(len(retrieved)) / sqrt(count(*)), 6) AS sem FROM turn_sets WHERE lower(primary_model) <> 'unknown' GROUP BY 1",
    "q36_counts_by_topic": with_(TURNS, SOURCES, TURN_SETS) + "SELECT topic, count(*) AS n, round(avg(len(retrieved)), 6) AS retrieved, round(avg(len(cited)), 6) AS cited, round(stddev_samp(len(retrieved)) / sqrt(count(*)), 6) AS sem FROM turn_sets WHERE lower(topic) NOT IN ('other', 'nan', 'misc') GROUP BY 1",
    "q38_positions": with_(SOURCES) + "SELECT turn_index, least(ref_index + 1, 11) AS rank, count(*) AS n FROM cited WHERE ref_index >= 0 AND turn_index IS NOT NULL GROUP BY 1, 2",
    "q38_mean_rank": with_(SOURCES) + "SELECT count(*) AS n, round(avg(r), 6) AS mean, round(median(r), 6) AS median, round(min(r), 6) AS low, round(max(r), 6) AS high FROM (SELECT row_id, avg(ref_index + 1) AS r FROM retrieved WHERE ref_index + 1 > 0 GROUP BY row_id)",
    "q40_novel_citations": with_(
        TURNS,
        SOURCES,
        "c AS (SELECT row_id, count(*) AS cited, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM source_keys r WHERE r.kind = 'retrieved' AND r.row_id = k.row_id AND (r.key = k.key OR r.domain = k.domain))) AS novel FROM source_keys k WHERE kind = 'cited' GROUP BY 1)",
        "m AS (SELECT month, sum(cited) AS cited, sum(novel) AS novel FROM turns JOIN c USING (row_id) WHERE month IS NOT NULL GROUP BY 1)",
        "spine AS (SELECT unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM m)",
    )
    + "SELECT strftime(month, '%Y-%m') AS month, coalesce(cited, 0)::BIGINT AS cited, coalesce(novel, 0)::BIGINT AS novel, round(CASE WHEN coalesce(cited, 0) = 0 THEN 0 ELSE novel / cited END, 6) AS rate FROM spine LEFT JOIN m USING (month)",
    "q41_citation_rounds": with_(SOURCES) + "SELECT turn_index, count(*) AS n, count(DISTINCT row_id) AS turns FROM cited WHERE turn_index IS NOT NULL GROUP BY 1",
    "q42_source_venn": with_(SOURCES) + "SELECT kinds, count(*) AS n FROM (SELECT key, string_agg(kind, '+' ORDER BY kind) AS kinds FROM (SELECT DISTINCT key, kind FROM source_keys) GROUP BY key) GROUP BY kinds",
    "x04_exclusive_kind": with_(SOURCES) + "SELECT ['cited', 'safe', 'retrieved'][p] AS kind, count(*) AS n FROM (SELECT row_id, key, min(CASE kind WHEN 'cited' THEN 1 WHEN 'safe' THEN 2 ELSE 3 END) AS p FROM source_keys GROUP BY 1, 2) GROUP BY 1",
    "f01_url_functions": "SELECT doc_id, replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '') AS domain, " + DOMAIN.format("url") + " AS plain, " + KEY.format("url") + " AS key, regexp_matches(lower(url), '\\.(jpg|jpeg|png|gif|webp|bmp|svg|tif|tiff|avif|heic|heif|jfif|pjpeg|pjp|mov)$') OR regexp_matches(lower(url), '^https?://tse[^/?#]*\\.mm\\.bing\\.net([/?#]|$)') AS image FROM documents WHERE url IS NOT NULL",
}
QUERIES = {
    f.__name__: f
    for f in (
        c15_retrieved, c15_safe, c16_cited, q29_turns_with_sources, q30_subset_relations, q30_cited_in_retrieved, q31_topic_domains, q32_top_domains, q32_top_domains_by_topic, q32_top_domains_by_model, q32_top_domains_by_platform, q33_reliability_paired_t, q46_scored_sources, q34_url_counts_by_month, q34_cited_split_by_month,
        q35_grounding_rate, q36_counts_by_month_and_model, q36_counts_by_model, q36_counts_by_topic, q38_positions, q38_mean_rank, q40_novel_citations, q41_citation_rounds, q42_source_venn, x04_exclusive_kind, f01_url_functions,
    )
}
