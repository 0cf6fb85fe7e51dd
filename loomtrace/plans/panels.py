"""Reports on outcomes, agreement, ranks and spines, bound to the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.functions import coerce, kernels
from loomtrace.functions import text as X
from loomtrace.operators import attribution, blocks, stats
from loomtrace.plans.sql import CHUNKS, SENTENCES, with_
from loomtrace.session import table

MAX_TYPES = 64
TYPES = ("click", "error", "purchase", "signup", "view")


def _cells(spark, d):
    """Events by user and day with a flag and a mean value per type."""
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    kinds = [r.event_type for r in e.select("event_type").distinct().orderBy("event_type").limit(MAX_TYPES + 1).collect()]
    if len(kinds) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types")
    return e.groupBy("user_id", "day").agg(*[F.max((F.col("event_type") == k).cast("int")).alias(f"f_{k}") for k in kinds], *[F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(f"v_{k}") for k in kinds]), kinds


def a02_event_rate_by_day(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("event_type") == "error").cast("int")), 6).alias("rate"))


def a22_value_sem(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value") / F.sqrt(F.count("value")), 4).alias("sem"))


def a05_region_rate(spark, d):
    """Broadcast chain of two small dimensions (25 and 5 rows; the planner checks their sizes)."""
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.avg((F.col("c_acctbal") < 0).cast("int")), 6).alias("rate")).orderBy(F.desc("rate"), "r_name")


def a24_month_spine(spark, d):
    o = table(spark, d, "orders").withColumn("m", F.trunc("o_orderdate", "month"))
    g = o.groupBy("m").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    spine = g.agg(F.explode(F.sequence(F.min("m"), F.max("m"), F.expr("interval 1 month"))).alias("m"))
    j = spine.join(g, "m", "left").na.fill(0, ["n", "f"])
    return j.select(F.date_format("m", "yyyy-MM").alias("month"), "n", "f", F.round(F.coalesce(F.try_divide("f", "n"), F.lit(0.0)), 6).alias("rate"))


def a25_lines_histogram(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("q"))
    b = g.groupBy(F.least("n", F.lit(5)).alias("bucket")).agg(F.count("*").alias("orders"), F.sum("n").alias("lines"), F.max("q").alias("max_quantity"))
    return b.withColumn("share", F.round(F.col("orders") / F.sum("orders").over(W.partitionBy()), 6))


def a21_quantity_band(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_returnflag").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("m"), (F.coalesce(F.stddev_samp("l_quantity"), F.lit(0.0)) / F.sqrt(F.count("*"))).alias("s"))
    return g.select("month", "l_returnflag", "n", F.round("m", 5).alias("mean"), F.round(F.greatest(F.lit(0.0), F.col("m") - F.col("s")), 5).alias("low"), F.round(F.col("m") + F.col("s"), 5).alias("high"))


def a19_distinct_per_month(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    back = l.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    m = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    a = o.groupBy(m).agg(F.countDistinct("o_custkey").alias("customers"))
    b = o.join(back, "o_orderkey", "left_semi").groupBy(m).agg(F.countDistinct("o_custkey").alias("with_returns"))
    return a.join(b, "month", "left").na.fill(0, ["with_returns"])


def a11_combinations(spark, d):
    """Cells by the exact set of event types in them."""
    c, kinds = _cells(spark, d)
    key = F.array_join(F.filter(F.array(*[F.when(F.col(f"f_{k}") == 1, F.lit(k)) for k in kinds]), lambda x: x.isNotNull()), "+")
    return c.groupBy(key.alias("types")).agg(F.count("*").alias("n"))


def a12_anchor_agreement(spark, d):
    """How many of the other types agree with the presence of purchases."""
    c, kinds = _cells(spark, d)
    rest = sum((F.col(f"f_{k}") for k in kinds if k != "purchase"), F.lit(0))
    anchor = F.col("f_purchase") == 1
    g = c.groupBy(anchor.alias("anchor"), F.when(anchor, rest).otherwise(len(kinds) - 1 - rest).alias("agreeing")).agg(F.count("*").alias("n"))
    spine = c.sparkSession.range(2).select((F.col("id") == 1).alias("anchor")).select("anchor", F.explode(F.sequence(F.lit(0), F.lit(len(kinds) - 1))).alias("agreeing"))
    return spine.join(g, ["anchor", "agreeing"], "left").na.fill(0, ["n"])


def a13_all_flags_means(spark, d):
    c, kinds = _cells(spark, d)
    whole = c.filter(" AND ".join(f"`f_{k}` = 1" for k in kinds))
    long = whole.select(F.explode(F.array(*[F.struct(F.lit(k).alias("event_type"), F.col(f"v_{k}").alias("v")) for k in kinds])).alias("x"))
    return long.groupBy("x.event_type").agg(F.count("x.v").alias("n"), F.round(F.avg("x.v"), 5).alias("mean"))


def a07_mode_metric_matrix(spark, d):
    """Mean of three metrics per return flag with the mean of the means."""
    l = table(spark, d, "lineitem")
    m = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax"}
    g = l.groupBy(F.col("l_returnflag").alias("mode")).agg(*[F.avg(coerce.to_number(F.col(c))).alias(k) for k, c in m.items()])
    return g.select("mode", *[F.round(k, 6).alias(k) for k in m], F.round(sum((F.col(k) for k in m), F.lit(0.0)) / len(m), 6).alias("average"))


def a08_call_outcome(spark, d):
    """Strict outcome per order: the first line of the order as one mode, the last as the other, three metrics."""
    l = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax").alias("x"))
    g = l.groupBy("l_orderkey").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    cols = ("l_quantity", "l_discount", "l_tax")
    better = sum((F.when(F.col(f"a.{c}") > F.col(f"b.{c}"), 1).otherwise(0) for c in cols), F.lit(0))
    worse = sum((F.when(F.col(f"a.{c}") < F.col(f"b.{c}"), 1).otherwise(0) for c in cols), F.lit(0))
    web = F.col("l_orderkey") % 2 == 0
    o = g.select(web.alias("web"), stats.strict_outcome(web, better, worse, 3).alias("outcome"))
    return o.groupBy("web", "outcome").agg(F.count("*").alias("n"))


def a14_confusion(spark, d):
    l = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").alias("truth"), (F.col("l_discount") > 0.05).alias("said"))
    c = l.agg(F.count_if(F.col("truth") & F.col("said")).alias("tp"), F.count_if(~F.col("truth") & F.col("said")).alias("fp"), F.count_if(F.col("truth") & ~F.col("said")).alias("fn"), F.count_if(~F.col("truth") & ~F.col("said")).alias("tn"))
    div = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return c.select("tp", "fp", "fn", "tn", div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def a10_contingency(spark, d):
    o = table(spark, d, "orders")
    g = o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return g.select("o_orderpriority", F.col("F").alias("n_f"), F.col("O").alias("n_o"), F.col("P").alias("n_p"))


def w06_rank_correlation(spark, d):
    """Correlation of the price and quantity ranks of each order's lines, and whether both orders agree."""
    l = table(spark, d, "lineitem")
    tie = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
    p = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_extendedprice", *tie))
    q = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_quantity", *tie))
    g = l.select("l_orderkey", p.alias("p"), q.alias("q")).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.corr("p", "q").alias("r"), F.bool_and(F.col("p") == F.col("q")).alias("same"))
    k = g.filter("n >= 2")
    return k.agg(F.count("*").alias("orders"), F.round(F.avg("r"), 5).alias("mean"), F.round(F.median("r"), 5).alias("median"), F.round(F.avg(F.col("same").cast("int")), 6).alias("exact"))


def t1_paired_t(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    return stats.paired_t(g, "a", "b").select("n", "mean_diff", "t")


def a37_diagonal(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    side = F.when(stats.is_close(F.col("a"), F.col("b")), "on").when(F.col("a") > F.col("b"), "above").otherwise("below")
    return g.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def j06_customers_without_urgent(spark, d):
    o = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def w07_first_of_copies(spark, d):
    """Documents without exact copies of a text: the lowest doc_id of each stays, null texts each stay."""
    t = table(spark, d, "documents").select("doc_id", "doc_kind", F.when(F.col("text").isNotNull(), F.md5("text")).otherwise(F.concat(F.lit("null-"), F.col("doc_id").cast("string"))).alias("h"))
    g = t.groupBy("h").agg(F.min(F.struct("doc_id", "doc_kind")).alias("k"), F.count("*").alias("copies"))
    return g.select("k.doc_id", "k.doc_kind", "copies")


def _daily(spark, d):
    return table(spark, d, "events").withColumn("day", F.to_date("ts"))


def w05_last_of_runs(spark, d):
    """Last event of each run of equal types per user, day by day with what the day before ended with."""
    e = blocks.previous(_daily(spark, d), ["user_id"], "day", ["ts", "event_id"], "event_type", "before")
    new = (~F.col("before").eqNullSafe(F.col("event_type"))).cast("int")
    r = blocks.running(e, ["user_id"], "day", ["ts", "event_id"], new, "run")
    return r.groupBy("user_id", "run").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("length"))


def c08_event_turns(spark, d):
    """Turns closed by a purchase; an open tail is left out."""
    closes = (F.col("event_type") == "purchase").cast("int")
    t = blocks.running(_daily(spark, d), ["user_id"], "day", ["ts", "event_id"], closes, "turn", inclusive=False)
    t = t.groupBy("user_id", "turn").agg(F.count("*").alias("n"), F.max(closes).alias("whole"), F.round(F.sum("value"), 4).alias("value"))
    return t.filter("whole = 1").select("user_id", "turn", "n", "value")


def usual_event_type(spark, d):
    """Most frequent event type of each user, the earliest on a tie."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min(F.struct("ts", "event_id")).alias("first"))
    g = e.groupBy("user_id").agg(F.max_by(F.struct("event_type", "n"), F.struct(F.col("n"), -F.unix_micros(F.col("first.ts").cast("timestamp")), -F.col("first.event_id"))).alias("x"))
    return g.select("user_id", "x.event_type", "x.n")


def m01_centroid_cosine(spark, d):
    """Cosine of each vector with the centroid of its label."""
    e = table(spark, d, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    c = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    return e.join(c, "label").select("vec_id", F.round(kernels.cosine(F.col("embedding"), F.col("c")), 4).alias("cosine"))


def m05_attribution(spark, d):
    """Attribution cascade over orders: lines as candidates, tiers by flag, support by discount."""
    l = table(spark, d, "lineitem")
    tier = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    c = l.select("l_orderkey", F.col("l_partkey").alias("source"), tier.alias("tier"), F.col("l_linenumber").alias("pos"), (F.col("l_discount") >= 0.08).alias("entailed"))
    c = c.groupBy("l_orderkey", "source", "tier", "pos").agg(F.bool_or("entailed").alias("entailed"))
    return attribution.cascade(c, ["l_orderkey"])


def a35_novel_parts(spark, d):
    """Lines whose part and supplier both stand in no earlier line of the order."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    a = l.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("p"))
    b = l.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("s"))
    j = l.join(a, ["l_orderkey", "l_partkey"]).join(b, ["l_orderkey", "l_suppkey"]).filter((F.col("p") == F.col("l_linenumber")) & (F.col("s") == F.col("l_linenumber")))
    return j.groupBy("l_linenumber").agg(F.count("*").alias("n"))


def f20_event_props(spark, d):
    """Number inside the JSON of an event, also where the JSON stands in other text."""
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("reply: "), F.col("props"), F.lit(" end")).alias("t"))
    v = coerce.judged_json(F.col("t"))
    return e.select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"))


def f08_text_scalars(spark, d):
    p = table(spark, d, "documents").filter("text is not null")
    t = F.col("text")
    return p.select("doc_id", X.term_count(t).alias("terms"), F.size(X.tokens(t)).alias("tokens"), F.ceil(F.length(t) / 3).cast("bigint").alias("estimate"), F.md5(t).alias("key"), F.sha2(t, 256).alias("sha"))


def f26_sentences(spark, d):
    p = table(spark, d, "documents").filter("text is not null and lang = 'en'")
    s = X.sentences(F.col("text"))
    return p.select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "|")).alias("md5"))


def f29_chunks(spark, d):
    """Pieces of answers closed by citation marks: number, number with refs, refs in order."""
    p = table(spark, d, "documents").filter("doc_kind = 'answer' and text is not null")
    c = p.select("doc_id", F.posexplode(X.answer_chunks("text")).alias("i", "c"))
    return c.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.size("c.refs") > 0).alias("with_refs"), F.sum(F.length("c.text")).alias("chars"))


def w10_latest_claims(spark, d):
    """Newest claim of each run of equal refs within an answer."""
    p = table(spark, d, "documents").filter("doc_kind = 'answer' and text is not null")
    c = p.select("doc_id", F.posexplode(X.answer_chunks("text")).alias("i", "c")).select("doc_id", "i", X.refs_key(F.col("c.refs")).alias("refs"))
    return attribution.latest_claims(c, "doc_id", "i", "refs")


def f33_html_text(spark, d):
    """Visible text of documents with markup remains."""
    p = table(spark, d, "documents").filter("text like '%<%'")
    return p.select("doc_id", F.length(X.html_to_text("text")).alias("chars"))


def s12_reachable(spark, d):
    """Share of documents whose url is complete and known to be alive, from a static table of dead hosts."""
    from loomtrace.functions import urls

    p = table(spark, d, "documents").filter("url is not null").select(urls.with_scheme(F.col("url")).alias("u"))
    alive = F.col("u").isNotNull() & ~F.col("u").contains("//harbour-desk.")
    return p.agg(F.count("*").alias("n"), F.count_if(alive).alias("alive"))


ORACLES = {
    "f26_sentences": "SELECT doc_id, len(s)::INT AS n, md5(array_to_string(s, '|')) AS md5 FROM (SELECT doc_id, " + SENTENCES.format("text") + " AS s FROM documents WHERE text IS NOT NULL AND lang = 'en')",
    "f29_chunks": with_(CHUNKS) + "SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE refs <> '') AS with_refs, sum(length(text))::BIGINT AS chars FROM chunk GROUP BY 1",
    "w10_latest_claims": with_(CHUNKS, "n AS (SELECT doc_id, row_number() OVER w - 1 AS i, refs, lead(refs) OVER w AS after FROM chunk WINDOW w AS (PARTITION BY doc_id ORDER BY ord))") + "SELECT doc_id, i::INT AS i, refs FROM n WHERE refs <> '' AND after IS DISTINCT FROM refs",
    "a02_event_rate_by_day": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg((event_type = 'error')::INT), 6) AS rate FROM events GROUP BY 1",
    "a22_value_sem": "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value) / sqrt(count(value)), 4) AS sem FROM events GROUP BY 1, 2",
    "a05_region_rate": "SELECT r_name, count(*) AS n, round(avg((c_acctbal < 0)::INT), 6) AS rate FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "a24_month_spine": "WITH g AS (SELECT date_trunc('month', o_orderdate)::DATE AS m, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1), s AS (SELECT unnest(generate_series(min(m)::TIMESTAMP, max(m)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM g) SELECT strftime(m, '%Y-%m') AS month, coalesce(n, 0) AS n, coalesce(f, 0) AS f, round(coalesce(f / n, 0), 6) AS rate FROM s LEFT JOIN g USING (m)",
    "a25_lines_histogram": "SELECT least(n, 5) AS bucket, count(*) AS orders, sum(n)::BIGINT AS lines, max(q) AS max_quantity, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) GROUP BY 1",
    "a21_quantity_band": "SELECT month, l_returnflag, n, round(m, 5) AS mean, round(greatest(0, m - s), 5) AS low, round(m + s, 5) AS high FROM (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag, count(*) AS n, avg(l_quantity) AS m, coalesce(stddev_samp(l_quantity), 0) / sqrt(count(*)) AS s FROM lineitem GROUP BY 1, 2)",
    "a19_distinct_per_month": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_custkey) FILTER (WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS with_returns FROM orders GROUP BY 1",
    "a11_combinations": "SELECT types, count(*) AS n FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS types FROM events GROUP BY 1, 2) GROUP BY 1",
    "a12_anchor_agreement": "WITH c AS (SELECT bool_or(event_type = 'purchase') AS anchor, count(DISTINCT event_type) FILTER (WHERE event_type <> 'purchase') AS k FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d')), t AS (SELECT count(DISTINCT event_type) - 1 AS m FROM events), g AS (SELECT anchor, CASE WHEN anchor THEN k ELSE m - k END AS agreeing, count(*) AS n FROM c, t GROUP BY 1, 2) SELECT anchor, agreeing, coalesce(n, 0) AS n FROM (SELECT unnest([true, false]) AS anchor) CROSS JOIN (SELECT unnest(generate_series(0, m)) AS agreeing FROM t) LEFT JOIN g USING (anchor, agreeing)",
    "a13_all_flags_means": "WITH c AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, avg(value) AS v FROM events GROUP BY 1, 2, 3), k AS (SELECT user_id, day FROM c GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events)) SELECT event_type, count(v) AS n, round(avg(v), 5) AS mean FROM c JOIN k USING (user_id, day) GROUP BY 1",
    "a07_mode_metric_matrix": "SELECT l_returnflag AS mode, round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax, round((avg(l_quantity) + avg(l_discount) + avg(l_tax)) / 3, 6) AS average FROM lineitem GROUP BY 1",
    "a08_call_outcome": "WITH g AS (SELECT l_orderkey, min(x) AS a, max(x) AS b FROM (SELECT l_orderkey, {'n': l_linenumber, 'p': l_partkey, 's': l_suppkey, 'e': l_extendedprice, 'q': l_quantity, 'd': l_discount, 't': l_tax} AS x FROM lineitem) GROUP BY 1), o AS (SELECT l_orderkey % 2 = 0 AS web, (a.q > b.q)::INT + (a.d > b.d)::INT + (a.t > b.t)::INT AS r, (a.q < b.q)::INT + (a.d < b.d)::INT + (a.t < b.t)::INT AS n FROM g) SELECT web, CASE WHEN web AND r >= 1 THEN 'Right' WHEN web AND n >= 1 THEN 'Over' WHEN web THEN 'Right' WHEN n >= 1 THEN 'Right' WHEN r = 3 THEN 'Under' ELSE 'Right' END AS outcome, count(*) AS n FROM o GROUP BY 1, 2",
    "a14_confusion": "WITH c AS (SELECT count(*) FILTER (WHERE t AND s) AS tp, count(*) FILTER (WHERE NOT t AND s) AS fp, count(*) FILTER (WHERE t AND NOT s) AS fn, count(*) FILTER (WHERE NOT t AND NOT s) AS tn FROM (SELECT l_returnflag = 'R' AS t, l_discount > 0.05 AS s FROM lineitem)) SELECT *, round(coalesce(tp / (tp + fp), 0), 6) AS precision, round(coalesce(tp / (tp + fn), 0), 6) AS recall FROM c",
    "a10_contingency": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1",
    "w06_rank_correlation": "WITH k AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS q FROM lineitem), g AS (SELECT count(*) AS n, corr(p, q) AS r, bool_and(p = q) AS same FROM k GROUP BY l_orderkey) SELECT count(*) AS orders, round(avg(r), 5) AS mean, round(median(r), 5) AS median, round(avg(same::INT), 6) AS exact FROM g WHERE n >= 2",
    "t1_paired_t": "SELECT count(*) AS n, round(avg(x), 6) AS mean_diff, round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 4) AS t FROM (SELECT avg(l_discount) - avg(l_tax) AS x FROM lineitem GROUP BY l_orderkey)",
    "a37_diagonal": "SELECT CASE WHEN abs(a - b) <= 1e-8 + 1e-5 * abs(b) THEN 'on' WHEN a > b THEN 'above' ELSE 'below' END AS side, count(*) AS n FROM (SELECT avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem GROUP BY l_orderkey) GROUP BY 1",
    "j06_customers_without_urgent": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL) GROUP BY 1",
    "w07_first_of_copies": "SELECT doc_id, doc_kind, copies FROM (SELECT doc_id, doc_kind, row_number() OVER w AS n, count(*) OVER (PARTITION BY coalesce(md5(text), 'null-' || doc_id)) AS copies FROM documents WINDOW w AS (PARTITION BY coalesce(md5(text), 'null-' || doc_id) ORDER BY doc_id)) WHERE n = 1",
    "w05_last_of_runs": "WITH b AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM b) SELECT user_id, run, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS length FROM r GROUP BY 1, 2",
    "c08_event_turns": "WITH t AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS turn FROM events) SELECT user_id, turn, count(*) AS n, round(sum(value), 4) AS value FROM t GROUP BY 1, 2 HAVING bool_or(event_type = 'purchase')",
    "usual_event_type": "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(ts), min(event_id)) AS k FROM events GROUP BY 1, 2) WHERE k = 1",
    "m01_centroid_cosine": "WITH p AS (SELECT label, i, avg(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS c FROM p GROUP BY 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], c), 4) AS cosine FROM embeddings JOIN c USING (label)",
    "m05_attribution": "WITH k AS (SELECT l_orderkey, l_partkey AS source, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS tier, l_linenumber AS pos, bool_or(l_discount >= 0.08) AS e FROM lineitem GROUP BY 1, 2, 3, 4), o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, source ORDER BY tier, pos) AS x FROM k), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY tier, pos, source) AS n FROM o WHERE x = 1), g AS (SELECT l_orderkey, min(n) FILTER (WHERE e) AS hit, arg_min(tier, n) FILTER (WHERE e) AS tier, arg_min(source, n) FILTER (WHERE e) AS source, count(*) AS total, count(*) FILTER (WHERE tier = 1) AS first FROM n GROUP BY 1) SELECT l_orderkey, CASE tier WHEN 1 THEN 'Marked Citations' WHEN 2 THEN 'Other Citations' WHEN 3 THEN 'Retrieved Sources' ELSE 'Unexplained' END AS bucket, source, CASE WHEN hit IS NULL THEN total WHEN tier = 1 THEN first ELSE hit END AS checked FROM g",
    "a35_novel_parts": "WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) SELECT l_linenumber, count(*) AS n FROM l WHERE NOT EXISTS (SELECT 1 FROM l e WHERE e.l_orderkey = l.l_orderkey AND e.l_linenumber < l.l_linenumber AND (e.l_partkey = l.l_partkey OR e.l_suppkey = l.l_suppkey)) GROUP BY 1",
    "f20_event_props": "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events",
    "f08_text_scalars": "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS terms, len(regexp_extract_all(lower(text), '(\\p{L}+|\\d+)')) AS tokens, ceil(length(text) / 3)::BIGINT AS estimate, md5(text) AS key, sha256(text) AS sha FROM documents WHERE text IS NOT NULL",
    "s12_reachable": "SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(trim(url), '^https?://[^/?#\\s]+') AND NOT contains(url, '//harbour-desk.')) AS alive FROM documents WHERE url IS NOT NULL",
}
QUERIES = {
    f.__name__: f
    for f in (
        a02_event_rate_by_day, a22_value_sem, a05_region_rate, a24_month_spine, a25_lines_histogram, a21_quantity_band, a19_distinct_per_month, a11_combinations, a12_anchor_agreement, a13_all_flags_means, a07_mode_metric_matrix,
        a08_call_outcome, a14_confusion, a10_contingency, w06_rank_correlation, t1_paired_t, a37_diagonal, j06_customers_without_urgent, w07_first_of_copies, w05_last_of_runs, c08_event_turns, usual_event_type, m01_centroid_cosine,
        m05_attribution, a35_novel_parts, f20_event_props, f08_text_scalars, f26_sentences, f29_chunks, w10_latest_claims, f33_html_text, s12_reachable,
    )
}
