"""Reports on when an assistant calls the web: rates by time, platform, model and topic, shares and model counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.functions import coerce
from loomtrace.operators import messages as M
from loomtrace.plans.sql import MESSAGES, QUERIES as QUERY_TABLES, TURNS, as_list, with_
from loomtrace.session import table

# Topic labels that are no topic, and first months of the trend reports.
NO_TOPIC = ("other", "nan", "unknown", "misc")
FIRST_MONTH = "2023-01-01"
FIRST_MODEL_MONTH = "2024-01-01"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    t = M.turns(table(spark, d, "web_data_summary"))
    return t.withColumn("web", M.used_web(F.col("tools"), F.col("interactions"))).withColumn("primary_model", M.primary_model(F.col("models")))


def rate(flag: Column) -> Column:
    return F.round(F.avg(flag.cast("int")), 6)


def _month() -> Column:
    return F.date_format("month", "yyyy-MM").alias("month")


def q01_tool_rate_by_month(spark, d):
    """Three rates in one pass: web, any tool, tools other than web."""
    other = F.exists("tools", lambda t: ~F.lower(F.coalesce(t, F.lit("web"))).contains("web"))
    t = _turns(spark, d).filter("month is not null")
    return t.groupBy(_month()).agg(F.count("*").alias("n"), rate(F.col("web")).alias("web_rate"), rate(F.coalesce(F.size("tools") > 0, F.lit(False))).alias("tool_rate"), rate(F.coalesce(other, F.lit(False))).alias("other_rate"))


def q02_web_rate_by_platform(spark, d):
    t = _turns(spark, d).filter(F.col("month") >= F.lit(FIRST_MONTH).cast("date"))
    return t.groupBy("platform", _month()).agg(F.count("*").alias("n"), rate(F.col("web")).alias("web_rate"))


def q03_web_rate_by_model(spark, d):
    t = _turns(spark, d).filter((F.col("month") >= F.lit(FIRST_MODEL_MONTH).cast("date")) & (F.col("primary_model") != "Unknown"))
    return t.groupBy("primary_model", _month()).agg(F.count("*").alias("n"), rate(F.col("web")).alias("web_rate"))


def q04_models(spark, d):
    t = _turns(spark, d).select(F.explode("models").alias("model")).filter("model is not null and trim(model) <> ''")
    return t.distinct().orderBy("model")


def q05_topic_share(spark, d):
    t = _turns(spark, d).filter(~F.lower("topic").isin(*NO_TOPIC))
    g = t.groupBy("topic").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


def q06_web_rate_by_topic(spark, d):
    return _turns(spark, d).groupBy("topic").agg(F.count("*").alias("n"), rate(F.col("web")).alias("web_rate")).orderBy(F.desc("web_rate"), "topic")


def q07_first_sample_per_topic(spark, d):
    """First English turn of each topic in order of arrival, with its prompt."""
    t = _turns(spark, d).filter("language = 'en' and platform is not null")
    first = t.groupBy("topic").agg(F.min_by(F.struct("row_id", M.last_user(F.col("users")).alias("prompt")), "row_id").alias("s"))
    return first.select("topic", "s.row_id", "s.prompt")


def q08_topic_share_within_platform(spark, d):
    g = _turns(spark, d).groupBy("platform", "topic").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("platform")), 6))


def q14_model_counts(spark, d):
    """Mentions of each model and turns that end with it."""
    t = _turns(spark, d)
    mentions = t.select(F.explode("models").alias("model")).filter("model is not null and trim(model) <> ''").groupBy("model").agg(F.count("*").alias("mentions"))
    primary = t.groupBy(F.col("primary_model").alias("model")).agg(F.count("*").alias("turns"))
    return mentions.join(primary, "model", "full").na.fill(0, ["mentions", "turns"])


def q25_model_coverage(spark, d):
    raw = table(spark, d, "web_data_summary")
    have = M.loops(raw).select("row_id").distinct().withColumn("has", F.lit(1))
    t = _turns(spark, d).select("row_id", "primary_model").join(have, "row_id", "left")
    return t.groupBy("primary_model").agg(F.count("*").alias("n"), F.count("has").alias("with_queries"), F.round(F.count("has") / F.count("*"), 6).alias("coverage")).orderBy(F.desc("with_queries"), F.desc("n"), "primary_model")


def c18_thoughts_before_web(spark, d):
    """Thoughts up to and including the first message that calls the web."""
    m = M.messages(table(spark, d, "web_data_summary"))
    calls = F.lower(M.field("m", "recipient")).contains("web")
    thought = F.array_join(F.filter(F.transform(M.list_field("m", "content.thoughts"), lambda t: F.try_variant_get(t, "$.content", "string")), lambda t: t.isNotNull()), "\n")
    parts = m.select("row_id", "pos", F.coalesce(calls, F.lit(False)).alias("calls"), thought.alias("thought"))
    first = parts.withColumn("first", F.min(F.when(F.col("calls"), F.col("pos"))).over(W.partitionBy("row_id"))).filter("pos <= first")
    return first.groupBy("row_id").agg(F.count_if(F.col("thought") != "").alias("n_thoughts"), F.sum(F.length(F.coalesce("thought", F.lit("")))).alias("chars"))


def single_english_starters(spark, d):
    t = _turns(spark, d).filter((F.col("conv_starter") == 1) & (F.col("language") == "en") & (F.size("users") == 1) & (F.trim(F.coalesce(M.last_user(F.col("users")), F.lit(""))) != ""))
    return t.select("row_id", "conv_id", "turn_id", F.length(M.last_user(F.col("users"))).alias("chars"))


def c22_history_prompt(spark, d):
    """Replay prompt of the last two pairs before the current text."""
    t = _turns(spark, d).filter(F.size("users") >= 3)
    n = F.size("users")
    pairs = F.transform(F.sequence(n - 2, n - 1), lambda i: F.concat_ws("\n", F.concat(F.lit("U: "), F.coalesce(F.get("users", i - 1), F.lit(""))), F.concat(F.lit("A: "), F.coalesce(F.get("answers", i - 1), F.lit("")))))
    return t.select("row_id", F.md5(F.concat_ws("\n", F.array_join(pairs, "\n"), F.coalesce(F.element_at("users", -1), F.lit("")))).alias("prompt_md5"))


def a51_length_stats(spark, d):
    t = _turns(spark, d)
    u = F.length(F.element_at("users", -1))
    h = F.aggregate(F.transform("users", lambda x: F.length(F.coalesce(x, F.lit("")))), F.lit(0), lambda s, x: s + x)
    return t.agg(F.round(F.avg(u), 4).alias("user_mean"), F.round(F.stddev_pop(u), 4).alias("user_std"), F.round(F.avg(h), 4).alias("history_mean"), F.round(F.stddev_pop(h), 4).alias("history_std"))


def a50_totals(spark, d):
    t = _turns(spark, d)
    return t.agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.countDistinct("user_id").alias("users"), F.sum(F.coalesce(F.size("tools"), F.lit(0))).cast("bigint").alias("tool_calls"))


def safe_conversations(spark, d):
    """Turns of conversations whose every rating says no to both questions (null and blank count as no answer)."""
    a = table(spark, d, "conv_annotations")
    no = (F.lower(F.trim(F.coalesce("personal_presence", F.lit("")))) == "no") & (F.lower(F.trim(F.coalesce("special_category_presence", F.lit("")))) == "no")
    safe = a.filter("conv_id is not null").groupBy("conv_id").agg(F.bool_and(no).alias("ok")).filter("ok").select("conv_id")
    return _turns(spark, d).join(safe, "conv_id", "left_semi").select("row_id", "conv_id")


def r05_balanced_sample(spark, d):
    """Web and other conversation starters without a rating, 50 of each by hash of the row."""
    rated = table(spark, d, "conv_annotations").filter("conv_id is not null").select("conv_id").distinct()
    t = _turns(spark, d).join(rated, "conv_id", "left_anti").withColumn("h", F.md5(F.concat_ws(":", F.col("row_id").cast("string"), F.lit("42"))))
    n = F.row_number().over(W.partitionBy("web").orderBy("h", "row_id"))
    return t.withColumn("n", n).filter("n <= 50").select("row_id", "web", "n")


def r02_stratified_sample(spark, d):
    """Up to 20 English turns of each of three topics by hash of the row."""
    t = _turns(spark, d).filter(F.col("topic").isin("Finance", "Travel", "Law") & (F.col("language") == "en"))
    h = F.md5(F.concat_ws(":", F.col("row_id").cast("string"), F.lit("42")))
    return t.withColumn("n", F.row_number().over(W.partitionBy("topic").orderBy(h, "row_id"))).filter("n <= 20").select("topic", "row_id", "n")


def j02_rating_outer_merge(spark, d):
    """Ratings per conversation against turns per conversation, both sides kept, null keys matched."""
    a = table(spark, d, "conv_annotations").groupBy("conv_id").agg(F.count("*").alias("ratings"))
    t = _turns(spark, d).groupBy(F.col("conv_id").alias("c2")).agg(F.count("*").alias("turns"))
    j = a.join(t, F.col("conv_id").eqNullSafe(F.col("c2")), "full")
    return j.select(F.coalesce("conv_id", "c2").alias("conv_id"), F.coalesce("ratings", F.lit(0)).alias("ratings"), F.coalesce("turns", F.lit(0)).alias("turns"))


def t4_bool_words(spark, d):
    a = table(spark, d, "conv_annotations")
    return a.groupBy(coerce.parse_bool(F.col("personal_presence")).alias("personal"), coerce.parse_bool(F.col("special_category_presence")).alias("special")).agg(F.count("*").alias("n"))


def a15_fleiss_kappa(spark, d):
    """Agreement of three raters: the two ratings as words and the turn table's reasoning flag, complete items only."""
    a = table(spark, d, "conv_annotations").filter("conv_id is not null").groupBy("conv_id").agg(F.min(F.lower(F.trim("personal_presence"))).alias("a"), F.min(F.lower(F.trim("special_category_presence"))).alias("b"))
    t = _turns(spark, d).groupBy("conv_id").agg(F.when(F.max("reasoning") == 1, "yes").otherwise("no").alias("c"))
    from loomtrace.operators.stats import fleiss_kappa

    return fleiss_kappa(a.join(t, "conv_id").select("conv_id", F.array("a", "b", "c").alias("labels")), "labels")


def a16_majority(spark, d):
    from loomtrace.operators.stats import majority

    a = table(spark, d, "conv_annotations").withColumn("id", F.concat_ws("|", F.coalesce("conv_id", F.lit("")), F.coalesce("personal_presence", F.lit("")), F.coalesce("special_category_presence", F.lit("")))).groupBy("id").agg(F.first("personal_presence").alias("p"), F.first("special_category_presence").alias("s"))
    labels = F.array(F.lower(F.trim("p")), F.lower(F.trim("s")), F.lit("no"))
    return majority(a.select("id", labels.alias("labels")), "id", "labels")


_NOT = "lower(topic) NOT IN ('other', 'nan', 'unknown', 'misc')"
ORACLES = {
    "q01_tool_rate_by_month": with_(TURNS) + "SELECT strftime(month, '%Y-%m') AS month, count(*) AS n, round(avg(web::INT), 6) AS web_rate, round(avg(coalesce(len(tools) > 0, false)::INT), 6) AS tool_rate, round(avg(coalesce(len(list_filter(tools, lambda t: NOT contains(lower(coalesce(t, 'web')), 'web'))) > 0, false)::INT), 6) AS other_rate FROM turns WHERE month IS NOT NULL GROUP BY 1",
    "q02_web_rate_by_platform": with_(TURNS) + "SELECT platform, strftime(month, '%Y-%m') AS month, count(*) AS n, round(avg(web::INT), 6) AS web_rate FROM turns WHERE month >= DATE '2023-01-01' GROUP BY 1, 2",
    "q03_web_rate_by_model": with_(TURNS) + "SELECT primary_model, strftime(month, '%Y-%m') AS month, count(*) AS n, round(avg(web::INT), 6) AS web_rate FROM turns WHERE month >= DATE '2024-01-01' AND primary_model <> 'Unknown' GROUP BY 1, 2",
    "q04_models": with_(TURNS) + "SELECT DISTINCT model FROM (SELECT unnest(models) AS model FROM turns) WHERE model IS NOT NULL AND trim(model) <> ''",
    "q05_topic_share": with_(TURNS) + f"SELECT topic, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM turns WHERE {_NOT} GROUP BY topic",
    "q06_web_rate_by_topic": with_(TURNS) + "SELECT topic, count(*) AS n, round(avg(web::INT), 6) AS web_rate FROM turns GROUP BY topic",
    "q07_first_sample_per_topic": with_(TURNS) + "SELECT topic, row_id, last_user AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY row_id) AS n FROM turns WHERE language = 'en' AND platform IS NOT NULL) WHERE n = 1",
    "q08_topic_share_within_platform": with_(TURNS) + "SELECT platform, topic, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY platform), 6) AS share FROM turns GROUP BY 1, 2",
    "q14_model_counts": with_(TURNS) + "SELECT coalesce(a.model, b.model) AS model, coalesce(mentions, 0) AS mentions, coalesce(turns, 0) AS turns FROM (SELECT model, count(*) AS mentions FROM (SELECT unnest(models) AS model FROM turns) WHERE model IS NOT NULL AND trim(model) <> '' GROUP BY 1) a FULL JOIN (SELECT primary_model AS model, count(*) AS turns FROM turns GROUP BY 1) b ON a.model = b.model",
    "q25_model_coverage": with_(TURNS, QUERY_TABLES) + "SELECT primary_model, count(*) AS n, count(l.row_id) AS with_queries, round(count(l.row_id) / count(*), 6) AS coverage FROM turns LEFT JOIN (SELECT DISTINCT row_id FROM loops) l USING (row_id) GROUP BY 1",
    "c18_thoughts_before_web": with_(MESSAGES, "parts AS (SELECT row_id, pos, coalesce(contains(lower(m ->> '$.recipient'), 'web'), false) AS calls, array_to_string(list_filter(list_transform(" + as_list("(m -> '$.content.thoughts')") + ", lambda t: t ->> '$.content'), lambda t: t IS NOT NULL), chr(10)) AS thought FROM msgs)") + "SELECT row_id, count(*) FILTER (WHERE thought <> '') AS n_thoughts, sum(length(coalesce(thought, '')))::BIGINT AS chars FROM (SELECT *, min(pos) FILTER (WHERE calls) OVER (PARTITION BY row_id) AS first FROM parts) WHERE pos <= first GROUP BY row_id",
    "single_english_starters": with_(TURNS) + "SELECT row_id, conv_id, turn_id, length(last_user) AS chars FROM turns WHERE conv_starter = 1 AND language = 'en' AND len(users) = 1 AND trim(coalesce(last_user, '')) <> ''",
    "c22_history_prompt": with_(TURNS) + "SELECT row_id, md5(concat_ws(chr(10), 'U: ' || coalesce(users[len(users)-2], ''), 'A: ' || coalesce(answers[len(users)-2], ''), 'U: ' || coalesce(users[len(users)-1], ''), 'A: ' || coalesce(answers[len(users)-1], ''), coalesce(users[-1], ''))) AS prompt_md5 FROM turns WHERE len(users) >= 3",
    "a51_length_stats": with_(TURNS) + "SELECT round(avg(u), 4) AS user_mean, round(stddev_pop(u), 4) AS user_std, round(avg(h), 4) AS history_mean, round(stddev_pop(h), 4) AS history_std FROM (SELECT length(users[-1]) AS u, list_sum(list_transform(users, lambda x: length(coalesce(x, ''))))::BIGINT AS h FROM turns)",
    "a50_totals": with_(TURNS) + "SELECT count(*) AS turns, count(DISTINCT conv_id) AS conversations, count(DISTINCT user_id) AS users, sum(coalesce(len(tools), 0))::BIGINT AS tool_calls FROM turns",
    "safe_conversations": with_(TURNS) + "SELECT row_id, conv_id FROM turns WHERE conv_id IN (SELECT conv_id FROM conv_annotations WHERE conv_id IS NOT NULL GROUP BY conv_id HAVING bool_and(lower(trim(coalesce(personal_presence, ''))) = 'no' AND lower(trim(coalesce(special_category_presence, ''))) = 'no'))",
    "r05_balanced_sample": with_(TURNS) + "SELECT row_id, web, n FROM (SELECT *, row_number() OVER (PARTITION BY web ORDER BY md5(row_id || ':42'), row_id) AS n FROM turns WHERE conv_id IS NULL OR conv_id NOT IN (SELECT conv_id FROM conv_annotations WHERE conv_id IS NOT NULL)) WHERE n <= 50",
    "r02_stratified_sample": with_(TURNS) + "SELECT topic, row_id, n FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY md5(row_id || ':42'), row_id) AS n FROM turns WHERE topic IN ('Finance', 'Travel', 'Law') AND language = 'en') WHERE n <= 20",
    "j02_rating_outer_merge": with_(TURNS) + "SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(ratings, 0) AS ratings, coalesce(turns, 0) AS turns FROM (SELECT conv_id, count(*) AS ratings FROM conv_annotations GROUP BY 1) a FULL JOIN (SELECT conv_id, count(*) AS turns FROM turns GROUP BY 1) b ON a.conv_id IS NOT DISTINCT FROM b.conv_id",
    "t4_bool_words": "SELECT coalesce(lower(trim(personal_presence)) IN ('true','1','yes','y','t'), false) AS personal, coalesce(lower(trim(special_category_presence)) IN ('true','1','yes','y','t'), false) AS special, count(*) AS n FROM conv_annotations GROUP BY 1, 2",
    "a15_fleiss_kappa": with_(
        TURNS,
        "a AS (SELECT conv_id, min(lower(trim(personal_presence))) AS a, min(lower(trim(special_category_presence))) AS b FROM conv_annotations WHERE conv_id IS NOT NULL GROUP BY 1)",
        "i AS (SELECT conv_id, a, b, c FROM a JOIN (SELECT conv_id, CASE WHEN max(reasoning) = 1 THEN 'yes' ELSE 'no' END AS c FROM turns GROUP BY 1) USING (conv_id) WHERE coalesce(a, '') <> '' AND coalesce(b, '') <> '')",
        "l AS (SELECT conv_id, unnest([a, b, c]) AS label FROM i)",
        "c AS (SELECT conv_id, label, count(*) AS n FROM l GROUP BY 1, 2)",
        "p AS (SELECT avg(x) AS pbar FROM (SELECT (sum(n * n) - 3) / 6.0 AS x FROM c GROUP BY conv_id))",
        "e AS (SELECT sum(x * x) AS pe FROM (SELECT sum(n) / (SELECT count(*) FROM l)::DOUBLE AS x FROM c GROUP BY label))",
    )
    + "SELECT (SELECT count(*) FROM i) AS items, round(pbar, 6) AS agreement, round(pe, 6) AS chance, round((pbar - pe) / (1 - pe), 6) AS kappa FROM p, e",
    "a16_majority": "WITH a AS (SELECT concat_ws('|', coalesce(conv_id, ''), coalesce(personal_presence, ''), coalesce(special_category_presence, '')) AS id, lower(trim(any_value(personal_presence))) AS p, lower(trim(any_value(special_category_presence))) AS s FROM conv_annotations GROUP BY 1), l AS (SELECT id, unnest([p, s, 'no']) AS label FROM a), c AS (SELECT id, label, count(*) AS n FROM l WHERE coalesce(label, '') <> '' GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY n DESC) AS k, count(*) OVER (PARTITION BY id) AS kinds FROM c) SELECT id, CASE WHEN count(*) = 1 THEN max(label) ELSE 'tie: ' || string_agg(label, '|' ORDER BY label) END AS vote, max(kinds) AS n_labels FROM r WHERE k = 1 GROUP BY id",
}
QUERIES = {
    f.__name__: f
    for f in (
        q01_tool_rate_by_month, q02_web_rate_by_platform, q03_web_rate_by_model, q04_models, q05_topic_share, q06_web_rate_by_topic, q07_first_sample_per_topic, q08_topic_share_within_platform,
        q14_model_counts, q25_model_coverage, c18_thoughts_before_web, single_english_starters, c22_history_prompt, a51_length_stats, a50_totals, safe_conversations, r05_balanced_sample, r02_stratified_sample,
        j02_rating_outer_merge, t4_bool_words, a15_fleiss_kappa, a16_majority,
    )
}
