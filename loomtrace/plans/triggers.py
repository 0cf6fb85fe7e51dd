"""Reports on what triggers a web call and why queries change, with judgements of an offline stand-in.

The stand-in answers from a hash of the turn, as JSON inside other text, so that the reports read it as they would read
a live judge.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions import coerce
from loomtrace.functions import text as X
from loomtrace.operators import messages as M
from loomtrace.operators import transitions as T
from loomtrace.plans.sql import QUERIES as QUERY_TABLES
from loomtrace.plans.sql import TURNS, with_
from loomtrace.session import table

# Triggers of a web call, those no report counts, short names, topics of the report by topic.
TRIGGERS = (
    "High-Investment Recommendation", "Volatile/Temporal Information", "Low Confidence/Niche Fact", "Unfamiliar Term/Typo", "High-Stakes Accuracy", "External Reference",
    "User Verification", "Attribution/Sourcing Needed", "Explicit Command", "OpenAI Product Info", "None of the Above",
)
NO_TRIGGER = ("None of the Above", "OpenAI Product Info")
SHOWN = {
    "High-Investment Recommendation": "High-Investment", "Volatile/Temporal Information": "Temporal Information", "Low Confidence/Niche Fact": "Low Confidence Fact",
    "Unfamiliar Term/Typo": "Unfamiliar Term", "Attribution/Sourcing Needed": "Attribution Needed",
}
TOPICS = ("Travel", "Cars", "Mobile phones", "Finance", "Games", "Health")


def _number(c):
    return F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("int")


def _policies(spark, d):
    """Turns that called the web with the judge's reply on their triggers."""
    t = M.turns(table(spark, d, "web_data_summary"))
    t = t.filter(M.used_web(F.col("tools"), F.col("interactions")))
    names = F.array(*[F.lit(x) for x in TRIGGERS])
    of = lambda part: F.get(names, _number(F.concat_ws(":", F.col("row_id").cast("string"), F.lit(part))) % len(TRIGGERS))
    reply = F.concat(F.lit("Here it is:\n"), F.to_json(F.struct(of("first").alias("primary_trigger"), F.array(of("second"), of("third")).alias("secondary_triggers"))))
    return t.select("row_id", "conv_id", "turn_id", "topic", "language", "users", reply.alias("reply"))


def _triggers(spark, d):
    v = coerce.judged_json(F.col("reply"))
    return _policies(spark, d).withColumn("primary", F.try_variant_get(v, "$.primary_trigger", "string")).withColumn("secondary", F.try_variant_get(v, "$.secondary_triggers", "array<string>"))


def q07_trigger_shares(spark, d):
    """Shares of primary and of secondary triggers, without those that name none."""
    t = _triggers(spark, d)
    long = t.select(F.explode(F.concat(F.array(F.struct(F.lit("primary").alias("rank"), F.col("primary").alias("trigger"))), F.transform("secondary", lambda x: F.struct(F.lit("secondary").alias("rank"), x.alias("trigger"))))).alias("x")).select("x.*")
    g = long.filter(~F.col("trigger").isin(*NO_TRIGGER)).groupBy("rank", "trigger").agg(F.count("*").alias("n"))
    sums = g.groupBy("rank").agg(F.sum("n").alias("total"))
    return g.join(sums, "rank").select("rank", coerce.shown(F.col("trigger"), SHOWN).alias("trigger"), "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def q07_trigger_samples(spark, d):
    """First English turn of each primary trigger with its prompt."""
    t = _triggers(spark, d).filter(~F.col("primary").isin(*NO_TRIGGER) & (F.col("language") == "en"))
    s = t.groupBy("primary").agg(F.min_by(F.struct("row_id", "topic", F.trim(F.coalesce(F.try_element_at("users", F.lit(-1)), F.lit(""))).alias("prompt")), "row_id").alias("s"))
    return s.select(coerce.shown(F.col("primary"), SHOWN).alias("trigger"), "s.row_id", "s.topic", "s.prompt")


def q08_trigger_topic_shares(spark, d):
    """Share of each topic within each primary trigger, triggers with most turns first."""
    t = _triggers(spark, d).filter(F.col("topic").isin(*TOPICS) & ~F.col("primary").isin(*NO_TRIGGER))
    g = t.groupBy("primary", "topic").agg(F.count("*").alias("n"))
    sums = g.groupBy("primary").agg(F.sum("n").alias("total"))
    j = g.join(sums, "primary").select(coerce.shown(F.col("primary"), SHOWN).alias("trigger"), "topic", "n", "total", F.round(F.col("n") / F.col("total"), 6).alias("share"))
    return j.orderBy(F.desc("total"), "trigger", "topic")


def _edges(spark, d):
    raw = table(spark, d, "web_data_summary")
    starts = M.turns(raw).select("row_id", F.element_at("users", -1).alias("q"))
    return T.edges(starts, M.loops(raw).select("row_id", "loop_idx", "queries"))


def q26_reason_rates(spark, d):
    """Share of each label among all edges of an iteration (3 and later together), before and after the validator's pass."""
    e = _edges(spark, d).withColumn("label", T.kind(F.col("from_words"), F.col("to_words")))
    back = T.reversed_edges(e)
    ok = _number(F.concat_ws(":", F.col("row_id").cast("string"), "from_id", "to_id")) % 4 > 0
    e = e.withColumn("before", F.col("label"))
    v = T.validated(e, back.select("row_id", "from_id", "to_id", ok.alias("ok")))
    v = v.withColumn("step", F.least(T.iteration(F.col("from_id"), F.col("to_id")), F.lit(3))).filter("step is not null")
    g = v.groupBy("step", F.col("before").alias("label")).agg(F.count("*").alias("n"), F.count("label").alias("confirmed"))
    sums = g.groupBy("step").agg(F.sum("n").alias("total"))
    return g.join(sums, "step").select("step", "label", "n", "confirmed", F.round(F.col("n") / F.col("total"), 6).alias("rate"), F.round(F.col("confirmed") / F.col("total"), 6).alias("confirmed_rate"))


def f38_transition_text(spark, d):
    """Every edge as the line a judge reads."""
    e = _edges(spark, d)
    return e.select("row_id", F.concat(F.lit("("), "from_id", F.lit(") -> ("), "to_id", F.lit(")")).alias("line"), T.iteration(F.col("from_id"), F.col("to_id")).alias("iteration"), X.percent(F.size(F.array_intersect("from_words", "to_words")), F.size(F.array_distinct("to_words"))).alias("kept"))


_N = "('0x' || substr(md5({0}), 1, 4))::INT"
_NAMES = "[" + ", ".join(f"'{x}'" for x in TRIGGERS) + "]"
_SHOW = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SHOWN.items()) + " ELSE {0} END"
_POLICY = with_(TURNS, "p AS (SELECT *, " + ", ".join(f"{_NAMES}[{_N.format('row_id || ' + chr(39) + ':' + x + chr(39))} % {len(TRIGGERS)} + 1] AS {x}" for x in ("first", "second", "third")) + " FROM turns WHERE web)")
_NONE = "('None of the Above', 'OpenAI Product Info')"
_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '(\\p{{L}}+|\\d+)')"
_EDGES = with_(
    TURNS, QUERY_TABLES,
    "q AS (SELECT row_id, loop_idx::INT AS l, loop_idx || '.' || generate_subscripts(queries, 1) AS id, unnest(queries) AS q FROM loops)",
    "b AS (SELECT row_id, 0 AS l, 'U' AS id, users[-1] AS q FROM turns WHERE users[-1] IS NOT NULL UNION ALL SELECT * FROM q)",
    "e AS (SELECT q.row_id, b.id AS from_id, q.id AS to_id, q.l AS iteration, " + _TOK.format("b.q") + " AS fw, " + _TOK.format("q.q") + " AS tw FROM q JOIN b ON b.row_id = q.row_id AND b.l + 1 = q.l)",
    "k AS (SELECT *, len(list_distinct(list_filter(tw, lambda x: NOT list_contains(fw, x)))) AS new, len(list_distinct(list_filter(fw, lambda x: NOT list_contains(tw, x)))) AS lost FROM e)",
)
ORACLES = {
    "q07_trigger_shares": _POLICY + "SELECT rank, " + _SHOW.format("trigger") + f" AS trigger, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY rank), 6) AS share FROM (SELECT 'primary' AS rank, first AS trigger FROM p UNION ALL SELECT 'secondary', second FROM p UNION ALL SELECT 'secondary', third FROM p) WHERE trigger NOT IN {_NONE} GROUP BY rank, trigger",
    "q07_trigger_samples": _POLICY + "SELECT " + _SHOW.format("first") + f" AS trigger, row_id, topic, trim(coalesce(users[-1], '')) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY first ORDER BY row_id) AS n FROM p WHERE language = 'en' AND first NOT IN {_NONE}) WHERE n = 1",
    "q08_trigger_topic_shares": _POLICY + "SELECT " + _SHOW.format("first") + f" AS trigger, topic, count(*) AS n, sum(count(*)) OVER (PARTITION BY first)::BIGINT AS total, round(count(*) / sum(count(*)) OVER (PARTITION BY first), 6) AS share FROM p WHERE first NOT IN {_NONE} AND topic IN ('Travel', 'Cars', 'Mobile phones', 'Finance', 'Games', 'Health') GROUP BY first, topic",
    "q26_reason_rates": _EDGES + ", l AS (SELECT least(iteration, 3) AS step, CASE WHEN new = 0 AND lost = 0 THEN 'same' WHEN new = 0 THEN 'narrowing' WHEN lost = 0 THEN 'expansion' ELSE 'rewriting' END AS label, " + _N.format("row_id || ':' || to_id || ':' || from_id") + " % 4 > 0 AS ok FROM k) SELECT step, label, count(*) AS n, count(*) FILTER (WHERE ok) AS confirmed, round(count(*) / sum(count(*)) OVER (PARTITION BY step), 6) AS rate, round(count(*) FILTER (WHERE ok) / sum(count(*)) OVER (PARTITION BY step), 6) AS confirmed_rate FROM l GROUP BY step, label",
    "f38_transition_text": _EDGES + "SELECT row_id, '(' || from_id || ') -> (' || to_id || ')' AS line, iteration, CASE WHEN len(tw) = 0 THEN 'NA' ELSE printf('%.1f%%', len(list_filter(list_distinct(tw), lambda x: list_contains(fw, x))) * 100.0 / len(list_distinct(tw))) END AS kept FROM e",
}
QUERIES = {f.__name__: f for f in (q07_trigger_shares, q07_trigger_samples, q08_trigger_topic_shares, q26_reason_rates, f38_transition_text)}
