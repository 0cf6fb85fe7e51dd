"""Reports on replayed conversation starters, judged by the stand-in of ``loomtrace.operators.replays``."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import messages as M
from loomtrace.operators import replays as R
from loomtrace.operators import stats
from loomtrace.plans.sql import TURNS, with_
from loomtrace.session import table

TOOLS = ("alder", "birch", "cedar")
OUTCOMES = ("Right", "Over", "Under")


def _starters(spark, d):
    return R.starters(table(spark, d, "web_data_summary"))


def _evaluated(spark, d, tool=TOOLS[0]):
    return R.first_of_turn(R.stand_in_scores(_starters(spark, d), tool))


def _merged(spark, d):
    return R.merged({t: _evaluated(spark, d, t).drop("row_id") for t in TOOLS}, ["conv_id", "turn_id"])


def q09_score_matrix(spark, d):
    """Mean score of each mode and metric, and the mean of a mode's means; missing scores do not count."""
    e = _evaluated(spark, d)
    long = e.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), *[F.col(f"{m}_{x}").alias(x) for x in R.METRICS]) for m in R.MODES])).alias("x")).select("x.*")
    g = long.groupBy("mode").agg(*[F.avg(x).alias(x) for x in R.METRICS])
    return g.select("mode", *[F.round(x, 6).alias(x) for x in R.METRICS], F.round(sum((F.col(x) for x in R.METRICS), F.lit(0.0)) / len(R.METRICS), 6).alias("average"))


def _outcomes(spark, d, outcome, domain):
    e = _evaluated(spark, d).join(_starters(spark, d).select("row_id", "web"), "row_id")
    g = e.groupBy(outcome(F.col("web")).alias("outcome")).agg(F.count_if("web").alias("web"), F.count_if(~F.col("web")).alias("no_web"))
    spine = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in domain])).alias("outcome"))
    return spine.join(g, "outcome", "left").na.fill(0, ["web", "no_web"])


def q10_call_outcomes(spark, d):
    """Strict outcome of turns with and without a call, all outcomes listed."""
    better, worse = R.preferences()
    return _outcomes(spark, d, lambda web: stats.strict_outcome(web, better, worse, len(R.METRICS)), OUTCOMES)


def a09_mean_outcomes(spark, d):
    """Outcome by mean scores."""
    return _outcomes(spark, d, R.mean_outcome, [f"{x} Call" for x in OUTCOMES])


def q11_tool_sets(spark, d):
    """Starters that all tools have judged, by the exact set of tools that called the web."""
    return R.combinations(_merged(spark, d), {t: f"{t}_called" for t in TOOLS})


def q11_anchor_agreement(spark, d):
    """How many of the other tools do what the first one does."""
    return R.agreement(_merged(spark, d), f"{TOOLS[0]}_called", [f"{t}_called" for t in TOOLS[1:]])


def q12_all_tools_means(spark, d):
    """Mean scores of each tool's automatic mode over starters where every tool called the web."""
    m = _merged(spark, d).filter(" AND ".join(f"{t}_called" for t in TOOLS))
    long = m.select(F.explode(F.array(*[F.struct(F.lit(t).alias("tool"), *[F.col(f"{t}_auto_{x}").alias(x) for x in R.METRICS]) for t in TOOLS])).alias("x")).select("x.*")
    g = long.groupBy("tool").agg(F.count("*").alias("n"), *[F.avg(x).alias(x) for x in R.METRICS])
    return g.select("tool", "n", *[F.round(x, 6).alias(x) for x in R.METRICS], F.round(sum((F.col(x) for x in R.METRICS), F.lit(0.0)) / len(R.METRICS), 6).alias("average"))


def q16_oracle_against_auto(spark, d):
    """The better of the two fixed modes as truth against the automatic call: confusion, precision and recall."""
    better, worse = R.preferences()
    e = _evaluated(spark, d).select((better > worse).alias("truth"), F.col("called").alias("said"))
    c = e.agg(F.count_if(F.col("truth") & F.col("said")).alias("tp"), F.count_if(~F.col("truth") & F.col("said")).alias("fp"), F.count_if(F.col("truth") & ~F.col("said")).alias("fn"), F.count_if(~F.col("truth") & ~F.col("said")).alias("tn"))
    div = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return c.select("tp", "fp", "fn", "tn", div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def c20_platform_calls(spark, d):
    """Web calls by the rule of each platform and by the common rule."""
    t = M.turns(table(spark, d, "web_data_summary"))
    own = R.platform_web_call(F.col("platform"), F.col("tools"), F.col("interactions"))
    common = M.used_web(F.col("tools"), F.col("interactions"))
    return t.groupBy("platform", "topic").agg(F.count("*").alias("n"), F.count_if(own).alias("own_rule"), F.count_if(common).alias("common_rule"))


_H = "(strpos('0123456789abcdef', substr(md5({0}), 1, 1)) - 1)"


def _evaluated_sql(tool: str) -> str:
    """Evaluation table of one tool, first row of each turn."""
    scores = ", ".join(f"CASE WHEN {h} < 15 THEN ({h} % 5 + 1)::DOUBLE END AS {m}_{x}" for m in R.MODES for x in R.METRICS for h in (_H.format(f"row_id || ':{tool}:{m}:{x}'"),))
    own = f"row_id || ':{tool}'"
    called = f"row_id || ':{tool}:called'"
    return f"{tool} AS (SELECT * EXCLUDE (k) FROM (SELECT row_id, conv_id, turn_id, web, {_H.format(called)} < 8 AS called, {scores}, row_number() OVER (PARTITION BY conv_id, turn_id ORDER BY row_id) AS k FROM turns WHERE conv_starter = 1 AND trim(conv_id) <> '' AND trim(turn_id) <> '' AND {_H.format(own)} > 0) WHERE k = 1)"


def _count(a: str, b: str) -> str:
    return " + ".join(f"coalesce(({a}_{x} > {b}_{x})::INT, 0)" for x in R.METRICS)


_ONE = with_(TURNS, _evaluated_sql("alder"))
_ALL = with_(TURNS, *[_evaluated_sql(t) for t in TOOLS], "m AS (SELECT alder.called AS a, birch.called AS b, cedar.called AS c, " + ", ".join(f"{t}.auto_{x} AS {t}_{x}" for t in TOOLS for x in R.METRICS) + " FROM alder JOIN birch USING (conv_id, turn_id) JOIN cedar USING (conv_id, turn_id))")
_MEAN = "list_avg(list_filter([{0}], lambda x: x IS NOT NULL))"
ORACLES = {
    "q09_score_matrix": _ONE + " UNION ALL ".join(f"SELECT '{m}' AS mode, " + ", ".join(f"round(avg({m}_{x}), 6) AS {x}" for x in R.METRICS) + ", round((" + " + ".join(f"avg({m}_{x})" for x in R.METRICS) + ") / 3, 6) AS average FROM alder" for m in R.MODES),
    "q10_call_outcomes": _ONE + f"SELECT o.outcome, count(*) FILTER (WHERE web) AS web, count(*) FILTER (WHERE NOT web) AS no_web FROM (SELECT unnest(['Right', 'Over', 'Under']) AS outcome) o LEFT JOIN (SELECT web, CASE WHEN web AND r >= 1 THEN 'Right' WHEN web AND n >= 1 THEN 'Over' WHEN web THEN 'Right' WHEN n >= 1 THEN 'Right' WHEN r = 3 THEN 'Under' ELSE 'Right' END AS outcome FROM (SELECT web, {_count('required', 'none')} AS r, {_count('none', 'required')} AS n FROM alder)) x USING (outcome) GROUP BY 1",
    "a09_mean_outcomes": _ONE + "SELECT o.outcome, count(*) FILTER (WHERE web) AS web, count(*) FILTER (WHERE NOT web) AS no_web FROM (SELECT unnest(['Right Call', 'Over Call', 'Under Call']) AS outcome) o LEFT JOIN (SELECT web, CASE WHEN web AND r < n THEN 'Over Call' WHEN NOT web AND r > n THEN 'Under Call' ELSE 'Right Call' END AS outcome FROM (SELECT web, " + _MEAN.format(", ".join(f"required_{x}" for x in R.METRICS)) + " AS r, " + _MEAN.format(", ".join(f"none_{x}" for x in R.METRICS)) + " AS n FROM alder)) x USING (outcome) GROUP BY 1",
    "q11_tool_sets": _ALL + "SELECT CASE WHEN size = 0 THEN 'No Tool' ELSE array_to_string(t, '+') END AS tools, size::INT AS size, count(*) AS n FROM (SELECT t, len(t) AS size FROM (SELECT list_filter([CASE WHEN a THEN 'alder' END, CASE WHEN b THEN 'birch' END, CASE WHEN c THEN 'cedar' END], lambda x: x IS NOT NULL) AS t FROM m)) GROUP BY 1, 2",
    "q11_anchor_agreement": _ALL + "SELECT s.anchor, s.agreeing, count(m.a) AS n FROM (SELECT unnest([true, true, true, false, false, false]) AS anchor, unnest([0, 1, 2, 0, 1, 2]) AS agreeing) s LEFT JOIN m ON m.a = s.anchor AND (m.b = m.a)::INT + (m.c = m.a)::INT = s.agreeing GROUP BY 1, 2",
    "q12_all_tools_means": _ALL + " UNION ALL ".join(f"SELECT '{t}' AS tool, count(*) AS n, " + ", ".join(f"round(avg({t}_{x}), 6) AS {x}" for x in R.METRICS) + ", round((" + " + ".join(f"avg({t}_{x})" for x in R.METRICS) + ") / 3, 6) AS average FROM m WHERE a AND b AND c HAVING count(*) > 0" for t in TOOLS),
    "q16_oracle_against_auto": _ONE + f"SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM (SELECT count(*) FILTER (WHERE t AND called) AS tp, count(*) FILTER (WHERE NOT t AND called) AS fp, count(*) FILTER (WHERE t AND NOT called) AS fn, count(*) FILTER (WHERE NOT t AND NOT called) AS tn FROM (SELECT called, ({_count('required', 'none')}) > ({_count('none', 'required')}) AS t FROM alder))",
    "c20_platform_calls": with_(TURNS) + f"SELECT platform, topic, count(*) AS n, count(*) FILTER (WHERE CASE platform WHEN 'chatgpt' THEN len(list_filter(interactions, lambda x: contains(x, 'web'))) > 0 WHEN 'claude' THEN len(list_filter(tools, lambda x: contains(lower(x), 'web'))) > 0 WHEN 'grok' THEN list_has_any(tools, {list(R.GROK_TOOLS)}) WHEN 'deepseek' THEN list_has_any(tools, {list(R.DEEPSEEK_TOOLS)}) END) AS own_rule, count(*) FILTER (WHERE web) AS common_rule FROM turns GROUP BY 1, 2",
}
QUERIES = {f.__name__: f for f in (q09_score_matrix, q10_call_outcomes, a09_mean_outcomes, q11_tool_sets, q11_anchor_agreement, q12_all_tools_means, q16_oracle_against_auto, c20_platform_calls)}
