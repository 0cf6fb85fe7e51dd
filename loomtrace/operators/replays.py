"""Replayed prompts under several modes and their judgements: call outcomes, tool sets and merges of evaluation tables.

An evaluation table has one row per result key with ``called`` (whether the automatic mode called the web) and one
column ``<mode>_<metric>`` per score. Without a live judge, ``stand_in_scores`` gives scores from a hash of the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.operators import messages as M

MODES = ("auto", "none", "required")
METRICS = ("factuality", "completeness", "relevance")
# Tools of two platforms that reach the web.
GROK_TOOLS = ("WebSearch", "BrowsePage", "XThreadFetch", "XSearch", "XUserSearch", "ViewXVideo", "ImageSearch", "PdfSearch", "PdfBrowse")
DEEPSEEK_TOOLS = ("SEARCH", "READ_LINK", "TOOL_SEARCH", "TOOL_OPEN", "TOOL_FIND")


def platform_web_call(platform: Column, tools: Column, interactions: Column) -> Column:
    """Whether a turn called the web, by the rule of its platform; unknown platforms never do."""
    named = F.lower(F.trim(platform))
    none = F.lit(False)
    listed = lambda names: F.coalesce(F.exists(tools, lambda t: F.coalesce(t.isin(*names), none)), none)
    return (
        F.when(named == "chatgpt", F.coalesce(F.exists(interactions, lambda x: F.coalesce(x, F.lit("")).contains("web")), none))
        .when(named == "claude", F.coalesce(F.exists(tools, lambda t: F.lower(F.coalesce(t, F.lit(""))).contains("web")), none))
        .when(named == "grok", listed(GROK_TOOLS))
        .when(named == "deepseek", listed(DEEPSEEK_TOOLS))
        .otherwise(none)
    )


def _digit(text: Column) -> Column:
    """First hexadecimal digit of a hash, 0 to 15."""
    return F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(text), 1, 1)) - 1


def stand_in_scores(prompts: DataFrame, tool: str) -> DataFrame:
    """An evaluation table of ``prompts`` (row_id, conv_id, turn_id): scores 1 to 5, some missing; a tool leaves some prompts out."""

    def score(mode: str, metric: str) -> Column:
        h = _digit(F.concat_ws(":", F.col("row_id").cast("string"), F.lit(tool), F.lit(mode), F.lit(metric)))
        return F.when(h < 15, (h % 5 + 1).cast("double"))

    own = F.concat_ws(":", F.col("row_id").cast("string"), F.lit(tool))
    scores = [score(m, x).alias(f"{m}_{x}") for m in MODES for x in METRICS]
    return prompts.filter(_digit(own) > 0).select("row_id", "conv_id", "turn_id", (_digit(F.concat(own, F.lit(":called"))) < 8).alias("called"), *scores)


def first_of_turn(table: DataFrame) -> DataFrame:
    """Rows with both keys, the lowest row_id of each (conv_id, turn_id)."""
    kept = table.filter("trim(conv_id) <> '' and trim(turn_id) <> ''")
    others = [c for c in table.columns if c not in ("conv_id", "turn_id", "row_id")]
    g = kept.groupBy("conv_id", "turn_id").agg(F.min(F.struct("row_id", *others)).alias("x"))
    return g.select("conv_id", "turn_id", "x.*")


def merged(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Inner merge of evaluation tables on the keys; every other column gets the name of its table in front."""
    named = [t.select(*keys, *[F.col(c).alias(f"{n}_{c}") for c in t.columns if c not in keys]) for n, t in tables.items()]
    return reduce(lambda a, b: a.join(b, keys), named)


def preferences(better: str = "required", worse: str = "none", metrics: tuple[str, ...] = METRICS) -> tuple[Column, Column]:
    """Number of metrics on which each of two modes is better; missing scores count for neither."""
    one = lambda a, b: sum((F.coalesce((F.col(f"{a}_{m}") > F.col(f"{b}_{m}")).cast("int"), F.lit(0)) for m in metrics), F.lit(0))
    return one(better, worse), one(worse, better)


def mean_outcome(web: Column, metrics: tuple[str, ...] = METRICS) -> Column:
    """Right, Over or Under by the mean scores with and without calls; ties and missing means are right."""

    def mean(mode: str) -> Column:
        x = F.array_compact(F.array(*[F.col(f"{mode}_{m}") for m in metrics]))
        return F.try_divide(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), F.size(x))

    with_, without = mean("required"), mean("none")
    return F.when(web & (with_ < without), "Over Call").when(~web & (with_ > without), "Under Call").otherwise("Right Call")


def combinations(table: DataFrame, flags: dict[str, str], none: str = "No Tool") -> DataFrame:
    """(tools, size, n): rows by the exact set of flags, larger sets first."""
    names = F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for n, c in flags.items()]))
    g = table.select(names.alias("t")).groupBy(F.when(F.size("t") == 0, none).otherwise(F.array_join("t", "+")).alias("tools"), F.size("t").alias("size")).agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("size"), F.desc("n"), "tools")


def agreement(table: DataFrame, anchor: str, others: list[str]) -> DataFrame:
    """(anchor, agreeing, n): how many of the others do what the anchor does; absent counts are 0."""
    called = sum((F.col(c).cast("int") for c in others), F.lit(0))
    a = F.col(anchor)
    g = table.groupBy(a.alias("anchor"), F.when(a, called).otherwise(len(others) - called).alias("agreeing")).agg(F.count("*").alias("n"))
    spine = table.sparkSession.range(2).select((F.col("id") == 1).alias("anchor")).select("anchor", F.explode(F.sequence(F.lit(0), F.lit(len(others)))).alias("agreeing"))
    return spine.join(g, ["anchor", "agreeing"], "left").na.fill(0, ["n"])


def query_groups(response: Column) -> Column:
    """Search loops of a replayed response (JSON): the distinct queries of each web search call that has any."""
    calls = F.filter(F.try_variant_get(F.try_parse_json(response), "$.output", "array<variant>"), lambda x: F.try_variant_get(x, "$.type", "string") == "web_search_call")
    asked = F.transform(calls, lambda x: F.array_distinct(F.filter(F.transform(F.coalesce(F.try_variant_get(x, "$.action.queries", "array<string>"), F.array().cast("array<string>")), lambda q: F.trim(q)), lambda q: q != "")))
    return F.coalesce(F.filter(asked, lambda q: F.size(q) > 0), F.array().cast("array<array<string>>"))


def replay_loops(replays: DataFrame, mode: str) -> DataFrame:
    """Loop table (result_key, loop_idx, queries, thoughts, sources, memories) of replays (result_key, mode, response); a replay tells no context."""
    none = F.array().cast("array<string>")
    loops = replays.filter(F.col("mode") == mode).select("result_key", F.posexplode(query_groups(F.col("response"))).alias("i", "queries"))
    return loops.select("result_key", (F.col("i") + 1).alias("loop_idx"), "queries", *[none.alias(c) for c in ("thoughts", "sources", "memories")])


def starters(turns: DataFrame) -> DataFrame:
    """Turns that open a conversation, with whether they called the web."""
    t = M.turns(turns).filter("conv_starter = 1")
    return t.select("row_id", "conv_id", "turn_id", "platform", M.used_web(F.col("tools"), F.col("interactions")).alias("web"))
