"""Reports on judged queries, source ranks, attribution buckets and the turn export.

Judgements come from the deterministic stand-ins here, so that results can be compared; a live judge takes the
same place through ``loomtrace.sources.adapters``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.functions import text as X
from loomtrace.functions import urls
from loomtrace.operators import attribution, blocks, threads
from loomtrace.operators import messages as M
from loomtrace.operators.stats import share_of_all
from loomtrace.plans import formulation
from loomtrace.plans.sql import CONTEXT, KEY, OUTER_MARK, PROVENANCE, REFS, SOURCES, TURNS, with_
from loomtrace.plans.sql import QUERIES as QUERY_TABLES
from loomtrace.session import table

KINDS = ("fact", "guide", "news", "other")


def _raw(spark, d):
    return table(spark, d, "web_data_summary")


def _turns(spark, d):
    return M.turns(_raw(spark, d)).select("row_id", "platform", "month", "topic", "users", "answers", "thoughts", "conv_id", "turn_id")


def query_kind(q: Column) -> Column:
    """Kind of a query by its words, in order of precedence."""
    x = F.lower(q)
    return F.when(x.rlike("statistics|numbers|how (much|many)"), "fact").when(x.rlike("guide|how |explain"), "guide").when(x.rlike("latest|news|recent|updates"), "news").otherwise("other")


def q27_kind_by_stage(spark, d):
    """Share of each kind at the prompt (stage 0) and at loops 1, 2 and 3 or later, absent kinds as 0."""
    u = _turns(spark, d).select(F.lit(0).alias("stage"), F.element_at("users", -1).alias("q")).filter("q is not null")
    q = M.loops(_raw(spark, d)).select(F.least("loop_idx", F.lit(3)).alias("stage"), F.explode("queries").alias("q"))
    g = u.unionByName(q).groupBy("stage", query_kind(F.col("q")).alias("kind")).agg(F.count("*").alias("n"))
    spine = g.select("stage").distinct().withColumn("kind", F.explode(F.array(*[F.lit(k) for k in KINDS])))
    j = spine.join(g, ["stage", "kind"], "left").na.fill(0, ["n"])
    return j.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("stage")), 6))


def q28_relation_sets(spark, d):
    """Turns by the exact set of kinds of their queries, largest sets first."""
    q = M.queries(_raw(spark, d)).select("row_id", query_kind(F.col("q")).alias("k")).distinct()
    g = q.groupBy("row_id").agg(F.array_sort(F.collect_list("k")).alias("k")).groupBy(F.array_join("k", "+").alias("kinds"), F.size("k").alias("size")).agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("size"), F.desc("n"), "kinds")


def q13_intent_share(spark, d):
    """Share of intents found in the thoughts, in a fixed order with absent ones as 0."""
    t = F.lower(F.coalesce("thoughts", F.lit("")))
    intent = F.when(t == "", "none").when(t.contains("compare"), "compare").when(t.contains("recent"), "freshness").when(t.contains("search"), "search").otherwise("other")
    g = _turns(spark, d).groupBy(intent.alias("intent")).agg(F.count("*").alias("n"))
    order = ["none", "compare", "freshness", "search", "other"]
    spine = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in order])).alias("ord", "intent"))
    j = spine.join(g, "intent", "left").na.fill(0, ["n"])
    return j.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6)).orderBy("ord")


def q18_provenance_by_month(spark, d):
    """Mean share of each factor in the words of a turn's queries, per month."""
    r = formulation.n07_factor_rates(spark, d).join(_turns(spark, d).filter("month is not null").select("row_id", "month"), "row_id")
    return r.groupBy(F.date_format("month", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), *[F.round(F.avg(f"{x}_rate"), 5).alias(x) for x in formulation.FACTORS])


def q19_one_loop_check(spark, d):
    """Turns with one loop: how many hold sources before its query ends, and how many draw words of the query from them."""
    o = formulation.word_origins(spark, d).filter("n_loops = 1").select("row_id", F.size("source_words").alias("drawn"))
    c = M.loop_context(_raw(spark, d)).filter("loop_idx = 1").select("row_id", F.size("sources").alias("sources"))
    j = c.join(o, "row_id")
    return j.agg(F.count("*").alias("one_loop"), F.count_if(F.col("sources") > 0).alias("with_sources"), F.count_if(F.col("drawn") > 0).alias("drawing_on_them"), F.sum("drawn").alias("words"))


def q37_safe_against_rest(spark, d):
    """Safe urls against retrieved ones that are not safe, per month: number and share with an alive host."""
    k = M.source_keys(_raw(spark, d)).filter("kind in ('retrieved', 'safe')").groupBy("row_id", "key").agg(F.max((F.col("kind") == "safe").cast("int")).alias("safe"))
    j = k.join(_turns(spark, d).filter("month is not null").select("row_id", "month"), "row_id")
    alive = F.col("key").rlike("^https?://") & ~F.col("key").contains("harbour-desk.")
    return j.groupBy(F.date_format("month", "yyyy-MM").alias("month"), (F.col("safe") == 1).alias("safe")).agg(F.count("*").alias("n"), F.round(F.avg(alive.cast("int")), 6).alias("alive"))


def q43_rank_by_kind(spark, d):
    """Mean rank of a turn's retrieved sources that were cited and that were not; only turns with both."""
    k = M.keyed(M.sources(_raw(spark, d)))
    got = F.collect_list(F.when((F.col("kind") == "retrieved") & (F.col("ref_index") >= 0), F.struct("key", (F.col("ref_index") + 1).alias("rank"))))
    g = k.groupBy("row_id").agg(got.alias("got"), F.collect_set(F.when(F.col("kind") == "cited", F.col("key"))).alias("said"))

    def mean(of):
        ranks = F.transform(F.filter("got", of), lambda x: x["rank"])
        return F.try_divide(F.aggregate(ranks, F.lit(0), lambda s, x: s + x), F.size(ranks))

    g = g.select(mean(lambda x: F.array_contains("said", x["key"])).alias("a"), mean(lambda x: ~F.array_contains("said", x["key"])).alias("b")).filter("a is not null and b is not null")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("cited"), F.round(F.avg("b"), 6).alias("other"), F.count_if(F.col("a") < F.col("b")).alias("cited_better"))


def q47_support_by_kind(spark, d):
    """Words of the last answer found in a turn's snippets: mean share for cited and for other retrieved sources."""
    a = _turns(spark, d).select("row_id", F.array_distinct(X.tokens(F.try_element_at("answers", F.lit(-1)))).alias("a")).filter(F.size("a") > 0)
    k = M.keyed(M.sources(_raw(spark, d)))
    got = F.collect_set(F.when((F.col("kind") == "retrieved") & (F.col("snippet") != ""), F.struct("key", "snippet")))
    g = k.groupBy("row_id").agg(got.alias("got"), F.collect_set(F.when(F.col("kind") == "cited", F.col("key"))).alias("said"))
    r = g.select("row_id", "said", F.explode("got").alias("x")).join(a, "row_id")
    s = F.size(F.array_intersect("a", X.tokens(F.col("x.snippet")))) / F.size("a")
    return r.groupBy(F.array_contains("said", F.col("x.key")).alias("cited")).agg(F.count("*").alias("n"), F.round(F.avg(s), 6).alias("share"))


TURN_BLOCK = 10_000


def q50_turn_export(spark, d):
    """Turn table of the message rows: the newest state of each message, along the first children from the start of its
    conversation, without system messages, cut after each closing message; open tails are left out. One row per turn,
    named by its last message, with its tool calls (assistant messages with a time that go to someone) and its steps."""
    m = threads.newest(table(spark, d, "turn_messages"), "author_role", "recipient", "create_time", "end_turn")
    m = threads.path(m).withColumn("role", threads.role(F.col("author_role"))).filter("role <> 'system'")
    m = m.withColumns({"end": F.coalesce(F.col("end_turn"), F.lit(False)).cast("int"), "block": F.floor(F.col("depth") / TURN_BLOCK)})
    m = blocks.running(m, ["conv_id"], "block", ["depth"], F.col("end"), "turn_no", inclusive=False)
    to = F.coalesce("recipient", F.lit("all"))
    call = F.col("role").isin("assistant", "bot") & (to != "all") & (F.col("create_time") != 0)
    steps = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", F.concat_ws(":", "role", to).alias("x")))), lambda x: x["x"]), ",")
    g = m.groupBy("conv_id", "turn_no").agg(F.count("*").alias("messages"), F.max_by("msg_id", "depth").alias("turn_id"), F.count_if(call).alias("tool_calls"), F.max("end").alias("closed"), steps.alias("interactions"))
    return g.filter("closed = 1").select("conv_id", "turn_no", "turn_id", "messages", "tool_calls", "interactions")


def f33_markup_regex(spark, d):
    """Length of texts without tags and character entities, by pattern."""
    p = table(spark, d, "documents").filter("text is not null")
    plain = F.regexp_replace(F.regexp_replace("text", r"<[^<>]*>", " "), r"&[a-z]+;", " ")
    return p.select("doc_id", F.length(F.regexp_replace(F.regexp_replace(plain, r"[ \t\n]+", " "), "^ +| +$", "")).alias("chars"))


def f25_citation_marks(spark, d):
    """Citation marks of documents: how many, and the refs of the first."""
    p = table(spark, d, "documents").filter(F.col("text").contains(""))
    return p.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(f"({X.MARK_OUTER})"), F.lit(1))).alias("marks"), X.refs_key(X.citation_refs(F.col("text"))).alias("refs")).filter("marks > 0")


def o04_top_users(spark, d):
    """Ten users with most turns and their share of all turns; null users are no user."""
    g = M.turns(_raw(spark, d)).filter("user_id is not null").groupBy("user_id").agg(F.count("*").alias("n"))
    return share_of_all(g, "n").orderBy(F.desc("n"), "user_id").limit(10)


def j11_query_lookup(spark, d):
    """Each (conversation, turn) with several rows: the one with most queries, the first on a tie."""
    t = M.turns(_raw(spark, d)).filter("conv_id is not null and turn_id is not null").select("row_id", "conv_id", "turn_id")
    q = M.queries(_raw(spark, d)).groupBy("row_id").agg(F.count("*").alias("n"))
    j = t.join(q, "row_id", "left").na.fill(0, ["n"])
    g = j.groupBy("conv_id", "turn_id").agg(F.max_by("row_id", F.struct(F.col("n"), -F.col("row_id"))).alias("row_id"), F.count("*").alias("rows"))
    return g.filter("rows > 1")


_KIND = "CASE WHEN regexp_matches(lower(q), 'statistics|numbers|how (much|many)') THEN 'fact' WHEN regexp_matches(lower(q), 'guide|how |explain') THEN 'guide' WHEN regexp_matches(lower(q), 'latest|news|recent|updates') THEN 'news' ELSE 'other' END"
_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '(\\p{{L}}+|\\d+)')"
#: The path of first children of every conversation, written from the definition of the message table.
PATH_SQL = """
WITH RECURSIVE ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, msg_id ORDER BY batch_no DESC, msg_row DESC) AS rn FROM turn_messages WHERE conv_id IS NOT NULL AND msg_id IS NOT NULL),
m AS (SELECT conv_id, msg_id, msg_row, child_no, lower(trim(coalesce(author_role, ''))) AS role, recipient, create_time, end_turn,
  CASE WHEN lower(trim(parent_id)) IN ('', 'root') THEN NULL ELSE parent_id END AS parent FROM ranked WHERE rn = 1),
start AS (SELECT a.conv_id, arg_min(a.msg_id, a.msg_row) AS msg_id FROM m a LEFT JOIN m b ON a.conv_id = b.conv_id AND a.parent = b.msg_id WHERE b.msg_id IS NULL GROUP BY 1),
kid AS (SELECT *, row_number() OVER (PARTITION BY conv_id, parent ORDER BY child_no NULLS LAST, msg_id) AS k FROM m WHERE parent IS NOT NULL),
path AS (SELECT m.*, 0 AS depth FROM m JOIN start USING (conv_id, msg_id)
 UNION ALL SELECT kid.* EXCLUDE (k), path.depth + 1 FROM path JOIN kid ON kid.conv_id = path.conv_id AND kid.parent = path.msg_id AND kid.k = 1)
"""
ORACLES = {
    "q27_kind_by_stage": with_(TURNS, QUERY_TABLES, "a AS (SELECT 0 AS stage, users[-1] AS q FROM turns WHERE users[-1] IS NOT NULL UNION ALL SELECT least(loop_idx, 3), unnest(queries) FROM loops)", f"g AS (SELECT stage, {_KIND} AS kind, count(*) AS n FROM a GROUP BY 1, 2)", "s AS (SELECT stage, unnest(['fact', 'guide', 'news', 'other']) AS kind FROM (SELECT DISTINCT stage FROM g))") + "SELECT stage, kind, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY stage), 6) AS share FROM s LEFT JOIN g USING (stage, kind)",
    "q28_relation_sets": with_(QUERY_TABLES, f"k AS (SELECT DISTINCT row_id, {_KIND} AS k FROM queries)") + "SELECT kinds, size, count(*) AS n FROM (SELECT row_id, string_agg(k, '+' ORDER BY k) AS kinds, count(*) AS size FROM k GROUP BY 1) GROUP BY 1, 2",
    "q13_intent_share": with_(TURNS, "g AS (SELECT CASE WHEN coalesce(thoughts, '') = '' THEN 'none' WHEN contains(lower(thoughts), 'compare') THEN 'compare' WHEN contains(lower(thoughts), 'recent') THEN 'freshness' WHEN contains(lower(thoughts), 'search') THEN 'search' ELSE 'other' END AS intent, count(*) AS n FROM turns GROUP BY 1)", "s AS (SELECT unnest(['none', 'compare', 'freshness', 'search', 'other']) AS intent, unnest([0, 1, 2, 3, 4]) AS ord)") + "SELECT intent, ord, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 6) AS share FROM s LEFT JOIN g USING (intent)",
    "q18_provenance_by_month": with_(TURNS, QUERY_TABLES, CONTEXT, PROVENANCE, formulation._FACTOR_SQL, "k AS (SELECT row_id, " + ", ".join(f"round(len({x}) / words, 6) AS {x}" for x in formulation.FACTORS) + " FROM factor WHERE words > 0)") + "SELECT strftime(month, '%Y-%m') AS month, count(*) AS n, " + ", ".join(f"round(avg(k.{x}), 5) AS {x}" for x in formulation.FACTORS) + " FROM k JOIN turns USING (row_id) WHERE month IS NOT NULL GROUP BY 1",
    "q19_one_loop_check": with_(TURNS, QUERY_TABLES, CONTEXT, PROVENANCE) + "SELECT count(*) AS one_loop, count(*) FILTER (WHERE len(sources) > 0) AS with_sources, count(*) FILTER (WHERE len(source_words) > 0) AS drawing_on_them, sum(len(source_words))::BIGINT AS words FROM context JOIN origin USING (row_id) WHERE n_loops = 1",
    "q37_safe_against_rest": with_(TURNS, SOURCES, "k AS (SELECT row_id, key, bool_or(kind = 'safe') AS safe FROM source_keys WHERE kind IN ('retrieved', 'safe') GROUP BY 1, 2)") + "SELECT strftime(month, '%Y-%m') AS month, safe, count(*) AS n, round(avg((regexp_matches(key, '^https?://') AND NOT contains(key, 'harbour-desk.'))::INT), 6) AS alive FROM k JOIN turns USING (row_id) WHERE month IS NOT NULL GROUP BY 1, 2",
    "q43_rank_by_kind": with_(SOURCES, "c AS (SELECT DISTINCT row_id, " + KEY.format("url") + " AS key FROM cited)", "r AS (SELECT r.row_id, ref_index + 1 AS rank, c.key IS NOT NULL AS c FROM retrieved r LEFT JOIN c ON c.row_id = r.row_id AND c.key = " + KEY.format("r.url") + " WHERE ref_index >= 0)", "g AS (SELECT row_id, avg(rank) FILTER (WHERE c) AS a, avg(rank) FILTER (WHERE NOT c) AS b FROM r GROUP BY 1)") + "SELECT count(*) AS n, round(avg(a), 6) AS cited, round(avg(b), 6) AS other, count(*) FILTER (WHERE a < b) AS cited_better FROM g WHERE a IS NOT NULL AND b IS NOT NULL",
    "q47_support_by_kind": with_(TURNS, SOURCES, "c AS (SELECT DISTINCT row_id, " + KEY.format("url") + " AS key FROM cited)", "r AS (SELECT DISTINCT row_id, " + KEY.format("url") + " AS key, snippet FROM retrieved WHERE snippet <> '')", f"a AS (SELECT row_id, list_distinct({_TOK.format('answers[-1]')}) AS a FROM turns)") + f"SELECT c.key IS NOT NULL AS cited, count(*) AS n, round(avg(len(list_filter(a, lambda x: list_contains({_TOK.format('snippet')}, x))) / len(a)), 6) AS share FROM r JOIN a USING (row_id) LEFT JOIN c ON c.row_id = r.row_id AND c.key = r.key WHERE len(a) > 0 GROUP BY 1",
    "q50_turn_export": PATH_SQL + "SELECT conv_id, turn_no, arg_max(msg_id, depth) AS turn_id, count(*) AS messages, count(*) FILTER (WHERE role IN ('assistant', 'bot') AND coalesce(recipient, 'all') <> 'all' AND create_time <> 0) AS tool_calls, string_agg(role || ':' || coalesce(recipient, 'all'), ',' ORDER BY depth) AS interactions FROM (SELECT *, coalesce(sum(coalesce(end_turn, false)::INT) OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS turn_no FROM path WHERE role <> 'system') GROUP BY 1, 2 HAVING bool_or(coalesce(end_turn, false))",
    "f25_citation_marks": "SELECT doc_id, len(marks)::INT AS marks, array_to_string(" + REFS.format("marks[1]") + ", ';') AS refs FROM (SELECT doc_id, regexp_extract_all(text, '" + OUTER_MARK + "') AS marks FROM documents) WHERE len(marks) > 0",
    "f33_markup_regex": "SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^<>]*>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '[ \\t\\n]+', ' ', 'g'), '^ +| +$', '', 'g')) AS chars FROM documents WHERE text IS NOT NULL",
    "o04_top_users": with_(TURNS) + "SELECT user_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM turns WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
    "j11_query_lookup": with_(TURNS, QUERY_TABLES, "t AS (SELECT conv_id, turn_id, row_id, (SELECT count(*) FROM queries q WHERE q.row_id = turns.row_id) AS n FROM turns WHERE conv_id IS NOT NULL AND turn_id IS NOT NULL)") + "SELECT conv_id, turn_id, arg_max(row_id, (n, -row_id)) AS row_id, count(*) AS rows FROM t GROUP BY 1, 2 HAVING count(*) > 1",
}
QUERIES = {
    f.__name__: f
    for f in (
        q27_kind_by_stage, q28_relation_sets, q13_intent_share, q18_provenance_by_month, q19_one_loop_check, q37_safe_against_rest, q43_rank_by_kind, q47_support_by_kind, q50_turn_export,
        f33_markup_regex, f25_citation_marks, o04_top_users, j11_query_lookup,
    )
}
