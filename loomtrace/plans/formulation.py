"""Reports on search queries: loops, parallel queries, term counts, provenance of words, similarity and transitions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.functions import kernels as K
from loomtrace.functions import text as X
from loomtrace.operators import blocks
from loomtrace.operators import messages as M
from loomtrace.plans.sql import QUERIES as QUERY_TABLES
from loomtrace.plans.sql import CONTEXT, PROVENANCE, SOURCES, TURNS, with_
from loomtrace.session import table


def _raw(spark, d):
    return table(spark, d, "web_data_summary")


def _turns(spark, d):
    return M.turns(_raw(spark, d)).select("row_id", "platform", "month", "topic", "users", "answers", "turn_id")


def _loops(spark, d):
    return M.loops(_raw(spark, d))


def bucket(c):
    return F.when(c >= 3, "3+").otherwise(c.cast("string"))


def c14_loops(spark, d):
    return _loops(spark, d).select("row_id", "loop_idx", "pos", "n_queries", F.array_join("queries", " | ").alias("queries"))


def q20_loop_histogram(spark, d):
    """Turns by number of loops (3 and more together) and largest number of parallel queries; shares of all counted turns."""
    t = _loops(spark, d).groupBy("row_id").agg(F.count("*").alias("l"), F.max("n_queries").alias("p"))
    g = t.groupBy(bucket(F.col("l")).alias("loops"), bucket(F.col("p")).alias("parallel")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


def q21_loops_by_month(spark, d):
    t = _loops(spark, d).groupBy("row_id").agg(F.count("*").alias("l"), F.sum("n_queries").alias("p")).join(_turns(spark, d).filter("month is not null"), "row_id")
    return t.groupBy(F.date_format("month", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.avg("l"), 6).alias("loops"), F.round(F.avg("p"), 6).alias("queries"))


#: Rows of so many consecutive row_ids are ranked together.
CDF_BLOCK = 50_000


def q22_term_cdf(spark, d):
    """Empirical distribution of query lengths in words by platform: the i-th smallest of n values stands at i/n.

    Rows are ranked inside blocks of (platform, length, range of row_id); the sizes of the blocks before give the rest.
    """
    q = M.queries(_raw(spark, d)).select("row_id", "pos", "q", X.term_count(F.col("q")).alias("terms")).join(_turns(spark, d).select("row_id", "platform"), "row_id")
    q = q.withColumn("block", F.struct("terms", F.floor(F.col("row_id") / CDF_BLOCK).alias("range")))
    i = blocks.running(q, ["platform"], "block", ["row_id", "pos", "q"], F.lit(1), "i")
    n = q.groupBy("platform").agg(F.count("*").alias("n"))
    return i.join(n, "platform").select("platform", "row_id", "pos", "q", "terms", F.round(F.col("i") / F.col("n"), 6).alias("cdf"))


def q22_term_summary(spark, d):
    q = M.queries(_raw(spark, d)).select("row_id", X.term_count(F.col("q")).alias("terms")).join(_turns(spark, d).select("row_id", "platform"), "row_id")
    return q.groupBy("platform").agg(F.count("*").alias("n"), F.round(F.avg("terms"), 6).alias("mean"), F.median("terms").alias("median"))


def q22_iteration_timeline(spark, d):
    """Share of each number of loops per month, absent combinations filled with 0."""
    t = _loops(spark, d).groupBy("row_id").agg(bucket(F.count("*")).alias("bucket")).join(_turns(spark, d).filter("month is not null").select("row_id", "month"), "row_id")
    g = t.groupBy("month", "bucket").agg(F.count("*").alias("n"))
    buckets = F.explode(F.array(F.lit("1"), F.lit("2"), F.lit("3+"))).alias("bucket")
    spine = g.select("month").distinct().select("month", buckets)
    j = spine.join(g, ["month", "bucket"], "left").na.fill(0, ["n"])
    return j.select(F.date_format("month", "yyyy-MM").alias("month"), "bucket", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy("month")), 6).alias("share"))


def q23_term_band(spark, d):
    """Mean terms of queries by loop bucket and month with a band of one standard error, cut at 0."""
    q = _loops(spark, d).select("row_id", F.least("loop_idx", F.lit(3)).alias("bucket"), F.explode("queries").alias("q"))
    t = q.select("row_id", "bucket", X.term_count(F.col("q")).alias("n")).join(_turns(spark, d).filter("month is not null"), "row_id")
    g = t.groupBy(F.date_format("month", "yyyy-MM").alias("month"), "bucket").agg(F.count("*").alias("queries"), F.avg("n").alias("m"), (F.coalesce(F.stddev_samp("n"), F.lit(0.0)) / F.sqrt(F.count("*"))).alias("se"))
    return g.select("month", "bucket", "queries", F.round("m", 6).alias("mean"), F.round(F.greatest(F.lit(0.0), F.col("m") - F.col("se")), 6).alias("low"), F.round(F.col("m") + F.col("se"), 6).alias("high"))


def q24_query_turns_by_month(spark, d):
    """Distinct turns and distinct turns with queries per month."""
    t = _turns(spark, d).filter("month is not null and turn_id is not null")
    have = _loops(spark, d).select("row_id").distinct()
    a = t.groupBy("month").agg(F.countDistinct("turn_id").alias("turns"))
    b = t.join(have, "row_id", "left_semi").groupBy("month").agg(F.countDistinct("turn_id").alias("with_queries"))
    j = a.join(b, "month", "left").na.fill(0, ["with_queries"])
    return j.select(F.date_format("month", "yyyy-MM").alias("month"), "turns", "with_queries", F.round(F.col("with_queries") / F.col("turns"), 6).alias("rate"))


def n04_query_similarity(spark, d):
    """Unigram precision, recall, F1 and BLEU-1 of each turn's queries against the current prompt, averaged over queries."""
    q = M.queries(_raw(spark, d)).select("row_id", X.tokens(F.col("q")).alias("c"))
    u = _turns(spark, d).select("row_id", X.tokens(F.element_at("users", -1)).alias("r")).filter(F.size("r") > 0)
    j = q.join(u, "row_id")
    p, r = K.unigram_precision(F.col("c"), F.col("r")), K.unigram_recall(F.col("c"), F.col("r"))
    j = j.select("row_id", p.alias("p_"), r.alias("r_"), K.f1(p, r).alias("f_"), K.bleu(F.col("c"), F.col("r")).alias("b_"))
    return j.groupBy("row_id").agg(*[F.round(F.avg(x), 5).alias(n) for x, n in (("p_", "precision"), ("r_", "recall"), ("f_", "f1"), ("b_", "bleu1"))])


def n03_bleu4(spark, d):
    """Mean BLEU-4 of queries by platform."""
    q = M.queries(_raw(spark, d)).select("row_id", X.tokens(F.col("q")).alias("c")).filter(F.size("c") > 0)
    u = _turns(spark, d).select("row_id", "platform", X.tokens(F.element_at("users", -1)).alias("r")).filter(F.size("r") > 0)
    return q.join(u, "row_id").groupBy("platform").agg(F.count("*").alias("n"), F.round(F.avg(K.bleu(F.col("c"), F.col("r"), 4)), 5).alias("bleu4"))


ORIGINS = ("user", "history", "memory", "source", "model")


def _words(texts):
    return F.array_distinct(F.flatten(F.transform(texts, lambda t: X.tokens(t))))


def word_origins(spark, d):
    """(row_id, n_loops, one list of words per origin): where the distinct words of each loop's queries come from.

    The first that holds a word counts: current prompt, earlier history, the loop's memories, the loop's sources, else
    the model itself. Lists are distinct over the loops of a turn, so a word can stand in two.
    """
    n = F.size("users")
    old = F.concat(F.slice("users", 1, F.greatest(n - 1, F.lit(0))), F.coalesce("answers", F.array().cast("array<string>")))
    t = _turns(spark, d).select("row_id", F.array_distinct(X.tokens(F.element_at("users", -1))).alias("uw"), _words(old).alias("hw"))
    c = M.loop_context(_raw(spark, d)).select("row_id", "loop_idx", _words(F.col("queries")).alias("w0"), _words(F.col("memories")).alias("mw"), _words(F.col("sources")).alias("sw"))
    j = c.join(t, "row_id")
    none = F.array().cast("array<string>")
    for i, known in enumerate(("uw", "hw", "mw", "sw")):
        found = F.array_intersect(f"w{i}", F.coalesce(known, none))
        j = j.withColumn(f"f{i}", found).withColumn(f"w{i + 1}", F.array_except(f"w{i}", f"f{i}"))
    lists = dict(zip(ORIGINS, ("f0", "f1", "f2", "f3", "w4")))
    return j.groupBy("row_id").agg(F.max("loop_idx").alias("n_loops"), *[F.array_distinct(F.flatten(F.collect_list(c))).alias(f"{o}_words") for o, c in lists.items()])


def c14_loop_context(spark, d):
    """Thoughts, sources and memories that lead to each loop's queries."""
    c = M.loop_context(_raw(spark, d))
    return c.select("row_id", "loop_idx", F.size("queries").alias("n_queries"), *[F.size(x).alias(f"n_{x}") for x in ("thoughts", "sources", "memories")], F.md5(F.concat_ws("|", F.array_join("thoughts", "|"), F.array_join("sources", "|"), F.array_join("memories", "|"))).alias("context_md5"))


def n06_word_provenance(spark, d):
    """Number of distinct query words of a turn by origin."""
    o = word_origins(spark, d)
    return o.select("row_id", "n_loops", *[F.size(f"{x}_words").alias(x) for x in ORIGINS])


def factor_words(spark, d):
    """Words a turn's queries draw on, as the factor reports count them: history with the prompt's, unexplained with the memories'."""
    o = word_origins(spark, d)
    return o.select("row_id", "n_loops", F.col("user_words").alias("user"), F.array_union("history_words", "user_words").alias("history"), F.col("source_words").alias("sources"), F.array_union("model_words", "memory_words").alias("unexplained"))


FACTORS = ("user", "history", "sources", "unexplained")


def n07_factor_rates(spark, d):
    """Share of each factor in the distinct words of a turn; a word can count for several factors."""
    f = factor_words(spark, d)
    f = f.withColumn("words", F.size(F.array_union(F.array_union("user", "history"), F.array_union("sources", "unexplained")))).filter("words > 0")
    return f.select("row_id", "n_loops", "words", *[F.round(F.size(x) / F.col("words"), 6).alias(f"{x}_rate") for x in FACTORS])


def a49_factor_shares(spark, d):
    """Share of each factor in all factors' words, for turns of one loop (which have no sources yet) and of several."""
    f = factor_words(spark, d).withColumn("loops", F.when(F.col("n_loops") > 1, "several").otherwise("one"))
    long = f.select("loops", F.explode(F.array(*[F.struct(F.lit(x).alias("factor"), F.size(x).alias("n")) for x in FACTORS])).alias("x")).select("loops", "x.*")
    g = long.filter("NOT (loops = 'one' AND factor = 'sources')").groupBy("loops", "factor").agg(F.sum("n").alias("words"))
    return g.withColumn("share", F.round(F.col("words") / F.sum("words").over(W.partitionBy("loops")), 6))


def _pages_and_answers(spark, d):
    pages = M.retrieved(_raw(spark, d)).filter("snippet <> ''").groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_set("snippet")), " ").alias("page"))
    a = _turns(spark, d).select("row_id", X.tokens(F.try_element_at("answers", F.lit(-1))).alias("a")).filter(F.size("a") > 0)
    return pages.select("row_id", X.tokens(F.col("page")).alias("p")).join(a, "row_id")


def n08_rouge(spark, d):
    """ROUGE-1 and ROUGE-2 precision of the last answer against the snippets the turn retrieved."""
    return _pages_and_answers(spark, d).select("row_id", F.round(K.rouge_precision(F.col("p"), F.col("a"), 1), 6).alias("rouge1"), F.round(K.rouge_precision(F.col("p"), F.col("a"), 2), 6).alias("rouge2"))


def n08_rouge_l(spark, d):
    """ROUGE-L precision of the same; a longest common subsequence has no SQL, a test compares it with a table."""
    return _pages_and_answers(spark, d).select("row_id", F.round(K.rouge_l_precision("p", "a"), 6).alias("rouge_l"))


def j09_transitions(spark, d):
    """Edges prompt -> first loop and loop -> next loop, counted by step and by what changed in the words."""
    q = _loops(spark, d).select("row_id", "loop_idx", F.explode("queries").alias("q"), X.tokens(F.col("q")).alias("w"))
    start = _turns(spark, d).select("row_id", F.lit(0).cast("int").alias("loop_idx"), F.element_at("users", -1).alias("q")).filter("q is not null").select("row_id", "loop_idx", "q", X.tokens(F.col("q")).alias("w"))
    f = start.unionByName(q.withColumn("loop_idx", F.col("loop_idx").cast("int"))).select("row_id", (F.col("loop_idx") + 1).alias("loop_idx"), F.col("w").alias("fw"))
    e = f.join(q.withColumn("loop_idx", F.col("loop_idx").cast("int")), ["row_id", "loop_idx"])
    new, lost = F.size(F.array_except("w", "fw")), F.size(F.array_except("fw", "w"))
    kind = F.when((new == 0) & (lost == 0), "same").when(new == 0, "narrowing").when(lost == 0, "expansion").otherwise("rewriting")
    g = e.groupBy(F.least("loop_idx", F.lit(3)).alias("step"), kind.alias("kind")).agg(F.count("*").alias("n"))
    return g.withColumn("rate", F.round(F.col("n") / F.sum("n").over(W.partitionBy("step")), 6))


def a44_destination_rollup(spark, d):
    """Labels of the edges into each query rolled up: rewriting with expansion is hybrid, a single kind stays, else other."""
    q = _loops(spark, d).select("row_id", "loop_idx", F.explode("queries").alias("q"), X.tokens(F.col("q")).alias("w"))
    f = q.select("row_id", (F.col("loop_idx") + 1).alias("loop_idx"), F.col("w").alias("fw"))
    e = q.join(f, ["row_id", "loop_idx"])
    new, lost = F.size(F.array_except("w", "fw")), F.size(F.array_except("fw", "w"))
    kind = F.when((new == 0) & (lost == 0), "other").when(lost == 0, "expansion").otherwise("rewriting")
    g = e.groupBy("row_id", "loop_idx", "q").agg(F.array_sort(F.collect_set(kind)).alias("k"))
    own = F.filter("k", lambda x: x != "other")
    label = F.when(F.size(own) >= 2, "hybrid").when(F.size(own) == 1, own[0]).otherwise("other")
    return g.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def w04_refs_runs(spark, d):
    """Last message of each run of equal numbers of queries within a turn (gaps and islands)."""
    p = _loops(spark, d).select("row_id", "loop_idx", "n_queries")
    w = W.partitionBy("row_id").orderBy("loop_idx")
    b = p.withColumn("new", (~F.lag("n_queries").over(w).eqNullSafe(F.col("n_queries"))).cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return b.groupBy("row_id", "run").agg(F.max("loop_idx").alias("last_loop"), F.first("n_queries").alias("n_queries"), F.count("*").alias("length"))


_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '(\\p{{L}}+|\\d+)')"
_TERMS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> ''))"
_B = "CASE WHEN {0} >= 3 THEN '3+' ELSE {0}::VARCHAR END"
_OVER = "list_sum(list_transform(list_distinct(c), lambda x: least(len(list_filter(c, lambda y: y = x)), len(list_filter(r, lambda y: y = x)))))"
_SIM = with_(TURNS, QUERY_TABLES, f"j AS (SELECT row_id, {_TOK.format('q')} AS c, {_TOK.format('users[-1]')} AS r FROM queries JOIN turns USING (row_id))", f"o AS (SELECT row_id, coalesce({_OVER}, 0)::DOUBLE AS o, len(c) AS nc, len(r) AS nr FROM j WHERE len(r) > 0)")
def _grams(x: str, n: int) -> str:
    return x if n == 1 else f"list_transform(range(1, len({x}) - {n - 2}), lambda i: array_to_string({x}[i:i + {n - 1}], ' '))"


def _hits(n: int) -> str:
    """Size of the multiset intersection of the n-grams of c and r."""
    c, r = _grams("c", n), _grams("r", n)
    return f"coalesce(list_sum(list_transform(list_distinct({c}), lambda x: least(len(list_filter({c}, lambda y: y = x)), len(list_filter({r}, lambda y: y = x))))), 0)::DOUBLE"


_FACTOR_SQL = "factor AS (SELECT *, len(list_distinct(list_concat(list_concat(user, history), list_concat(sources, unexplained)))) AS words FROM (SELECT row_id, n_loops, user_words AS user, list_distinct(list_concat(history_words, user_words)) AS history, source_words AS sources, list_distinct(list_concat(model_words, memory_words)) AS unexplained FROM origin))"
_EDGE = "CASE WHEN new = 0 AND lost = 0 THEN {same} WHEN {narrow} lost = 0 THEN 'expansion' ELSE 'rewriting' END"
_DIFF = "len(list_distinct(list_filter({0}, lambda x: NOT list_contains({1}, x))))"
ORACLES = {
    "c14_loops": with_(QUERY_TABLES) + "SELECT row_id, loop_idx, pos, n_queries, array_to_string(queries, ' | ') AS queries FROM loops",
    "q20_loop_histogram": with_(QUERY_TABLES, "t AS (SELECT row_id, count(*) AS l, max(n_queries) AS p FROM loops GROUP BY 1)") + f"SELECT {_B.format('l')} AS loops, {_B.format('p')} AS parallel, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM t GROUP BY 1, 2",
    "q21_loops_by_month": with_(TURNS, QUERY_TABLES, "t AS (SELECT row_id, count(*) AS l, sum(n_queries) AS p FROM loops GROUP BY 1)") + "SELECT strftime(month, '%Y-%m') AS month, count(*) AS n, round(avg(l), 6) AS loops, round(avg(p), 6) AS queries FROM t JOIN turns USING (row_id) WHERE month IS NOT NULL GROUP BY 1",
    "q22_term_cdf": with_(TURNS, QUERY_TABLES, f"t AS (SELECT platform, row_id, pos, q, {_TERMS.format('q')} AS terms FROM queries JOIN turns USING (row_id))") + "SELECT platform, row_id, pos, q, terms, round(row_number() OVER (PARTITION BY platform ORDER BY terms, row_id, pos, q) / count(*) OVER (PARTITION BY platform), 6) AS cdf FROM t",
    "q22_term_summary": with_(TURNS, QUERY_TABLES, f"t AS (SELECT platform, {_TERMS.format('q')} AS terms FROM queries JOIN turns USING (row_id))") + "SELECT platform, count(*) AS n, round(avg(terms), 6) AS mean, median(terms) AS median FROM t GROUP BY 1",
    "q22_iteration_timeline": with_(TURNS, QUERY_TABLES, f"t AS (SELECT month, {_B.format('l')} AS bucket, count(*) AS n FROM (SELECT row_id, count(*) AS l FROM loops GROUP BY 1) JOIN turns USING (row_id) WHERE month IS NOT NULL GROUP BY 1, 2)", "s AS (SELECT month, unnest(['1', '2', '3+']) AS bucket FROM (SELECT DISTINCT month FROM t))") + "SELECT strftime(month, '%Y-%m') AS month, bucket, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY month), 6) AS share FROM s LEFT JOIN t USING (month, bucket)",
    "q23_term_band": with_(TURNS, QUERY_TABLES, f"t AS (SELECT month, least(loop_idx, 3) AS bucket, {_TERMS.format('q')} AS n FROM (SELECT row_id, loop_idx, unnest(queries) AS q FROM loops) JOIN turns USING (row_id) WHERE month IS NOT NULL)", "g AS (SELECT month, bucket, count(*) AS queries, avg(n) AS m, coalesce(stddev_samp(n), 0) / sqrt(count(*)) AS se FROM t GROUP BY 1, 2)") + "SELECT strftime(month, '%Y-%m') AS month, bucket, queries, round(m, 6) AS mean, round(greatest(0, m - se), 6) AS low, round(m + se, 6) AS high FROM g",
    "q24_query_turns_by_month": with_(TURNS, QUERY_TABLES) + "SELECT strftime(month, '%Y-%m') AS month, count(DISTINCT turn_id) AS turns, count(DISTINCT turn_id) FILTER (WHERE row_id IN (SELECT row_id FROM loops)) AS with_queries, round(count(DISTINCT turn_id) FILTER (WHERE row_id IN (SELECT row_id FROM loops)) / count(DISTINCT turn_id), 6) AS rate FROM turns WHERE month IS NOT NULL AND turn_id IS NOT NULL GROUP BY 1",
    "n04_query_similarity": _SIM + "SELECT row_id, round(avg(o / greatest(nc, 1)), 5) AS precision, round(avg(o / greatest(nr, 1)), 5) AS recall, round(avg(CASE WHEN o > 0 THEN 2 * (o / nc) * (o / nr) / (o / nc + o / nr) ELSE 0 END), 5) AS f1, round(avg(CASE WHEN o > 0 THEN (CASE WHEN nc > nr THEN 1 ELSE exp(1 - nr / nc) END) * o / nc ELSE 0 END), 5) AS bleu1 FROM o GROUP BY 1",
    "n03_bleu4": with_(TURNS, QUERY_TABLES, f"j AS (SELECT platform, {_TOK.format('q')} AS c, {_TOK.format('users[-1]')} AS r FROM queries JOIN turns USING (row_id))", "g AS (SELECT platform, len(c) AS nc, len(r) AS nr, " + ", ".join(f"{_hits(n)} AS h{n}, greatest(len(c) - {n - 1}, 0) AS t{n}" for n in (1, 2, 3, 4)) + " FROM j WHERE len(c) > 0 AND len(r) > 0)") + "SELECT platform, count(*) AS n, round(avg(CASE WHEN h1 > 0 THEN (CASE WHEN nc > nr THEN 1 ELSE exp(1 - nr / nc) END) * exp((" + " + ".join(f"ln((CASE WHEN h{n} > 0 THEN h{n} ELSE 0.1 END) / greatest(t{n}, 1))" for n in (1, 2, 3, 4)) + ") / 4) ELSE 0 END), 5) AS bleu4 FROM g GROUP BY 1",
    "n08_rouge": with_(TURNS, SOURCES, "p AS (SELECT row_id, string_agg(snippet, ' ' ORDER BY snippet) AS page FROM (SELECT DISTINCT row_id, snippet FROM retrieved WHERE snippet <> '') GROUP BY 1)", f"j AS (SELECT row_id, {_TOK.format('answers[-1]')} AS c, {_TOK.format('page')} AS r FROM p JOIN turns USING (row_id))") + f"SELECT row_id, round({_hits(1)} / len(c), 6) AS rouge1, round(CASE WHEN len(c) > 1 THEN {_hits(2)} / (len(c) - 1) ELSE 0 END, 6) AS rouge2 FROM j WHERE len(c) > 0",
    "c14_loop_context": with_(QUERY_TABLES, CONTEXT) + "SELECT row_id, loop_idx, len(queries) AS n_queries, len(thoughts) AS n_thoughts, len(sources) AS n_sources, len(memories) AS n_memories, md5(array_to_string(thoughts, '|') || '|' || array_to_string(sources, '|') || '|' || array_to_string(memories, '|')) AS context_md5 FROM context",
    "n06_word_provenance": with_(TURNS, QUERY_TABLES, CONTEXT, PROVENANCE) + "SELECT row_id, n_loops, len(user_words) AS user, len(history_words) AS history, len(memory_words) AS memory, len(source_words) AS source, len(model_words) AS model FROM origin",
    "n07_factor_rates": with_(TURNS, QUERY_TABLES, CONTEXT, PROVENANCE, _FACTOR_SQL) + "SELECT row_id, n_loops, words, " + ", ".join(f"round(len({x}) / words, 6) AS {x}_rate" for x in FACTORS) + " FROM factor WHERE words > 0",
    "a49_factor_shares": with_(TURNS, QUERY_TABLES, CONTEXT, PROVENANCE, _FACTOR_SQL, "g AS (SELECT CASE WHEN n_loops > 1 THEN 'several' ELSE 'one' END AS loops, unnest(['user', 'history', 'sources', 'unexplained']) AS factor, unnest([len(user), len(history), len(sources), len(unexplained)]) AS n FROM factor)") + "SELECT loops, factor, sum(n)::BIGINT AS words, round(sum(n) / sum(sum(n)) OVER (PARTITION BY loops), 6) AS share FROM g WHERE NOT (loops = 'one' AND factor = 'sources') GROUP BY 1, 2",
    "j09_transitions": with_(TURNS, QUERY_TABLES, f"q AS (SELECT row_id, loop_idx, {_TOK.format('q')} AS w FROM (SELECT row_id, loop_idx, unnest(queries) AS q FROM loops))", f"f AS (SELECT row_id, 1 AS loop_idx, {_TOK.format('users[-1]')} AS fw FROM turns WHERE users[-1] IS NOT NULL UNION ALL SELECT row_id, loop_idx + 1, w FROM q)", f"e AS (SELECT least(loop_idx, 3) AS step, {_DIFF.format('w', 'fw')} AS new, {_DIFF.format('fw', 'w')} AS lost FROM q JOIN f USING (row_id, loop_idx))", f"k AS (SELECT step, {_EDGE.format(same=chr(39) + 'same' + chr(39), narrow='new = 0 THEN ' + chr(39) + 'narrowing' + chr(39) + ' WHEN')} AS kind FROM e)") + "SELECT step, kind, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY step), 6) AS rate FROM k GROUP BY 1, 2",
    "a44_destination_rollup": with_(QUERY_TABLES, f"q AS (SELECT row_id, loop_idx, q, {_TOK.format('q')} AS w FROM (SELECT row_id, loop_idx, unnest(queries) AS q FROM loops))", f"e AS (SELECT a.row_id, a.loop_idx, a.q, {_DIFF.format('a.w', 'b.w')} AS new, {_DIFF.format('b.w', 'a.w')} AS lost FROM q a JOIN q b ON a.row_id = b.row_id AND a.loop_idx = b.loop_idx + 1)", f"k AS (SELECT row_id, loop_idx, q, list_distinct(list({_EDGE.format(same=chr(39) + 'other' + chr(39), narrow='')})) AS k FROM e GROUP BY 1, 2, 3)") + "SELECT CASE WHEN len(list_filter(k, lambda x: x <> 'other')) >= 2 THEN 'hybrid' WHEN len(list_filter(k, lambda x: x <> 'other')) = 1 THEN list_filter(k, lambda x: x <> 'other')[1] ELSE 'other' END AS label, count(*) AS n FROM k GROUP BY 1",
    "w04_refs_runs": with_(QUERY_TABLES, "b AS (SELECT *, CASE WHEN lag(n_queries) OVER (PARTITION BY row_id ORDER BY loop_idx) IS NOT DISTINCT FROM n_queries THEN 0 ELSE 1 END AS new FROM loops)", "r AS (SELECT *, sum(new) OVER (PARTITION BY row_id ORDER BY loop_idx) AS run FROM b)") + "SELECT row_id, run::BIGINT AS run, max(loop_idx) AS last_loop, any_value(n_queries) AS n_queries, count(*) AS length FROM r GROUP BY 1, 2",
}
QUERIES = {
    f.__name__: f
    for f in (
        c14_loops, q20_loop_histogram, q21_loops_by_month, q22_term_cdf, q22_term_summary, q22_iteration_timeline, q23_term_band, q24_query_turns_by_month, n04_query_similarity, n03_bleu4, c14_loop_context, n06_word_provenance, n07_factor_rates, a49_factor_shares, n08_rouge, n08_rouge_l,
        j09_transitions, a44_destination_rollup, w04_refs_runs,
    )
}
