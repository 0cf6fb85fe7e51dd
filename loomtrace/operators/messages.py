"""Long tables of the turn export: turns, messages, queries, search loops and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.functions import coerce, text, urls
from loomtrace.session import spread

# Fixed values.
PLATFORMS = ("chatgpt", "grok", "claude", "deepseek")
LIST_FIELDS = ("thoughts", "search_result_groups", "entries", "content_references", "items")


def turns(raw: DataFrame) -> DataFrame:
    """The turn table with settled labels; every export row counts."""
    named = F.lower(F.trim("platform"))
    return raw.select(
        "row_id", "user_id", "conv_id", "turn_id", "conv_starter", "reasoning", "thinking", "thoughts", "tools", "interactions", "month",
        F.when(named.isin(*PLATFORMS), named).otherwise(F.split("conv_id", "_")[0]).alias("platform"),
        coerce.or_other(F.col("topic")).alias("topic"),
        F.lower(F.trim("language")).alias("language"),
        F.col("openai_models").alias("models"),
        F.col("user_msg_history").alias("users"),
        F.col("assistant_msg_history").alias("answers"),
    )


def primary_model(models: Column) -> Column:
    """Last model named, or Unknown."""
    return F.coalesce(F.try_element_at(F.filter(models, lambda m: m.isNotNull() & (F.trim(m) != "")), F.lit(-1)), F.lit("Unknown"))


def used_web(tools: Column, interactions: Column) -> Column:
    def names(c):
        return F.coalesce(F.exists(c, lambda t: F.lower(F.coalesce(t, F.lit(""))).contains("web")), F.lit(False))

    return names(tools) | names(interactions)


def last_user(users: Column) -> Column:
    """Latest non-blank user text."""
    return F.try_element_at(F.filter(users, lambda u: u.isNotNull() & (F.trim(u) != "")), F.lit(-1))


def field(v: str, path: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get({v}, '$.{path}', '{kind}')")


def list_sql(v: str, path: str) -> str:
    """``list_field`` as SQL text, which may stand inside a lambda."""
    own = f"try_variant_get({v}, '$.{path}', 'variant')"

    def direct(x: str) -> str:
        return f"CASE WHEN schema_of_variant({x}) LIKE 'ARRAY%' THEN try_variant_get({x}, '$', 'array<variant>') WHEN schema_of_variant({x}) LIKE 'OBJECT%' THEN array({x}) END"

    inner = f"try_parse_json(try_variant_get({v}, '$.{path}', 'string'))"
    return f"CASE WHEN schema_of_variant({own}) = 'STRING' THEN {direct(inner)} ELSE {direct(own)} END"


def list_field(v: str, path: str) -> Column:
    """A list field as written, as JSON text or as a single object: array of variants, null if it is none of these."""
    return F.expr(list_sql(v, path))


def joined(*lists: str) -> str:
    """SQL text of several lists as one; null lists count as empty."""
    return f"flatten(filter(array({', '.join(lists)}), x -> x IS NOT NULL))"


def messages(raw: DataFrame) -> DataFrame:
    """(row_id, pos, m): every message of every valid turn as a variant."""
    return spread(raw.select("row_id", "turn_msgs")).select("row_id", F.try_parse_json("turn_msgs").alias("v")).select("row_id", F.posexplode(F.expr("try_variant_get(v, '$', 'array<variant>')")).alias("pos", "m"))


def _message_queries() -> Column:
    """Distinct search queries of a message ``m``, in order."""
    none = F.array().cast("array<string>")
    single = F.transform(list_field("m", "metadata.search_queries"), lambda x: F.try_variant_get(x, "$.q", "string"))
    joint = field("m", "metadata.search_model_queries.queries", "array<string>")
    return F.array_distinct(F.filter(F.concat(F.coalesce(single, none), F.coalesce(joint, none)), lambda q: q.isNotNull() & (q != "")))


def queries(raw: DataFrame) -> DataFrame:
    """(row_id, pos, q): distinct search queries of each message."""
    return messages(raw).select("row_id", "pos", _message_queries().alias("qs")).filter(F.size("qs") > 0).select("row_id", "pos", F.explode("qs").alias("q"))


def loops(raw: DataFrame) -> DataFrame:
    """(row_id, loop_idx, pos, n_queries, queries): a message that carries queries closes a search loop."""
    closing = queries(raw).groupBy("row_id", "pos").agg(F.count("*").alias("n_queries"), F.array_sort(F.collect_list("q")).alias("queries"))
    return closing.select("row_id", F.row_number().over(W.partitionBy("row_id").orderBy("pos")).alias("loop_idx"), "pos", "n_queries", "queries")


def loop_context(raw: DataFrame) -> DataFrame:
    """(row_id, loop_idx, queries, thoughts, sources, memories): what stands between one query-bearing message and the
    next, that message included, all in order of the messages; what follows the last query is left out.

    A source is one text of title, domain and snippet, one per line; an image result has no snippet.
    """
    none = F.array().cast("array<string>")

    def texts(sql: str) -> Column:
        return F.filter(F.coalesce(F.expr(sql), none), lambda x: x.isNotNull())

    def described(v: str, host: str) -> str:
        parts = ", ".join(f"coalesce({x}, '')" for x in (f"try_variant_get({v}, '$.title', 'string')", host, f"try_variant_get({v}, '$.snippet', 'string')"))
        return f"concat_ws('\\n', {parts})"

    def objects(sql: str) -> str:
        return f"filter({sql}, x -> schema_of_variant(x) LIKE 'OBJECT%')"

    host = "try_variant_get(g, '$.domain', 'string')"
    groups = f"flatten(filter(transform({list_sql('m', 'metadata.search_result_groups')}, g -> transform({objects(list_sql('g', 'entries'))}, x -> {described('x', host)})), l -> l IS NOT NULL))"
    no_text = "''"
    images = f"transform({objects(list_sql('m', 'metadata.image_results'))}, x -> {described('x', no_text)})"
    thoughts = f"CASE WHEN try_variant_get(m, '$.content.content_type', 'string') = 'thoughts' THEN transform({list_sql('m', 'content.thoughts')}, x -> coalesce(try_variant_get(x, '$.content', 'string'), '')) END"
    memory = field("m", "metadata.user_context_message_data.about_user_message")
    parts = messages(raw).select(
        "row_id", "pos", _message_queries().alias("q"), texts(thoughts).alias("t"), F.concat(texts(groups), texts(images)).alias("s"),
        F.when(F.trim(memory) != "", F.array(memory)).otherwise(none).alias("m"),
    )
    closed = F.sum((F.size("q") > 0).cast("int")).over(W.partitionBy("row_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    rows = parts.withColumn("loop_idx", (F.coalesce(closed, F.lit(0)) + 1).cast("int"))
    x = F.array_sort(F.collect_list(F.struct("pos", "q", "t", "s", "m")))
    g = rows.groupBy("row_id", "loop_idx").agg(x.alias("x"), F.max(F.size("q")).alias("n")).filter("n > 0")

    def of(name: str) -> Column:
        return F.flatten(F.transform("x", lambda y: y[name]))

    return g.select("row_id", "loop_idx", F.array_sort(F.array_distinct(of("q"))).alias("queries"), of("t").alias("thoughts"), of("s").alias("sources"), of("m").alias("memories"))


IMAGES = 1_000_000


def sources(raw: DataFrame) -> DataFrame:
    """Every source of every valid turn in one pass over the parsed messages: (row_id, kind, pos, g, src, e, url, title, snippet, turn_index, ref_index).

    ``retrieved``: entries of result groups (g, e) and image results (g = IMAGES); urls are kept as written.
    ``safe``: safe urls without the platform's utm mark.
    ``cited``: references (g) whose text holds a citation mark: their own url (src 0) and those of their images (src 1)
    and items (src 2). An item's place is its first ref, else the reference's ref of the same ordinal, else none.
    """
    parts = joined(
        f"transform({list_sql('m', 'metadata.search_result_groups')}, (x, i) -> struct('group' AS part, i AS g, x AS v))",
        f"transform({list_sql('m', 'metadata.image_results')}, (x, i) -> struct('image' AS part, i AS g, x AS v))",
        "transform(try_variant_get(m, '$.metadata.safe_urls', 'array<variant>'), (x, i) -> struct('safe' AS part, i AS g, x AS v))",
        f"transform({list_sql('m', 'metadata.content_references')}, (x, i) -> struct('ref' AS part, i AS g, x AS v))",
    )
    p = messages(raw).select("row_id", "pos", F.explode(F.expr(parts)).alias("p")).select("row_id", "pos", "p.*")
    p = p.withColumn("mark", F.when(F.col("part") == "ref", text.citation_refs(field("v", "matched_text")))).filter("part <> 'ref' OR size(mark) > 0")
    rows = f"""CASE part
        WHEN 'group' THEN transform({list_sql("v", "entries")}, (x, i) -> struct(0 AS src, i AS e, x AS iv))
        WHEN 'ref' THEN {joined("array(struct(0 AS src, 0 AS e, v AS iv))", f"transform({list_sql('v', 'images')}, (x, i) -> struct(1 AS src, i AS e, x AS iv))", "transform(CASE WHEN size(fallback) > 0 THEN fallback ELSE listed END, (x, i) -> struct(2 AS src, i AS e, x AS iv))")}
        ELSE array(struct(0 AS src, g AS e, v AS iv)) END"""
    is_ref = F.col("part") == "ref"
    p = p.withColumns({"own": F.when(is_ref, list_field("v", "refs")), "fallback": F.when(is_ref, list_field("v", "fallback_items")), "listed": F.when(is_ref, list_field("v", "items"))})
    r = p.withColumn("x", F.explode(F.expr(rows))).select("row_id", "pos", "part", "g", "mark", "own", "x.*")
    r = r.withColumn("first", F.when((F.col("part") == "ref") & (F.col("src") > 0), F.try_element_at(list_field("iv", "refs"), F.lit(1))))
    place = F.when(F.col("first").isNotNull(), F.col("first")).otherwise(F.get("own", F.col("e")))
    r = r.withColumn("place", F.when(F.col("src") > 0, place))

    def index(name: str, image: Column) -> Column:
        return (
            F.when(F.col("part") == "group", field("iv", f"ref_id.{name}", "int"))
            .when(F.col("part") == "image", image)
            .when((F.col("part") == "ref") & (F.col("src") == 0), F.col("mark")[0][name])
            .when(F.col("part") == "ref", field("place", name, "int"))
        )

    url = F.when(F.col("part") == "safe", F.try_variant_get("iv", "$", "string")).otherwise(field("iv", "url"))
    kind = F.when(is_ref, "cited").when(F.col("part") == "safe", "safe").otherwise("retrieved")
    out = r.select(
        "row_id", kind.alias("kind"), "pos", F.when(F.col("part") == "image", IMAGES).when(F.col("part") == "safe", 0).otherwise(F.col("g")).alias("g"), "src", "e",
        F.when(F.col("part") == "safe", urls.without_utm(url)).otherwise(url).alias("url"), field("iv", "title").alias("title"), field("iv", "snippet").alias("snippet"),
        index("turn_index", F.lit(None).cast("int")).alias("turn_index"), index("ref_index", F.col("e")).alias("ref_index"), url.alias("_raw"),
    )
    return out.filter("_raw <> ''").drop("_raw")


def retrieved(raw: DataFrame) -> DataFrame:
    """Search results and image results with their place."""
    return sources(raw).filter("kind = 'retrieved'").drop("src")


def safe(raw: DataFrame) -> DataFrame:
    return sources(raw).filter("kind = 'safe'").drop("src")


def cited(raw: DataFrame) -> DataFrame:
    """Cited sources; of equal (url, turn_index, ref_index) the one with most filled fields stays, at the first one's place."""
    return richest(sources(raw).filter("kind = 'cited'"))


def richest(every: DataFrame) -> DataFrame:
    rich = F.when(F.trim(F.coalesce("title", F.lit(""))) != "", 1).otherwise(0) + F.when(F.trim(F.coalesce("snippet", F.lit(""))) != "", 1).otherwise(0)
    order = [F.col(x) for x in ("pos", "g", "src", "e")]
    key = W.partitionBy("row_id", "url", "turn_index", "ref_index")
    best = every.withColumn("rich", rich).withColumn("n", F.row_number().over(key.orderBy(F.desc("rich"), *order))).withColumn("at", F.min(F.struct(*order)).over(key)).filter("n = 1")
    return best.select("row_id", "at.pos", F.col("at.g").alias("g"), (F.col("at.src") * 1000 + F.col("at.e")).alias("e"), "url", "title", "snippet", "turn_index", "ref_index", F.lit("cited").alias("kind"))


def keyed(every: DataFrame) -> DataFrame:
    """Sources with their url as it is compared and their plain domain."""
    return every.withColumns({"key": urls.match_key(F.col("url")), "domain": urls.plain_domain(urls.domain(F.col("url")))})


def source_keys(raw: DataFrame) -> DataFrame:
    """(row_id, kind, key, domain): distinct normalised urls of each turn and kind of source."""
    return keyed(sources(raw)).select("row_id", "kind", "key", "domain").distinct()


KINDS = ("retrieved", "safe", "cited")


def url_sets(raw: DataFrame) -> DataFrame:
    """(row_id, retrieved, safe, cited, retrieved_domains, cited_domains): sets of each turn that has any source."""
    k = keyed(sources(raw))

    def gathered(kind: str, column: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col(column))))

    return k.groupBy("row_id").agg(*[gathered(x, "key").alias(x) for x in KINDS], *[gathered(x, "domain").alias(f"{x}_domains") for x in ("retrieved", "cited")])


def turn_sets(turns_: DataFrame, raw: DataFrame) -> DataFrame:
    """``turns_`` with the sets of ``url_sets``; a turn without sources, or with null or broken JSON, has empty ones."""
    none = F.array().cast("array<string>")
    names = [*KINDS, "retrieved_domains", "cited_domains"]
    return turns_.join(url_sets(raw), "row_id", "left").withColumns({x: F.coalesce(x, none) for x in names})
