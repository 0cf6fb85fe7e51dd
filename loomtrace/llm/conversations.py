"""Problem 7: conversations rebuilt from message rows.

``sessionise`` turns the rows of a channel into sessions: states of one message are reduced to the newest, timestamps
are repaired and sorted, the rows are split at inactivity gaps that are calibrated for each platform (a quantile of its
own gaps), roles are inferred from the spelling of the author, and sessions without reciprocal replies are dropped.

Where the rows name their parents, timestamps as unreliable as these are no match for the links: ``rebuild`` is the
same operator with the order and the limits of a session taken from the links (every conversation with one start and
without a lost parent is one session in the order of its first children). Roles and reciprocal replies are shared.
The README states how far the two differ.

Conversations of up to ``GROUP_ROWS`` rows are walked one by one; larger ones, found by a join, are walked by pointer
doubling over joins, so no task ever holds a whole large one. Windows over time or depth run in blocks whose sums are
chained, so a huge channel is spread over its blocks.

Defined results: rows with a null conversation or message id belong to no conversation; of equally new states
of a message the highest ``msg_row`` holds; children of equal ``child_no`` are taken by ``msg_id``, null
``child_no`` last; unknown roles are never spoken. A message without a time takes that of its parent, else the
earliest of its channel; a channel without any time is one session in order of ``msg_row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.session import checkpointed

GROUP_ROWS = 20_000
#: Quantile of a platform's gaps above which a gap ends a session, and the width of a block of time.
GAP_QUANTILE = 0.99
BLOCK_SECONDS = 21_600
BLOCK_DEPTH = 10_000

# Spellings of the two speakers.
USER = ("user", "human", "prompter", "customer", "you")
ASSISTANT = ("assistant", "bot", "ai", "model", "chatbot", "gpt")
BLANK = r"[\p{Z}\p{Cc}\p{Cf}\p{Cn}⠀ㅤᅟᅠ️]"


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\p{Z}\p{Cc}]+|[\p{Z}\p{Cc}]+$", "")


def speaker_of(role: Column) -> Column:
    r = F.lower(_squeezed(role))
    return F.when(r.isin(*USER), "user").when(r.isin(*ASSISTANT), "assistant")


def current_messages(rows: DataFrame, **more: Column) -> DataFrame:
    """One row per (conv_id, msg_id) with what the walk needs, and more columns of the newest state; bodies are left behind."""
    slim = rows.filter("conv_id is not null and msg_id is not null").select(
        "conv_id",
        "msg_id",
        F.struct(
            "batch_no",
            "msg_row",
            F.when(F.lower(_squeezed(F.col("parent_id"))).isin("", "root"), None).otherwise(F.col("parent_id")).alias("parent"),
            "child_no",
            F.when(
                F.coalesce(F.col("recipient") == "all", F.lit(True))
                & F.col("content_type").isin("text", "multimodal_text")
                & F.coalesce(F.length(F.regexp_replace("body", BLANK, "")) > 0, F.lit(False)),
                speaker_of(F.col("author_role")),
            ).alias("speaker"),
            *[c.alias(name) for name, c in more.items()],
        ).alias("state"),
    )
    best = slim.groupBy("conv_id", "msg_id").agg(F.max("state").alias("s"))
    return best.select("conv_id", "msg_id", "s.parent", "s.child_no", "s.speaker", *[F.col(f"s.{c}") for c in more])


def reciprocal(speakers: list[str]) -> bool:
    """Begins with the user, and an assistant message follows every user message before the next one or the end."""
    if not speakers or speakers[0] != "user" or speakers[-1] != "assistant":
        return False
    return all(a != "user" or b == "assistant" for a, b in zip(speakers, speakers[1:]))


def walk(messages: list[tuple]) -> list[tuple[str, str]]:
    """Spoken (msg_id, speaker) of one sound conversation in order, else nothing. messages: (msg_id, parent, child_no, speaker)."""
    ids = {m[0]: m for m in messages}
    starts = [m for m in messages if m[1] is None]
    if len(starts) != 1 or any(m[1] is not None and m[1] not in ids for m in messages):
        return []
    first: dict[str, tuple] = {}
    for m in messages:
        if m[1] is not None:
            rank = (m[2] is None, m[2] or 0, m[0])
            if m[1] not in first or rank < first[m[1]][0]:
                first[m[1]] = (rank, m)
    spoken, at = [], starts[0]
    while True:
        if at[3] is not None:
            spoken.append((at[0], at[3]))
        if at[0] not in first:
            break
        at = first[at[0]][1]
    return spoken if reciprocal([s for _, s in spoken]) else []


def _walk_small(messages: DataFrame) -> DataFrame:
    grouped = messages.groupBy("conv_id").agg(F.collect_list(F.struct("msg_id", "parent", "child_no", "speaker")).alias("m"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for conv, m in zip(f["conv_id"], f["m"]):
                spoken = walk([(x["msg_id"], x["parent"], None if x["child_no"] is None or x["child_no"] != x["child_no"] else x["child_no"], x["speaker"]) for x in m])
                out.extend((conv, i, msg, who) for i, (msg, who) in enumerate(spoken, 1))
            yield pd.DataFrame(out, columns=["conv_id", "pos", "msg_id", "speaker"])

    return grouped.mapInPandas(run, "conv_id string, pos bigint, msg_id string, speaker string")


def _walk_large(messages: DataFrame) -> DataFrame:
    """The same by pointer doubling: every join and window key is a message, never a conversation alone."""
    m = checkpointed(messages)
    ids = m.select("conv_id", F.col("msg_id").alias("parent"), F.lit(1).alias("there"))
    sound = (
        m.join(ids, ["conv_id", "parent"], "left")
        .groupBy("conv_id")
        .agg(F.count_if(F.col("parent").isNull()).alias("starts"), F.count_if(F.col("parent").isNotNull() & F.col("there").isNull()).alias("lost"))
        .filter("starts = 1 and lost = 0")
        .select("conv_id")
    )
    rank = F.struct(F.col("child_no").isNull().alias("n"), F.coalesce("child_no", F.lit(0)).alias("c"), "msg_id")
    first = m.filter("parent is not null").groupBy("conv_id", "parent").agg(F.min(rank).alias("r")).select("conv_id", F.col("parent").alias("msg_id"), F.col("r.msg_id").alias("next"))
    # reach: nodes known to lie on the path with their distance from the start; jump: node -> node 2^k steps ahead
    reach = checkpointed(m.join(sound, "conv_id", "left_semi").filter("parent is null").select("conv_id", "msg_id", F.lit(0).cast("bigint").alias("depth")))
    jump = checkpointed(first)
    step = 1
    while True:
        more = reach.join(jump, ["conv_id", "msg_id"]).select("conv_id", F.col("next").alias("msg_id"), (F.col("depth") + step).alias("depth"))
        more = checkpointed(more)
        if more.isEmpty():
            break
        reach = checkpointed(reach.unionByName(more))
        onward = jump.select("conv_id", F.col("msg_id").alias("next"), F.col("next").alias("further"))
        jump = checkpointed(jump.join(onward, ["conv_id", "next"]).select("conv_id", "msg_id", F.col("further").alias("next")))
        step *= 2
    spoken = reach.join(m.filter("speaker is not null").select("conv_id", "msg_id", "speaker"), ["conv_id", "msg_id"])
    return _reciprocal(checkpointed(spoken.withColumn("block", F.floor(F.col("depth") / BLOCK_DEPTH))), ["conv_id"], ["depth"])


def _reciprocal(spoken: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """(key, pos, msg_id, speaker) of the sessions with reciprocal replies; ``order`` is settled within and between blocks."""
    inner = W.partitionBy(*key, "block").orderBy(*order)
    place = F.struct(*order)
    marked = spoken.select("*", F.row_number().over(inner).alias("n"), F.lag("speaker").over(inner).alias("before"))
    blocks = marked.groupBy(*key, "block").agg(
        F.count("*").alias("size"),
        F.min_by("speaker", place).alias("first"),
        F.max_by("speaker", place).alias("last"),
        F.count_if((F.col("speaker") == "user") & (F.col("before") == "user")).alias("bad"),
    )
    outer = W.partitionBy(*key).orderBy("block")
    chained = blocks.select(
        "*",
        F.coalesce(F.sum("size").over(outer.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.lag("last").over(outer).alias("prior"),
    )
    good = (
        chained.groupBy(*key)
        .agg(
            F.sum(F.col("bad") + F.when((F.col("prior") == "user") & (F.col("first") == "user"), 1).otherwise(0)).alias("bad"),
            F.min_by("first", "block").alias("first"),
            F.max_by("last", "block").alias("last"),
        )
        .filter("bad = 0 and first = 'user' and last = 'assistant'")
        .select(*key)
    )
    return (
        marked.join(chained.select(*key, "block", "offset"), [*key, "block"])
        .join(good, key, "left_semi")
        .select(*key, (F.col("n") + F.col("offset")).cast("bigint").alias("pos"), "msg_id", "speaker")
    )


def seconds(time: Column) -> Column:
    """Epoch seconds of a number of seconds or milliseconds; what is no time after 1970 is null."""
    t = F.when(~F.isnan(time) & (time > 0) & (time < 1e15), time)
    return F.when(t > 1e12, t / 1000).otherwise(t)


def repaired(rows: DataFrame) -> DataFrame:
    """The newest states with a time for each message and the platform it is calibrated by."""
    m = current_messages(rows, row=F.col("msg_row"), time=seconds(F.col("create_time")), platform=F.lower(F.trim(F.coalesce("platform", F.lit("")))))
    parents = m.select("conv_id", F.col("msg_id").alias("parent"), F.col("time").alias("above")).filter("above is not null")
    earliest = m.groupBy("conv_id").agg(F.min("time").alias("start"))
    whole = m.join(parents, ["conv_id", "parent"], "left").join(earliest, "conv_id")
    return whole.select("conv_id", "msg_id", "row", "speaker", "platform", F.coalesce("time", "above", "start", F.lit(0.0)).alias("time"))


def split_at_gaps(messages: DataFrame, channel: str = "conv_id", quantile: float = GAP_QUANTILE) -> DataFrame:
    """``messages`` with the number of their session in the channel and their block of time."""
    m = messages.withColumn("block", F.floor(F.col("time") / BLOCK_SECONDS))
    inner = W.partitionBy(channel, "block").orderBy("time", "row", "msg_id")
    m = m.withColumn("before", F.lag("time").over(inner))
    ends = m.groupBy(channel, "block").agg(F.min("time").alias("first"), F.max("time").alias("last"))
    ends = ends.withColumn("prior", F.lag("last").over(W.partitionBy(channel).orderBy("block"))).select(channel, "block", "prior")
    m = m.join(ends, [channel, "block"]).withColumn("gap", F.col("time") - F.coalesce("before", "prior"))
    limit = m.filter("gap > 0").groupBy("platform").agg(F.percentile_approx("gap", quantile, 10_000).alias("limit"))
    m = m.join(limit, "platform", "left").withColumn("new", F.coalesce((F.col("gap") > F.col("limit")).cast("int"), F.lit(0)))
    breaks = m.groupBy(channel, "block").agg(F.sum("new").alias("breaks"))
    breaks = breaks.withColumn("offset", F.coalesce(F.sum("breaks").over(W.partitionBy(channel).orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("breaks")
    running = F.sum("new").over(inner.rowsBetween(W.unboundedPreceding, 0))
    return m.join(breaks, [channel, "block"]).withColumn("session", (running + F.col("offset")).cast("bigint"))


def sessionise(rows: DataFrame, quantile: float = GAP_QUANTILE) -> DataFrame:
    """(conv_id, session, pos, msg_id, speaker) of the spoken messages of every session with reciprocal replies, by time and gaps alone."""
    m = split_at_gaps(repaired(rows), quantile=quantile).filter("speaker is not null")
    return _reciprocal(m.select("conv_id", "session", "block", "time", "row", "msg_id", "speaker"), ["conv_id", "session"], ["time", "row", "msg_id"])


def rebuild(rows: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(conv_id, pos, msg_id, speaker) of every spoken message of the sound conversations: sessions by their links."""
    messages = current_messages(rows)
    large = checkpointed(rows.filter("conv_id is not null").groupBy("conv_id").count().filter(F.col("count") > group_rows).select("conv_id"))
    if large.isEmpty():
        return _walk_small(messages)
    return _walk_small(messages.join(large, "conv_id", "left_anti")).unionByName(_walk_large(messages.join(large, "conv_id", "left_semi")))
