"""Message trees: the path of first children from the start of each conversation.

Conversations of up to ``GROUP_ROWS`` rows are walked one by one. The paths of larger ones are followed by pointer
doubling over joins on single messages, so no task holds a whole one and the number of rounds grows with the logarithm
of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.session import checkpointed

GROUP_ROWS = 20_000


def reach(starts: DataFrame, following: DataFrame) -> DataFrame:
    """(conv_id, msg_id, depth) of all messages on the paths from ``starts`` (conv_id, msg_id) along ``following``
    (conv_id, msg_id, next). Each message may be followed by one and be reached from one only, so paths end."""
    found = checkpointed(starts.select("conv_id", "msg_id", F.lit(0).cast("bigint").alias("depth")))
    jump = checkpointed(following)
    step = 1
    while True:
        more = found.join(jump, ["conv_id", "msg_id"]).select("conv_id", F.col("next").alias("msg_id"), (F.col("depth") + step).alias("depth"))
        more = checkpointed(more)
        if more.isEmpty():
            return found
        found = checkpointed(found.unionByName(more))
        onward = jump.select("conv_id", F.col("msg_id").alias("next"), F.col("next").alias("further"))
        jump = checkpointed(jump.join(onward, ["conv_id", "next"]).select("conv_id", "msg_id", F.col("further").alias("next")))
        step *= 2


def first_children(messages: DataFrame) -> DataFrame:
    """(conv_id, msg_id, next): the child of lowest ``child_no`` (null last, then by msg_id) of each parent."""
    rank = F.struct(F.col("child_no").isNull().alias("n"), F.coalesce("child_no", F.lit(0)).alias("c"), "msg_id")
    first = messages.filter("parent is not null").groupBy("conv_id", "parent").agg(F.min(rank).alias("r"))
    return first.select("conv_id", F.col("parent").alias("msg_id"), F.col("r.msg_id").alias("next"))


def newest(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per (conv_id, msg_id): the state of the highest ``batch_no``, then ``msg_row``; a null, blank or ``root`` parent is none."""
    parent = F.when(F.lower(F.regexp_replace("parent_id", r"^[\p{Z}\p{Cc}]+|[\p{Z}\p{Cc}]+$", "")).isin("", "root"), None).otherwise(F.col("parent_id"))
    state = F.struct("batch_no", "msg_row", parent.alias("parent"), "child_no", *columns)
    best = rows.filter("conv_id is not null and msg_id is not null").groupBy("conv_id", "msg_id").agg(F.max(state).alias("s"))
    return best.select("conv_id", "msg_id", "s.msg_row", "s.parent", "s.child_no", *[f"s.{c}" for c in columns])


def starts(messages: DataFrame) -> DataFrame:
    """The first message (by ``msg_row``) of each conversation whose parent is none or is not in the conversation."""
    ids = messages.select("conv_id", F.col("msg_id").alias("parent"), F.lit(1).alias("there"))
    open_ = messages.join(ids, ["conv_id", "parent"], "left").filter("there is null")
    return open_.groupBy("conv_id").agg(F.min_by("msg_id", "msg_row").alias("msg_id"))


def walk(messages: list[tuple]) -> list[str]:
    """Ids on the path of one conversation. messages: (msg_id, parent, child_no, msg_row)."""
    ids = {m[0] for m in messages}
    open_ = [m for m in messages if m[1] is None or m[1] not in ids]
    if not open_:
        return []
    first: dict[str, tuple] = {}
    for msg, parent, number, _ in messages:
        rank = (number is None or number != number, number or 0, msg)
        if parent is not None and (parent not in first or rank < first[parent]):
            first[parent] = rank
    at = min(open_, key=lambda m: m[3])[0]
    out, seen = [at], {at}
    while at in first and first[at][2] not in seen:
        at = first[at][2]
        seen.add(at)
        out.append(at)
    return out


def _walked(messages: DataFrame) -> DataFrame:
    grouped = messages.groupBy("conv_id").agg(F.collect_list(F.struct("msg_id", "parent", "child_no", "msg_row")).alias("m"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(c, x, i) for c, m in zip(f["conv_id"], f["m"]) for i, x in enumerate(walk([(r["msg_id"], r["parent"], r["child_no"], r["msg_row"]) for r in m]))]
            yield pd.DataFrame(out, columns=["conv_id", "msg_id", "depth"])

    return grouped.mapInPandas(run, "conv_id string, msg_id string, depth bigint")


def _doubled(messages: DataFrame) -> DataFrame:
    m = checkpointed(messages)
    begin = starts(m)
    # what leads back to a start is cut, so that a damaged conversation has an end
    onward = first_children(m).join(begin.select("conv_id", F.col("msg_id").alias("next")), ["conv_id", "next"], "left_anti")
    return reach(begin, onward)


def path(messages: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``messages`` (of ``newest``) on the path of first children with their ``depth``; a message is never entered twice."""
    large = checkpointed(messages.groupBy("conv_id").count().filter(F.col("count") > group_rows).select("conv_id"))
    slim = messages.select("conv_id", "msg_id", "parent", "child_no", "msg_row")
    if large.isEmpty():
        return messages.join(_walked(slim), ["conv_id", "msg_id"])
    depths = _walked(slim.join(large, "conv_id", "left_anti")).unionByName(_doubled(slim.join(large, "conv_id", "left_semi")))
    return messages.join(depths, ["conv_id", "msg_id"])


def role(author: Column) -> Column:
    return F.lower(F.trim(F.coalesce(author, F.lit(""))))
