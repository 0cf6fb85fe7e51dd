"""Conversation exports of four platforms as turns: ordering, segmentation, features and topics."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PLATFORMS = ("chatgpt", "claude", "grok", "deepseek")
MESSAGE = "msg_id string, role string, name string, recipient string, content_type string, body string, create_time double, end_turn boolean, reasoning_status string, model string"


def seconds(value, platform: str | None = None) -> float | None:
    """Epoch seconds of an export's time: number in s or ms, ISO text (offset cut off) or a BSON date."""
    if platform is not None and platform not in PLATFORMS:
        raise ValueError(f"unknown platform {platform}")
    if isinstance(value, dict):
        inner = value.get("$date", value)
        value = inner.get("$numberLong") if isinstance(inner, dict) else inner
    if value is None or isinstance(value, bool):
        return None
    if isinstance(value, str):
        try:
            value = float(value)
        except ValueError:
            try:
                return datetime.fromisoformat(value.replace("Z", "+00:00")).replace(tzinfo=timezone.utc).timestamp()
            except ValueError:
                return None
    return value / 1000 if value > 1e12 else float(value)


def root_of(mapping: dict) -> str | None:
    """First node, in order of the export, without a parent in the tree."""
    for key, node in mapping.items():
        parent = (node or {}).get("parent")
        if parent is None or parent == "root" or parent not in mapping:
            return key
    return None


def first_child_path(mapping: dict) -> list[dict]:
    """Messages on the path of first children; nodes without message are passed, a missing or repeated id ends it."""
    out, at, seen = [], root_of(mapping), set()
    while at is not None and at in mapping and at not in seen:
        seen.add(at)
        node = mapping[at] or {}
        if node.get("message"):
            out.append(node["message"])
        children = node.get("children") or []
        at = children[0] if children else None
    return out


def _text(content) -> str:
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return "\n".join(x for c in content if (x := _text(c)))
    if isinstance(content, dict):
        return _text(content.get("parts") or content.get("text") or content.get("content") or "")
    return ""


def _row(m: dict, role=None, body=None, at=None) -> tuple:
    author, meta = m.get("author") or {}, m.get("metadata") or {}
    content = m.get("content")
    kind = content.get("content_type") if isinstance(content, dict) else None
    return (
        m.get("id") or m.get("uuid"), role or author.get("role"), author.get("name"), m.get("recipient"), kind, _text(content) if body is None else body,
        seconds(m.get("create_time")) if at is None else at, m.get("end_turn"), meta.get("reasoning_status"), meta.get("model_slug"),
    )


def ordered_messages(platform: str, conversation: dict) -> list[tuple]:
    """Messages of one conversation in reading order."""
    if platform == "chatgpt":
        return [_row(m) for m in first_child_path(conversation.get("mapping") or {})]
    if platform == "deepseek":
        return [_row(m, body="") for m in first_child_path(conversation.get("mapping") or {})]
    if platform == "claude":
        rows = []
        for m in conversation.get("chat_messages") or []:
            blocks = [b.get("text") for b in m.get("content") or [] if isinstance(b, dict) and b.get("type") == "text" and b.get("text")]
            rows.append(_row({"id": m.get("uuid")}, role=m.get("sender"), body="\n".join(blocks) if blocks else m.get("text") or "", at=seconds(m.get("created_at"))))
        return rows
    if platform == "grok":
        found = [r.get("response", r) for r in conversation.get("responses") or []]
        found.sort(key=lambda r: seconds(r.get("create_time")) or 0.0)
        return [_row({"id": r.get("_id")}, role=r.get("sender"), body=r.get("message") or "", at=seconds(r.get("create_time"))) for r in found]
    raise ValueError(f"unknown platform {platform}")


def messages_of(exports: DataFrame) -> DataFrame:
    """(platform, conv_id, pos, message fields) from exports (platform, conv_id, conversation JSON); broken JSON gives nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["platform", "conv_id", "pos", *[c.split()[0] for c in MESSAGE.split(", ")]]
        for f in frames:
            out = []
            for p, c, j in f[["platform", "conv_id", "conversation"]].itertuples(index=False, name=None):
                try:
                    v = json.loads(j)
                except (TypeError, ValueError):
                    continue
                out += [(p, c, i, *r) for i, r in enumerate(ordered_messages(p, v))]
            yield pd.DataFrame(out, columns=columns)

    return exports.select("platform", "conv_id", "conversation").mapInPandas(run, "platform string, conv_id string, pos int, " + MESSAGE)


def turns_of(messages: DataFrame) -> DataFrame:
    """Turns closed by ``end_turn``; system messages are passed over and an open tail is left out."""
    m = messages.filter("role is null or role <> 'system'")
    w = W.partitionBy("platform", "conv_id").orderBy("pos")
    end = F.coalesce(F.col("end_turn"), F.lit(False)).cast("int")
    m = m.withColumn("turn_no", F.coalesce(F.sum(end).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", "role").alias("who"), "role", "recipient", "create_time", "msg_id", "reasoning_status", "model")))
    g = m.groupBy("platform", "conv_id", "turn_no").agg(x.alias("x"), F.max(end).alias("closed")).filter("closed = 1")
    return g.select(
        "platform", "conv_id", "turn_no",
        F.element_at("x", -1)["msg_id"].alias("turn_id"),
        (F.col("turn_no") == 0).cast("int").alias("conv_starter"),
        F.transform("x", lambda a: F.concat_ws(":", a["who"], F.coalesce(a["recipient"], F.lit("all")))).alias("interactions"),
        F.transform(F.filter("x", lambda a: a["create_time"].isNotNull() & (a["role"] == "assistant") & (F.coalesce(a["recipient"], F.lit("all")) != "all")), lambda a: a["recipient"]).alias("tools"),
        F.exists("x", lambda a: F.coalesce(a["reasoning_status"], F.lit("")) != "").cast("int").alias("reasoning"),
        F.transform("x", lambda a: a["model"]).alias("models"),
        F.timestamp_seconds(F.element_at("x", -1)["create_time"]).alias("time"),
    )


def resolve_topic(labels: list | None, per_turn: list | None) -> str:
    """Other without labels, the label itself, or of several the commonest turn topic (earliest on a tie), else the first label."""
    labels = [x for x in labels or [] if x]
    if len(labels) <= 1:
        return labels[0] if labels else "Other"
    said = [t for t in per_turn or [] if t]
    if not said:
        return labels[0]
    counts = Counter(said)
    return max(counts, key=lambda t: (counts[t], -said.index(t)))


def attach_topics(turns: DataFrame, topics: DataFrame) -> DataFrame:
    """Left join of conversation topics; missing ones are Other. Of repeated conversations the row
    with the highest ``ord`` holds, without that column the greatest topic."""
    from loomtrace.functions.coerce import or_other

    last = F.max_by("topic", "ord") if "ord" in topics.columns else F.max("topic")
    one = topics.groupBy("conv_id").agg(last.alias("topic"))
    return turns.drop("topic").join(one, "conv_id", "left").withColumn("topic", or_other(F.col("topic")))
