"""Queries of the general training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtrace.operators import shredding, timestamps
from loomtrace.plans.sql import as_list
from loomtrace.session import spread, table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "web_data_summary").select("row_id", "conv_id", "time", "platform")
    return timestamps.normalise_times(turns, table(spark, d, "platform_clock")).select("row_id", "utc_us")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return shredding.node_table(spread(table(spark, d, "web_data_summary").select("row_id", "turn_msgs")), "row_id", "turn_msgs")


def p6_tables(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables with their values: one row per value of each list element."""
    return shredding.flat_tables(spread(table(spark, d, "web_data_summary").select("row_id", "turn_msgs")), "row_id", "turn_msgs")


QUERIES = {"p5_found": p5_found, "p6_found": p6_found, "p6_tables": p6_tables}

_LISTS = "('thoughts', 'search_result_groups', 'entries', 'content_references', 'items')"
_CHILD = "(v -> ('$.\"' || k || '\"'))"
ORACLES: dict[str, str] = {
    "p6_found": f"""
WITH RECURSIVE walk AS (
 SELECT row_id, '$' AS path, '$' AS owner, turn_msgs::JSON AS v, false AS element FROM web_data_summary WHERE json_valid(turn_msgs)
 UNION ALL
 SELECT row_id, path || c.step, CASE WHEN element AND json_type(v) = 'OBJECT' THEN path ELSE owner END, c.v, c.element FROM (
  SELECT *, unnest(CASE json_type(v)
   WHEN 'ARRAY' THEN list_transform(range(0, json_array_length(v)::BIGINT), lambda i: {{'step': '[' || i || ']', 'v': v -> ('$[' || i || ']'), 'element': true}})
   WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: {{'step': '.' || k, 'v': CASE WHEN k IN {_LISTS} THEN coalesce(to_json({as_list(_CHILD)}), {_CHILD}) ELSE {_CHILD} END, 'element': false}})
   END) AS c FROM walk))
SELECT row_id, path AS node_path, owner AS parent_path FROM walk WHERE element AND json_type(v) = 'OBJECT'""",
}
