"""Queries of the training-text problems and, where SQL can express them, their equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtrace.llm import conversations, language, leakage, models, pairs, pii, reading, subjects, tokens
from loomtrace.session import spread, table


def _language_model(spark: SparkSession, d: str) -> language.Model:
    turns = table(spark, d, "web_data_summary").select("row_id", "language", "user_msg_history")
    return models.fitted(spark, "language", lambda: language.trained(table(spark, d, "subject_samples"), table(spark, d, "documents"), turns))


def _openings(spark: SparkSession, turns: DataFrame) -> frozenset[str]:
    return models.fitted(spark, "openings", lambda: pairs.openings(turns))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    turns = spread(table(spark, d, "web_data_summary").select("row_id", "language", "user_msg_history"))
    return language.mislabelled(turns, _language_model(spark, d))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every prompt with its language and confidence."""
    turns = table(spark, d, "web_data_summary").select("row_id", "language", "user_msg_history")
    return language.prompt_segments(turns, _language_model(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    turns = spread(table(spark, d, "web_data_summary").select("row_id", "user_msg_history", "assistant_msg_history"))
    return pairs.defective_pairs(turns, _language_model(spark, d), _openings(spark, turns))


def p2_triggered(spark: SparkSession, d: str) -> DataFrame:
    """Every defect type that a pair triggers, in the order of the rules."""
    turns = spread(table(spark, d, "web_data_summary").select("row_id", "user_msg_history", "assistant_msg_history"))
    return pairs.triggered_pairs(turns, _language_model(spark, d), _openings(spark, turns))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "web_data_summary").select("row_id", "topic", "platform", "user_msg_history")
    model = models.fitted(spark, "subjects", lambda: subjects.trained(table(spark, d, "subject_areas"), table(spark, d, "subject_samples"), table(spark, d, "documents"), turns))
    return subjects.subject_rows(spread(turns), model)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    turns = spread(table(spark, d, "web_data_summary").select("row_id", "user_msg_history", "turn_msgs"))
    return pii.findings(turns, pii.learn(turns))


def p4_sanitised(spark: SparkSession, d: str) -> DataFrame:
    """The texts of both fields with placeholders, one per row, field and position."""
    turns = spread(table(spark, d, "web_data_summary").select("row_id", "user_msg_history", "turn_msgs"))
    return pii.sanitised_texts(turns, pii.learn(turns))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuild(table(spark, d, "turn_messages"))


def p7_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by repaired timestamps and calibrated gaps alone."""
    return conversations.sessionise(table(spark, d, "turn_messages"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(spread(table(spark, d, "documents").select("doc_id", "text")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "reading_samples"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (p1_found, p1_segments, p2_found, p2_triggered, p3_found, p4_found, p4_sanitised, p7_found, p7_sessions, p8_ids, p9_found, p10_found)
    }


def oracle_sql() -> dict[str, str]:
    return {"p7_found": P7_SQL}


P7_SQL = r"""
WITH RECURSIVE ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, msg_id ORDER BY batch_no DESC, msg_row DESC) AS rn
  FROM turn_messages WHERE conv_id IS NOT NULL AND msg_id IS NOT NULL),
m AS (
  SELECT conv_id, msg_id, child_no,
         CASE WHEN parent_id IS NULL OR lower(trim(regexp_replace(parent_id, '[\s\x{00a0}]+', ' ', 'g'))) IN ('', 'root') THEN NULL ELSE parent_id END AS parent,
         CASE WHEN (recipient = 'all' OR recipient IS NULL) AND content_type IN ('text', 'multimodal_text')
                   AND length(regexp_replace(coalesce(body, ''), '[\p{Z}\p{Cc}\p{Cf}]', '', 'g')) > 0
              THEN CASE WHEN lower(trim(author_role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(author_role)) IN ('assistant', 'bot') THEN 'assistant' END END AS speaker
  FROM ranked WHERE rn = 1),
sound AS (
  SELECT m.conv_id FROM m LEFT JOIN m p ON p.conv_id = m.conv_id AND p.msg_id = m.parent
  GROUP BY m.conv_id HAVING count(*) FILTER (WHERE m.parent IS NULL) = 1 AND count(*) FILTER (WHERE m.parent IS NOT NULL AND p.msg_id IS NULL) = 0),
kid AS (SELECT *, row_number() OVER (PARTITION BY conv_id, parent ORDER BY child_no NULLS LAST, msg_id) AS k FROM m WHERE parent IS NOT NULL),
path AS (
  SELECT m.conv_id, m.msg_id, m.speaker, 0 AS depth FROM m JOIN sound USING (conv_id) WHERE m.parent IS NULL
  UNION ALL
  SELECT kid.conv_id, kid.msg_id, kid.speaker, path.depth + 1 FROM path JOIN kid ON kid.conv_id = path.conv_id AND kid.parent = path.msg_id AND kid.k = 1),
spoken AS (
  SELECT conv_id, msg_id, speaker, row_number() OVER w AS pos, lead(speaker) OVER w AS after
  FROM path WHERE speaker IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
good AS (
  SELECT conv_id FROM spoken GROUP BY conv_id
  HAVING min(speaker) FILTER (WHERE pos = 1) = 'user' AND count(*) FILTER (WHERE speaker = 'user' AND coalesce(after, '') <> 'assistant') = 0)
SELECT conv_id, pos, msg_id, speaker FROM spoken JOIN good USING (conv_id)
"""
