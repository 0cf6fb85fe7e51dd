"""Event windows and sessions, run as a batch here; the same functions run on a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.session import table
from loomtrace.streaming import events


def st_daily_windows(spark, d):
    w = events.tumbling(table(spark, d, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", "rate")


def st_user_sessions(spark, d):
    s = events.sessions(table(spark, d, "events"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


ORACLES = {
    "st_daily_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg((event_type = 'error')::INT), 6) AS rate FROM events GROUP BY 1",
    "st_user_sessions": "WITH b AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM b), g AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM g GROUP BY 1",
}
QUERIES = {"st_daily_windows": st_daily_windows, "st_user_sessions": st_user_sessions}
