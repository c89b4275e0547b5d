"""The live feed's operators, run over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import live


def hourly(events: DataFrame) -> DataFrame:
    """Of each user and hour the newest event (ties: the largest event_id) and how many there were."""
    rows = events.select("user_id", "ts", "event_id", "event_type", "value")
    got = live.latest(rows, "user_id")
    return got.select("window_start", "user_id", "last_ts", "n", F.col("last.event_id").alias("event_id"), F.col("last.event_type").alias("event_type"), F.col("last.value").alias("value"))


QUERIES = {
    "latest_by_hour": (
        lambda t: hourly(t.events),
        """SELECT window_start, user_id, ts AS last_ts, n, event_id, event_type, value FROM (SELECT *, COUNT(*) OVER (PARTITION BY user_id, window_start) AS n,
 ROW_NUMBER() OVER (PARTITION BY user_id, window_start ORDER BY ts DESC, event_id DESC) AS k FROM (SELECT *, date_trunc('hour', ts) AS window_start FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) e) x WHERE k = 1""",
    ),
}
