"""Changes of state of a feed's keys, in the order of event time, whatever order events come in and however often."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "key long, at_micros long, from_status string, to_status string"
STATE = "last string, times array<long>, ids array<long>, statuses array<string>"


def changes(feed: DataFrame) -> DataFrame:
    """(key, at_micros, from_status, to_status) of a table feed(key, at, id, status): each event whose status isn't that of the key's
    event before, by time, then id; the first has none before it. Repeated events count once; rows without key, time, id or status none."""
    rows = feed.where("key IS NOT NULL AND at IS NOT NULL AND id IS NOT NULL AND status IS NOT NULL").dropDuplicates(["key", "at", "id"])
    before = F.lag("status").over(Window.partitionBy("key").orderBy("at", "id"))
    return rows.withColumn("from_status", before).where("NOT from_status <=> status").select("key", F.unix_micros("at").alias("at_micros"), "from_status", F.col("status").alias("to_status"))


def _step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, *pending = state.get if state.exists else (None, [], [], [])
    waiting = set(zip(*pending, strict=True))
    for part in parts:
        waiting |= set(zip(part["micros"].tolist(), part["id"].tolist(), part["status"].tolist(), strict=True))
    mark = state.getCurrentWatermarkMs() * 1000
    out, seen = [], None
    for at, id_, status in sorted(x for x in waiting if x[0] <= mark):
        if (at, id_) != seen and status != last:
            out.append((key[0], at, last, status))
            last = status
        seen = (at, id_)
    kept = sorted(x for x in waiting if x[0] > mark)
    state.update((last, *([x[i] for x in kept] for i in range(3))))
    if kept:
        state.setTimeoutTimestamp(kept[0][0] // 1000 + 1)  # when the watermark passes it, it can be told
    yield pd.DataFrame(out, columns=[f.split()[0] for f in CHANGES.split(", ")])


def changes_as_they_come(feed: DataFrame, late: str = "1 hour") -> DataFrame:
    """changes of a stream. An event is told once the watermark, so much behind the newest event, has passed it, for until then one before
    it may come; later ones are dropped. A key's state is its last status and the events that wait."""
    rows = feed.where("key IS NOT NULL AND at IS NOT NULL AND id IS NOT NULL AND status IS NOT NULL").withWatermark("at", late)
    rows = rows.select("key", "at", F.unix_micros("at").alias("micros"), "id", "status")
    return rows.groupBy("key").applyInPandasWithState(_step, CHANGES, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def settle_counts(pending: DataFrame, results: DataFrame, rows_of: str = "match_id") -> DataFrame:
    """One row (checked, updated, not_finished, errors) for pending(match_id) against results(match_id, home_score, away_score, finished):
    updated have a finished result with both scores, errors a finished one without; the rest aren't finished."""
    known = results.where("finished").groupBy(rows_of).agg(F.max(F.col("home_score").isNotNull() & F.col("away_score").isNotNull()).alias("scored"))
    met = pending.join(known, rows_of, "left")
    n = lambda c, name: F.count_if(c).alias(name)
    return met.agg(F.count("*").alias("checked"), n(F.col("scored"), "updated"), n(F.col("scored").isNull(), "not_finished"), n(~F.col("scored"), "errors"))


def _feed(t) -> DataFrame:
    return t.events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("status"))


QUERIES = {
    "status_changes": (
        lambda t: changes(_feed(t)),
        """SELECT key, epoch_us(ts) AS at_micros, from_status, to_status FROM (SELECT user_id AS key, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_status, event_type AS to_status
 FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL AND event_type IS NOT NULL) e WHERE from_status IS DISTINCT FROM to_status""",
    ),
    "settle_counts": (
        lambda t: settle_counts(t.predictions.where("qualifies").select(F.col("id").alias("match_id")), t.matches.select("match_id", F.when(F.col("h") % 7 != 0, F.col("home_score")).alias("home_score"), "away_score", F.col("actual_result").isNotNull().alias("finished"))),
        """SELECT COUNT(*) AS checked, COUNT(CASE WHEN actual_result IS NOT NULL AND h % 7 <> 0 THEN 1 END) AS updated, COUNT(CASE WHEN actual_result IS NULL THEN 1 END) AS not_finished, COUNT(CASE WHEN actual_result IS NOT NULL AND h % 7 = 0 THEN 1 END) AS errors
 FROM (SELECT m.actual_result, m.h FROM <predictions> p JOIN <matches> m ON m.match_id = p.id WHERE p.qualifies) x""",
    ),
}
