"""Live feeds as streams: the latest state of each key, repeated lookups dropped, and results that settle what is pending."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(feed: DataFrame, key: str, ts: str = "ts", late: str = "30 seconds", every: str = "1 hour") -> DataFrame:
    """(window_start, key, last_ts, n, last row as struct): for each key and window of event time its newest row; rows later than `late`
    are dropped, and a window's state goes once it is past. Runs in update or append mode, and on tables. Of a stream, ts must be a timestamp, which one without a time zone isn't."""
    others = [c for c in feed.columns if c not in (key, ts)]
    w = F.window(ts, every)
    got = feed.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    return got.groupBy(w.alias("w"), key).agg(F.max(ts).alias("last_ts"), F.count("*").alias("n"), F.max_by(F.struct(*others), F.struct(ts, *others)).alias("last")).select(F.col("w.start").alias("window_start"), key, "last_ts", "n", "last")


def once(feed: DataFrame, keys: list[str], ts: str = "ts", ttl: str = "30 minutes") -> DataFrame:
    """The first lookup of each key within ttl; a stream only."""
    return feed.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def with_live(feed: DataFrame, matches: DataFrame) -> DataFrame:
    """A stream of scores (home_team, away_team, ...) joined to a table of matches by both names in lower case."""
    names = [F.lower(f"{s}_team").alias(f"_{s}") for s in ("home", "away")]
    return feed.select("*", *names).drop("home_team", "away_team").join(matches.select("match_id", *names), ["_home", "_away"]).drop("_home", "_away")


def settle_each(apply: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: gives apply a batch's finished matches, one row each, the newest by ts. apply must be safe to repeat for a batch
    number, since a batch runs again after a failure."""

    def run(batch: DataFrame, number: int) -> None:
        finished = batch.where("actual_result IS NOT NULL").groupBy("match_id").agg(F.max_by("actual_result", F.struct("ts", "actual_result")).alias("actual_result"))
        apply(finished, number)

    return run
