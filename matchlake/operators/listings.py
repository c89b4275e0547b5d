"""Counts and lists that a front page shows: by sport, by day, by result, upcoming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sport_counts(predictions: DataFrame) -> DataFrame:
    """Predictions of each sport and of all: total, qualified, with a result, with a fan vote."""
    got = predictions.rollup("sport").agg(F.count("*").alias("total"), F.count(F.when(F.col("qualifies"), 1)).alias("qualified"), F.count("actual_result").alias("with_result"), F.count("fan_home_win_prob").alias("with_votes"))
    return got.withColumn("sport", F.coalesce("sport", F.lit("all")))


def result_split(predictions: DataFrame) -> DataFrame:
    """Results of each sport by outcome."""
    of = lambda r, name: F.count(F.when(F.col("actual_result") == r, 1)).alias(name)
    return predictions.groupBy("sport").agg(of("1", "home"), of("X", "draw"), of("2", "away"))


def window(predictions: DataFrame, as_of: str, before: int, after: int) -> DataFrame:
    """Qualified predictions from `before` days ahead of as_of to `after` days behind it."""
    day = F.expr(as_of)
    return predictions.where(F.col("qualifies") & F.col("match_date").between(F.date_sub(day, before), F.date_add(day, after))).select("id", "match_date", "match_time", "sport", "home_team", "away_team")


def calendar(predictions: DataFrame) -> DataFrame:
    """Each day: predictions, qualified ones, and whether at least half qualify."""
    got = predictions.groupBy("match_date").agg(F.count("*").alias("total"), F.count(F.when(F.col("qualifies"), 1)).alias("qualified"))
    return got.withColumn("good_day", F.col("qualified") * 2 >= F.col("total"))


def search(predictions: DataFrame, text: str) -> DataFrame:
    """Predictions whose teams or league contain text, in any case."""
    return predictions.where(F.lower(F.concat_ws(" ", "home_team", "away_team", "league")).contains(text.lower())).select("id", "home_team", "away_team", "league")


_AS_OF = "DATE '2001-08-01'"
QUERIES = {
    "sport_counts": (
        lambda t: sport_counts(t.predictions),
        "SELECT COALESCE(sport, 'all') AS sport, COUNT(*) AS total, COUNT(CASE WHEN qualifies THEN 1 END) AS qualified, COUNT(actual_result) AS with_result, COUNT(fan_home_win_prob) AS with_votes FROM <predictions> p GROUP BY ROLLUP (sport)",
    ),
    "result_split": (
        lambda t: result_split(t.predictions),
        "SELECT sport, COUNT(CASE WHEN actual_result = '1' THEN 1 END) AS home, COUNT(CASE WHEN actual_result = 'X' THEN 1 END) AS draw, COUNT(CASE WHEN actual_result = '2' THEN 1 END) AS away FROM <predictions> p GROUP BY sport",
    ),
    "recent_qualified": (
        lambda t: window(t.predictions, _AS_OF, 7, 0),
        "SELECT id, match_date, match_time, sport, home_team, away_team FROM <predictions> p WHERE qualifies AND match_date BETWEEN <as_of> - INTERVAL '7 days' AND <as_of>",
    ),
    "calendar_days": (
        lambda t: calendar(t.predictions),
        "SELECT match_date, COUNT(*) AS total, COUNT(CASE WHEN qualifies THEN 1 END) AS qualified, COUNT(CASE WHEN qualifies THEN 1 END) * 2 >= COUNT(*) AS good_day FROM <predictions> p GROUP BY match_date",
    ),
    "team_search": (
        lambda t: search(t.predictions, "münchen"),
        "SELECT id, home_team, away_team, league FROM <predictions> p WHERE contains(lower(home_team || ' ' || away_team || ' ' || league), 'münchen')",
    ),
}
