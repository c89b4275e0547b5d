"""Accuracy and return of the sources that pick a winner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

D = "decimal(18,2)"


def picks(predictions: DataFrame) -> DataFrame:
    """A row for each source and settled prediction: source, pick (null: abstains), odds, actual_result.

    H2H rates of 60 or more pick the home side; the fan vote picks its largest share, ties in the order 1, X, 2, with odds 1 for X.
    """
    h, x, a = (F.coalesce(f"fan_{c}", F.lit(-1)) for c in ("home_win_prob", "draw_prob", "away_win_prob"))
    fans = F.when(F.col("fan_home_win_prob").isNull(), None).when((h >= x) & (h >= a), "1").when(x >= a, "X").otherwise("2")
    home, draw, away = (F.coalesce(F.col(f"tip_{c}_odds"), F.lit(1)).cast(D) for c in ("home", "draw", "away"))
    rate = F.when(F.col("h2h_win_rate") >= 60, "1")
    advice = F.when(F.col("advice_recommendation").isin("HIGH", "LOCK"), F.when(F.col("focus_team") == "away", "2").otherwise("1"))
    by = {"tips": F.col("tip_prediction"), "fans": fans, "h2h": rate, "advice": advice}
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("source"), p.alias("pick")) for s, p in by.items())))
    settled = predictions.where(F.col("actual_result").isNotNull())
    got = settled.select(each.alias("e"), home.alias("h"), draw.alias("x"), away.alias("a"), "actual_result", "sport", "match_date")
    odds = F.when(F.col("e.pick") == "1", F.col("h")).when(F.col("e.pick") == "2", F.col("a")).when((F.col("e.pick") == "X") & (F.col("e.source") != "fans"), F.col("x")).otherwise(F.lit(1).cast(D))
    return got.select("e.source", "e.pick", odds.alias("odds"), "actual_result", "sport", "match_date")


def by_source(predictions: DataFrame, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """Per source: settled rows, picks made, right ones, accuracy over all settled rows, profit of flat unit stakes, return on them."""
    hit, made = F.col("pick") == F.col("actual_result"), F.col("pick").isNotNull()
    got = picks(predictions).groupBy(*keys).agg(F.count("*").alias("total"), F.count("pick").alias("n_picked"), F.count(F.when(hit, 1)).alias("correct"), F.sum(F.when(hit, F.col("odds") - 1).when(made, -1).otherwise(0).cast(D)).cast("double").alias("profit"))
    return got.select(*keys, "total", "n_picked", "correct", (F.col("correct") * 100.0 / F.col("total")).cast("double").alias("accuracy"), F.when(F.col("n_picked") > 0, F.col("profit") * 100.0 / F.col("n_picked")).cast("double").alias("roi"), "profit")


PICKS_SQL = """(SELECT source, pick, actual_result, sport, match_date, CASE WHEN pick = '1' THEN h WHEN pick = '2' THEN a WHEN pick = 'X' AND source <> 'fans' THEN x ELSE 1 END AS odds FROM (
 SELECT p.*, s.source, COALESCE(tip_home_odds, 1) AS h, COALESCE(tip_draw_odds, 1) AS x, COALESCE(tip_away_odds, 1) AS a,
 CASE s.source WHEN 'tips' THEN tip_prediction
  WHEN 'fans' THEN CASE WHEN fan_home_win_prob IS NULL THEN NULL WHEN fan_home_win_prob >= fan_draw_prob AND fan_home_win_prob >= fan_away_win_prob THEN '1' WHEN fan_draw_prob >= fan_away_win_prob THEN 'X' ELSE '2' END
  WHEN 'h2h' THEN CASE WHEN h2h_win_rate >= 60 THEN '1' END
  ELSE CASE WHEN advice_recommendation IN ('HIGH', 'LOCK') THEN CASE WHEN focus_team = 'away' THEN '2' ELSE '1' END END END AS pick
 FROM <predictions> p CROSS JOIN (VALUES ('tips'), ('fans'), ('h2h'), ('advice')) AS s(source) WHERE actual_result IS NOT NULL) q) z"""


def _sql(keys: str) -> str:
    return f"""SELECT {keys}, total, n_picked, correct, CAST(correct * 100.0 / total AS DOUBLE) AS accuracy, CASE WHEN n_picked > 0 THEN profit * 100.0 / n_picked END AS roi, profit FROM (
 SELECT {keys}, COUNT(*) AS total, COUNT(pick) AS n_picked, COUNT(CASE WHEN pick = actual_result THEN 1 END) AS correct,
 CAST(SUM(CAST(CASE WHEN pick = actual_result THEN odds - 1 WHEN pick IS NOT NULL THEN -1 ELSE 0 END AS DECIMAL(18,2))) AS DOUBLE) AS profit FROM {PICKS_SQL} GROUP BY {keys}) g"""


QUERIES = {
    "source_accuracy": (lambda t: by_source(t.predictions), _sql("source")),
    "source_accuracy_by_sport": (lambda t: by_source(t.predictions, ("source", "sport")), _sql("source, sport")),
}
