"""Filters by sport and lists of the longest odds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .form import BY_TEAM, by_team
from .tennis import _OLD, _WITH, histories, older_of

# Thresholds by sport (confidence, tip probability, head-to-head rate, least and most odds, advanced score, whether the form
# of both sides must be known); None doesn't apply.
RULES = {
    "football": (75, 55, 60, 1.80, 3.50, None, False),
    "basketball": (70, 60, 60, 1.70, 4.00, None, False),
    "volleyball": (70, None, 70, None, None, None, True),
    "tennis": (65, None, None, None, None, 50, False),
    "handball": (70, None, 65, None, None, None, False),
    "rugby": (70, None, 65, None, None, None, False),
    "hockey": (70, 60, 60, None, None, None, False),
}


def sport_rules(predictions: DataFrame, rules: dict[str, tuple] = RULES, form_known: Column | None = None, advanced_score: Column | None = None) -> DataFrame:
    """Predictions that meet all thresholds of their sport: what is missing meets its threshold, but for form where it is required
    (form_known: whether both sides have some). A sport without rules passes. The rules are one broadcast row for each sport."""
    schema = "rule_sport string, confidence double, tip double, rate double, least double, most double, advanced double, needs_form boolean"
    table = predictions.sparkSession.createDataFrame([(s, *(None if x is None else float(x) for x in v[:-1]), v[-1]) for s, v in rules.items()], schema)
    odds = F.when(F.col("focus_team") == "home", F.col("tip_home_odds")).otherwise(F.col("tip_away_odds")).cast("double")
    score = F.lit(None).cast("double") if advanced_score is None else advanced_score
    known = F.lit(True) if form_known is None else form_known
    fails = lambda test: F.coalesce(test, F.lit(False))
    joined = predictions.withColumns({"focus_odds": odds, "score": score, "known": known}).join(F.broadcast(table), F.col("sport") == F.col("rule_sport"), "left")
    failed = fails(F.col("advice_confidence") < F.col("confidence")) | fails(F.col("tip_probability") < F.col("tip")) | fails(F.col("h2h_win_rate") < F.col("rate")) | fails((F.col("focus_odds") < F.col("least")) | (F.col("focus_odds") > F.col("most"))) | fails(F.col("score") < F.col("advanced")) | (fails(F.col("needs_form")) & ~F.col("known"))
    return joined.where(~failed).select("id", "sport", "advice_confidence", "tip_probability", "h2h_win_rate")


def ruled(matches: DataFrame, predictions: DataFrame) -> DataFrame:
    """sport_rules with what the matches tell: both teams had a finished match of the sport before (form), and the older tennis model's
    score, in size."""
    first = by_team(matches).groupBy("sport", "team").agg(F.min(F.struct("match_date", "match_id")).alias("first"))
    side = lambda c: first.select(F.col("sport").alias(f"{c}_sport"), F.col("team").alias(f"{c}_name"), F.col("first").alias(f"{c}_first"))
    scores = older_of(histories(matches)).select(F.col("match_id").alias("score_id"), F.abs("total_score").alias("advanced_score"))
    got = predictions.join(scores, F.col("id") == F.col("score_id"), "left")
    for c in ("home", "away"):
        got = got.join(side(c), (F.col("sport") == F.col(f"{c}_sport")) & (F.col(f"{c}_team") == F.col(f"{c}_name")), "left")
    known = F.lit(True)
    for c in ("home", "away"):
        known = known & F.coalesce(F.col(f"{c}_first") < F.struct("match_date", F.col("id").alias("match_id")), F.lit(False))
    return sport_rules(got, form_known=known, advanced_score=F.col("advanced_score"))


def longest_odds(predictions: DataFrame, n: int = 15) -> DataFrame:
    """The n qualified predictions with the longest odds above 0 of each outcome; ties go to the smaller id. Each task keeps its own n
    first, so an outcome's odds are never gathered."""
    each = F.explode(F.array(*(F.struct(F.lit(o).alias("outcome"), F.col(f"tip_{o}_odds").alias("odds")) for o in ("home", "draw", "away")))).alias("e")
    rows = predictions.where("qualifies").select("id", each).select("id", "e.*").where("odds > 0")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("outcome").orderBy(F.desc("odds"), "id"))).where(F.col("rank") <= n).select("outcome", "rank", "id", F.col("odds").cast("double").alias("odds"))


QUERIES = {
    "sport_rules": (
        lambda t: ruled(t.matches, t.predictions),
        f"""{_WITH}, {_OLD}, firsts AS (SELECT sport, team, MIN(match_date) AS d FROM {BY_TEAM} t GROUP BY sport, team), first_ids AS (SELECT t.sport, t.team, f.d, MIN(t.match_id) AS i FROM {BY_TEAM} t JOIN firsts f ON f.sport = t.sport AND f.team = t.team AND f.d = t.match_date GROUP BY t.sport, t.team, f.d)
 SELECT id, sport, advice_confidence, tip_probability, h2h_win_rate FROM (SELECT p.*, CASE WHEN focus_team = 'home' THEN tip_home_odds ELSE tip_away_odds END AS odds, ABS(o.total) AS score,
  COALESCE((x.d, x.i) < (p.match_date, p.id), FALSE) AND COALESCE((y.d, y.i) < (p.match_date, p.id), FALSE) AS known FROM <predictions> p LEFT JOIN old o ON o.match_id = p.id
  LEFT JOIN first_ids x ON x.sport = p.sport AND x.team = p.home_team LEFT JOIN first_ids y ON y.sport = p.sport AND y.team = p.away_team) q WHERE CASE sport
 WHEN 'football' THEN COALESCE(advice_confidence >= 75, TRUE) AND COALESCE(tip_probability >= 55, TRUE) AND COALESCE(h2h_win_rate >= 60, TRUE) AND COALESCE(odds BETWEEN 1.80 AND 3.50, TRUE)
 WHEN 'basketball' THEN COALESCE(advice_confidence >= 70, TRUE) AND COALESCE(tip_probability >= 60, TRUE) AND COALESCE(h2h_win_rate >= 60, TRUE) AND COALESCE(odds BETWEEN 1.70 AND 4.00, TRUE)
 WHEN 'volleyball' THEN COALESCE(advice_confidence >= 70, TRUE) AND COALESCE(h2h_win_rate >= 70, TRUE) AND known WHEN 'tennis' THEN COALESCE(advice_confidence >= 65, TRUE) AND COALESCE(score >= 50, TRUE)
 WHEN 'handball' THEN COALESCE(advice_confidence >= 70, TRUE) AND COALESCE(h2h_win_rate >= 65, TRUE) WHEN 'rugby' THEN COALESCE(advice_confidence >= 70, TRUE) AND COALESCE(h2h_win_rate >= 65, TRUE)
 WHEN 'hockey' THEN COALESCE(advice_confidence >= 70, TRUE) AND COALESCE(tip_probability >= 60, TRUE) AND COALESCE(h2h_win_rate >= 60, TRUE) ELSE TRUE END""",
    ),
    "longest_odds": (
        lambda t: longest_odds(t.predictions),
        """SELECT outcome, CAST(rank AS INTEGER) AS rank, id, CAST(odds AS DOUBLE) AS odds FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY outcome ORDER BY odds DESC, id) AS rank FROM (
 SELECT o.outcome, id, CASE o.outcome WHEN 'home' THEN tip_home_odds WHEN 'draw' THEN tip_draw_odds ELSE tip_away_odds END AS odds FROM <predictions> p CROSS JOIN (VALUES ('home'), ('draw'), ('away')) AS o(outcome) WHERE qualifies) x WHERE odds > 0) y WHERE rank <= 15""",
    ),
}
