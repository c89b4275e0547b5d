"""Picks: strategy filters, their ranking, consensus of sources, and value against odds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# Strategies with their priorities, in the order in which they are listed; two share the first.
PRIORITIES = (("BEST_PICK", 1), ("HIGH_CONFIDENCE", 2), ("VALUE_PLAY", 3), ("LOCKED_PICK", 1))


def matched(predictions: DataFrame) -> DataFrame:
    """A row for each strategy that a prediction meets: advice HIGH with confidence, rate and tip; sheer confidence; value on the guests'
    side; or a dominant rate with any advice but SKIP, none included. A missing tip or missing odds meet theirs."""
    c, r, p, advice = F.col("advice_confidence"), F.col("h2h_win_rate"), F.col("tip_probability"), F.col("advice_recommendation")
    tests = {
        "BEST_PICK": (advice == "HIGH") & (c >= 80) & (r >= 60) & ((p > 60) | p.isNull()),
        "HIGH_CONFIDENCE": (c >= 85) & advice.isin("HIGH", "MEDIUM"),
        "VALUE_PLAY": (F.col("focus_team") == "away") & (c >= 70) & (r >= 60) & (F.col("tip_away_odds").isNull() | F.col("tip_away_odds").between(1.80, 3.50)),
        "LOCKED_PICK": (r >= 80) & (c >= 70) & ~advice.eqNullSafe("SKIP") & ((p >= 65) | p.isNull()),
    }
    met = F.array(*(F.when(tests[s], F.struct(F.lit(s).alias("strategy"), F.lit(n).alias("priority"), F.lit(i).alias("place"))) for i, (s, n) in enumerate(PRIORITIES)))
    return predictions.select("*", F.explode(F.filter(met, lambda x: x.isNotNull())).alias("m")).select(*predictions.columns, "m.*")


def strategies(predictions: DataFrame) -> DataFrame:
    """Of each address, the strategy of least priority, of equal ones the first listed."""
    first = Window.partitionBy("match_url").orderBy("priority", "place", "id")
    got = matched(predictions).withColumn("n", F.row_number().over(first)).where("n = 1")
    return got.select("id", "match_url", "sport", "strategy", "priority", "advice_confidence")


def top_by_sport(predictions: DataFrame, n: int = 10) -> DataFrame:
    """The n best picks of each sport, ranked by priority, confidence and address."""
    order = Window.partitionBy("sport").orderBy("priority", F.desc("advice_confidence"), "match_url")
    return strategies(predictions).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def consensus(predictions: DataFrame, at_least: int = 3, since: str | None = None) -> DataFrame:
    """Qualified predictions (from `since` on) on which at_least sources agree about the home side: how many and which. Fans agree if
    their votes for the home side are more than for the guests."""
    votes = {"h2h": F.col("h2h_win_rate") >= 60, "tips": F.col("tip_prediction") == "1", "fans": F.col("fan_home_win_prob") > F.col("fan_away_win_prob"), "advice": F.col("advice_recommendation").isin("HIGH", "LOCK")}
    agree = F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in votes.items())), lambda x: x.isNotNull())
    rows = predictions.where("qualifies") if since is None else predictions.where(F.col("qualifies") & (F.col("match_date") >= F.expr(since)))
    return rows.select("id", F.size(agree).alias("n_agree"), F.array_join(agree, ",").alias("sources")).where(F.col("n_agree") >= at_least)


def blended(predictions: DataFrame) -> DataFrame:
    """predictions with p1, px and p2, which add up to 1: means over the sources that speak. A tip gives its outcome its probability and
    splits the rest; fans give their shares (0.25 for a missing or zero draw, 0.35 for guests); the rate of past meetings (50 where
    unknown, none where 0) counts for the focus side, 1 - rate - 0.1 for the other, 0.25 for a draw."""
    tip, p = F.col("tip_prediction"), F.coalesce("tip_probability", F.lit(50)) / 100
    home, draw, away = (F.col(f"fan_{s}") / 100 for s in ("home_win_prob", "draw_prob", "away_win_prob"))
    fans = F.col("fan_home_win_prob") > 0
    rate, focus = F.coalesce("h2h_win_rate", F.lit(50)) / 100, F.coalesce("focus_team", F.lit("home")) == "home"
    past = rate > 0
    or_ = lambda x, default: F.when(x > 0, x).otherwise(default)
    sources = {
        "p1": (F.when(tip == "1", p).when(tip == "2", (1 - p) * 0.6).when(tip == "X", (1 - p) * 0.5), F.when(fans, home), F.when(past, F.when(focus, rate).otherwise(1 - rate - 0.1))),
        "px": (F.when(tip == "X", p).when(tip.isNotNull(), (1 - p) * 0.4), F.when(fans, or_(draw, 0.25)), F.when(past, 0.25)),
        "p2": (F.when(tip == "2", p).when(tip == "1", (1 - p) * 0.6).when(tip == "X", (1 - p) * 0.5), F.when(fans, or_(away, 0.35)), F.when(past, F.when(focus, 1 - rate - 0.1).otherwise(rate))),
    }
    mean = lambda xs: F.coalesce(sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0)) / F.nullif(sum((x.isNotNull().cast("int") for x in xs), F.lit(0)), F.lit(0)), F.lit(0.33))
    got = predictions.withColumns({k: mean(xs) for k, xs in sources.items()})
    total = F.col("p1") + F.col("px") + F.col("p2")
    return got.withColumns({k: F.when(total > 0, F.col(k) / total).otherwise(F.col(k)) for k in sources})


def value_bets(predictions: DataFrame, min_edge: float = 0.02) -> DataFrame:
    """Outcomes whose blended probability beats the odds' by min_edge: edge, expected value of a unit stake."""
    of = lambda o, p, odds: F.struct(F.lit(o).alias("outcome"), F.col(p).alias("probability"), F.col(odds).cast("double").alias("odds"))
    each = F.explode(F.array(of("1", "p1", "tip_home_odds"), of("X", "px", "tip_draw_odds"), of("2", "p2", "tip_away_odds")))
    got = blended(predictions).select("id", each.alias("e")).select("id", "e.*").where((F.col("odds") > 0) & (F.col("odds") <= 100))
    got = got.withColumns({"edge": F.col("probability") - 1 / F.col("odds"), "ev": F.col("probability") * F.col("odds") - 1})
    return got.where(F.col("edge") >= min_edge).select("id", "outcome", "odds", "edge", "ev")


_MET = """(SELECT id, match_url, sport, advice_confidence, s.strategy, s.priority, s.place FROM <predictions> p JOIN (VALUES ('BEST_PICK', 1, 0), ('HIGH_CONFIDENCE', 2, 1), ('VALUE_PLAY', 3, 2), ('LOCKED_PICK', 1, 3)) AS s(strategy, priority, place) ON CASE s.strategy
 WHEN 'BEST_PICK' THEN advice_recommendation = 'HIGH' AND advice_confidence >= 80 AND h2h_win_rate >= 60 AND (tip_probability > 60 OR tip_probability IS NULL)
 WHEN 'HIGH_CONFIDENCE' THEN advice_confidence >= 85 AND advice_recommendation IN ('HIGH', 'MEDIUM')
 WHEN 'VALUE_PLAY' THEN focus_team = 'away' AND advice_confidence >= 70 AND h2h_win_rate >= 60 AND (tip_away_odds IS NULL OR (tip_away_odds >= 1.80 AND tip_away_odds <= 3.50))
 ELSE h2h_win_rate >= 80 AND advice_confidence >= 70 AND advice_recommendation IS DISTINCT FROM 'SKIP' AND (tip_probability >= 65 OR tip_probability IS NULL) END)"""
_STRATEGY = f"SELECT id, match_url, sport, strategy, priority, advice_confidence FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_url ORDER BY priority, place, id) AS n FROM {_MET} m) k WHERE n = 1"
# sums in the same order as the columns above, so that both round alike
_MEAN = lambda k: f"CASE WHEN a{k} IS NULL AND b{k} IS NULL AND c{k} IS NULL THEN 0.33::DOUBLE ELSE (COALESCE(a{k}, 0) + COALESCE(b{k}, 0) + COALESCE(c{k}, 0)) / (CAST(a{k} IS NOT NULL AS INTEGER) + CAST(b{k} IS NOT NULL AS INTEGER) + CAST(c{k} IS NOT NULL AS INTEGER)) END AS m{k}"
_MEANS = f"""(SELECT *, CASE WHEN t > 0 THEN m1 / t ELSE m1 END AS p1, CASE WHEN t > 0 THEN mx / t ELSE mx END AS px, CASE WHEN t > 0 THEN m2 / t ELSE m2 END AS p2 FROM (SELECT *, m1 + mx + m2 AS t FROM (
 SELECT id, tip_home_odds, tip_draw_odds, tip_away_odds, {_MEAN("1")}, {_MEAN("x")}, {_MEAN("2")} FROM (SELECT id, tip_home_odds, tip_draw_odds, tip_away_odds,
  CASE tip_prediction WHEN '1' THEN q WHEN '2' THEN (1 - q) * 0.6::DOUBLE WHEN 'X' THEN (1 - q) * 0.5::DOUBLE END AS a1, CASE tip_prediction WHEN 'X' THEN q WHEN '1' THEN (1 - q) * 0.4::DOUBLE WHEN '2' THEN (1 - q) * 0.4::DOUBLE END AS ax,
  CASE tip_prediction WHEN '2' THEN q WHEN '1' THEN (1 - q) * 0.6::DOUBLE WHEN 'X' THEN (1 - q) * 0.5::DOUBLE END AS a2,
  CASE WHEN fan_home_win_prob > 0 THEN CAST(fan_home_win_prob AS DOUBLE) / 100 END AS b1, CASE WHEN fan_home_win_prob > 0 THEN CASE WHEN fan_draw_prob > 0 THEN CAST(fan_draw_prob AS DOUBLE) / 100 ELSE 0.25::DOUBLE END END AS bx,
  CASE WHEN fan_home_win_prob > 0 THEN CASE WHEN fan_away_win_prob > 0 THEN CAST(fan_away_win_prob AS DOUBLE) / 100 ELSE 0.35::DOUBLE END END AS b2,
  CASE WHEN r > 0 THEN CASE WHEN focus_team = 'home' THEN r ELSE 1 - r - 0.1::DOUBLE END END AS c1, CASE WHEN r > 0 THEN 0.25::DOUBLE END AS cx, CASE WHEN r > 0 THEN CASE WHEN focus_team = 'home' THEN 1 - r - 0.1::DOUBLE ELSE r END END AS c2
 FROM (SELECT *, CAST(COALESCE(tip_probability, 50) AS DOUBLE) / 100 AS q, CAST(COALESCE(h2h_win_rate, 50) AS DOUBLE) / 100 AS r FROM <predictions> d) e) f) g) h)"""
QUERIES = {
    "pick_strategies": (lambda t: strategies(t.predictions), _STRATEGY),
    "strategy_rows": (lambda t: matched(t.predictions).select("id", "strategy", "priority"), f"SELECT id, strategy, priority FROM {_MET} m"),
    "top_picks_by_sport": (lambda t: top_by_sport(t.predictions), f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sport ORDER BY priority, advice_confidence DESC, match_url) AS rank FROM ({_STRATEGY}) a) b WHERE rank <= 10"),
    "consensus_picks": (
        lambda t: consensus(t.predictions, since="DATE '1999-01-01'"),
        """SELECT id, CAST(h + t + f + a AS INTEGER) AS n_agree, concat_ws(',', CASE WHEN h = 1 THEN 'h2h' END, CASE WHEN t = 1 THEN 'tips' END, CASE WHEN f = 1 THEN 'fans' END, CASE WHEN a = 1 THEN 'advice' END) AS sources FROM (
 SELECT id, CASE WHEN h2h_win_rate >= 60 THEN 1 ELSE 0 END AS h, CASE WHEN tip_prediction = '1' THEN 1 ELSE 0 END AS t, CASE WHEN fan_home_win_prob > fan_away_win_prob THEN 1 ELSE 0 END AS f, CASE WHEN advice_recommendation IN ('HIGH', 'LOCK') THEN 1 ELSE 0 END AS a
 FROM <predictions> p WHERE qualifies AND match_date >= DATE '1999-01-01') q WHERE h + t + f + a >= 3""",
    ),
    "blended_probabilities": (
        lambda t: blended(t.predictions).select("id", "p1", "px", "p2"),
        f"SELECT id, p1, px, p2 FROM {_MEANS} m",
    ),
    "value_bets": (
        lambda t: value_bets(t.predictions),
        f"""SELECT id, outcome, odds, edge, ev FROM (SELECT id, outcome, odds, probability - 1 / odds AS edge, probability * odds - 1 AS ev FROM (SELECT id, o.outcome, CASE o.outcome WHEN '1' THEN p1 WHEN 'X' THEN px ELSE p2 END AS probability,
 CAST(CASE o.outcome WHEN '1' THEN tip_home_odds WHEN 'X' THEN tip_draw_odds ELSE tip_away_odds END AS DOUBLE) AS odds FROM {_MEANS} m CROSS JOIN (VALUES ('1'), ('X'), ('2')) AS o(outcome)) q WHERE odds > 0 AND odds <= 100) r WHERE edge >= 0.02::DOUBLE""",
    ),
}
