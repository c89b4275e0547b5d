"""Rules checked on rows made by hand."""

import pytest
from pyspark.sql import functions as F

from matchlake.operators import calibration, filters, picks, tennis, views

SCHEMA = """id long, match_url string, sport string, h2h_win_rate int, tip_prediction string, tip_probability int, tip_home_odds double, tip_draw_odds double, tip_away_odds double,
 fan_home_win_prob int, fan_draw_prob int, fan_away_win_prob int, advice_recommendation string, advice_confidence int, focus_team string, qualifies boolean"""
NAMES = [f.split()[0] for f in SCHEMA.replace("\n", " ").split(",")]


def rows(spark, *changes):
    base = {"sport": "rugby", "qualifies": True, "focus_team": "home"}
    return spark.createDataFrame([tuple(({"id": i, "match_url": str(i)} | base | c).get(n) for n in NAMES) for i, c in enumerate(changes)], SCHEMA)


def test_strategies(spark):
    df = rows(
        spark,
        {"h2h_win_rate": 80, "advice_confidence": 70},  # locked without advice
        {"h2h_win_rate": 80, "advice_confidence": 70, "advice_recommendation": "SKIP"},
        {"h2h_win_rate": 80, "advice_confidence": 70, "tip_probability": 64},
        {"h2h_win_rate": 59, "advice_confidence": 70, "focus_team": "away", "tip_away_odds": 2.0},
        {"h2h_win_rate": 60, "advice_confidence": 70, "focus_team": "away", "tip_away_odds": 3.5},
        {"h2h_win_rate": 80, "advice_confidence": 85, "advice_recommendation": "HIGH"},
    )
    got = {(r.id, r.strategy) for r in picks.matched(df).collect()}
    assert got == {(0, "LOCKED_PICK"), (4, "VALUE_PLAY"), (5, "BEST_PICK"), (5, "HIGH_CONFIDENCE"), (5, "LOCKED_PICK")}
    assert {(r.id, r.strategy) for r in picks.strategies(df).collect()} == {(0, "LOCKED_PICK"), (4, "VALUE_PLAY"), (5, "BEST_PICK")}


def test_consensus_counts_fans_by_comparison(spark):
    df = rows(spark, {"h2h_win_rate": 60, "tip_prediction": "1", "fan_home_win_prob": 30, "fan_away_win_prob": 29}, {"h2h_win_rate": 60, "tip_prediction": "1", "fan_home_win_prob": 50, "fan_away_win_prob": 50}, {"h2h_win_rate": 60, "tip_prediction": "1", "advice_recommendation": "LOCK", "qualifies": False})
    assert [(r.id, r.n_agree, r.sources) for r in picks.consensus(df).collect()] == [(0, 3, "h2h,tips,fans")]


def test_blended_probabilities(spark):
    df = rows(spark, {"h2h_win_rate": 60, "tip_prediction": "1", "tip_probability": 50, "fan_home_win_prob": 40, "fan_draw_prob": 0, "fan_away_win_prob": 30}, {"h2h_win_rate": 0})
    a, b = picks.blended(df).orderBy("id").collect()
    p = [(0.5 + 0.4 + 0.6) / 3, (0.2 + 0.25 + 0.25) / 3, (0.3 + 0.3 + 0.3) / 3]
    assert [a.p1, a.px, a.p2] == pytest.approx([x / sum(p) for x in p]) and [b.p1, b.px, b.p2] == pytest.approx([1 / 3] * 3)


def test_sport_rules_let_missing_values_pass(spark):
    df = rows(spark, {}, {"advice_confidence": 69}, {"h2h_win_rate": 64}, {"sport": "football", "tip_home_odds": 1.79}, {"sport": "chess", "advice_confidence": 1}, {"sport": "volleyball"}, {"sport": "tennis"})
    assert {r.id for r in filters.sport_rules(df).collect()} == {0, 4, 5, 6}
    got = filters.sport_rules(df, form_known=F.lit(False), advanced_score=F.lit(49.0))
    assert {r.id for r in got.collect()} == {0, 4}


def test_confidence_and_agreement(spark):
    df = rows(spark, {"h2h_win_rate": 60, "tip_prediction": "2", "tip_probability": 50, "fan_home_win_prob": 20, "fan_away_win_prob": 40, "advice_recommendation": "HIGH", "focus_team": "away"}, {})
    a, b = calibration.confidence(df).orderBy("id").collect()
    want = (60 * 1.0 + 50 * 1.2 + 0.8 * 40 + 1.2 * 80 * 1.5 + 1.5 * 100 * 2) / (1 + 1 + 0.8 + 1.2 + 1.5)
    assert (a.agreement, a.confidence) == (4, round(min(100, want), 1)) and (b.agreement, b.confidence) == (0, 20.0)


def test_older_tennis_model(spark):
    df = spark.createDataFrame([(3, 1, 4, 20, 26, list("LWWLW"), list("LLWLL"), 0.85, 0.72)], "wins_a int, wins_b int, meetings int, rank_a int, rank_b int, results_a array<string>, results_b array<string>, rate_a double, rate_b double")
    r = tennis.older(df).first()
    assert (r.h2h_score, r.ranking_score, r.form_score, r.surface_score, r.total_score, r.qualifies, r.favourite) == (30.0, 3.0, 6.0, 10.0, 49.0, False, "player_a")


def test_newer_tennis_model_parts(spark):
    day = "DATE '2024-06-01'"
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert [get(tennis.threshold(F.lit(n), F.lit(h))) for n, h in ((4, True), (3, True), (2, True), (3, False))] == [45.0, 40.0, 35.0, 50.0]
    assert [round(get(tennis.win_probability(F.lit(float(x)))), 4) for x in (45, 55, 30, 100)] == [0.5, 0.7311, 0.5, 0.95]
    assert [get(tennis.tier(F.lit(x))) for x in ("ATP Wimbledon", "Rome", "ATP 500 Dubai", "Challenger Lyon", "", "Munich")] == ["grand_slam", "masters_1000", "atp_500", "challenger", "unknown", "atp_250"]
    meeting = lambda w, d, s: F.struct(F.lit(w).alias("winner"), F.expr(f"DATE '{d}'").alias("date"), F.lit(s).alias("score"))
    h2h = F.array(meeting("a", "2021-01-01", "2-0"), meeting("a", "2023-08-01", "2-0"), meeting("a", "2024-05-01", "2-0"), meeting(None, "2024-05-02", "1-1"))
    assert get(tennis.meetings_score(h2h, F.lit("a"), F.expr(day))) == 40.0 and get(tennis.meetings_score(h2h, F.lit("b"), F.expr(day))) == -40.0
    assert get(tennis.meetings_score(F.array(meeting("a", "2023-01-01", "2-1"), meeting("b", "2023-08-01", "2-1")), F.lit("a"), F.expr(day))) == 8.0 - 12.0
    form = lambda *days: F.array(*(F.struct(F.lit("W").alias("result"), F.expr(f"DATE '{d}'").alias("date"), F.lit(5).alias("opponent_rank"), F.lit("2-0").alias("score"), F.lit("clay").alias("surface")) for d in days))
    assert [get(tennis.fatigue(form(*d), F.expr(day))) for d in (["2024-05-28"] * 5, ["2024-05-28"] * 3, ["2024-05-28"], ["2024-05-20"], ["2024-01-01"])] == [-5.0, -2.0, 3.0, 0.0, -3.0]


def test_rating(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 5), ("b", 0.5, 0.5, 2), ("c", 0.0, 0.1, -4)], "team string, rate5 double, rate10 double, streak int")
    assert {r.team: r.rating for r in views.rating(df).collect()} == {"a": 100, "b": 50, "c": 0}
