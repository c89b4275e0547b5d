"""Stakes by strategy, simulated over settled tips, and what a run of bets looks like at its end.

Money is counted in whole ten-thousandths until the last step, so sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bets import PROFIT, profit

#: The largest share of the bankroll that the Kelly stake may take.
KELLY_CAP = 0.1
STRATEGIES = ("flat", "kelly", "proportional")


def stake(strategy: Column, odds: Column, confidence: Column, base: int = 100, cap: float = KELLY_CAP) -> Column:
    """The stake in ten-thousandths of a unit: flat; Kelly's share of the bankroll, 0 to cap; or the base times 0.5 + confidence."""
    gain = odds - 1
    share = F.when(gain > 0, F.least(F.greatest(confidence - (1 - confidence) / gain, F.lit(0.0)), F.lit(cap))).otherwise(0.0)
    of = F.when(strategy == "kelly", share).when(strategy == "proportional", 0.5 + confidence).otherwise(1.0)
    return F.floor(of * base * 10_000 + 0.5).cast("bigint")


def tips(predictions: DataFrame) -> DataFrame:
    """Settled tips that have odds: id, sport, odds, confidence (0.5 where unknown), won."""
    odds = F.when(F.col("tip_prediction") == "1", F.col("tip_home_odds")).when(F.col("tip_prediction") == "X", F.col("tip_draw_odds")).when(F.col("tip_prediction") == "2", F.col("tip_away_odds"))
    settled = predictions.where(F.col("actual_result").isNotNull() & odds.isNotNull())
    return settled.select("id", "sport", odds.alias("odds"), (F.coalesce("advice_confidence", F.lit(50)) / F.lit(100.0)).cast("double").alias("confidence"), (F.col("tip_prediction") == F.col("actual_result")).alias("won"))


def simulate(predictions: DataFrame, base: int = 100) -> DataFrame:
    """All strategies at once, in one scan: bets, won ones, money staked, profit and return of each."""
    each = tips(predictions).withColumn("strategy", F.explode(F.array(*map(F.lit, STRATEGIES))))
    each = each.withColumn("stake", stake(F.col("strategy"), F.col("odds").cast("double"), F.col("confidence"), base).cast("decimal(18,0)"))
    gain = F.when(F.col("won"), F.col("stake") * (F.col("odds") * 100 - 100).cast("decimal(8,0)")).otherwise(F.col("stake") * -100)
    got = each.groupBy("strategy").agg(F.count("*").alias("n_bets"), F.count(F.when(F.col("won"), 1)).alias("n_won"), (F.sum("stake").cast("double") / 10_000).alias("staked"), (F.sum(gain).cast("double") / 1_000_000).alias("profit"))
    return got.withColumn("roi", F.col("profit") * 100 / F.nullif("staked", F.lit(0.0)))


def summary(bets: DataFrame) -> DataFrame:
    """One row: the day with the most profit and with the least (ties: the earlier day), and the latest winning run: how many bets were
    won since the last lost one, skipping lost bets after the run.

    No task sorts all bets: the last won bet and the last lost one before it bound the run, which is then counted.
    """
    settled = bets.where(F.col("status").isin("won", "lost"))
    days = settled.groupBy("placed_on").agg(F.sum(profit()).alias("p"))
    best = days.agg(F.min_by("placed_on", F.struct(-F.col("p"), "placed_on")).alias("best_day"), F.min_by("placed_on", F.struct("p", "placed_on")).alias("worst_day"))
    order = F.struct("placed_on", "match_id", "l_linenumber")
    last_won = settled.where("status = 'won'").agg(F.max(order).alias("w"))
    before = settled.where("status = 'lost'").select(order.alias("o")).crossJoin(F.broadcast(last_won)).where("o < w").agg(F.max("o").alias("b"))  # one row
    ends = last_won.crossJoin(before)
    run = settled.where("status = 'won'").select(order.alias("o")).crossJoin(F.broadcast(ends)).where("b IS NULL OR o > b").agg(F.count("*").alias("winning_run"))
    return best.crossJoin(run)


_TIPS = """(SELECT id, sport, odds, CAST(COALESCE(advice_confidence, 50) AS DOUBLE) / 100.0 AS confidence, tip_prediction = actual_result AS won FROM (
 SELECT *, CASE tip_prediction WHEN '1' THEN tip_home_odds WHEN 'X' THEN tip_draw_odds WHEN '2' THEN tip_away_odds END AS odds FROM <predictions> p) q WHERE actual_result IS NOT NULL AND odds IS NOT NULL)"""
_SHARE = "CASE WHEN CAST(odds AS DOUBLE) - 1 > 0 THEN LEAST(GREATEST(confidence - (1 - confidence) / (CAST(odds AS DOUBLE) - 1), 0.0), 0.1) ELSE 0.0 END"
QUERIES = {
    "stake_simulation": (
        lambda t: simulate(t.predictions),
        f"""SELECT *, profit * 100 / NULLIF(staked, 0) AS roi FROM (SELECT strategy, COUNT(*) AS n_bets, COUNT(CASE WHEN won THEN 1 END) AS n_won, CAST(SUM(stake) AS DOUBLE) / 10000 AS staked,
 CAST(SUM(CASE WHEN won THEN stake * CAST(odds * 100 - 100 AS BIGINT) ELSE stake * -100 END) AS DOUBLE) / 1000000 AS profit FROM (SELECT strategy, odds, won,
 CAST(FLOOR(CASE strategy WHEN 'kelly' THEN {_SHARE} WHEN 'proportional' THEN CAST(0.5 AS DOUBLE) + confidence ELSE CAST(1 AS DOUBLE) END * 100 * 10000 + 0.5) AS BIGINT) AS stake
 FROM {_TIPS} t CROSS JOIN (VALUES ('flat'), ('kelly'), ('proportional')) AS s(strategy)) x GROUP BY strategy) y""",
    ),
    "bet_summary": (
        lambda t: summary(t.bets),
        f"""WITH s AS (SELECT * FROM <bets> b WHERE status IN ('won', 'lost')), d AS (SELECT placed_on, SUM({PROFIT}) AS p FROM s GROUP BY placed_on),
 r AS (SELECT status, ROW_NUMBER() OVER (ORDER BY placed_on DESC, match_id DESC, l_linenumber DESC) AS n FROM s),
 w AS (SELECT MIN(n) AS first_won FROM r WHERE status = 'won'), e AS (SELECT MIN(n) AS ends FROM r, w WHERE status = 'lost' AND n > first_won)
 SELECT (SELECT placed_on FROM d ORDER BY p DESC, placed_on LIMIT 1) AS best_day, (SELECT placed_on FROM d ORDER BY p, placed_on LIMIT 1) AS worst_day,
 (SELECT COUNT(*) FROM r, w, e WHERE status = 'won' AND (ends IS NULL OR n < ends)) AS winning_run""",
    ),
}
