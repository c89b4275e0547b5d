"""Settlement, returns and runs of bets. Money is decimal until the last step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profit() -> Column:
    """Won: stake * (odds - 1); lost: -stake; else nothing."""
    stake, odds = F.col("stake"), F.col("odds_at_bet")
    return F.when(F.col("status") == "won", stake * (odds - 1)).when(F.col("status") == "lost", -stake).otherwise(0).cast("decimal(18,4)")


PROFIT = "CAST(CASE status WHEN 'won' THEN stake * (odds_at_bet - 1) WHEN 'lost' THEN -stake ELSE 0 END AS DECIMAL(18,4))"


def stats(bets: DataFrame, *keys: str) -> DataFrame:
    """Counts by status, money staked over all and over settled bets, profit, win rate and return in percent."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}")
    settled = F.col("status").isin("won", "lost")
    got = bets.groupBy(*keys).agg(F.count("*").alias("n_bets"), n("won"), n("lost"), n("pending"), n("void"), F.sum("stake").cast("double").alias("staked_all"), F.sum(F.when(settled, F.col("stake"))).cast("double").alias("staked_settled"), F.sum(profit()).cast("double").alias("profit"))
    return got.withColumns({"win_rate": (F.col("n_won") * 100.0 / F.nullif(F.col("n_won") + F.col("n_lost"), F.lit(0))).cast("double"), "roi": F.col("profit") * 100 / F.nullif("staked_settled", F.lit(0))})


def _stats_sql(keys: str = "") -> str:
    k, g = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    counts = ", ".join(f"COUNT(CASE WHEN status = '{s}' THEN 1 END) AS n_{s}" for s in ("won", "lost", "pending", "void"))
    return f"""SELECT *, CAST(n_won * 100.0 / NULLIF(n_won + n_lost, 0) AS DOUBLE) AS win_rate, profit * 100 / NULLIF(staked_settled, 0) AS roi FROM (SELECT {k}COUNT(*) AS n_bets, {counts},
 CAST(SUM(stake) AS DOUBLE) AS staked_all, CAST(SUM(CASE WHEN status IN ('won', 'lost') THEN stake END) AS DOUBLE) AS staked_settled, CAST(SUM({PROFIT}) AS DOUBLE) AS profit FROM <bets> b {g}) x"""


def daily(bets: DataFrame) -> DataFrame:
    """Profit of each day's settled bets, and of all days until then; days are few, so the running sum is one small task."""
    days = bets.where(F.col("status").isin("won", "lost")).groupBy("placed_on").agg(F.sum(profit()).alias("p"), F.sum("stake").alias("s"))
    w = Window.orderBy("placed_on").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("placed_on", F.col("p").cast("double").alias("profit"), F.sum("p").over(w).cast("double").alias("total_profit"), F.sum("s").over(w).cast("double").alias("total_staked"))


QUERIES = {
    "bet_stats": (lambda t: stats(t.bets), _stats_sql()),
    "bet_stats_by_selection": (lambda t: stats(t.bets, "bet_selection"), _stats_sql("bet_selection")),
    "bet_daily_profit": (
        lambda t: daily(t.bets),
        f"""SELECT placed_on, CAST(p AS DOUBLE) AS profit, CAST(SUM(p) OVER w AS DOUBLE) AS total_profit, CAST(SUM(s) OVER w AS DOUBLE) AS total_staked FROM (
 SELECT placed_on, SUM({PROFIT}) AS p, SUM(stake) AS s FROM <bets> b WHERE status IN ('won', 'lost') GROUP BY placed_on) x WINDOW w AS (ORDER BY placed_on ROWS UNBOUNDED PRECEDING)""",
    ),
}
