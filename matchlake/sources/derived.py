"""The match tables, derived from the driver's tables by SQL that Spark and DuckDB both read."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

AS_OF = "DATE '2001-08-01'"
_TEAMS = """(SELECT * FROM (VALUES (0, 'Arsenal'), (1, 'Chelsea'), (2, 'Wisła Kraków'), (3, 'Śląsk Wrocław'), (4, 'FC Porto'),
 (5, 'Bayern München'), (6, 'Real Sociedad'), (7, 'Lech Poznań'), (8, 'Malmö FF'), (9, 'Dinamo Kyiv'), (10, 'Ferencváros'),
 (11, 'Galatasaray'), (12, 'Hapoel Haifa'), (13, 'Leeds United'), (14, 'Norwich City'), (15, 'Olympique Lyon'), (16, 'Skra Bełchatów'),
 (17, 'Tottenham Hotspur'), (18, 'Udinese Calcio'), (19, 'Zenit Moscow')) AS t(team_id, team_name))"""
_HASH = "(o_orderkey * 7919 + o_custkey * 104729) % 1000003"
MATCHES = f"""SELECT m.match_id, m.match_date, CAST(12 + m.h % 10 AS STRING) || CASE WHEN m.h % 2 = 0 THEN ':00' ELSE ':30' END AS match_time,
 m.sport, 'league_' || CAST(m.h % 8 AS STRING) AS league, nh.team_name AS home_team, na.team_name AS away_team, m.home_score, m.away_score,
 CASE WHEN m.home_score > m.away_score THEN '1' WHEN m.home_score < m.away_score THEN '2' WHEN m.home_score = m.away_score THEN 'X' END AS actual_result, m.h
FROM (SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date, {_HASH} AS h,
 CASE o_orderkey % 6 WHEN 0 THEN 'football' WHEN 1 THEN 'basketball' WHEN 2 THEN 'volleyball' WHEN 3 THEN 'handball' WHEN 4 THEN 'hockey' ELSE 'tennis' END AS sport,
 ({_HASH}) % 20 AS home_id, (({_HASH}) % 20 + 1 + (o_orderkey * 31 + o_custkey) % 19) % 20 AS away_id,
 CASE WHEN o_orderstatus = 'P' THEN NULL ELSE (o_orderkey * 17 + o_custkey * 3) % 5 END AS home_score,
 CASE WHEN o_orderstatus = 'P' THEN NULL ELSE (o_orderkey * 13 + o_custkey * 7) % 4 END AS away_score FROM orders) m
JOIN {_TEAMS} nh ON nh.team_id = m.home_id JOIN {_TEAMS} na ON na.team_id = m.away_id"""
PREDICTIONS = f"""SELECT match_id AS id, match_date, match_time, home_team, away_team, sport, league, actual_result, home_score, away_score,
 CASE WHEN h % 11 = 0 THEN NULL ELSE 40 + h % 61 END AS h2h_win_rate,
 CASE h % 4 WHEN 0 THEN '1' WHEN 1 THEN 'X' WHEN 2 THEN '2' END AS tip_prediction,
 CASE WHEN h % 4 = 3 THEN NULL ELSE 35 + (h * 7) % 50 END AS tip_probability,
 CAST((105 + (h * 3) % 300) / 100.0 AS DECIMAL(6,2)) AS tip_home_odds,
 CASE WHEN sport IN ('football', 'hockey', 'handball') THEN CAST((250 + (h * 5) % 250) / 100.0 AS DECIMAL(6,2)) END AS tip_draw_odds,
 CAST((105 + (h * 11) % 400) / 100.0 AS DECIMAL(6,2)) AS tip_away_odds,
 CASE WHEN h % 9 = 0 THEN NULL ELSE (h * 5) % 71 END AS fan_home_win_prob,
 CASE WHEN h % 9 = 0 THEN NULL ELSE 10 + h % 21 END AS fan_draw_prob,
 CASE WHEN h % 9 = 0 THEN NULL ELSE (h * 3) % 71 END AS fan_away_win_prob,
 CASE h % 7 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' WHEN 3 THEN 'SKIP' WHEN 4 THEN 'LOCK' END AS advice_recommendation,
 CASE WHEN h % 7 > 4 THEN NULL ELSE 55 + h % 45 END AS advice_confidence,
 CASE WHEN h % 3 = 0 THEN 'away' ELSE 'home' END AS focus_team,
 'https://x.example/match/' || CAST(match_id AS STRING) AS match_url, h % 5 <> 0 AS qualifies FROM ({MATCHES}) d"""
BETS = f"""SELECT l.l_orderkey AS match_id, CAST(l.l_shipdate AS DATE) AS placed_on,
 CASE (l.l_partkey + l.l_linenumber) % 3 WHEN 0 THEN '1' WHEN 1 THEN 'X' ELSE '2' END AS bet_selection,
 CAST((110 + l.l_partkey % 300) / 100.0 AS DECIMAL(6,2)) AS odds_at_bet, CAST(l.l_quantity AS DECIMAL(10,2)) AS stake,
 CASE WHEN l.l_suppkey % 25 = 0 THEN 'void' WHEN d.actual_result IS NULL THEN 'pending'
  WHEN d.actual_result = CASE (l.l_partkey + l.l_linenumber) % 3 WHEN 0 THEN '1' WHEN 1 THEN 'X' ELSE '2' END THEN 'won' ELSE 'lost' END AS status,
 l.l_linenumber, l.l_partkey, l.l_suppkey FROM lineitem l JOIN ({MATCHES}) d ON d.match_id = l.l_orderkey"""


def filled(sql: str) -> str:
    """SQL with the derived tables and the reference date put in."""
    return sql.replace("<matches>", f"({MATCHES})").replace("<predictions>", f"({PREDICTIONS})").replace("<bets>", f"({BETS})").replace("<as_of>", AS_OF)


class Tables:
    """matches, predictions and bets of a folder of the driver's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _sql(self, text: str) -> DataFrame:
        views = {n: self.spark.read.parquet(f"{self.sf_dir}/{n}.parquet") for n in ("orders", "lineitem")}
        text = text.replace("{", "{{").replace("}", "}}")  # for the views' names below are set in braces
        for n in views:
            text = text.replace(f"FROM {n}", f"FROM {{{n}}}")
        return self.spark.sql(text, **{n: v for n, v in views.items() if f"{{{n}}}" in text})

    def rows(self, sql: str) -> DataFrame:
        """SQL over <matches>, <predictions>, <bets> and <as_of>."""
        return self._sql(filled(sql))

    def spread(self, sql: str) -> DataFrame:
        """SQL over <matches> alone, dealt over all cores first: they come from one small file, and what is made of each is large."""
        text = sql.replace("{", "{{").replace("}", "}}").replace("<matches>", "{dealt}")
        return self.spark.sql(text, dealt=self.matches.repartition(self.spark.sparkContext.defaultParallelism))

    @cached_property
    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/events.parquet")

    @cached_property
    def pages(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/pages.parquet")

    @cached_property
    def matches(self) -> DataFrame:
        return self._sql(MATCHES)

    @cached_property
    def predictions(self) -> DataFrame:
        return self._sql(PREDICTIONS)

    @cached_property
    def bets(self) -> DataFrame:
        return self._sql(BETS)
