"""Trends of teams, their form before each match, and the surfaces of tennis players, as windows over each team's matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .form import BY_TEAM, by_team, form

#: A trend is a change of the half-draw win rate beyond this; a team is hot or cold from RUN equal results on.
CHANGE, RUN = 0.15, 3


def trends(matches: DataFrame) -> DataFrame:
    """Each team's goals for and against over its last ten matches, the trend of the last five against the five before them, and
    whether it runs hot or cold."""
    newest = Window.partitionBy("sport", "team").orderBy(F.desc("match_date"), F.desc("match_id"))
    last = by_team(matches).withColumn("n", F.row_number().over(newest)).where("n <= 10")
    worth = F.when(F.col("result") == "W", 1.0).when(F.col("result") == "D", 0.5).otherwise(0.0)
    got = last.groupBy("sport", "team").agg(F.count("*").alias("n"), F.avg("scored").alias("goals_for"), F.avg("conceded").alias("goals_against"), F.avg(F.when(F.col("n") <= 5, worth)).alias("now"), F.avg(F.when(F.col("n") > 5, worth)).alias("then"))
    gap = F.col("now") - F.col("then")
    trend = F.when((F.col("n") == 10) & (gap > CHANGE), "improving").when((F.col("n") == 10) & (gap < -CHANGE), "declining").otherwise("stable")
    streak = form(matches).select("sport", "team", F.when(F.col("streak") >= RUN, "hot").when(F.col("streak") <= -RUN, "cold").otherwise("neutral").alias("temperature"))
    return got.select("sport", "team", "goals_for", "goals_against", trend.alias("trend")).join(streak, ["sport", "team"])


def advantage(matches: DataFrame) -> DataFrame:
    """Before each match, points (3, 1, 0) of both teams in their last five matches, of the home team at home and of the guests away,
    and whether form favours the home team: good against poor form, or better on both counts. No matches yet: no points."""
    points = F.when(F.col("result") == "W", 3).when(F.col("result") == "D", 1).when(F.col("result") == "L", 0)
    side = lambda team, won, venue: F.struct(F.col(team).alias("team"), F.when(F.col("actual_result") == won, "W").when(F.col("actual_result") == "X", "D").when(F.col("actual_result").isNotNull(), "L").alias("result"), F.lit(venue).alias("venue"))
    rows = matches.select("match_id", "match_date", "sport", F.explode(F.array(side("home_team", "1", "home"), side("away_team", "2", "away"))).alias("s")).select("match_id", "match_date", "sport", "s.*")
    before = lambda *keys: Window.partitionBy(*keys).orderBy("match_date", "match_id").rowsBetween(-5, -1)
    rows = rows.withColumn("points", points).withColumns({"all": F.coalesce(F.sum("points").over(before("sport", "team")), F.lit(0)), "here": F.coalesce(F.sum("points").over(before("sport", "team", "venue")), F.lit(0))})
    of = lambda venue, what: F.max(F.when(F.col("venue") == venue, F.col(what))).alias(f"{venue}_{what}")
    got = rows.groupBy("match_id").agg(of("home", "all"), of("away", "all"), of("home", "here"), of("away", "here"))
    better = (F.col("home_all") > F.col("away_all")) & (F.col("home_here") > F.col("away_here"))
    return got.withColumn("form_advantage", ((F.col("home_all") >= 7) & (F.col("away_all") <= 6)) | better)


def surfaces(matches: DataFrame) -> DataFrame:
    """Of each tennis player and surface (leagues stand for surfaces): matches, wins, rate, and the last five results."""
    surface = F.element_at(F.array(*map(F.lit, ("clay", "hard", "grass"))), (F.substring("league", -1, 1).cast("int") % 3 + 1))
    rows = by_team(matches.where("sport = 'tennis'")).join(matches.select("match_id", surface.alias("surface")), "match_id")
    newest = Window.partitionBy("team", "surface").orderBy(F.desc("match_date"), F.desc("match_id"))
    won = F.count(F.when(F.col("result") == "W", 1))
    got = rows.withColumn("n", F.row_number().over(newest)).groupBy("team", "surface").agg(F.count("*").alias("total"), won.alias("wins"), (won / F.count("*")).alias("rate"), F.sort_array(F.collect_list(F.when(F.col("n") <= 5, F.struct("n", "result")))).alias("last"))
    return got.select("team", "surface", "total", "wins", "rate", F.array_join(F.transform("last", lambda x: x["result"]), "").alias("form"))


def teams(matches: DataFrame) -> DataFrame:
    """All teams of either side, by sport, once."""
    return matches.select("sport", F.explode(F.array("home_team", "away_team")).alias("team")).distinct()


_GOALS = """(SELECT match_id, match_date, sport, home_team AS team, home_score AS own, away_score AS other, CASE actual_result WHEN '1' THEN 1.0 WHEN 'X' THEN 0.5 ELSE 0.0 END AS worth FROM <matches> a WHERE actual_result IS NOT NULL
 UNION ALL SELECT match_id, match_date, sport, away_team, away_score, home_score, CASE actual_result WHEN '2' THEN 1.0 WHEN 'X' THEN 0.5 ELSE 0.0 END FROM <matches> b WHERE actual_result IS NOT NULL)"""
_SIDES = """(SELECT match_id, match_date, sport, home_team AS team, 'home' AS venue, CASE actual_result WHEN '1' THEN 3 WHEN 'X' THEN 1 WHEN '2' THEN 0 END AS points FROM <matches> a
 UNION ALL SELECT match_id, match_date, sport, away_team, 'away', CASE actual_result WHEN '2' THEN 3 WHEN 'X' THEN 1 WHEN '1' THEN 0 END FROM <matches> b)"""
QUERIES = {
    "team_trends": (
        lambda t: trends(t.matches),
        f"""SELECT g.sport, g.team, goals_for, goals_against, CASE WHEN k = 10 AND now - past > 0.15 THEN 'improving' WHEN k = 10 AND now - past < -0.15 THEN 'declining' ELSE 'stable' END AS trend,
 CASE WHEN f LIKE 'WWW%' THEN 'hot' WHEN f LIKE 'LLL%' THEN 'cold' ELSE 'neutral' END AS temperature FROM (
 SELECT sport, team, COUNT(*) AS k, AVG(own) AS goals_for, AVG(other) AS goals_against, AVG(CASE WHEN n <= 5 THEN CAST(worth AS DOUBLE) END) AS now, AVG(CASE WHEN n > 5 THEN CAST(worth AS DOUBLE) END) AS past
 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sport, team ORDER BY match_date DESC, match_id DESC) AS n FROM {_GOALS} p) q WHERE n <= 10 GROUP BY sport, team) g
 JOIN (SELECT sport, team, string_agg(result, '' ORDER BY n) AS f FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sport, team ORDER BY match_date DESC, match_id DESC) AS n FROM {BY_TEAM} p) q WHERE n <= 10 GROUP BY sport, team) s ON s.sport = g.sport AND s.team = g.team""",
    ),
    "form_advantage": (
        lambda t: advantage(t.matches),
        f"""SELECT *, (home_all >= 7 AND away_all <= 6) OR (home_all > away_all AND home_here > away_here) AS form_advantage FROM (SELECT match_id,
 CAST(MAX(CASE WHEN venue = 'home' THEN a END) AS BIGINT) AS home_all, CAST(MAX(CASE WHEN venue = 'away' THEN a END) AS BIGINT) AS away_all, CAST(MAX(CASE WHEN venue = 'home' THEN h END) AS BIGINT) AS home_here, CAST(MAX(CASE WHEN venue = 'away' THEN h END) AS BIGINT) AS away_here FROM (
 SELECT match_id, venue, COALESCE(SUM(points) OVER (PARTITION BY sport, team ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS a,
 COALESCE(SUM(points) OVER (PARTITION BY sport, team, venue ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS h FROM {_SIDES} s) x GROUP BY match_id) y""",
    ),
    "surface_stats": (
        lambda t: surfaces(t.matches),
        f"""SELECT team, surface, COUNT(*) AS total, COUNT(CASE WHEN result = 'W' THEN 1 END) AS wins, CAST(COUNT(CASE WHEN result = 'W' THEN 1 END) AS DOUBLE) / COUNT(*) AS rate, string_agg(CASE WHEN n <= 5 THEN result END, '' ORDER BY n) AS form FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY team, surface ORDER BY match_date DESC, match_id DESC) AS n FROM (SELECT r.*, CASE CAST(right(m.league, 1) AS INTEGER) % 3 WHEN 0 THEN 'clay' WHEN 1 THEN 'hard' ELSE 'grass' END AS surface
 FROM {BY_TEAM} r JOIN <matches> m ON m.match_id = r.match_id WHERE m.sport = 'tennis') p) q GROUP BY team, surface""",
    ),
    "distinct_teams": (lambda t: teams(t.matches), "SELECT sport, home_team AS team FROM <matches> a UNION SELECT sport, away_team FROM <matches> b"),
}
