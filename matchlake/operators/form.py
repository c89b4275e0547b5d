"""Team form, head-to-head meetings and streaks, as windows over each team's matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_team(matches: DataFrame) -> DataFrame:
    """Two rows for each finished match, one from each side: team, result W, D or L, goals for and against."""
    side = lambda team, won, own, other, venue: F.struct(F.col(team).alias("team"), F.when(F.col("actual_result") == won, "W").when(F.col("actual_result") == "X", "D").otherwise("L").alias("result"), F.col(own).alias("scored"), F.col(other).alias("conceded"), F.lit(venue).alias("venue"))
    both = F.explode(F.array(side("home_team", "1", "home_score", "away_score", "home"), side("away_team", "2", "away_score", "home_score", "away")))
    return matches.where(F.col("actual_result").isNotNull()).select("match_id", "match_date", "sport", both.alias("s")).select("match_id", "match_date", "sport", "s.*")


def form(matches: DataFrame) -> DataFrame:
    """Each team's last ten results in a sport, newest first, its rates over five and ten (a draw is half a win), and its streak:
    equal results at the head of the last five, as a negative number for losses and 0 for draws."""
    newest = Window.partitionBy("sport", "team").orderBy(F.desc("match_date"), F.desc("match_id"))
    last = by_team(matches).withColumn("n", F.row_number().over(newest)).where("n <= 10")
    worth = F.when(F.col("result") == "W", 1.0).when(F.col("result") == "D", 0.5).otherwise(0.0)
    all_ = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "result"))), lambda x: x["result"]), "")
    got = last.groupBy("sport", "team").agg(all_.alias("form"), F.avg(F.when(F.col("n") <= 5, worth)).alias("rate5"), F.avg(worth).alias("rate10"))
    run = F.length(F.regexp_extract(F.substring("form", 1, 5), "^(W+|L+)", 1))
    return got.withColumn("streak", F.when(F.col("form").startswith("W"), run).when(F.col("form").startswith("L"), -run).otherwise(0))


def meetings(matches: DataFrame) -> DataFrame:
    """Of each pair of teams in a sport the last five meetings: how many, wins of either, their rate, whether 60 percent qualify."""
    pair = matches.where(F.col("actual_result").isNotNull()).withColumns({"team_a": F.least("home_team", "away_team"), "team_b": F.greatest("home_team", "away_team")})
    last = pair.withColumn("n", F.row_number().over(Window.partitionBy("sport", "team_a", "team_b").orderBy(F.desc("match_date"), F.desc("match_id")))).where("n <= 5")
    won = lambda team: F.count(F.when(((F.col("actual_result") == "1") & (F.col("home_team") == F.col(team))) | ((F.col("actual_result") == "2") & (F.col("away_team") == F.col(team))), 1))
    got = last.groupBy("sport", "team_a", "team_b").agg(F.count("*").alias("n_meetings"), won("team_a").alias("wins_a"), won("team_b").alias("wins_b"))
    return got.withColumns({"rate_a": (F.col("wins_a") * 1.0 / F.col("n_meetings")).cast("double"), "qualifies": F.col("wins_a") * 100 >= 60 * F.col("n_meetings")})


BY_TEAM = """(SELECT match_id, match_date, sport, home_team AS team, CASE actual_result WHEN '1' THEN 'W' WHEN 'X' THEN 'D' ELSE 'L' END AS result FROM <matches> a WHERE actual_result IS NOT NULL
 UNION ALL SELECT match_id, match_date, sport, away_team, CASE actual_result WHEN '2' THEN 'W' WHEN 'X' THEN 'D' ELSE 'L' END FROM <matches> b WHERE actual_result IS NOT NULL)"""
_WORTH = "CASE result WHEN 'W' THEN 1.0 WHEN 'D' THEN 0.5 ELSE 0.0 END"
QUERIES = {
    "team_form": (
        lambda t: form(t.matches),
        f"""SELECT sport, team, form, rate5, rate10, CAST(CASE WHEN form LIKE 'W%' THEN length(regexp_extract(substr(form, 1, 5), '^W+')) WHEN form LIKE 'L%' THEN -length(regexp_extract(substr(form, 1, 5), '^L+')) ELSE 0 END AS INTEGER) AS streak FROM (
 SELECT sport, team, string_agg(result, '' ORDER BY n) AS form, CAST(AVG(CASE WHEN n <= 5 THEN CAST({_WORTH} AS DOUBLE) END) AS DOUBLE) AS rate5, AVG(CAST({_WORTH} AS DOUBLE)) AS rate10 FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY sport, team ORDER BY match_date DESC, match_id DESC) AS n FROM {BY_TEAM} p) q WHERE n <= 10 GROUP BY sport, team) r""",
    ),
    "head_to_head": (
        lambda t: meetings(t.matches),
        """SELECT *, CAST(wins_a AS DOUBLE) / n_meetings AS rate_a, wins_a * 100 >= 60 * n_meetings AS qualifies FROM (SELECT sport, team_a, team_b, COUNT(*) AS n_meetings,
 COUNT(CASE WHEN (actual_result = '1' AND home_team = team_a) OR (actual_result = '2' AND away_team = team_a) THEN 1 END) AS wins_a,
 COUNT(CASE WHEN (actual_result = '1' AND home_team = team_b) OR (actual_result = '2' AND away_team = team_b) THEN 1 END) AS wins_b FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY sport, team_a, team_b ORDER BY match_date DESC, match_id DESC) AS n FROM (SELECT *, LEAST(home_team, away_team) AS team_a, GREATEST(home_team, away_team) AS team_b FROM <matches> m WHERE actual_result IS NOT NULL) p) q
 WHERE n <= 5 GROUP BY sport, team_a, team_b) r""",
    ),
}
