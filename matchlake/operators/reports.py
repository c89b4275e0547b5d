"""What reports and summaries list: sort orders, ranks over all rows, leaders, run figures, form at each venue, payloads by sport."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.text import event_id

from .form import by_team

#: Sort orders of a day's report, each with what settles ties.
NO_TIME = "99:99"
# The range of odds that count.
LEAST_ODDS, MOST_ODDS = 1.01, 100.0


def valid_odds(rows: DataFrame) -> DataFrame:
    """Rows with odds of either side above 0, whose odds of both are in the valid range where they are known."""
    inside = lambda c: F.coalesce(F.col(c).between(LEAST_ODDS, MOST_ODDS), F.lit(True))
    some = F.coalesce((F.col("tip_home_odds") > 0) | (F.col("tip_away_odds") > 0), F.lit(False))
    return rows.where(some & inside("tip_home_odds") & inside("tip_away_odds"))


def report_order(rows: DataFrame, by: str) -> DataFrame:
    """(id, match_date, place): the place of each row in its day's report. by: time (the first hour and minute in match_time; without
    one, last), wins (of the side in focus, most first), team (the home team in lower case). Ties: the least id."""
    clock = F.coalesce(F.nullif(F.regexp_extract("match_time", r"(\d{1,2}:\d{2})", 1), F.lit("")), F.lit(NO_TIME))
    wins = F.coalesce(F.when(F.col("focus_team") == "away", F.col("away_wins")).otherwise(F.col("home_wins")), F.lit(0))
    key = {"time": clock.asc(), "wins": wins.desc(), "team": F.lower(F.coalesce("home_team", F.lit(""))).asc()}[by]
    return rows.select("id", "match_date", F.row_number().over(Window.partitionBy("match_date").orderBy(key, "id")).alias("place"))


def ranked_over_all(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their rank, from 1, in an order of all of them, which must leave no ties. No task sees more than its part: rows are dealt
    by ranges of the order, ranked within their range, and the ranges' sizes, a row for each, give what lies before it."""
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).persist()  # read twice, with the same ranges
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return within.join(before, "_range").select(*rows.columns, (F.col("_before") + F.col("_n")).alias(name))


def daily_summary(predictions: DataFrame, matches_form: DataFrame, n: int = 5) -> DataFrame:
    """(match_date, total, qualifying, form_advantage, sports, best): of each day its matches, those that qualify, those of which
    matches_form(id) has the home side ahead, its sports with their numbers, and the ids of the n qualifying ones with the highest rate."""
    rows = predictions.join(matches_form.select("id", F.lit(True).alias("ahead")), "id", "left")
    by_sport = rows.groupBy("match_date", "sport").agg(F.count("*").alias("n"), F.count_if("qualifies").alias("q"), F.count_if("ahead").alias("a"))
    totals = by_sport.groupBy("match_date").agg(F.sum("n").alias("total"), F.sum("q").alias("qualifying"), F.sum("a").alias("form_advantage"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sport", "n"))), lambda x: F.concat_ws(":", x["sport"], x["n"].cast("string"))), ",").alias("sports"))
    first = Window.partitionBy("match_date").orderBy(F.desc("h2h_win_rate"), "id")
    top = rows.where("qualifies AND h2h_win_rate IS NOT NULL").withColumn("n", F.row_number().over(first)).where(F.col("n") <= n).groupBy("match_date").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "id"))), lambda x: x["id"].cast("string")), ",").alias("best"))
    return totals.join(top, "match_date", "left")


def run_figures(predictions: DataFrame) -> DataFrame:
    """(sport, total, qualifying, enriched, with_odds): by sport, and of all in the row without one and with of_all 1."""
    got = predictions.rollup("sport").agg(F.grouping("sport").cast("int").alias("of_all"), F.count("*").alias("total"), F.count_if("qualifies").alias("qualifying"), F.count_if(F.col("qualifies") & (F.col("tip_prediction").isNotNull() | F.col("fan_home_win_prob").isNotNull())).alias("enriched"), F.count_if((F.col("tip_home_odds") > 0) & (F.col("tip_away_odds") > 0)).alias("with_odds"))
    return got


def key_figures(predictions: DataFrame) -> DataFrame:
    """One row: how many, mean confidence and rate, how many of high advice, how many with a tip; 0 where there is none to take a mean of."""
    mean = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    return predictions.agg(F.count("*").alias("total"), mean("advice_confidence").alias("confidence"), F.count_if(F.col("advice_recommendation") == "HIGH").alias("high"), mean("h2h_win_rate").alias("rate"), F.count("tip_prediction").alias("with_tip"))


def advice_funnel(predictions: DataFrame, least: int = 70) -> DataFrame:
    """One row: advised rows, those of at least that confidence, those of high advice, those with both, and both with a rate of 60."""
    sure, high = F.col("advice_confidence") >= least, F.col("advice_recommendation") == "HIGH"
    return predictions.where("advice_confidence IS NOT NULL").agg(F.count("*").alias("advised"), F.count_if(sure).alias("sure"), F.count_if(high).alias("high"), F.count_if(sure & high).alias("both"), F.count_if(sure & high & (F.col("h2h_win_rate") >= 60)).alias("all_three"))


def high_picks(predictions: DataFrame, n: int = 6, least: int = 85) -> DataFrame:
    """(match_date, place, id): of each day the n picks of high advice and at least that confidence, most confident first."""
    first = Window.partitionBy("match_date").orderBy(F.desc("advice_confidence"), "id")
    got = predictions.where((F.col("advice_recommendation") == "HIGH") & (F.col("advice_confidence") >= least)).withColumn("place", F.row_number().over(first))
    return got.where(F.col("place") <= n).select("match_date", "place", "id")


def leaders(bets: DataFrame, matches: DataFrame) -> DataFrame:
    """(sport, settled, won, accuracy, profit, by_accuracy, by_profit): settled bets of each sport with its ranks; equal ones share one."""
    settled = bets.where("status IN ('won', 'lost')").join(matches.select("match_id", "sport"), "match_id")
    profit = F.when(F.col("status") == "won", F.col("stake") * (F.col("odds_at_bet") - 1)).otherwise(-F.col("stake"))
    got = settled.groupBy("sport").agg(F.count("*").alias("settled"), F.count_if(F.col("status") == "won").alias("won"), F.sum(profit.cast("decimal(20,4)")).cast("double").alias("profit"))
    got = got.withColumn("accuracy", F.col("won") / F.col("settled"))
    place = lambda c: F.rank().over(Window.orderBy(F.desc(c)))  # noqa: E731  a row for each sport
    return got.withColumns({"by_accuracy": place("accuracy"), "by_profit": place("profit")})


def forms_by_venue(matches: DataFrame, n: int = 5) -> DataFrame:
    """(sport, team, overall, at_home, away): each team's last n results, at home and away, newest first; empty where it has none."""
    rows = by_team(matches)
    newest = lambda *keys: F.row_number().over(Window.partitionBy("sport", "team", *keys).orderBy(F.desc("match_date"), F.desc("match_id")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "result"))), lambda x: x["result"]), "")
    overall = rows.withColumn("n", newest()).where(F.col("n") <= n).groupBy("sport", "team").agg(joined.alias("overall"))
    venues = rows.withColumn("n", newest("venue")).where(F.col("n") <= n).groupBy("sport", "team", "venue").agg(joined.alias("f"))
    at = lambda v: F.coalesce(F.max(F.when(F.col("venue") == v, F.col("f"))), F.lit(""))
    return overall.join(venues.groupBy("sport", "team").agg(at("home").alias("at_home"), at("away").alias("away")), ["sport", "team"])


def last_meeting(matches: DataFrame) -> DataFrame:
    """(sport, team_a, team_b, last_date, last_home, last_score, last_winner): the newest finished meeting of each pair of teams."""
    pair = matches.where("actual_result IS NOT NULL").withColumns({"team_a": F.least("home_team", "away_team"), "team_b": F.greatest("home_team", "away_team")})
    winner = F.when(F.col("actual_result") == "1", F.col("home_team")).when(F.col("actual_result") == "2", F.col("away_team")).otherwise("draw")
    row = F.struct("match_date", F.col("home_team"), F.concat_ws("-", "home_score", "away_score").alias("score"), winner.alias("winner"))
    last = pair.groupBy("sport", "team_a", "team_b").agg(F.max_by(row, F.struct("match_date", "match_id")).alias("m"))
    return last.select("sport", "team_a", "team_b", F.col("m.match_date").alias("last_date"), F.col("m.home_team").alias("last_home"), F.col("m.score").alias("last_score"), F.col("m.winner").alias("last_winner"))


def vote_shares(votes: DataFrame) -> DataFrame:
    """votes(id, home, draw, away, yes, no), counts, as whole percents, halves to the even one: home_share, draw_share (null without a
    vote for it), away_share, total, yes_share, no_share (null without either). Rows without votes for an outcome are left out."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    total, both = n("home") + n("draw") + n("away"), n("yes") + n("no")
    share = lambda c, of: F.bround(n(c) / of * 100).cast("int")
    return votes.where(total > 0).select("id", share("home", total).alias("home_share"), F.when(n("draw") > 0, share("draw", total)).alias("draw_share"), share("away", total).alias("away_share"), total.alias("total"), *(F.when(both > 0, share(c, both)).alias(f"{c}_share") for c in ("yes", "no")))


def payloads(predictions: DataFrame) -> DataFrame:
    """(match_date, sport, total, qualifying, matches): what is sent of each sport on a day: numbers, and matches as JSON, by time and id."""
    each = F.transform(F.sort_array(F.collect_list(F.struct("match_time", "id", "home_team", "away_team"))), lambda x: F.struct(x["id"].alias("id"), x["home_team"].alias("home"), x["away_team"].alias("away")))
    return predictions.groupBy("match_date", "sport").agg(F.count("*").alias("total"), F.count_if("qualifies").alias("qualifying"), F.to_json(each).alias("matches"))


def new_links(found: DataFrame, seen: DataFrame) -> DataFrame:
    """The distinct links of found(link) that seen(link) lacks; nulls are none."""
    return found.select("link").where("link IS NOT NULL").distinct().join(seen.select("link"), "link", "left_anti")


def by_event(rows: DataFrame, events: DataFrame, url: str = "url") -> DataFrame:
    """rows joined to events(event_id, ...) by the event's id in their link; rows whose link has none, or an unknown one, are left out."""
    return rows.withColumn("event_id", event_id(F.col(url))).where("event_id IS NOT NULL").join(events, "event_id")


_ID = "'K' || CAST(100000 + id % 900000 AS STRING)"
_URLS = f"SELECT id, 'https://x.example/' || CASE id % 3 WHEN 0 THEN 'match/?mid=' || {_ID} WHEN 1 THEN 'hockey/#id/' || {_ID} ELSE 'overall/' END AS url FROM <predictions> p"
_VOTES = "SELECT id, id % 40 AS home, CASE WHEN id % 4 = 0 THEN NULL ELSE id % 7 END AS draw, id % 9 AS away, CASE WHEN id % 5 = 0 THEN NULL ELSE id % 30 END AS yes, CASE WHEN id % 5 < 2 THEN 0 ELSE id % 11 END AS no FROM <predictions> p"
_WINS = "SELECT id, match_date, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN 'later' ELSE '01.02.2024 ' || match_time END AS match_time, home_team, focus_team, id % 6 AS home_wins, CASE WHEN id % 5 = 0 THEN NULL ELSE id % 4 END AS away_wins FROM <predictions> p"
_BY_TEAM = """(SELECT match_id, match_date, sport, home_team AS team, 'home' AS venue, CASE actual_result WHEN '1' THEN 'W' WHEN 'X' THEN 'D' ELSE 'L' END AS result FROM <matches> a WHERE actual_result IS NOT NULL
 UNION ALL SELECT match_id, match_date, sport, away_team, 'away', CASE actual_result WHEN '2' THEN 'W' WHEN 'X' THEN 'D' ELSE 'L' END FROM <matches> b WHERE actual_result IS NOT NULL)"""
_LAST = lambda keys, name: f"(SELECT {keys}, string_agg(result, '' ORDER BY n) AS {name} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY match_date DESC, match_id DESC) AS n FROM {_BY_TEAM} t) u WHERE n <= 5 GROUP BY {keys})"
_BOTH_SHARE = lambda c: f"CASE WHEN both_ > 0 THEN CAST(round_even(CAST({c} AS DOUBLE) / both_ * 100, 0) AS INTEGER) END AS {c}_share"
_REPORT = lambda key: f"SELECT id, match_date, CAST(ROW_NUMBER() OVER (PARTITION BY match_date ORDER BY {key}, id) AS INTEGER) AS place FROM ({_WINS}) w"
_AHEAD = "id % 3 = 0"
QUERIES = {
    "valid_odds": (lambda t: valid_odds(t.predictions).select("id"), "SELECT id FROM <predictions> p WHERE (tip_home_odds > 0 OR tip_away_odds > 0) AND COALESCE(tip_home_odds BETWEEN 1.01 AND 100, TRUE) AND COALESCE(tip_away_odds BETWEEN 1.01 AND 100, TRUE)"),
    "report_by_time": (lambda t: report_order(t.rows(_WINS), "time"), _REPORT("CASE WHEN id % 7 < 2 THEN '99:99' ELSE substr(match_time, 12) END")),
    "report_by_wins": (lambda t: report_order(t.rows(_WINS), "wins"), _REPORT("COALESCE(CASE WHEN focus_team = 'away' THEN away_wins ELSE home_wins END, 0) DESC")),
    "report_by_team": (lambda t: report_order(t.rows(_WINS), "team"), _REPORT("encode(lower(home_team))")),
    "ranked_over_all": (
        lambda t: ranked_over_all(t.predictions.where("advice_confidence IS NOT NULL").select("id", "advice_confidence"), [F.desc("advice_confidence"), F.col("id")]),
        "SELECT id, advice_confidence, ROW_NUMBER() OVER (ORDER BY advice_confidence DESC, id) AS rank FROM <predictions> p WHERE advice_confidence IS NOT NULL",
    ),
    "daily_summary": (
        lambda t: daily_summary(t.predictions, t.predictions.where(_AHEAD)),
        f"""SELECT match_date, total, qualifying, form_advantage, sports, best FROM (SELECT match_date, CAST(SUM(n) AS BIGINT) AS total, CAST(SUM(q) AS BIGINT) AS qualifying, CAST(SUM(a) AS BIGINT) AS form_advantage, string_agg(sport || ':' || CAST(n AS VARCHAR), ',' ORDER BY sport) AS sports FROM (
 SELECT match_date, sport, COUNT(*) AS n, COUNT(CASE WHEN qualifies THEN 1 END) AS q, COUNT(CASE WHEN {_AHEAD} THEN 1 END) AS a FROM <predictions> p GROUP BY match_date, sport) s GROUP BY match_date) d
 LEFT JOIN (SELECT match_date, string_agg(CAST(id AS VARCHAR), ',' ORDER BY n) AS best FROM (SELECT match_date, id, ROW_NUMBER() OVER (PARTITION BY match_date ORDER BY h2h_win_rate DESC, id) AS n FROM <predictions> r WHERE qualifies AND h2h_win_rate IS NOT NULL) x WHERE n <= 5 GROUP BY match_date) b USING (match_date)""",
    ),
    "run_figures": (
        lambda t: run_figures(t.predictions),
        """SELECT sport, CAST(grouping(sport) AS INTEGER) AS of_all, COUNT(*) AS total, COUNT(CASE WHEN qualifies THEN 1 END) AS qualifying, COUNT(CASE WHEN qualifies AND (tip_prediction IS NOT NULL OR fan_home_win_prob IS NOT NULL) THEN 1 END) AS enriched,
 COUNT(CASE WHEN tip_home_odds > 0 AND tip_away_odds > 0 THEN 1 END) AS with_odds FROM <predictions> p GROUP BY ROLLUP (sport)""",
    ),
    "key_figures": (lambda t: key_figures(t.predictions), "SELECT COUNT(*) AS total, AVG(CAST(advice_confidence AS DOUBLE)) AS confidence, COUNT(CASE WHEN advice_recommendation = 'HIGH' THEN 1 END) AS high, AVG(CAST(h2h_win_rate AS DOUBLE)) AS rate, COUNT(tip_prediction) AS with_tip FROM <predictions> p"),
    "advice_funnel": (
        lambda t: advice_funnel(t.predictions),
        """SELECT COUNT(*) AS advised, COUNT(CASE WHEN advice_confidence >= 70 THEN 1 END) AS sure, COUNT(CASE WHEN advice_recommendation = 'HIGH' THEN 1 END) AS high, COUNT(CASE WHEN advice_confidence >= 70 AND advice_recommendation = 'HIGH' THEN 1 END) AS "both",
 COUNT(CASE WHEN advice_confidence >= 70 AND advice_recommendation = 'HIGH' AND h2h_win_rate >= 60 THEN 1 END) AS all_three FROM <predictions> p WHERE advice_confidence IS NOT NULL""",
    ),
    "high_picks": (lambda t: high_picks(t.predictions), "SELECT match_date, CAST(n AS INTEGER) AS place, id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_date ORDER BY advice_confidence DESC, id) AS n FROM <predictions> p WHERE advice_recommendation = 'HIGH' AND advice_confidence >= 85) x WHERE n <= 6"),
    "leaders": (
        lambda t: leaders(t.bets, t.matches),
        """SELECT *, CAST(RANK() OVER (ORDER BY accuracy DESC) AS INTEGER) AS by_accuracy, CAST(RANK() OVER (ORDER BY profit DESC) AS INTEGER) AS by_profit FROM (SELECT sport, settled, won, CAST(profit AS DOUBLE) AS profit, CAST(won AS DOUBLE) / settled AS accuracy FROM (
 SELECT m.sport, COUNT(*) AS settled, COUNT(CASE WHEN b.status = 'won' THEN 1 END) AS won, SUM(CASE WHEN b.status = 'won' THEN b.stake * (b.odds_at_bet - 1) ELSE -b.stake END) AS profit FROM <bets> b JOIN <matches> m ON m.match_id = b.match_id WHERE b.status IN ('won', 'lost') GROUP BY m.sport) g) h""",
    ),
    "forms_by_venue": (
        lambda t: forms_by_venue(t.matches),
        f"""SELECT o.sport, o.team, o.overall, COALESCE(h.f, '') AS at_home, COALESCE(a.f, '') AS away FROM {_LAST("sport, team", "overall")} o LEFT JOIN {_LAST("sport, team, venue", "f")} h ON h.sport = o.sport AND h.team = o.team AND h.venue = 'home'
 LEFT JOIN {_LAST("sport, team, venue", "f")} a ON a.sport = o.sport AND a.team = o.team AND a.venue = 'away'""",
    ),
    "last_meeting": (
        lambda t: last_meeting(t.matches),
        """SELECT sport, team_a, team_b, match_date AS last_date, home_team AS last_home, CAST(home_score AS VARCHAR) || '-' || CAST(away_score AS VARCHAR) AS last_score, CASE actual_result WHEN '1' THEN home_team WHEN '2' THEN away_team ELSE 'draw' END AS last_winner FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY sport, team_a, team_b ORDER BY match_date DESC, match_id DESC) AS n FROM (SELECT *, CASE WHEN encode(home_team) < encode(away_team) THEN home_team ELSE away_team END AS team_a, CASE WHEN encode(home_team) < encode(away_team) THEN away_team ELSE home_team END AS team_b
 FROM <matches> m WHERE actual_result IS NOT NULL) p) q WHERE n = 1""",
    ),
    "vote_shares": (
        lambda t: vote_shares(t.rows(_VOTES)),
        f"""SELECT id, CAST(round_even(CAST(home AS DOUBLE) / total * 100, 0) AS INTEGER) AS home_share, CASE WHEN draw > 0 THEN CAST(round_even(CAST(draw AS DOUBLE) / total * 100, 0) AS INTEGER) END AS draw_share, CAST(round_even(CAST(away AS DOUBLE) / total * 100, 0) AS INTEGER) AS away_share, total,
 {_BOTH_SHARE("yes")}, {_BOTH_SHARE("no")} FROM (SELECT id, home, COALESCE(draw, 0) AS draw, away, home + COALESCE(draw, 0) + away AS total, COALESCE(yes, 0) AS yes, no, COALESCE(yes, 0) + no AS both_ FROM ({_VOTES}) v) w WHERE total > 0""",
    ),
    "payloads": (
        lambda t: payloads(t.predictions),
        """SELECT match_date, sport, COUNT(*) AS total, COUNT(CASE WHEN qualifies THEN 1 END) AS qualifying, '[' || string_agg('{"id":' || CAST(id AS VARCHAR) || ',"home":"' || home_team || '","away":"' || away_team || '"}', ',' ORDER BY match_time, id) || ']' AS matches FROM <predictions> p GROUP BY match_date, sport""",
    ),
    "new_links": (
        lambda t: new_links(t.predictions.select(F.col("match_url").alias("link")), t.predictions.where("id % 3 = 0").select(F.col("match_url").alias("link"))),
        "SELECT DISTINCT match_url AS link FROM <predictions> p WHERE match_url NOT IN (SELECT match_url FROM <predictions> q WHERE id % 3 = 0)",
    ),
    "joined_by_event": (
        lambda t: by_event(t.rows(_URLS), t.matches.where("match_id < 900000 AND match_id % 2 = 0").select(F.expr("'K' || cast(100000 + match_id as string)").alias("event_id"), "match_id")).select("id", "event_id", "match_id"),
        f"SELECT p.id, {_ID} AS event_id, m.match_id FROM <predictions> p JOIN <matches> m ON m.match_id = p.id % 900000 WHERE p.id % 3 < 2 AND m.match_id < 900000 AND m.match_id % 2 = 0",
    ),
    "qualified_links": (
        lambda t: t.matches.select("match_id", F.concat(F.lit("https://x.example/match/"), F.col("match_id").cast("string")).alias("match_url")).join(t.predictions.where("qualifies").select("match_url"), "match_url", "left_semi"),
        "SELECT match_id, 'https://x.example/match/' || CAST(match_id AS VARCHAR) AS match_url FROM <matches> m WHERE match_id IN (SELECT id FROM <predictions> p WHERE qualifies)",
    ),
}
