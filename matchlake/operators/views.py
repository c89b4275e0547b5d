"""The lists and figures that a dashboard asks for: the match list with its filters and pages, documents of single matches, dates,
upcoming and recent rows, reports, bet lists, and short ranked lists. All take the reference date as a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bets import PROFIT, profit
from .form import form

AS_OF = "DATE '2001-08-01'"
# The order of recommendations in lists.
RECOMMENDATIONS = ("LOCK", "HIGH", "MEDIUM", "LOW", "SKIP")


def documents(predictions: DataFrame) -> DataFrame:
    """Each wide row as a nested document; a part without its leading value is null, missing numbers inside are 0 where lists count them."""
    p = F.col
    odds = F.struct(p("tip_home_odds").alias("home"), p("tip_draw_odds").alias("draw"), p("tip_away_odds").alias("away"))
    tip = F.struct(p("tip_prediction").alias("prediction"), p("tip_probability").alias("probability"))
    fans = F.struct(p("fan_home_win_prob").alias("home"), p("fan_draw_prob").alias("draw"), p("fan_away_win_prob").alias("away"))
    advice = F.struct(p("advice_confidence").alias("confidence"), p("advice_recommendation").alias("recommendation"))
    some = lambda c, s: F.when(c.isNotNull() & (c != 0), s)
    return predictions.select(
        "id", p("home_team").alias("homeTeam"), p("away_team").alias("awayTeam"), p("match_time").alias("time"), p("match_date").alias("date"), F.coalesce("league", F.lit("")).alias("league"), F.coalesce("sport", F.lit("football")).alias("sport"), p("match_url").alias("matchUrl"), F.coalesce("qualifies", F.lit(False)).alias("qualifies"),
        F.struct(F.coalesce("h2h_win_rate", F.lit(0)).alias("winRate")).alias("h2h"), some(p("tip_home_odds"), odds).alias("odds"), F.when(p("tip_prediction").isNotNull(), tip).alias("tip"), some(p("fan_home_win_prob"), fans).alias("fans"), F.when(p("advice_recommendation").isNotNull(), advice).alias("advice"), F.coalesce("focus_team", F.lit("home")).alias("focusTeam"),
    )


def best_confidence() -> Column:
    """The advice's confidence, else the tip's probability, else 0."""
    return F.coalesce("advice_confidence", "tip_probability", F.lit(0))


def match_list(predictions: DataFrame, date: str | None = None, sport: str | None = None, search: str = "", qualifying: bool = False, recommendation: str | None = None, least_confidence: int = 0, with_odds: bool = False, with_tip: bool = False, with_votes: bool = False) -> DataFrame:
    """Predictions that meet every filter given."""
    got = predictions
    for on, test in (
        (date is not None, F.col("match_date") == F.to_date(F.lit(date))), (sport is not None, F.col("sport") == sport), (qualifying, F.col("qualifies")), (recommendation is not None, F.col("advice_recommendation") == recommendation),
        (bool(search), F.lower(F.concat_ws(" ", "home_team", "away_team", "league")).contains(search.lower())), (least_confidence > 0, best_confidence() >= least_confidence),
        (with_odds, F.col("tip_home_odds") > 0), (with_tip, F.col("tip_prediction").isNotNull()), (with_votes, F.col("fan_home_win_prob").isNotNull()),
    ):
        got = got.where(test) if on else got
    return got


def pages(rows: DataFrame, by: str = "match_date", order: tuple[str, ...] = ("match_time", "id"), per_page: int = 100) -> DataFrame:
    """(id, by, page, pages, total): the page of each row in the list of its `by`, and how many pages and rows that has."""
    numbered = rows.select("id", by, F.row_number().over(Window.partitionBy(by).orderBy(*order)).alias("n"), F.count("*").over(Window.partitionBy(by)).alias("total"))
    page = lambda n: F.ceil(n / per_page).cast("long")
    return numbered.select("id", by, page(F.col("n")).alias("page"), F.greatest(page(F.col("total")), F.lit(1).cast("long")).alias("pages"), "total")


def page(rows: DataFrame, number: int = 1, per_page: int = 100, order: tuple[str, ...] = ("match_date", "match_time", "id")) -> DataFrame:
    """One page of a list."""
    return rows.orderBy(*order).offset((number - 1) * per_page).limit(per_page)


def by_id(predictions: DataFrame, id_: int) -> DataFrame:
    return predictions.where(F.col("id") == id_).limit(1)


def between(predictions: DataFrame, as_of: str, first: int, last: int, qualifying: bool = True) -> DataFrame:
    """Predictions from `first` to `last` days after as_of, in order of date and time within a date: n."""
    got = predictions.where(F.col("match_date").between(F.date_add(F.expr(as_of), first), F.date_add(F.expr(as_of), last)))
    got = got.where("qualifies") if qualifying else got
    return got.select("id", "match_date", "match_time", "sport", F.row_number().over(Window.partitionBy("match_date").orderBy("match_time", "id")).alias("n"))


def dates(*tables: DataFrame) -> DataFrame:
    """The dates of all tables' first columns, once each."""
    out = None
    for t in tables:
        t = t.select(F.col(t.columns[0]).alias("date"))
        out = t if out is None else out.unionByName(t)
    return out.where("date IS NOT NULL").distinct()


def period(predictions: DataFrame, as_of: str, days: int) -> DataFrame:
    """Predictions of the last days by sport and of all: total, qualified, with a result; and with tips, votes and odds."""
    since = predictions.where(F.col("match_date") >= F.date_sub(F.expr(as_of), days))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    got = since.rollup("sport").agg(F.grouping("sport").alias("of_all"), F.count("*").alias("total"), n(F.col("qualifies"), "qualified"), F.count("actual_result").alias("with_result"), F.count("tip_prediction").alias("with_tip"), F.count("fan_home_win_prob").alias("with_votes"), n(F.col("tip_home_odds") > 0, "with_odds"))
    return got.withColumn("sport", F.when(F.col("of_all") == 1, "all").otherwise(F.col("sport"))).drop("of_all")  # a missing sport stays null


def league_groups(predictions: DataFrame) -> DataFrame:
    """Each league's matches of a sport: how many, the first three ids by date and time, and the qualified share."""
    first = F.slice(F.sort_array(F.collect_list(F.struct("match_date", "match_time", "id"))), 1, 3)
    last_day = predictions.where("qualifies").groupBy("sport", "league").agg(F.max("match_date").alias("last_day"))
    got = predictions.join(last_day, ["sport", "league"]).where(F.col("match_date") == F.col("last_day"))
    return got.groupBy("sport", "league").agg(F.count("*").alias("n"), F.array_join(F.transform(first, lambda x: x["id"].cast("string")), ",").alias("first_ids"))


def top(rows: DataFrame, by: list[Column], n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The first n rows of each group of keys in an order, with their rank. A task keeps n rows of each group before any are shuffled."""
    got = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    return got.where(F.col("rank") <= n)


def rating(teams: DataFrame) -> DataFrame:
    """form's rows with a rating from 0 to 100: six tenths of the rate over five matches, four of that over ten, and three points for each
    match of a run of three or more, 15 at most."""
    run = F.when(F.abs("streak") >= 3, F.least(F.abs("streak") * 3, F.lit(15)) * F.signum("streak")).otherwise(0)
    base = (F.col("rate5") * 0.6 + F.col("rate10") * 0.4) * 100 + run
    return teams.withColumn("rating", F.greatest(F.lit(0), F.least(F.lit(100), F.round(base, 6).cast("int"))))


def hot_and_cold(teams: DataFrame, least: int = 3, n: int = 10) -> DataFrame:
    """The n teams of each sport with the longest run of wins and of losses, `least` or more."""
    kind = F.when(F.col("streak") >= least, "hot").when(F.col("streak") <= -least, "cold")
    some = rating(teams).withColumn("kind", kind).where("kind IS NOT NULL")
    return top(some, [F.desc(F.abs("streak")), F.col("team")], n, ("sport", "kind")).select("sport", "kind", "rank", "team", "streak", "rating")


def rivals(teams: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(sport, team_a, team_b) with both ratings, their difference, and who has the advantage (10 or more)."""
    rated = rating(teams).select("sport", "team", "rating")
    got = pairs.join(rated.withColumnsRenamed({"team": "team_a", "rating": "rating_a"}), ["sport", "team_a"]).join(rated.withColumnsRenamed({"team": "team_b", "rating": "rating_b"}), ["sport", "team_b"])
    gap = F.col("rating_a") - F.col("rating_b")
    return got.withColumn("difference", gap).withColumn("advantage", F.when(gap >= 10, F.col("team_a")).when(gap <= -10, F.col("team_b")))


def verification(predictions: DataFrame) -> DataFrame:
    """How qualified predictions turned out by sport: finished or not, right ones, draws; the right share of finished, and the return of
    100 on each at its odds. Tennis bets on the focus, other sports on the home side. A draw is finished, not wrong, and loses the stake."""
    home = (F.col("sport") != "tennis") | (F.col("focus_team") == "home")
    odds = F.when(home, F.col("tip_home_odds")).otherwise(F.col("tip_away_odds"))
    got = predictions.where("qualifies").withColumns({"right": F.col("actual_result") == F.when(home, "1").otherwise("2"), "odds": odds, "draw": F.col("actual_result") == "X"})
    finished = F.col("actual_result").isNotNull()
    staked = finished & (F.col("odds") > 0)
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    gain = F.when(staked, F.when(F.col("right"), (F.col("odds") - 1) * 100).otherwise(F.lit(-100))).cast("decimal(18,4)")
    got = got.groupBy("sport").agg(F.count("*").alias("total"), n(finished, "finished"), n(~finished, "not_finished"), n(F.col("right"), "correct"), n(finished & ~F.col("right") & ~F.col("draw"), "incorrect"), n(F.col("draw"), "draws"), n(staked, "staked"), F.sum(gain).cast("double").alias("profit"))
    return got.withColumns({"accuracy": F.col("correct").cast("double") * 100 / F.nullif("finished", F.lit(0)), "roi": F.col("profit") / F.nullif("staked", F.lit(0))})


def first_right_and_wrong(predictions: DataFrame, n: int = 5) -> DataFrame:
    """Of each sport's finished qualified predictions for the home side, the first n right and the first n wrong ones; draws are neither."""
    got = predictions.where("qualifies AND actual_result IN ('1', '2')").withColumn("right", F.col("actual_result") == "1")
    return top(got, [F.col("match_date"), F.col("id")], n, ("sport", "right")).select("sport", "right", "rank", "id")


def bet_report(bets: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """Each bet of the last days: profit and WIN, LOSS or PENDING; a void bet is PENDING."""
    got = bets.where(F.col("placed_on") >= F.date_sub(F.expr(as_of), days))
    return got.select("match_id", "placed_on", "bet_selection", F.col("odds_at_bet").cast("double").alias("odds"), profit().cast("double").alias("profit"), F.when(F.col("status") == "won", "WIN").when(F.col("status") == "lost", "LOSS").otherwise("PENDING").alias("outcome"))


def newest_bets(bets: DataFrame, status: str | None = None, n: int = 50) -> DataFrame:
    """The n newest bets of each status, or of one."""
    got = bets if status is None else bets.where(F.col("status") == status)
    order = [F.desc("placed_on"), F.desc("match_id"), F.desc("l_linenumber"), F.desc("l_partkey"), F.desc("l_suppkey")]
    return top(got, order, n, ("status",)).select("status", "rank", "match_id", "placed_on", "l_linenumber")


def accumulators(bets: DataFrame) -> DataFrame:
    """The bets on one order as one accumulator, of two or more: product of odds, implied chance in percent, whether all won."""
    got = bets.groupBy("match_id").agg(F.count("*").alias("n"), F.product(F.col("odds_at_bet").cast("double")).alias("odds"), F.count(F.when(F.col("status") == "won", 1)).alias("n_won")).where("n >= 2")
    return got.select("match_id", "n", F.round(F.col("odds") + 1e-9, 4).alias("odds"), F.round(100 / F.col("odds"), 4).alias("implied"), (F.col("n") == F.col("n_won")).alias("won"))


def best_of(predictions: DataFrame) -> DataFrame:
    """One row: the sport whose tips are right most often, with its rate; ties: the first by name."""
    got = predictions.where("tip_prediction IS NOT NULL AND actual_result IS NOT NULL").groupBy("sport").agg(F.avg((F.col("tip_prediction") == F.col("actual_result")).cast("double")).alias("accuracy"))
    return got.agg(F.min_by(F.struct("sport", "accuracy"), F.struct(-F.col("accuracy"), "sport")).alias("b")).select("b.*")


def ranked_list(predictions: DataFrame, n: int = 20) -> DataFrame:
    """Of each date the n first rows of the list: by recommendation, then confidence, then time."""
    place = F.coalesce(*(F.when(F.col("advice_recommendation") == r, i) for i, r in enumerate(RECOMMENDATIONS)), F.lit(len(RECOMMENDATIONS)))
    return top(predictions, [place, F.desc(best_confidence()), F.col("match_time"), F.col("id")], n, ("match_date",)).select("match_date", "rank", "id")


def table_counts(t) -> DataFrame:
    return t.matches.agg(F.count("*").alias("n")).select(F.lit("matches").alias("name"), "n").unionByName(t.predictions.agg(F.count("*").alias("n")).select(F.lit("predictions").alias("name"), "n")).unionByName(t.bets.agg(F.count("*").alias("n")).select(F.lit("bets").alias("name"), "n"))


_BEST = "COALESCE(advice_confidence, tip_probability, 0)"
_FORM = """(SELECT sport, team, form, rate5, rate10, CAST(CASE WHEN form LIKE 'W%' THEN length(regexp_extract(substr(form, 1, 5), '^W+')) WHEN form LIKE 'L%' THEN -length(regexp_extract(substr(form, 1, 5), '^L+')) ELSE 0 END AS INTEGER) AS streak FROM (
 SELECT sport, team, string_agg(result, '' ORDER BY n) AS form, AVG(CASE WHEN n <= 5 THEN CAST(w AS DOUBLE) END) AS rate5, AVG(CAST(w AS DOUBLE)) AS rate10 FROM (SELECT *, CASE result WHEN 'W' THEN 1.0 WHEN 'D' THEN 0.5 ELSE 0.0 END AS w, ROW_NUMBER() OVER (PARTITION BY sport, team ORDER BY match_date DESC, match_id DESC) AS n FROM (
 SELECT match_id, match_date, sport, home_team AS team, CASE actual_result WHEN '1' THEN 'W' WHEN 'X' THEN 'D' ELSE 'L' END AS result FROM <matches> a WHERE actual_result IS NOT NULL
 UNION ALL SELECT match_id, match_date, sport, away_team, CASE actual_result WHEN '2' THEN 'W' WHEN 'X' THEN 'D' ELSE 'L' END FROM <matches> b WHERE actual_result IS NOT NULL) p) q WHERE n <= 10 GROUP BY sport, team) r)"""
_RATED = f"""(SELECT *, CAST(GREATEST(0, LEAST(100, TRUNC(ROUND((rate5 * 0.6 + rate10 * 0.4) * 100 + CASE WHEN streak >= 3 THEN LEAST(streak * 3, 15) WHEN streak <= -3 THEN -LEAST(-streak * 3, 15) ELSE 0 END, 6)))) AS INTEGER) AS rating FROM {_FORM} f)"""
QUERIES = {
    "match_documents": (
        lambda t: documents(t.predictions).select("id", "sport", "h2h.winRate", F.col("odds.home").cast("double").alias("home_odds"), F.col("fans.home").alias("fans_home"), F.col("advice.recommendation").alias("recommendation"), F.col("tip.prediction").alias("tip"), "focusTeam"),
        """SELECT id, sport, COALESCE(h2h_win_rate, 0) AS winRate, CAST(CASE WHEN tip_home_odds <> 0 THEN tip_home_odds END AS DOUBLE) AS home_odds, CASE WHEN fan_home_win_prob <> 0 THEN fan_home_win_prob END AS fans_home,
 advice_recommendation AS recommendation, tip_prediction AS tip, focus_team AS "focusTeam" FROM <predictions> p""",
    ),
    "match_list": (
        lambda t: match_list(t.predictions, sport="football", search="FC", qualifying=True, least_confidence=70, with_odds=True, with_votes=True).select("id", "match_date", "home_team", "away_team", best_confidence().alias("confidence")),
        f"""SELECT id, match_date, home_team, away_team, {_BEST} AS confidence FROM <predictions> p WHERE sport = 'football' AND contains(lower(home_team || ' ' || away_team || ' ' || league), 'fc') AND qualifies AND {_BEST} >= 70
 AND tip_home_odds > 0 AND fan_home_win_prob IS NOT NULL""",
    ),
    "match_pages": (
        lambda t: pages(t.predictions, per_page=10),
        """SELECT id, match_date, CAST(CEIL(n / 10.0) AS BIGINT) AS page, GREATEST(CAST(CEIL(total / 10.0) AS BIGINT), 1) AS pages, total FROM (SELECT id, match_date, ROW_NUMBER() OVER (PARTITION BY match_date ORDER BY match_time, id) AS n,
 COUNT(*) OVER (PARTITION BY match_date) AS total FROM <predictions> p) x""",
    ),
    "upcoming_week": (
        lambda t: between(t.predictions, "DATE '2001-07-20'", 0, 7),
        "SELECT id, match_date, match_time, sport, CAST(ROW_NUMBER() OVER (PARTITION BY match_date ORDER BY match_time, id) AS INTEGER) AS n FROM <predictions> p WHERE qualifies AND match_date BETWEEN DATE '2001-07-20' AND DATE '2001-07-27'",
    ),
    "ten_days": (
        lambda t: between(t.predictions, "DATE '2001-07-20'", -10, 0, qualifying=False),
        "SELECT id, match_date, match_time, sport, CAST(ROW_NUMBER() OVER (PARTITION BY match_date ORDER BY match_time, id) AS INTEGER) AS n FROM <predictions> p WHERE match_date BETWEEN DATE '2001-07-10' AND DATE '2001-07-20'",
    ),
    "available_dates": (
        lambda t: dates(t.matches.select("match_date"), t.bets.select("placed_on")),
        "SELECT match_date AS date FROM <matches> m UNION SELECT placed_on FROM <bets> b",
    ),
    "period_stats": (
        lambda t: period(t.predictions, AS_OF, 365),
        """SELECT COALESCE(sport, 'all') AS sport, COUNT(*) AS total, COUNT(CASE WHEN qualifies THEN 1 END) AS qualified, COUNT(actual_result) AS with_result, COUNT(tip_prediction) AS with_tip, COUNT(fan_home_win_prob) AS with_votes,
 COUNT(CASE WHEN tip_home_odds > 0 THEN 1 END) AS with_odds FROM <predictions> p WHERE match_date >= <as_of> - 365 GROUP BY ROLLUP (sport)""",
    ),
    "league_groups": (
        lambda t: league_groups(t.predictions),
        """SELECT sport, league, COUNT(*) AS n, string_agg(CASE WHEN k <= 3 THEN CAST(id AS VARCHAR) END, ',' ORDER BY k) AS first_ids FROM (SELECT p.*, ROW_NUMBER() OVER (PARTITION BY p.sport, p.league ORDER BY match_date, match_time, id) AS k FROM <predictions> p
 JOIN (SELECT sport, league, MAX(match_date) AS last_day FROM <predictions> q WHERE qualifies GROUP BY sport, league) l ON l.sport = p.sport AND l.league = p.league AND l.last_day = p.match_date) x GROUP BY sport, league""",
    ),
    "hot_and_cold_teams": (
        lambda t: hot_and_cold(form(t.matches), least=1),
        f"""SELECT sport, kind, CAST(rank AS INTEGER) AS rank, team, streak, rating FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sport, kind ORDER BY ABS(streak) DESC, team) AS rank FROM (
 SELECT *, CASE WHEN streak >= 1 THEN 'hot' WHEN streak <= -1 THEN 'cold' END AS kind FROM {_RATED} g) h WHERE kind IS NOT NULL) i WHERE rank <= 10""",
    ),
    "rival_ratings": (
        lambda t: rivals(form(t.matches), t.matches.select("sport", F.least("home_team", "away_team").alias("team_a"), F.greatest("home_team", "away_team").alias("team_b")).distinct()).select("sport", "team_a", "team_b", "difference", "advantage"),
        f"""SELECT p.sport, p.team_a, p.team_b, a.rating - b.rating AS difference, CASE WHEN a.rating - b.rating >= 10 THEN p.team_a WHEN a.rating - b.rating <= -10 THEN p.team_b END AS advantage FROM (
 SELECT DISTINCT sport, LEAST(home_team, away_team) AS team_a, GREATEST(home_team, away_team) AS team_b FROM <matches> m) p JOIN {_RATED} a ON a.sport = p.sport AND a.team = p.team_a JOIN {_RATED} b ON b.sport = p.sport AND b.team = p.team_b""",
    ),
    "verification_report": (
        lambda t: verification(t.predictions),
        """SELECT *, CAST(correct AS DOUBLE) * 100 / NULLIF(finished, 0) AS accuracy, profit / NULLIF(staked, 0) AS roi FROM (SELECT sport, COUNT(*) AS total, COUNT(actual_result) AS finished, COUNT(*) - COUNT(actual_result) AS not_finished,
 COUNT(CASE WHEN actual_result = pick THEN 1 END) AS correct, COUNT(CASE WHEN actual_result <> pick AND actual_result <> 'X' THEN 1 END) AS incorrect, COUNT(CASE WHEN actual_result = 'X' THEN 1 END) AS draws,
 COUNT(CASE WHEN actual_result IS NOT NULL AND odds > 0 THEN 1 END) AS staked, CAST(SUM(CASE WHEN actual_result IS NOT NULL AND odds > 0 THEN CASE WHEN actual_result = pick THEN (odds - 1) * 100 ELSE -100 END END) AS DOUBLE) AS profit FROM (
 SELECT *, CASE WHEN sport <> 'tennis' OR focus_team = 'home' THEN '1' ELSE '2' END AS pick, CASE WHEN sport <> 'tennis' OR focus_team = 'home' THEN tip_home_odds ELSE tip_away_odds END AS odds FROM <predictions> p WHERE qualifies) x GROUP BY sport) y""",
    ),
    "first_right_and_wrong": (
        lambda t: first_right_and_wrong(t.predictions),
        """SELECT sport, "right", CAST(rank AS INTEGER) AS rank, id FROM (SELECT sport, actual_result = '1' AS "right", id, ROW_NUMBER() OVER (PARTITION BY sport, actual_result = '1' ORDER BY match_date, id) AS rank FROM <predictions> p
 WHERE qualifies AND actual_result IN ('1', '2')) x WHERE rank <= 5""",
    ),
    "bet_report": (
        lambda t: bet_report(t.bets, AS_OF),
        f"""SELECT match_id, placed_on, bet_selection, CAST(odds_at_bet AS DOUBLE) AS odds, CAST({PROFIT} AS DOUBLE) AS profit, CASE status WHEN 'won' THEN 'WIN' WHEN 'lost' THEN 'LOSS' ELSE 'PENDING' END AS outcome
 FROM <bets> b WHERE placed_on >= <as_of> - 365""",
    ),
    "newest_bets": (
        lambda t: newest_bets(t.bets),
        """SELECT status, CAST(rank AS INTEGER) AS rank, match_id, placed_on, l_linenumber FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY status ORDER BY placed_on DESC, match_id DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rank FROM <bets> b) x WHERE rank <= 50""",
    ),
    "accumulators": (
        lambda t: accumulators(t.bets),
        """SELECT match_id, n, ROUND(odds + 1e-9, 4) AS odds, ROUND(100 / odds, 4) AS implied, n = n_won AS won FROM (SELECT match_id, COUNT(*) AS n, PRODUCT(CAST(odds_at_bet AS DOUBLE)) AS odds, COUNT(CASE WHEN status = 'won' THEN 1 END) AS n_won
 FROM <bets> b GROUP BY match_id) x WHERE n >= 2""",
    ),
    "best_sport": (
        lambda t: best_of(t.predictions),
        "SELECT sport, accuracy FROM (SELECT sport, AVG(CASE WHEN tip_prediction = actual_result THEN 1.0 ELSE 0.0 END) AS accuracy FROM <predictions> p WHERE tip_prediction IS NOT NULL AND actual_result IS NOT NULL GROUP BY sport) x ORDER BY accuracy DESC, sport LIMIT 1",
    ),
    "ranked_list": (
        lambda t: ranked_list(t.predictions, 3),
        f"""SELECT match_date, CAST(rank AS INTEGER) AS rank, id FROM (SELECT match_date, id, ROW_NUMBER() OVER (PARTITION BY match_date ORDER BY CASE advice_recommendation WHEN 'LOCK' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'SKIP' THEN 4 ELSE 5 END,
 {_BEST} DESC, match_time, id) AS rank FROM <predictions> p) x WHERE rank <= 3""",
    ),
    "table_counts": (
        table_counts,
        "SELECT 'matches' AS name, COUNT(*) AS n FROM <matches> m UNION ALL SELECT 'predictions', COUNT(*) FROM <predictions> p UNION ALL SELECT 'bets', COUNT(*) FROM <bets> b",
    ),
}
