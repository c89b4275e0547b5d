"""Odds of several bookmakers, rows that are enriched from several sources, and sources that stand in for one another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bookmakers in the order in which they are asked.
ORDER = ("pinnacle", "bet365")
# Sports that know a draw.
WITH_DRAW = ("football", "handball", "hockey")
SIDES = ("home_odds", "draw_odds", "away_odds")


def place_in(value: Column, order: tuple[str, ...]) -> Column:
    """The place of a value in a list, from 0; null if it isn't there."""
    return F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)) - 1


def by_priority(quotes: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """(match_id, home_odds, draw_odds, away_odds, bookmaker): of each match the quote of the first bookmaker of the order that has odds,
    other than 0, for either side, as they stand: nothing is filled in from another. No draw in sports without one; bookmakers in any
    case, their names written with capitals and blanks. One grouped minimum, no sort."""
    quotes = quotes.withColumn("place", place_in(F.lower("bookmaker"), order)).withColumn("draw_odds", F.when(F.col("sport").isin(*WITH_DRAW), F.col("draw_odds")))
    has = (F.coalesce("home_odds", F.lit(0)) != 0) | (F.coalesce("away_odds", F.lit(0)) != 0)
    best = quotes.where(F.col("place").isNotNull() & F.col("match_id").isNotNull() & has).groupBy("match_id").agg(F.min(F.struct("place", *SIDES, "bookmaker")).alias("q"))
    return best.select("match_id", *(F.col(f"q.{c}").alias(c) for c in SIDES), F.initcap(F.replace(F.lower("q.bookmaker"), F.lit("_"), F.lit(" "))).alias("bookmaker"))


def best_of_all(quotes: DataFrame, order: tuple[str, ...] | None = None) -> DataFrame:
    """(match_id, home_odds, home_bookmaker, ..., sources): of each match the highest odds above 1 for each outcome and who gives them,
    ties to the first by alphabet, and all bookmakers that give any, in order, joined by commas. order: bookmakers that count."""
    rows = quotes if order is None else quotes.where(F.lower("bookmaker").isin(*order))
    rows = rows.withColumn("draw_odds", F.when(F.col("sport").isin(*WITH_DRAW), F.col("draw_odds")))
    fine = lambda c: F.when(F.col(c) > 1, F.col(c))
    rows = rows.where("match_id IS NOT NULL AND bookmaker IS NOT NULL").where(reduce(Column.__or__, (fine(c).isNotNull() for c in SIDES)))
    # a struct whose first field is null would be the least: such rows are put after all others
    who = lambda c: F.min(F.struct(fine(c).isNull().alias("no"), (-fine(c)).alias("least"), F.when(fine(c).isNotNull(), F.col("bookmaker")).alias("who")))
    best = rows.groupBy("match_id").agg(*(who(c).alias(c) for c in SIDES), F.array_join(F.sort_array(F.collect_set("bookmaker")), ",").alias("sources"))
    return best.select("match_id", *(x for c in SIDES for x in ((-F.col(f"{c}.least")).alias(c), F.col(f"{c}.who").alias(c.replace("odds", "bookmaker")))), "sources")


def filled(rows: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """rows(match_id, ...) with odds and bookmaker of primary, or, where that has none for either side, of fallback; both have a row for
    each match at most."""
    there = lambda p: F.col(f"{p}_home_odds").isNotNull() | F.col(f"{p}_away_odds").isNotNull()
    named = lambda df, p: df.select("match_id", *(F.col(c).alias(f"{p}_{c}") for c in (*SIDES, "bookmaker")))
    both = rows.join(named(primary, "a"), "match_id", "left").join(named(fallback, "b"), "match_id", "left")
    return both.select(*rows.columns, *(F.when(there("a"), F.col(f"a_{c}")).when(there("b"), F.col(f"b_{c}")).alias(c) for c in (*SIDES, "bookmaker")))


def enriched(rows: DataFrame, sources: dict[str, DataFrame], key: str = "match_id", qualifies: str = "qualifies") -> DataFrame:
    """rows with the columns of each source (key and others, a row for each key at most), looked up for qualifying rows alone; the rest
    passes by with nulls. All joins are by one key, so rows are shuffled once, whatever the number of sources, and a source's rows that
    no qualifying row asks for are gone before its own shuffle if the keys are few (Spark's runtime filter)."""
    asked = rows.where(F.coalesce(F.col(qualifies), F.lit(False)))
    for source in sources.values():
        asked = asked.join(source, key, "left")
    return asked.unionByName(rows.where(~F.coalesce(F.col(qualifies), F.lit(False))), allowMissingColumns=True)


def tips_first(tips: DataFrame, votes: DataFrame, meetings: DataFrame, odds: DataFrame, least: float = 60.0) -> DataFrame:
    """Tips with votes and past meetings where known; those whose rate of won meetings is at least so high, then with odds."""
    kept = tips.join(votes, "match_id", "left").join(meetings, "match_id", "left").where(F.col("win_rate") >= least)
    return kept.join(odds, "match_id", "left")


def first_source(sources: list[DataFrame], keys: tuple[str, ...]) -> DataFrame:
    """For each combination of keys all rows of the first of the sources that has any, with its number from 0 as source. Each source is
    read once: they are put together, and the least number of each combination is found over a window."""
    numbered = [df.withColumn("source", F.lit(i)) for i, df in enumerate(sources)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    least = F.min("source").over(Window.partitionBy(*keys))
    return both.withColumn("_least", least).where(F.col("source") == F.col("_least")).drop("_least")


def recent_files(results: DataFrame, listed: DataFrame, as_of: str, days: int, sports: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of the last days (and of the sports): of each date and sport those of results or, where it has none, of listed."""
    recent = lambda df: df.where((F.col("match_date") > F.date_sub(F.expr(as_of), days)) & (F.col("match_date") <= F.expr(as_of)) & (F.col("sport").isin(*sports) if sports else F.lit(True)))
    return first_source([recent(results), recent(listed)], ("match_date", "sport"))


_BOOKS = ("pinnacle", "bet365", "unibet", "nordic_bet")
#: Quotes of each match by four bookmakers, some without odds for a side, or without any.
QUOTES = " UNION ALL ".join(
    f"""SELECT match_id, sport, '{b}' AS bookmaker, CASE WHEN (h + {i}) % {3 + i} = 0 THEN NULL ELSE CAST((110 + (h * {3 + 2 * i}) % 300) / 100.0 AS DECIMAL(6,2)) END AS home_odds,
 CAST((250 + (h * {5 + i}) % 250) / 100.0 AS DECIMAL(6,2)) AS draw_odds, CASE WHEN (h + {i}) % {3 + i} < 2 THEN NULL ELSE CAST((90 + (h * {11 + i}) % 300) / 100.0 AS DECIMAL(6,2)) END AS away_odds FROM <matches> q{i}"""
    for i, b in enumerate(_BOOKS)
)
_PRIORITY = """(SELECT match_id, home_odds, draw_odds, away_odds, bookmaker FROM (SELECT match_id, home_odds, CASE WHEN sport IN ('football', 'handball', 'hockey') THEN draw_odds END AS draw_odds, away_odds,
 CASE bookmaker WHEN 'pinnacle' THEN 'Pinnacle' ELSE 'Bet365' END AS bookmaker, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY CASE bookmaker WHEN 'pinnacle' THEN 0 ELSE 1 END) AS n FROM (<quotes>) q
 WHERE bookmaker IN ('pinnacle', 'bet365') AND (COALESCE(home_odds, 0) <> 0 OR COALESCE(away_odds, 0) <> 0)) r WHERE n = 1)"""
_OTHER = "(SELECT match_id, home_odds, draw_odds, away_odds, bookmaker FROM (<quotes>) o WHERE bookmaker = 'unibet')"
_BEST = lambda c, draw: f"""(SELECT match_id, {c}_odds, bookmaker AS {c}_bookmaker FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY {c}_odds DESC, bookmaker) AS n FROM (<quotes>) x WHERE {c}_odds > 1{" AND sport IN ('football', 'handball', 'hockey')" if draw else ""}) y WHERE n = 1)"""


def _quotes(t) -> DataFrame:
    return t.rows(QUOTES)


def _parts(t) -> dict[str, DataFrame]:
    p = t.predictions.withColumnRenamed("id", "match_id")
    return {
        "tips": p.where("tip_prediction IS NOT NULL").select("match_id", "tip_prediction", "tip_probability"),
        "votes": p.where("fan_home_win_prob IS NOT NULL AND match_id % 3 <> 0").select("match_id", "fan_home_win_prob", "fan_away_win_prob"),
        "advice": p.where("advice_confidence IS NOT NULL").select("match_id", "advice_recommendation", "advice_confidence"),
        "odds": by_priority(_quotes(t)),
    }


def _dated(t) -> tuple[DataFrame, DataFrame]:
    """Results of some dates and sports, and listed matches of all but some."""
    m = t.matches.select("match_id", "match_date", "sport", "home_team")
    return m.where("(day(match_date) + length(sport)) % 3 = 0 AND match_id % 2 = 0"), m.where("(day(match_date) + length(sport)) % 5 <> 1")


_LISTED = "(SELECT match_id, match_date, sport, home_team, (day(match_date) + length(sport)) % 3 = 0 AND match_id % 2 = 0 AS in_results, (day(match_date) + length(sport)) % 5 <> 1 AS in_list FROM <matches> m)"
_SQL = {
    "odds_by_priority": f"SELECT * FROM {_PRIORITY} p",
    "best_odds": f"""SELECT match_id, home_odds, home_bookmaker, draw_odds, draw_bookmaker, away_odds, away_bookmaker, sources FROM (SELECT match_id, string_agg(bookmaker, ',' ORDER BY bookmaker) AS sources FROM (<quotes>) s
 WHERE home_odds > 1 OR away_odds > 1 OR (draw_odds > 1 AND sport IN ('football', 'handball', 'hockey')) GROUP BY match_id) a
 LEFT JOIN {_BEST("home", False)} h USING (match_id) LEFT JOIN {_BEST("draw", True)} d USING (match_id) LEFT JOIN {_BEST("away", False)} w USING (match_id)""",
    "odds_filled": f"""SELECT m.match_id, COALESCE(p.bookmaker, o.bookmaker) AS bookmaker, CASE WHEN p.match_id IS NOT NULL THEN p.home_odds ELSE o.home_odds END AS home_odds, CASE WHEN p.match_id IS NOT NULL THEN p.draw_odds ELSE o.draw_odds END AS draw_odds,
 CASE WHEN p.match_id IS NOT NULL THEN p.away_odds ELSE o.away_odds END AS away_odds FROM <matches> m LEFT JOIN {_PRIORITY} p ON p.match_id = m.match_id LEFT JOIN (SELECT * FROM {_OTHER} z WHERE home_odds IS NOT NULL OR away_odds IS NOT NULL) o ON o.match_id = m.match_id""",
    "enriched_matches": f"""SELECT p.id AS match_id, p.qualifies, CASE WHEN q AND tip_prediction IS NOT NULL THEN tip_prediction END AS tip_prediction, CASE WHEN q AND tip_prediction IS NOT NULL THEN tip_probability END AS tip_probability,
 CASE WHEN q AND p.id % 3 <> 0 THEN fan_home_win_prob END AS fan_home_win_prob, CASE WHEN q AND p.id % 3 <> 0 AND fan_home_win_prob IS NOT NULL THEN fan_away_win_prob END AS fan_away_win_prob,
 CASE WHEN q AND advice_confidence IS NOT NULL THEN advice_recommendation END AS advice_recommendation, CASE WHEN q THEN advice_confidence END AS advice_confidence, CASE WHEN q THEN o.home_odds END AS home_odds, CASE WHEN q THEN o.draw_odds END AS draw_odds,
 CASE WHEN q THEN o.away_odds END AS away_odds, CASE WHEN q THEN o.bookmaker END AS bookmaker FROM (SELECT *, COALESCE(qualifies, FALSE) AS q FROM <predictions> z) p LEFT JOIN {_PRIORITY} o ON o.match_id = p.id""",
    "tips_with_meetings": f"""SELECT p.id AS match_id, tip_prediction, tip_probability, CASE WHEN p.id % 3 <> 0 THEN fan_home_win_prob END AS fan_home_win_prob, CASE WHEN p.id % 3 <> 0 AND fan_home_win_prob IS NOT NULL THEN fan_away_win_prob END AS fan_away_win_prob, CAST(h2h_win_rate AS DOUBLE) AS win_rate,
 o.home_odds, o.draw_odds, o.away_odds, o.bookmaker FROM <predictions> p LEFT JOIN {_PRIORITY} o ON o.match_id = p.id WHERE tip_prediction IS NOT NULL AND h2h_win_rate >= 60""",
    "first_source_by_day": f"""SELECT l.match_id, l.match_date, l.sport, l.home_team, 0 AS source FROM {_LISTED} l WHERE in_results
 UNION ALL SELECT l.match_id, l.match_date, l.sport, l.home_team, 1 FROM {_LISTED} l WHERE in_list AND NOT EXISTS (SELECT 1 FROM {_LISTED} r WHERE r.in_results AND r.match_date = l.match_date AND r.sport = l.sport)""",
    "recent_by_source": f"""SELECT l.match_id, l.match_date, l.sport, l.home_team, 0 AS source FROM {_LISTED} l WHERE in_results AND match_date > <as_of> - 365 AND match_date <= <as_of> AND sport IN ('football', 'tennis')
 UNION ALL SELECT l.match_id, l.match_date, l.sport, l.home_team, 1 FROM {_LISTED} l WHERE in_list AND match_date > <as_of> - 365 AND match_date <= <as_of> AND sport IN ('football', 'tennis') AND NOT EXISTS (SELECT 1 FROM {_LISTED} r WHERE r.in_results AND r.match_date = l.match_date AND r.sport = l.sport)""",
}
_BUILD = {
    "odds_by_priority": lambda t: by_priority(_quotes(t)),
    "best_odds": lambda t: best_of_all(_quotes(t)),
    "odds_filled": lambda t: filled(t.matches.select("match_id"), by_priority(_quotes(t)), _quotes(t).where("bookmaker = 'unibet'").select("match_id", *SIDES, "bookmaker")),
    "enriched_matches": lambda t: enriched(t.predictions.select(F.col("id").alias("match_id"), "qualifies"), _parts(t)),
    "tips_with_meetings": lambda t: tips_first(*(_parts(t)[k] for k in ("tips", "votes")), t.predictions.select(F.col("id").alias("match_id"), F.col("h2h_win_rate").cast("double").alias("win_rate")), _parts(t)["odds"]),
    "first_source_by_day": lambda t: first_source(list(_dated(t)), ("match_date", "sport")),
    "recent_by_source": lambda t: recent_files(*_dated(t), "DATE '2001-08-01'", 365, ("football", "tennis")),
}
QUERIES = {name: (build, _SQL[name].replace("<quotes>", QUOTES)) for name, build in _BUILD.items()}
