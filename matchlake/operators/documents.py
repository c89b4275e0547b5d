"""Feed documents, JSON as the services send it, to rows. A document that can't be read gives no rows and is counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .odds import WITH_DRAW

# What the services call the states of a match; markets with three outcomes; the code of the break.
STATES = {"STATUS_IN_PROGRESS": "live", "STATUS_FINAL": "finished", "STATUS_HALFTIME": "halftime"}
MARKETS = ("Full Time", "1X2", "Match Winner", "Full Time Result")
BREAK = 31
SCORES = """events array<struct<id: string, season: struct<type: struct<name: string>>, status: struct<displayClock: string, type: struct<name: string>>,
 competitions: array<struct<competitors: array<struct<homeAway: string, score: string, team: struct<displayName: string>>>>>>>"""
SCHEDULE = """events array<struct<id: bigint, status: struct<type: string, code: int, description: string>, homeTeam: struct<name: string>, awayTeam: struct<name: string>,
 homeScore: struct<current: int>, awayScore: struct<current: int>, tournament: struct<name: string>>>"""
QUOTE = "home struct<value: string>, draw struct<value: string>, away struct<value: string>"
ODDS_MARKETS = "markets array<struct<marketName: string, choices: array<struct<name: string, fractionalValue: string, sourceOdds: array<struct<odds: string>>>>>>"


def read(documents: DataFrame, schema: str) -> DataFrame:
    """documents(body, ...) with body parsed as doc, and broken: what couldn't be read, as text, else null. Null bodies are neither."""
    parsed = F.from_json("body", f"{schema}, broken string", {"columnNameOfCorruptRecord": "broken"})
    got = documents.withColumn("doc", parsed)
    return got.withColumn("broken", F.col("doc.broken")).drop("body")


def broken_documents(documents: DataFrame, schema: str, *keys: str) -> DataFrame:
    """(keys..., documents, broken): how many documents there are and how many of them can't be read."""
    return read(documents, schema).groupBy(*keys).agg(F.count("*").alias("documents"), F.count("broken").alias("broken"))


def live_scores(documents: DataFrame) -> DataFrame:
    """(sport, id, home_team, away_team, home_score, away_score, status, clock, league) from documents(sport, body) of scores. Sides are
    the competitors that say so, else the first and the second; events with fewer than two are left out, and those with a score that is
    no whole number; an empty or missing score is 0, an unknown state is scheduled."""
    each = read(documents, SCORES).where("broken IS NULL").select("sport", F.explode("doc.events").alias("e"))
    sides = each.select("sport", "e", F.get("e.competitions", 0)["competitors"].alias("c")).where(F.size("c") >= 2)
    side = lambda name, i: F.coalesce(F.get(F.filter("c", lambda x: x["homeAway"] == name), 0), F.get("c", i)).alias(name)
    rows = sides.select("sport", "e", side("home", 0), side("away", 1))
    score = lambda s: F.when(F.coalesce(F.col(f"{s}.score"), F.lit("")) == "", F.lit(0)).otherwise(F.col(f"{s}.score").try_cast("int"))
    state = F.coalesce(F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv))[F.col("e.status.type.name")], F.lit("scheduled"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    got = rows.select(
        "sport", text("e.id").alias("id"), text("home.team.displayName").alias("home_team"), text("away.team.displayName").alias("away_team"), score("home").alias("home_score"), score("away").alias("away_score"),
        state.alias("status"), text("e.status.displayClock").alias("clock"), text("e.season.type.name").alias("league"),
    )
    return got.where("home_score IS NOT NULL AND away_score IS NOT NULL")


def finished(documents: DataFrame) -> DataFrame:
    """(sport, id, home_team, away_team, home_score, away_score, result) of the finished events of a schedule's documents(sport, body)
    that have both scores."""
    each = read(documents, SCHEDULE).where("broken IS NULL").select("sport", F.explode("doc.events").alias("e")).where("e.status.type = 'finished'")
    h, a = F.col("e.homeScore.current"), F.col("e.awayScore.current")
    result = F.when(h > a, "1").when(h < a, "2").otherwise("X")
    return each.where(h.isNotNull() & a.isNotNull()).select("sport", "e.id", F.col("e.homeTeam.name").alias("home_team"), F.col("e.awayTeam.name").alias("away_team"), h.alias("home_score"), a.alias("away_score"), result.alias("result"))


def in_progress(documents: DataFrame, most: int = 10) -> DataFrame:
    """(sport, day, position, id, home_team, away_team, home_score, away_score, minute, status, league): the first `most` events of each
    document(sport, day, body), from 1. A missing score is 0; at the break the status is halftime, unless the event's type says live."""
    each = read(documents, SCHEDULE).where("broken IS NULL").select("sport", "day", F.posexplode(F.slice("doc.events", 1, most)).alias("position", "e"))
    status = F.when(F.col("e.status.type") == "inprogress", "live").when(F.col("e.status.code") == BREAK, "halftime").otherwise("live")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return each.select(
        "sport", "day", (F.col("position") + 1).alias("position"), F.col("e.id").cast("string").alias("id"), text("e.homeTeam.name").alias("home_team"), text("e.awayTeam.name").alias("away_team"),
        F.coalesce("e.homeScore.current", F.lit(0)).alias("home_score"), F.coalesce("e.awayScore.current", F.lit(0)).alias("away_score"), text("e.status.description").alias("minute"), status.alias("status"), text("e.tournament.name").alias("league"),
    )


def quotes(documents: DataFrame) -> DataFrame:
    """(match_id, bookmaker, home_odds, draw_odds, away_odds) from answers(match_id, sport, bookmaker, body) about odds: under their usual
    name or, without it, under any other, the first that has odds for either side. No draw in sports without one; what is no number is
    null; answers without odds for either side are left out."""
    usual = F.from_json("body", f"data struct<findPrematchOddsForBookmaker: struct<{QUOTE.replace(' ', ': ', 1).replace(', draw ', ', draw: ').replace(', away ', ', away: ')}>>")
    any_ = F.from_json("body", f"data map<string, struct<{QUOTE.replace(' ', ': ', 1).replace(', draw ', ', draw: ').replace(', away ', ', away: ')}>>")
    value = lambda q, s: q[s]["value"].try_cast("double")
    some = lambda q: (F.coalesce(value(q, "home"), F.lit(0.0)) != 0) | (F.coalesce(value(q, "away"), F.lit(0.0)) != 0)
    known = documents.select("match_id", "sport", "bookmaker", usual["data"]["findPrematchOddsForBookmaker"].alias("usual"), any_["data"].alias("any"))
    named = F.array_contains(F.map_keys("any"), "findPrematchOddsForBookmaker")
    q = F.when(named, F.col("usual")).otherwise(F.get(F.filter(F.map_values("any"), some), 0))
    got = known.select("match_id", "sport", "bookmaker", q.alias("q")).where(some(F.col("q")))
    draw = F.when(F.col("sport").isin(*WITH_DRAW), value(F.col("q"), "draw"))
    return got.select("match_id", "bookmaker", value(F.col("q"), "home").alias("home_odds"), draw.alias("draw_odds"), value(F.col("q"), "away").alias("away_odds"))


def decimal_odds(choice: Column) -> Column:
    """A choice's odds: of a fraction a/b, a / b + 1; of another number itself; without it, or where it is 0, the first source's odds."""
    text = choice["fractionalValue"]
    parts = F.split(text, "/")
    fraction = F.when(F.size(parts) == 2, F.try_divide(F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")) + 1)
    own = F.when(text.contains("/"), fraction).otherwise(text.try_cast("double"))
    return F.coalesce(F.nullif(own, F.lit(0.0)), F.get(choice["sourceOdds"], 0)["odds"].try_cast("double"))


def market_odds(documents: DataFrame) -> DataFrame:
    """(match_id, home_odds, draw_odds, away_odds) from documents(match_id, body) of markets: of the first market with three outcomes in
    which both sides have odds, two decimals. A choice's name says its outcome: 1 or home, else x or draw, else 2 or away, in any case; the
    last choice of an outcome with odds above 1 counts, and one that an earlier market gave stays until then."""
    each = read(documents, ODDS_MARKETS).where("broken IS NULL").select("match_id", F.posexplode("doc.markets").alias("market", "m")).where(F.col("m.marketName").isin(*MARKETS))
    choices = each.select("match_id", "market", F.posexplode("m.choices").alias("place", "c")).select("match_id", "market", "place", F.lower(F.coalesce("c.name", F.lit(""))).alias("name"), decimal_odds(F.col("c")).alias("odds")).where("odds > 1")
    has = lambda a, b: F.col("name").contains(a) | F.col("name").contains(b)
    outcome = F.when(has("1", "home"), "home").when(has("x", "draw"), "draw").when(has("2", "away"), "away")
    rows = choices.withColumn("outcome", outcome).where("outcome IS NOT NULL")
    last = lambda o: F.max(F.when(F.col("outcome") == o, F.struct("market", "place", F.round("odds", 2).alias("odds")))).alias(o)
    by_market = rows.groupBy("match_id", "market").agg(*map(last, ("home", "draw", "away")))
    so_far = Window.partitionBy("match_id").orderBy("market").rowsBetween(Window.unboundedPreceding, 0)
    known = by_market.select("match_id", "market", *(F.last(o, True).over(so_far)["odds"].alias(f"{o}_odds") for o in ("home", "draw", "away")))
    done = known.where("home_odds IS NOT NULL AND away_odds IS NOT NULL").groupBy("match_id").agg(F.min(F.struct("market", "home_odds", "draw_odds", "away_odds")).alias("m"))
    return done.select("match_id", "m.home_odds", "m.draw_odds", "m.away_odds")


_UNREADABLE = "(day(match_date) + length(sport)) % 9 = 0"


def _documents(t, event: Column, kept: str = "true") -> DataFrame:
    """A document for each sport and day with an event of each match, by id; some are cut off before their end."""
    rows = t.matches.where(kept).select("sport", F.col("match_date").alias("day"), "match_id", F.expr(_UNREADABLE).alias("cut"), event.alias("e"))
    docs = rows.groupBy("sport", "day").agg(F.transform(F.sort_array(F.collect_list(F.struct("match_id", "e"))), lambda x: x["e"]).alias("events"), F.max("cut").alias("cut"))
    body = F.to_json(F.struct("events"))
    return docs.select("sport", "day", F.when(F.col("cut"), F.substring(body, F.lit(1), F.length(body) - 7)).otherwise(body).alias("body"))


def _score_events(t) -> DataFrame:
    team = lambda side, name: F.struct(F.when(F.col("h") % 4 != 0, F.lit(side)).alias("homeAway"), F.when(F.col("h") % 17 == 0, F.lit("?")).otherwise(F.col(f"{side}_score").cast("string")).alias("score"), F.struct(F.col(name).alias("displayName")).alias("team"))
    home, away = team("home", "home_team"), team("away", "away_team")
    # who says that it is the guests' side stands first; who says nothing stands in its place; some stand alone
    sides = F.when(F.col("h") % 13 == 0, F.array(home)).when(F.col("h") % 4 == 0, F.array(home, away)).otherwise(F.array(away, home))
    state = F.expr("CASE WHEN actual_result IS NOT NULL THEN 'STATUS_FINAL' WHEN h % 3 = 0 THEN 'STATUS_IN_PROGRESS' WHEN h % 3 = 1 THEN 'STATUS_HALFTIME' ELSE 'STATUS_POSTPONED' END")
    event = F.struct(F.col("match_id").cast("string").alias("id"), F.struct(F.struct(F.col("league").alias("name")).alias("type")).alias("season"), F.struct(F.col("match_time").alias("displayClock"), F.struct(state.alias("name")).alias("type")).alias("status"), F.array(F.struct(sides.alias("competitors"))).alias("competitions"))
    return _documents(t, event)


def _schedule(t) -> DataFrame:
    kind = F.expr("CASE WHEN actual_result IS NOT NULL AND h % 6 <> 0 THEN 'finished' WHEN h % 2 = 0 THEN 'inprogress' ELSE 'notstarted' END")
    side = lambda s: F.struct(F.col(f"{s}_team").alias("name")).alias(f"{s}Team")
    score = lambda s: F.struct(F.when(F.col("h") % 5 != 0, F.col(f"{s}_score")).alias("current")).alias(f"{s}Score")
    event = F.struct(F.col("match_id").alias("id"), F.struct(kind.alias("type"), F.when(F.col("h") % 3 == 0, BREAK).otherwise(7).alias("code"), F.col("match_time").alias("description")).alias("status"), side("home"), side("away"), score("home"), score("away"), F.struct(F.col("league").alias("name")).alias("tournament"))
    return _documents(t, event)


_ANSWERS = """SELECT match_id, sport, 'bet365' AS bookmaker, '{"data": {"' || CASE WHEN h % 3 = 0 THEN 'other": {}, "more' ELSE 'findPrematchOddsForBookmaker' END || '": {' || CASE WHEN h % 7 = 0 THEN '' ELSE '"home": {"value": "' || CAST(1 + (h % 300) / 100.0 AS STRING) || '"}, ' END
 || '"draw": {"value": "3.25"}, "away": ' || CASE WHEN h % 5 = 0 THEN 'null' WHEN h % 5 = 1 THEN '{"value": "-"}' ELSE '{"value": "2.50"}' END || '}}' || CASE WHEN h % 11 = 0 THEN '' ELSE '}' END AS body FROM <matches> m"""
_MARKETS = """SELECT match_id, '{"markets": [{"marketName": "Total", "choices": [{"name": "1", "fractionalValue": "9/1"}]}, {"marketName": "Full Time", "choices": [{"name": "1", "fractionalValue": "' || CAST(1 + h % 9 AS STRING) || '/' || CASE WHEN h % 8 = 0 THEN '0' ELSE '4' END || '"}, {"name": "X", "sourceOdds": [{"odds": "3.4"}]}'
 || CASE WHEN h % 3 = 0 THEN '' ELSE ', {"name": "2", "fractionalValue": "' || CAST(h % 4 AS STRING) || '", "sourceOdds": [{"odds": 2.126}]}' END || ']}, {"marketName": "1X2", "choices": [{"name": "Away", "fractionalValue": "1.5"}]}]' || CASE WHEN h % 11 = 0 THEN '' ELSE '}' END AS body FROM <matches> m"""
_READABLE = f"NOT ({_UNREADABLE})"
QUERIES = {
    "live_scores": (
        lambda t: live_scores(_score_events(t)),
        f"""SELECT sport, CAST(match_id AS VARCHAR) AS id, home_team, away_team, CAST(COALESCE(home_score, 0) AS INTEGER) AS home_score, CAST(COALESCE(away_score, 0) AS INTEGER) AS away_score,
 CASE WHEN actual_result IS NOT NULL THEN 'finished' WHEN h % 3 = 0 THEN 'live' WHEN h % 3 = 1 THEN 'halftime' ELSE 'scheduled' END AS status, match_time AS clock, league FROM <matches> m WHERE {_READABLE} AND h % 13 <> 0 AND h % 17 <> 0""",
    ),
    "broken_documents": (
        lambda t: broken_documents(_score_events(t), SCORES, "sport"),
        f"SELECT sport, COUNT(*) AS documents, COUNT(CASE WHEN {_UNREADABLE} THEN 1 END) AS broken FROM (SELECT DISTINCT sport, match_date FROM <matches> m) d GROUP BY sport",
    ),
    "finished_events": (
        lambda t: finished(_schedule(t)),
        f"""SELECT sport, match_id AS id, home_team, away_team, CAST(home_score AS INTEGER) AS home_score, CAST(away_score AS INTEGER) AS away_score, actual_result AS result FROM <matches> m WHERE {_READABLE} AND actual_result IS NOT NULL AND h % 6 <> 0 AND h % 5 <> 0""",
    ),
    "events_in_progress": (
        lambda t: in_progress(_schedule(t), 3),
        f"""SELECT sport, day, position, id, home_team, away_team, home_score, away_score, minute, status, league FROM (SELECT sport, match_date AS day, CAST(ROW_NUMBER() OVER (PARTITION BY sport, match_date ORDER BY match_id) AS INTEGER) AS position, CAST(match_id AS VARCHAR) AS id, home_team, away_team,
 CAST(CASE WHEN h % 5 <> 0 THEN COALESCE(home_score, 0) ELSE 0 END AS INTEGER) AS home_score, CAST(CASE WHEN h % 5 <> 0 THEN COALESCE(away_score, 0) ELSE 0 END AS INTEGER) AS away_score, match_time AS minute,
 CASE WHEN NOT (actual_result IS NOT NULL AND h % 6 <> 0) AND h % 2 = 0 THEN 'live' WHEN h % 3 = 0 THEN 'halftime' ELSE 'live' END AS status, league FROM <matches> m WHERE {_READABLE}) x WHERE position <= 3""",
    ),
    "odds_answers": (
        lambda t: quotes(t.rows(_ANSWERS)),
        """SELECT match_id, 'bet365' AS bookmaker, CASE WHEN h % 7 <> 0 THEN CAST(CAST(1 + (h % 300) / 100.0 AS DECIMAL(6,2)) AS DOUBLE) END AS home_odds, CASE WHEN sport IN ('football', 'handball', 'hockey') THEN 3.25::DOUBLE END AS draw_odds, CASE WHEN h % 5 > 1 THEN 2.5::DOUBLE END AS away_odds
 FROM <matches> m WHERE h % 11 <> 0 AND (h % 7 <> 0 OR h % 5 > 1)""",
    ),
    "odds_of_markets": (
        lambda t: market_odds(t.rows(_MARKETS)),
        """SELECT match_id, CAST(round((1 + h % 9) / 4.0 + 1, 2) AS DOUBLE) AS home_odds, 3.4::DOUBLE AS draw_odds, CASE WHEN h % 3 = 0 OR h % 4 = 1 THEN 1.5::DOUBLE WHEN h % 4 = 0 THEN 2.13::DOUBLE ELSE CAST(h % 4 AS DOUBLE) END AS away_odds FROM <matches> m WHERE h % 11 <> 0 AND h % 8 <> 0""",
    ),
}
