"""Players: rankings and odds out of saved pages, and rates of winning by surface where only meetings and a ranking are known."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions import text as X
from matchlake.sources.html import Node, picked

from .odds import WITH_DRAW

# Rankings up to each number add so much to a rate, up to a highest rate; below all of them it falls, down to a lowest.
TIERS = ((10, 0.15, 0.95), (30, 0.10, 0.90), (50, 0.05, 0.85), (100, 0.0, 0.75))
BELOW, LOWEST = -0.05, 0.45
SURFACES = ("clay", "grass", "hard")
# Words of a meeting's text and of a field that name a surface.
MEETING_WORDS = {"clay": ("clay", "ziemia", "antuka", "roland garros", "monte carlo"), "grass": ("grass", "trawa", "wimbledon"), "hard": ("hard", "twarda", "us open", "australian open")}
FIELD_WORDS = {"clay": ("clay", "ziemia"), "grass": ("grass", "trawa"), "hard": ("hard", "twarda")}
#: Characters of a page that belong to its question about the winner, and to the one about both sides' goals.
ABOUT_WINNER, ABOUT_GOALS = 5000, 1000


def same_name(a: Column, b: Column) -> Column:
    """Whether a name, in lower case and trimmed, is the other or a part of it; empty ones are no name."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def rankings(pages: DataFrame) -> DataFrame:
    """(page_id, player, ranking) for pages(page_id, player, html): the number behind the player's name in brackets; else of the page's two
    rankings, as its data has them or, without any, its text, the one in the place of the participant of that name; else its only one in
    the data; else the first number in an element named after rankings that has the name; else null."""

    def rule(page: Node) -> Iterator[tuple]:
        yield page.text(" "), [x.text() for x in page.all("a", having="participant__participantName")], [x.text() for x in page.all(part="ranking")]

    data = F.regexp_extract_all("html", F.lit(r'(?i)"rank":\["(?:ATP|WTA)","(\d+)",'), 1)
    found = picked(pages.where("player <> ''"), ["page_id", "player"], "text string, names array<string>, marked array<string>", rule)
    found = found.join(pages.select("page_id", "player", data.alias("data")).where("player <> ''").distinct(), ["page_id", "player"])
    behind = F.expr(r"regexp_extract(text, concat(r'\Q', player, r'\E\s*\((\d+)\)'), 1)")
    place = F.when(F.size("names") >= 2, F.when(same_name(F.col("player"), F.get("names", 0)), 0).when(same_name(F.col("player"), F.get("names", 1)), 1))
    written = F.regexp_extract_all("text", F.lit(r"(?i)(?:ATP|WTA):\s*(\d+)"), 1)
    of_two = lambda numbers: F.when(F.size(numbers) >= 2, F.get(numbers, place))
    own = F.get(F.filter("marked", lambda m: F.contains(F.lower(m), F.lower("player")) & m.rlike(r"\d")), 0)
    number = F.coalesce(F.nullif(behind, F.lit("")), of_two(F.col("data")), F.when(F.size("data") == 1, F.get("data", 0)), of_two(written), F.nullif(F.regexp_extract(own, r"(\d+)", 1), F.lit("")))
    return found.select("page_id", "player", number.try_cast("int").alias("ranking"))


def page_odds(pages: DataFrame) -> DataFrame:
    """(page_id, home_odds, away_odds): what a page's elements say in their attributes, the last of each side; where the home side's is
    missing, the first two numbers with two decimals in buttons and fields named after odds; else null."""
    number = re.compile(r"\d+\.\d{2}")

    def rule(page: Node) -> Iterator[tuple]:
        own = {s: next((x.attrs[f"data-{s}-odds"] for x in reversed(page.all()) if _number(x.attrs.get(f"data-{s}-odds"))), None) for s in ("home", "away")}
        yield own["home"], own["away"], [n for x in page.all("button", "div", "span", part="odds") for n in number.findall(x.text())]

    got = picked(pages, ["page_id"], "home string, away string, numbers array<string>", rule)
    two = F.col("home").isNull() & (F.size("numbers") >= 2)
    odds = lambda c, i: F.when(two, F.get("numbers", i)).otherwise(F.col(c)).try_cast("double").alias(f"{c}_odds")
    return got.select("page_id", odds("home", 0), odds("away", 1))


def _number(text: str | None) -> bool:
    try:
        return text is not None and float(text) == float(text)
    except ValueError:
        return False


def surface_rates(players: DataFrame) -> DataFrame:
    """players(name, ranking, wins, total, ...) with clay, grass and hard: the share of meetings won (0.60 without any), raised or lowered
    by the ranking's tier, more on the one surface that the sum of the name's characters tells and less on the others, and by a few
    hundredths that it tells too. Null for empty names."""
    rate = F.when(F.col("total") > 0, F.col("wins") / F.col("total")).otherwise(F.lit(0.60))
    tier = F.when(F.coalesce(F.col("ranking"), F.lit(0)) == 0, rate)
    for most, more, highest in TIERS:
        tier = tier.when(F.col("ranking") <= most, F.least(rate + more, F.lit(highest)))
    base = tier.otherwise(F.greatest(rate + BELOW, F.lit(LOWEST)))
    total = F.aggregate(F.split("name", ""), F.lit(0).cast("long"), lambda s, c: s + F.coalesce(F.ascii(c), F.lit(0)))
    got = players.withColumn("_sum", total).withColumn("_base", base)
    shift = (F.col("_sum") % 7 - 3) / 100
    for i, surface in enumerate(SURFACES):
        own = F.when(F.col("_sum") % 3 == i, F.least(F.col("_base") + 0.08, F.lit(0.98))).otherwise(F.greatest(F.col("_base") - 0.04, F.lit(0.30)))
        got = got.withColumn(surface, F.when(F.col("name") != "", F.greatest(F.lit(0.30), F.least(F.lit(0.98), own + shift))))
    return got.drop("_sum", "_base")


def _surface(text: Column, words: dict[str, tuple[str, ...]]) -> Column:
    out = F.when(F.lit(False), "")
    for surface, names in words.items():
        for name in names:
            out = out.when(F.lower(text).contains(name), surface)
    return out


def _won(sets: Column) -> Column:
    """Whether the first player has more sets."""
    return F.get(F.split(sets, "-"), 0).try_cast("int") > F.get(F.split(sets, "-"), 1).try_cast("int")


def dated_meetings(pages: DataFrame) -> DataFrame:
    """(page_id, nth, date, raw_score, score, winner, surface) of the meetings of two players on pages(page_id, player_a, player_b, html):
    rows with a date and a result, the first of three kinds that a page has. The winner is who the row's winner field names, or, without
    one, its text, player_a before player_b; else who has more sets, player_b at as many; rows that tell neither are left out. surface:
    unknown where the row's text names none."""

    def rule(page: Node) -> Iterator[tuple]:
        kinds = (page.all("div", having="h2h__row"), [y for x in page.all("div", having="rows") for y in x.all("div", having="h2h")], page.all("div", part="h2h"))
        for nth, row in enumerate(next((k for k in kinds if k), []), 1):
            result = next((x for x in row.all("div", "span") if "h2h__result" in x.classes or x.tag == "div" and "result" in " ".join(x.classes)), None)
            winner = row.first(part="winner")
            date = re.search(r"\d{1,2}\.\d{1,2}\.\d{2,4}", row.text())
            if date and result:
                yield nth, date.group(), result.text(), (winner or row).text().lower(), row.text()

    found = picked(pages, ["page_id", "player_a", "player_b"], "nth int, date string, raw_score string, told string, text string", rule)
    found = found.withColumn("score", X.sets_won(F.col("raw_score")))
    named = lambda p: F.coalesce(F.col("told").contains(F.lower(F.trim(p))), F.lit(False))
    winner = F.when(named("player_a"), "player_a").when(named("player_b"), "player_b").when(F.col("score").isNotNull(), F.when(_won(F.col("score")), "player_a").otherwise("player_b"))
    got = found.withColumns({"winner": winner, "surface": F.coalesce(_surface(F.col("text"), MEETING_WORDS), F.lit("unknown"))})
    return got.where("winner IS NOT NULL").select("page_id", "nth", "date", "raw_score", "score", "winner", "surface")


def detailed_form(pages: DataFrame, most: int = 10) -> DataFrame:
    """(page_id, nth, result, date, opponent, opponent_rank, score, surface) of the first `most` results on a player's page: W or L as the
    row says, else by its sets; rows that tell neither are left out. Scores as sets where they are games."""

    def rule(page: Node) -> Iterator[tuple]:
        rows = [x for x in page.all("div") if "sportName" in x.classes or any(w in " ".join(x.classes) for w in ("result", "match"))]
        for nth, row in enumerate(rows[:most], 1):
            date, score, surface = (row.first(part=name) for name in ("date", "score", "surface"))
            opponent = next((x for x in row.all() if "opponent" in " ".join(x.classes) or x.tag == "a" and "participant" in x.classes), None)
            low = row.text().lower()
            said = "W" if "win" in row.classes or "winner" in low else "L" if "loss" in row.classes or "loser" in low else None
            yield nth, said, *(x.text() if x else None for x in (date, opponent, score, surface))

    found = picked(pages, ["page_id"], "nth int, said string, date string, opponent string, raw string, field string", rule)
    found = found.withColumn("sets", X.sets_won(F.col("raw")))
    result = F.coalesce("said", F.when(F.col("sets").isNotNull(), F.when(_won(F.col("sets")), "W").otherwise("L")))
    rank = F.regexp_extract("opponent", r"\((\d+)\)", 1).try_cast("int")
    return found.select("page_id", "nth", result.alias("result"), "date", "opponent", rank.alias("opponent_rank"), F.coalesce("sets", "raw").alias("score"), _surface(F.col("field"), FIELD_WORDS).alias("surface")).where("result IS NOT NULL")


def page_votes(pages: DataFrame) -> DataFrame:
    """(page_id, home, draw, away, yes, no, votes) from pages(page_id, sport, html): the percents behind the question who will win, three
    in sports with a draw if there are, else the first two; the first two behind the question whether both teams score; the number of
    votes, 0 without one. Column functions alone."""
    html, after = F.col("html"), lambda text, words, n: F.when(F.instr(text, words) > 1, F.substring(text, F.instr(text, words), F.lit(n)))
    section = after(html, "Who will win", ABOUT_WINNER)
    rows = pages.select("page_id", "sport", X.votes(html).alias("votes"), section.alias("section"))
    rows = rows.withColumn("goals", F.when(F.instr("section", "both teams score") > 0, after(F.col("section"), "both teams score", ABOUT_GOALS)).otherwise(after(F.col("section"), "Will both", ABOUT_GOALS)))
    percents = lambda c: F.regexp_extract_all(c, F.lit(r">(\d{1,2})%<"), 1)
    rows = rows.select("page_id", "sport", "votes", percents("section").alias("p"), percents("goals").alias("g"))
    three, two = F.col("sport").isin(*WITH_DRAW) & (F.size("p") >= 3), F.size("p") >= 2
    of = lambda c, i: F.get(c, i).cast("int")
    goals = lambda i: F.when(F.size("g") >= 2, of("g", i))
    return rows.select("page_id", F.when(two, of("p", 0)).alias("home"), F.when(three, of("p", 1)).alias("draw"), F.when(three, of("p", 2)).when(two, of("p", 1)).alias("away"), goals(0).alias("yes"), goals(1).alias("no"), F.coalesce("votes", F.lit(0)).cast("long").alias("votes"))


#: A page of each tennis match, for one of its players: rankings in brackets, in data, in text, or in an element; odds in two places.
PLAYER_PAGES = """SELECT match_id AS page_id, CASE WHEN h % 2 = 0 THEN home_team ELSE away_team END AS player, '<body>' || CASE WHEN h % 5 = 4 THEN '' ELSE '<a class="participant__participantName">' || home_team || '</a><a class="participant__participantName x">' || away_team || '</a>' END
 || CASE h % 5 WHEN 0 THEN '<p>' || CASE WHEN h % 2 = 0 THEN home_team ELSE away_team END || ' (' || CAST(1 + h % 90 AS STRING) || ')</p>' WHEN 1 THEN '<script>{"rank":["ATP","' || CAST(1 + h % 80 AS STRING) || '","x"],"rank":["WTA","' || CAST(100 + h % 80 AS STRING) || '",1]}</script>'
  WHEN 2 THEN '<i>ATP: ' || CAST(1 + h % 70 AS STRING) || '</i><i>wta:' || CAST(100 + h % 70 AS STRING) || '</i>' WHEN 3 THEN '<div class="x__ranking">' || CASE WHEN h % 2 = 0 THEN home_team ELSE away_team END || ' no. ' || CAST(1 + h % 60 AS STRING) || '</div>' ELSE '<script>"rank":["ATP","' || CAST(1 + h % 50 AS STRING) || '",</script>' END
 || CASE WHEN h % 3 = 0 THEN '<b data-home-odds="1.5" data-away-odds="-"></b>' WHEN h % 3 = 1 THEN '<span class="odds">' || CAST(CAST((110 + h % 300) / 100.0 AS DECIMAL(4,2)) AS STRING) || '</span><button class="odds__x">2.25 and 9.99</button>' ELSE '<span class="odds">2.25</span>' END || '</body>' AS html FROM <matches> m WHERE sport = 'tennis'"""
_PLAYERS = "SELECT match_id, home_team AS name, CASE WHEN h % 9 = 0 THEN NULL ELSE CAST(h % 150 AS INT) END AS ranking, CAST(h % 4 AS INT) AS wins, CAST(CASE WHEN h % 5 = 0 THEN 0 ELSE h % 4 + h % 3 END AS INT) AS total FROM <matches> m"
_SURFACE = lambda i: f"GREATEST(0.30::DOUBLE, LEAST(0.98::DOUBLE, (CASE WHEN n % 3 = {i} THEN LEAST(base + 0.08::DOUBLE, 0.98::DOUBLE) ELSE GREATEST(base - 0.04::DOUBLE, 0.30::DOUBLE) END) + CAST(n % 7 - 3 AS DOUBLE) / 100)) AS {SURFACES[i]}"
_ROW = lambda i: f"""CASE WHEN h % 4 >= {i} THEN '<div class="h2h__row"><i>' || CASE WHEN (h + {i}) % 9 = 0 THEN 'soon' ELSE '0{1 + i}.10.24' END || '</i><b>' || CASE (h + {i}) % 4 WHEN 0 THEN 'Roland Garros' WHEN 1 THEN 'Wimbledon' WHEN 2 THEN 'Hard court' ELSE 'Cup' END || '</b><span class="h2h__result">' || CASE (h + {i}) % 3 WHEN 0 THEN '6-4, 7-5' WHEN 1 THEN '1-2' ELSE '4:6 6:3 2:6' END || '</span>' || CASE (h + {i}) % 5 WHEN 0 THEN '<u class="x-winner">' || away_team || '</u>' WHEN 1 THEN home_team ELSE '' END || '</div>' ELSE '' END"""
_MEET = f"SELECT match_id AS page_id, home_team AS player_a, away_team AS player_b, '<section>' || {' || '.join(_ROW(i) for i in range(4))} || '</section>' AS html FROM <matches> m WHERE sport = 'tennis'"
_RESULT = lambda i: f"""'<div class="row__match' || CASE (h + {i}) % 4 WHEN 0 THEN ' win' WHEN 1 THEN ' loss' ELSE '' END || '"><i class="date">{1 + i}.10.25</i><a class="participant">' || away_team || CASE WHEN (h + {i}) % 3 = 0 THEN ' (' || CAST(1 + h % 99 AS STRING) || ')' ELSE '' END || '</a><b class="x_score">' || CASE (h + {i}) % 5 WHEN 0 THEN '6-4 6-2' WHEN 1 THEN '0-2' WHEN 2 THEN 'ret.' ELSE '3-6, 6-7' END || '</b><u class="surface">' || CASE (h + {i}) % 3 WHEN 0 THEN 'Clay' WHEN 1 THEN 'TRAWA' ELSE '-' END || '</u></div>'"""
_FORM = f"SELECT match_id AS page_id, {' || '.join(_RESULT(i) for i in range(12))} AS html FROM <matches> m WHERE sport = 'tennis'"
_VOTED = """SELECT match_id AS page_id, sport, CASE WHEN h % 11 = 0 THEN '' ELSE '<div>' END || 'Who will win?<b>' || CAST(h % 60 AS STRING) || '%</b>' || CASE WHEN h % 5 = 0 THEN '' ELSE '<b>' || CAST(h % 30 AS STRING) || '%</b>' END || CASE WHEN h % 5 < 2 THEN '' ELSE '<b>100%</b><b>' || CAST(h % 40 AS STRING) || '%</b>' END
 || CASE h % 3 WHEN 0 THEN '<p>Will both' WHEN 1 THEN '<p>both teams score?' ELSE '<p>no' END || '<i>7%</i><i>' || CAST(h % 90 AS STRING) || '%</i>' || CASE WHEN h % 4 = 0 THEN '' ELSE 'Total votes: ' || CAST(h % 900 AS STRING) END AS html FROM <matches> m"""
QUERIES = {
    "dated_meetings": (
        lambda t: dated_meetings(t.spread(_MEET)),
        """SELECT page_id, CAST(nth AS INTEGER) AS nth, date, raw_score, score, CASE who WHEN 0 THEN 'player_b' WHEN 1 THEN 'player_a' ELSE CASE score WHEN '2-0' THEN 'player_a' ELSE 'player_b' END END AS winner, surface FROM (
 SELECT match_id AS page_id, i + 1 AS nth, '0' || CAST(1 + i AS VARCHAR) || '.10.24' AS date, CASE (h + i) % 3 WHEN 0 THEN '6-4, 7-5' WHEN 1 THEN '1-2' ELSE '4:6 6:3 2:6' END AS raw_score, CASE (h + i) % 3 WHEN 0 THEN '2-0' WHEN 1 THEN '1-2' ELSE '1-2' END AS score, (h + i) % 5 AS who,
  CASE (h + i) % 4 WHEN 0 THEN 'clay' WHEN 1 THEN 'grass' WHEN 2 THEN 'hard' ELSE 'unknown' END AS surface FROM <matches> m CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(i) WHERE sport = 'tennis' AND h % 4 >= i AND (h + i) % 9 <> 0) r""",
    ),
    "detailed_form": (
        lambda t: detailed_form(t.spread(_FORM)),
        """SELECT page_id, CAST(i + 1 AS INTEGER) AS nth, CASE q WHEN 0 THEN 'W' WHEN 1 THEN 'L' ELSE CASE r WHEN 0 THEN 'W' ELSE 'L' END END AS result, CAST(i + 1 AS VARCHAR) || '.10.25' AS date, away_team || CASE WHEN p = 0 THEN ' (' || CAST(1 + h % 99 AS VARCHAR) || ')' ELSE '' END AS opponent,
 CASE WHEN p = 0 THEN CAST(1 + h % 99 AS INTEGER) END AS opponent_rank, CASE r WHEN 0 THEN '2-0' WHEN 1 THEN '0-2' WHEN 2 THEN 'ret.' ELSE '0-2' END AS score, CASE p WHEN 0 THEN 'clay' WHEN 1 THEN 'grass' END AS surface FROM (
 SELECT match_id AS page_id, h, away_team, i, (h + i) % 4 AS q, (h + i) % 3 AS p, (h + i) % 5 AS r FROM <matches> m CROSS JOIN (SELECT unnest(range(10)) AS i) v WHERE sport = 'tennis') x WHERE q < 2 OR r <> 2""",
    ),
    "page_votes": (
        lambda t: page_votes(t.spread(_VOTED)),
        """SELECT match_id AS page_id, CASE WHEN n >= 2 THEN p[1] END AS home, CASE WHEN n >= 3 AND d THEN p[2] END AS draw, CASE WHEN n >= 3 AND d THEN p[3] WHEN n >= 2 THEN p[2] END AS away, CASE WHEN h % 11 <> 0 AND h % 3 < 2 THEN 7 END AS yes, CASE WHEN h % 11 <> 0 AND h % 3 < 2 THEN CAST(h % 90 AS INTEGER) END AS no, CASE WHEN h % 4 = 0 THEN 0 ELSE h % 900 END AS votes FROM (
 SELECT match_id, h, sport IN ('football', 'handball', 'hockey') AS d, CASE WHEN h % 11 = 0 THEN [] ELSE list_concat(list_concat(list_concat([CAST(h % 60 AS INTEGER)], CASE WHEN h % 5 = 0 THEN [] ELSE [CAST(h % 30 AS INTEGER)] END), CASE WHEN h % 5 < 2 THEN [] ELSE [CAST(h % 40 AS INTEGER)] END), [7, CAST(h % 90 AS INTEGER)]) END AS p, len(p) AS n FROM <matches> m) x""",
    ),
    "player_rankings": (
        lambda t: rankings(t.spread(PLAYER_PAGES)),
        """SELECT match_id AS page_id, CASE WHEN h % 2 = 0 THEN home_team ELSE away_team END AS player, CAST(CASE h % 5 WHEN 0 THEN 1 + h % 90 WHEN 1 THEN CASE WHEN h % 2 = 0 THEN 1 + h % 80 ELSE 100 + h % 80 END WHEN 2 THEN CASE WHEN h % 2 = 0 THEN 1 + h % 70 ELSE 100 + h % 70 END
 WHEN 3 THEN 1 + h % 60 ELSE 1 + h % 50 END AS INTEGER) AS ranking FROM <matches> m WHERE sport = 'tennis'""",
    ),
    "page_odds": (
        lambda t: page_odds(t.spread(PLAYER_PAGES)),
        """SELECT match_id AS page_id, CASE h % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN CAST(CAST((110 + h % 300) / 100.0 AS DECIMAL(4,2)) AS DOUBLE) END AS home_odds, CASE WHEN h % 3 = 1 THEN 2.25::DOUBLE END AS away_odds FROM <matches> m WHERE sport = 'tennis'""",
    ),
    "surface_rates": (
        lambda t: surface_rates(t.rows(_PLAYERS)).select("match_id", *SURFACES),
        f"""SELECT match_id, {_SURFACE(0)}, {_SURFACE(1)}, {_SURFACE(2)} FROM (SELECT match_id, n, CASE WHEN COALESCE(ranking, 0) = 0 THEN r WHEN ranking <= 10 THEN LEAST(r + 0.15::DOUBLE, 0.95::DOUBLE) WHEN ranking <= 30 THEN LEAST(r + 0.10::DOUBLE, 0.90::DOUBLE) WHEN ranking <= 50 THEN LEAST(r + 0.05::DOUBLE, 0.85::DOUBLE)
 WHEN ranking <= 100 THEN LEAST(r, 0.75::DOUBLE) ELSE GREATEST(r - 0.05::DOUBLE, 0.45::DOUBLE) END AS base FROM (SELECT match_id, ranking, list_sum([unicode(c) FOR c IN string_split(name, '')])::BIGINT AS n, CASE WHEN total > 0 THEN CAST(wins AS DOUBLE) / total ELSE 0.60::DOUBLE END AS r FROM ({_PLAYERS}) p) q) s""",
    ),
}
