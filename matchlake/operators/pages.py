"""Saved pages to rows: links, list items, past meetings, final scores and form, over any table of pages(page_id, html, ...)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.sources.html import Node, picked

from .odds import WITH_DRAW

# What addresses of matches have in them; words of a heading and of a status; marks of icons.
MATCH_ADDRESSES = ("/match/", "/mecz/", "/#/match/", "/#id/", "/event/", "/detail/")
MEETINGS = ("pojedynki", "bezpośrednie")
FINISHED = ("zakończony", "finished", "ft", "ao")
ICONS = (("win", "W"), ("loss", "L"), ("lost", "L"), ("draw", "D"))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def links(pages: DataFrame, site: str, patterns: tuple[str, ...] = MATCH_ADDRESSES, leagues: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, link): the distinct addresses in each page's links that have one of the patterns in them, or whose other address (data-
    href) has; whole: behind site, or behind the page's own url where they begin with #. With leagues, those with one of them, in any
    case, in the address or in the link's text."""

    def rule(page: Node) -> Iterator[tuple]:
        return ((a.attrs["href"], a.attrs.get("data-href"), a.text()) for a in page.all("a") if a.attrs.get("href") is not None)

    found = picked(pages, ["page_id", "url"], "href string, other string, text string", rule)
    raw = F.when(_any(F.col("href"), patterns), F.col("href")).when(_any(F.col("other"), patterns), F.col("other"))
    whole = F.when(raw.startswith("/"), F.concat(F.lit(site), raw)).when(raw.startswith("#"), F.concat("url", raw)).otherwise(raw)
    got = found.select("page_id", whole.alias("link"), F.lower("text").alias("text")).where("link IS NOT NULL")
    if leagues:
        low = tuple(x.lower() for x in leagues)
        got = got.where(_any(F.lower("link"), low) | _any(F.col("text"), low))
    return got.select("page_id", "link").distinct()


def list_items(pages: DataFrame) -> DataFrame:
    """(page_id, position, text, score): each list item of a page, from 1, with its text and the first score x-y or x:y in it, or in the
    text of the page's title where it has none, else null."""

    def rule(page: Node) -> Iterator[tuple]:
        title = page.first("title")
        return ((i, x.text(" "), title.text() if title else "") for i, x in enumerate(page.all("li"), 1))

    score = lambda c: F.nullif(F.regexp_extract(c, r"(\d+\s*[-:]\s*\d+)", 1), F.lit(""))
    return picked(pages, ["page_id"], "position int, text string, title string", rule).select("page_id", "position", "text", F.coalesce(score("text"), score("title")).alias("score"))


def past_meetings(pages: DataFrame, most: int = 5) -> DataFrame:
    """(page_id, nth, date, home, away, score, winner) of the rows in a page's section of direct meetings, or its first section: of the
    first `most` rows those that have both names and a score. winner: home, away, draw; unknown where a side's goals are no number."""

    def player(row: Node, side: str) -> str:
        box = row.first("span", having=f"h2h__{side}Participant")
        name = box and box.first("span", having="h2h__participantInner")
        return name.text() if name else ""

    def rule(page: Node) -> Iterator[tuple]:
        sections = page.all("div", having="h2h__section")
        chosen = next((s for s in sections if any(w in s.text(" ").lower() for w in MEETINGS)), sections[0] if sections else None)
        for nth, row in enumerate(chosen.all("a", having="h2h__row")[:most] if chosen else [], 1):
            date, result = row.first("span", having="h2h__date"), row.first("span", having="h2h__result")
            goals = [x.text() for x in result.all("span")] if result else []
            yield nth, date.text() if date else "", player(row, "home"), player(row, "away"), *(goals[:2] if len(goals) > 1 else (None, None))

    each = picked(pages, ["page_id"], "nth int, date string, home string, away string, x string, y string", rule)
    x, y = (F.col(c).try_cast("int") for c in "xy")
    winner = F.when(x > y, "home").when(x < y, "away").when(x == y, "draw").otherwise("unknown")
    return each.where("home <> '' AND away <> '' AND y IS NOT NULL").select("page_id", "nth", "date", "home", "away", F.concat_ws("-", "x", "y").alias("score"), winner.alias("winner"))


def final_scores(pages: DataFrame) -> DataFrame:
    """(page_id, status, score_home, score_away, winner): status not_finished where the page names another one; else no_score where
    neither its two score fields nor its embedded data have both scores; else finished."""

    def rule(page: Node) -> Iterator[tuple]:
        said, fields = page.first("div", having="detailScore__status"), page.all("div", having="detailScore__wrapper")
        data = [s.text() for s in page.all("script") if s.attrs.get("type") == "application/ld+json"]
        yield said.text().lower() if said else None, *(x.text() for x in (fields[:2] if len(fields) > 1 else [])), *[None] * (0 if len(fields) > 1 else 2), data

    own = picked(pages, ["page_id"], "said string, x string, y string, data array<string>", rule)
    data = F.get(F.filter("data", lambda d: F.get_json_object(d, "$.homeTeam").isNotNull()), 0)
    own = own.select("page_id", "said", data.alias("data"), *(F.col(c).try_cast("int").alias(c) for c in "xy"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    score = lambda c, side: F.when(both, F.col(c)).otherwise(F.get_json_object("data", f"$.{side}Team.score").try_cast("int"))
    got = own.select("page_id", "said", score("x", "home").alias("h"), score("y", "away").alias("a"))
    status = F.when(F.col("said").isNotNull() & ~_any(F.col("said"), FINISHED), "not_finished").when(F.col("h").isNull() | F.col("a").isNull(), "no_score").otherwise("finished")
    got = got.withColumn("status", status)
    done = lambda c: F.when(F.col("status") == "finished", c)
    winner = F.when(F.col("h") > F.col("a"), "home").when(F.col("h") < F.col("a"), "away").otherwise("draw")
    return got.select("page_id", "status", done(F.col("h")).alias("score_home"), done(F.col("a")).alias("score_away"), done(winner).alias("winner"))


def team_form(pages: DataFrame, side: str, most: int = 5) -> DataFrame:
    """(page_id, form): the newest results of the side's team, W, D or L, first of the icons in the first of three places that has any;
    else of texts that are one letter; else of scores in recent matches, whose first number counts as the team's own."""
    cell, score = re.compile("form.*cell|form.*item"), re.compile(r"(\d+)\s*[-:]\s*(\d+)")

    def icons(place: Node) -> Iterator[str]:
        for x in [x for x in place.all("div", "span") if any(cell.search(c) for c in x.classes)][:most]:
            yield from [letter for word, letter in ICONS if word in " ".join(x.classes).lower()][:1]

    def results(page: Node) -> Iterator[str]:
        for x in [x for x in page.all("div") if any(w in " ".join(x.classes) for w in ("lastMatch", "recentForm"))][:most]:
            found = next(filter(None, (score.search(t.own) for t in x.all("#text"))), None)
            if found:
                a, b = map(int, found.groups())
                yield "W" if a > b else "L" if a < b else "D"

    def rule(page: Node) -> Iterator[tuple]:
        box = page.first("div", having=f"smv__{side}Participant")
        places = (box and box.first("div", part="form"), page.first("div", having=f"participant__form--{side}"), page.first("div", part=f"{side}Form"))
        form = next((f for f in ("".join(icons(p)) for p in places if p) if f), "")
        form = form or "".join([x.text() for x in page.all("div", "span") if x.till == x.at + 2 and x.text() in ("W", "L", "D")][:most])
        yield (form or "".join(results(page)),)

    return picked(pages, ["page_id"], "form string", rule)


def results_in_text(pages: DataFrame, most: int = 20) -> DataFrame:
    """(page_id, match_id, home_team, away_team, home_score, away_score, result) from pages(page_id, sport, day, html): of the first
    `most` places that read "name 2 - 1 name" those with names of more than three letters. match_id: sport, day and the place's number,
    from 0. Equal scores: X in sports with a draw, else 2."""
    pattern = r"([A-Za-z\s.\-]+)\s+(\d+)\s*[-:]\s*(\d+)\s+([A-Za-z\s.\-]+)"
    part = lambda i: F.regexp_extract_all("html", F.lit(pattern), i)
    found = pages.select("page_id", "sport", "day", F.posexplode(F.slice(F.arrays_zip(part(1).alias("h"), part(2).alias("x"), part(3).alias("y"), part(4).alias("a")), 1, most)).alias("n", "m"))
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    rows = found.select("page_id", "sport", F.concat_ws("_", "sport", "day", "n").alias("match_id"), trimmed("m.h").alias("home_team"), trimmed("m.a").alias("away_team"), F.col("m.x").try_cast("int").alias("home_score"), F.col("m.y").try_cast("int").alias("away_score"))
    h, a = F.col("home_score"), F.col("away_score")
    result = F.when(h > a, "1").when(h < a, "2").when(F.col("sport").isin(*WITH_DRAW), "X").otherwise("2")
    kept = rows.where((F.length("home_team") > 3) & (F.length("away_team") > 3) & h.isNotNull() & a.isNotNull())
    return kept.select("page_id", "match_id", "home_team", "away_team", "home_score", "away_score", result.alias("result"))


def _meeting(i: int) -> str:
    """The i-th past meeting of a derived page, as HTML."""
    home, away = ("home_team", "away_team") if i % 2 else ("away_team", "home_team")
    goals = f"'<span class=\"h2h__result\"><span>' || CAST((h + {3 * i}) % 5 AS STRING) || '</span><span>' || CAST((h + {7 * i}) % 4 AS STRING) || '</span></span>'"
    if i == 3:
        goals = f"CASE WHEN h % 3 = 0 THEN '' ELSE {goals} END"  # without a score
    return f"""CASE WHEN h % 8 >= {i} THEN '<a class="h2h__row row" href="/match/' || CAST(h AS STRING) || '-{i}/"><span class="h2h__date">0{i}.02.24</span><span class="h2h__homeParticipant"><span class="h2h__participantInner">' || {home} || '</span></span><span class="h2h__awayParticipant x"><span class="h2h__participantInner">' || {away} || '</span></span>' || {goals} || '</a>' ELSE '' END"""


_DECOY = '<a class="h2h__row" href="/mecz/a"><span class="h2h__date">31.01.24</span><span class="h2h__homeParticipant"><span class="h2h__participantInner">Aa</span></span><span class="h2h__awayParticipant"><span class="h2h__participantInner">Bb</span></span><span class="h2h__result"><span>9</span><span>x</span></span></a>'
_ICON = lambda i: f"""'<span class="form__cell form__cell--' || CASE (h + {i}) % 3 WHEN 0 THEN 'win' WHEN 1 THEN 'loss' ELSE 'draw' END || '">o</span>'"""
_LETTER = lambda i: f"'<span>' || CASE (h + {i}) % 3 WHEN 0 THEN 'W' WHEN 1 THEN 'L' ELSE 'D' END || '</span>'"
_RECENT = lambda i: f"""'<div class="lastMatch__row">A ' || CAST((h + {i}) % 3 AS STRING) || ' : 1 B</div>'"""
_SIX = lambda f: " || ".join(f(i) for i in range(6))
#: A saved page of each football match: sections of meetings, of which some lack the heading, a status, scores in one of two places or none, and
#: form as icons, letters or recent scores.
SAVED = f"""SELECT match_id AS page_id, 'https://x.example/day' AS url, match_date, h, home_team, away_team, home_score, away_score,
 '<html><head><title>x</title><script type="application/ld+json">' || CASE WHEN h % 4 = 0 AND home_score IS NOT NULL THEN '{{"homeTeam": {{"score": ' || CAST(home_score AS STRING) || '}}, "awayTeam": {{"score": ' || CAST(away_score AS STRING) || '}}}}' ELSE '{{"name": "x"}}' END
 || '</script></head><body><div class="detailScore__status">' || CASE WHEN home_score IS NULL THEN '1st half' WHEN h % 2 = 0 THEN 'Finished' ELSE 'Zakończony' END || '</div>'
 || CASE WHEN h % 4 > 1 THEN '<div class="a detailScore__wrapper"><b>' || COALESCE(CAST(home_score AS STRING), '-') || '</b></div><div class="detailScore__wrapper">' || COALESCE(CAST(away_score AS STRING), '-') || '</div>' ELSE '' END
 || '<br><p>open<ul><li><a href="#/match/' || CAST(h % 50 AS STRING) || '">' || league || '</a><li><a href="/about" data-href="/detail/' || CAST(h % 7 AS STRING) || '">d</a><li><a href="/help">h</a></ul>'
 || '<div class="h2h__section"><div>Ostatnie mecze</div>{_DECOY}</div><div class="h2h__section section">' || CASE WHEN h % 10 = 0 THEN '<div>Inne</div>' ELSE '<div>Pojedynki <i>bezpośrednie</i></div>' END || {" || ".join(_meeting(i) for i in range(1, 8))} || '</div>'
 || CASE h % 3 WHEN 0 THEN '<div class="smv__homeParticipant"><div class="x__form">' || {_SIX(_ICON)} || '</div></div>' WHEN 1 THEN '<div class="y">' || {_SIX(_LETTER)} || '</div>' ELSE {_SIX(_RECENT)} END
 || '</body></html>' AS html FROM <matches> m WHERE sport = 'football'"""
_RESULTS = """SELECT match_id AS page_id, sport, CAST(match_date AS STRING) AS day, '<b>Home ' || sport || ' ' || CAST(h % 5 AS STRING) || ' - ' || CAST(h % 3 AS STRING) || ' Guests.' || sport || '</b>; Aa 1:1 Bb; <i>FC North  ' || CAST(h % 4 AS STRING) || ':2 South-East</i>' AS html FROM <matches> m"""
_ITEMS = "(SELECT page_id, html, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS li, generate_subscripts(regexp_extract_all(html, '<li>(.*?)</li>', 1), 1) AS position FROM pages) x"
_TEXT = "trim(regexp_replace({}, '<[^>]*>', ' ', 'g'))"
_FORM = lambda words: " || ".join(f"CASE (h + {i}) % 3 WHEN 0 THEN '{words[0]}' WHEN 1 THEN '{words[1]}' ELSE '{words[2]}' END" for i in range(5))
QUERIES = {
    "page_links": (
        lambda t: links(t.pages, "https://www.example.com", ("/",)),
        r"""SELECT DISTINCT page_id, CASE WHEN starts_with(link, '/') THEN 'https://www.example.com' || link ELSE link END AS link FROM (
 SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages) x WHERE contains(link, '/')""",
    ),
    "page_list_items": (
        lambda t: list_items(t.pages),
        rf"""SELECT page_id, CAST(position AS INTEGER) AS position, {_TEXT.format("li")} AS text, COALESCE(NULLIF(regexp_extract({_TEXT.format("li")}, '(\d+\s*[-:]\s*\d+)', 1), ''),
 NULLIF(regexp_extract(regexp_extract(html, '<title>(.*?)</title>', 1), '(\d+\s*[-:]\s*\d+)', 1), '')) AS score FROM {_ITEMS}""",
    ),
    "match_links": (
        lambda t: links(t.spread(SAVED), "https://www.example.com", leagues=("LEAGUE_1", "/detail/3", "-2/")),
        """SELECT DISTINCT match_id AS page_id, link FROM (SELECT match_id, 'https://x.example/day#/match/' || CAST(h % 50 AS VARCHAR) AS link FROM <matches> a WHERE sport = 'football' AND league = 'league_1'
 UNION ALL SELECT match_id, 'https://www.example.com/detail/3' FROM <matches> b WHERE sport = 'football' AND h % 7 = 3 UNION ALL SELECT match_id, 'https://www.example.com/match/' || CAST(h AS VARCHAR) || '-2/' FROM <matches> c WHERE sport = 'football' AND h % 8 >= 2) u""",
    ),
    "past_meetings": (
        lambda t: past_meetings(t.spread(SAVED)),
        """SELECT page_id, nth, date, home, away, CAST(x AS VARCHAR) || '-' || CAST(y AS VARCHAR) AS score, CASE WHEN x > y THEN 'home' WHEN x < y THEN 'away' ELSE 'draw' END AS winner FROM (
 SELECT match_id AS page_id, CAST(i AS INTEGER) AS nth, '0' || CAST(i AS VARCHAR) || '.02.24' AS date, CASE WHEN i % 2 = 1 THEN home_team ELSE away_team END AS home, CASE WHEN i % 2 = 1 THEN away_team ELSE home_team END AS away,
  (h + 3 * i) % 5 AS x, (h + 7 * i) % 4 AS y FROM <matches> m CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS v(i) WHERE sport = 'football' AND i <= h % 8 AND h % 10 <> 0 AND NOT (i = 3 AND h % 3 = 0)) r
 UNION ALL SELECT match_id, 1, '31.01.24', 'Aa', 'Bb', '9-x', 'unknown' FROM <matches> n WHERE sport = 'football' AND h % 10 = 0""",
    ),
    "final_scores": (
        lambda t: final_scores(t.spread(SAVED)),
        """SELECT page_id, status, CASE WHEN status = 'finished' THEN home_score END AS score_home, CASE WHEN status = 'finished' THEN away_score END AS score_away,
 CASE WHEN status = 'finished' THEN CASE WHEN home_score > away_score THEN 'home' WHEN home_score < away_score THEN 'away' ELSE 'draw' END END AS winner FROM (
 SELECT match_id AS page_id, CAST(home_score AS INTEGER) AS home_score, CAST(away_score AS INTEGER) AS away_score, CASE WHEN home_score IS NULL THEN 'not_finished' WHEN h % 4 = 1 THEN 'no_score' ELSE 'finished' END AS status FROM <matches> m WHERE sport = 'football') s""",
    ),
    "results_in_text": (
        lambda t: results_in_text(t.spread(_RESULTS)),
        """SELECT match_id AS page_id, sport || '_' || CAST(match_date AS VARCHAR) || '_' || CAST(n AS VARCHAR) AS match_id, home_team, away_team, CAST(x AS INTEGER) AS home_score, CAST(y AS INTEGER) AS away_score, CASE WHEN x > y THEN '1' WHEN x < y THEN '2' WHEN sport IN ('football', 'handball', 'hockey') THEN 'X' ELSE '2' END AS result FROM (
 SELECT match_id, sport, match_date, 0 AS n, 'Home ' || sport AS home_team, 'Guests.' || sport AS away_team, h % 5 AS x, h % 3 AS y FROM <matches> a UNION ALL SELECT match_id, sport, match_date, 2, 'FC North', 'South-East', h % 4, 2 FROM <matches> b) u""",
    ),
    "page_form": (
        lambda t: team_form(t.spread(SAVED), "home"),
        f"SELECT match_id AS page_id, CASE h % 3 WHEN 0 THEN {_FORM('WLD')} WHEN 1 THEN {_FORM('WLD')} ELSE {_FORM('LDW')} END AS form FROM <matches> m WHERE sport = 'football'",
    ),
}
