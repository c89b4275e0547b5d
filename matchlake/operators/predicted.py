"""Saved pages of predictions, form and surfaces to rows: a page's rows with picks and chances, the two sides' form by sections, a player's
matches by surface, and the court a page is about. What a page says is picked once; which of it counts is told by columns."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions import text as X
from matchlake.sources.html import Node, picked

from .momentum import surfaces
from .players import FIELD_WORDS, SURFACES, _surface

# What picks are written as, and what they are; words in classes of fields; marks of results and words of their titles.
PICKS = {"1": "1", "X": "X", "2": "2", "1X": "1X", "X2": "X2", "12": "12", "Home": "1", "H": "1", "Away": "2", "A": "2"}
PICK_FIELDS, CHANCE_FIELDS, LINE_FIELDS, BOTH_FIELDS = "fprc|forepr|foremark|pred", "prob|fpr", "ou_|over|under", "btts|both"
RESULT_MARKS = {"W": ("Zwyci", "Z", "W"), "D": ("Remis", "R", "D"), "L": ("Pora", "P", "L")}
# Words in classes, and words of text or address, that name a court; the first surface that has one counts.
CLASS_WORDS = {"clay": ("clay", "ziemna"), "grass": ("grass", "trawiasta"), "hard": ("hard", "twarda")}
COURT_WORDS = {
    "clay": ("clay", "ziemia", "ziemna", "antuka", "roland garros", "french open", "monte carlo", "rome", "madrid", "barcelona", "hamburg", "roland-garros", "glina"),
    "grass": ("grass", "trawa", "trawiasta", "wimbledon", "halle", "queens", "s-hertogenbosch", "eastbourne", "mallorca"),
    "hard": (
        "hard", "twarda", "us open", "australian open", "usopen", "australian", "indian wells", "miami", "cincinnati", "montreal", "toronto",
        "shanghai", "beijing", "paris masters", "szanghaj", "pekin",
    ),
}
WHOLE, DECIMAL = r"^\s*[+-]?\d+\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _whole(text: Column) -> Column:
    return F.when(text.rlike(WHOLE), F.trim(text).try_cast("int"))


def _decimal(text: Column) -> Column:
    return F.when(text.rlike(DECIMAL), F.trim(text).try_cast("double"))


def _first(texts: Column, of) -> Column:
    """The first of what `of` gives for each text that isn't null."""
    return F.get(F.filter(F.transform(texts, of), lambda x: x.isNotNull()), 0)


def _rows(pages: DataFrame) -> DataFrame:
    """(page_id, sport, nth, home_team, away_team, ...) of each row of a page that names both sides: its fields' classes and texts, and
    what its own places for chances, pick, exact score and average goals hold."""

    def rule(page: Node) -> Iterator[tuple]:
        rows = page.all("div", having="rcnt") or [x for x in page.all("tr") if {"tr_0", "tr_1"} & set(x.classes)]
        for nth, row in enumerate(rows, 1):
            spans, divs = row.all("span"), row.all("div")
            first = lambda found, c: next((x for x in found if c in x.classes), None)
            sides = [first(spans, f"{s}Team") for s in ("home", "away")]
            inner = [next((x for x in s.all("span") if x.attrs.get("itemprop") == "name"), None) if s else None for s in sides]
            home, away = (x.text() if x else "" for x in (inner if all(inner) else sides))
            if not (home and away):
                continue
            chances, pick, exact, average = first(divs, "fprc"), first(spans, "forepr"), first(divs, "ex_sc"), first(divs, "avg_sc")
            lines = [x.own for x in exact.all("#text")] if exact else None
            if lines is not None and not (exact.first("br") and len(lines) == 2):
                lines = ["".join(lines)]
            fields = [x for x in spans if x.classes]
            yield nth, home, away, [" ".join(x.classes) for x in fields], [x.text() for x in fields], [x.text() for x in chances.all("span")] if chances else [], pick.text() if pick else None, "-".join(lines) if lines else None, average.text() if average else None

    schema = "nth int, home_team string, away_team string, classes array<string>, texts array<string>, chances array<string>, said string, exact_score string, average string"
    return picked(pages, ["page_id", "sport"], schema, rule)


def prediction_rows(pages: DataFrame) -> DataFrame:
    """(page_id, nth, home_team, away_team, prediction, probability, over_under, btts, sport) of pages(page_id, sport, html): the first
    field that is a pick, the first chance that is a number, the first line of goals, and what the last field about both sides' goals
    says; null where no field tells. Rows without both names are left out; null, empty and broken pages have those that the parser finds."""
    rows = _rows(pages)
    texts = lambda words: F.filter("texts", lambda t, i: F.get("classes", i).rlike(words))
    names = F.create_map(*(F.lit(x) for pair in PICKS.items() for x in pair))
    pick = _first(texts(PICK_FIELDS), lambda t: F.try_element_at(names, t))
    chance = _first(texts(CHANCE_FIELDS), lambda t: _decimal(F.replace(t, F.lit("%"), F.lit(""))))
    line = _first(texts(LINE_FIELDS), lambda t: F.when(F.lower(t).rlike(r"over|under|^[0-9.]"), t))
    both = F.filter(F.transform(texts(BOTH_FIELDS), lambda t: F.when(F.lower(t).contains("yes"), "Yes").when(F.lower(t).contains("no"), "No")), lambda x: x.isNotNull())
    return rows.select("page_id", "nth", "home_team", "away_team", pick.alias("prediction"), chance.alias("probability"), line.alias("over_under"), F.try_element_at(both, F.lit(-1)).alias("btts"), "sport")


def row_details(pages: DataFrame) -> DataFrame:
    """(page_id, nth, home_team, away_team, prediction, probability, exact_score, avg_goals, over_under, btts) of pages(page_id, sport,
    html): the pick by three chances, or by two where a row has no more; without whole numbers there, the pick that the row names. An
    exact score in two lines is written with a dash. See X.over_under and X.both_score for the rest."""
    rows = _rows(pages).withColumn("n", F.transform("chances", _whole)).withColumn("average", _decimal(F.col("average")))
    n = lambda i: F.get("n", i)
    known = F.when(F.size("n") >= 3, n(0).isNotNull() & n(1).isNotNull() & n(2).isNotNull()).when(F.size("n") == 2, n(0).isNotNull() & n(1).isNotNull())
    rows = rows.withColumn("p", F.when(known, X.pick_of(n(0), F.when(F.size("n") >= 3, n(1)), F.when(F.size("n") >= 3, n(2)).otherwise(n(1)))))
    pick = F.coalesce("p.pick", F.when(F.col("said").isin("1", "X", "2"), F.col("said")))
    return rows.select("page_id", "nth", "home_team", "away_team", pick.alias("prediction"), F.col("p.probability").alias("probability"), "exact_score", F.col("average").alias("avg_goals"), X.over_under(F.col("average"), F.col("sport")).alias("over_under"), X.both_score(F.col("exact_score"), F.col("sport")).alias("btts"))


def section_form(pages: DataFrame, most: int = 5) -> DataFrame:
    """(page_id, home_form, away_form) of pages(page_id, html) whose first two sections of meetings are the sides': the marks of the
    first `most` badges of each; where neither has any, the results of its first meetings, where the side stands first in its own
    section for the hosts and second for the guests; where there are none either, the scores of the page's other rows, for both sides.
    Pages that report an error have no form."""

    def rule(page: Node) -> Iterator[tuple]:
        said, badges, results = page.text(" ").lower(), [], []
        for i, section in enumerate(page.all("div", having="h2h__section")[:2]):
            marks = [x for x in section.all("div") if any("badgeform" in c.lower() for c in x.classes)] or section.all("div", "span", part="form")
            badges += [{"i": i, "title": x.attrs.get("title") or "", "text": x.text()} for x in marks[:most]]
            for row in section.all("a", having="h2h__row")[:most]:
                goals = [y.text() for x in row.all("span", having="h2h__result") for y in x.all("span")]
                if len(goals) > 1:
                    results.append({"i": i, "x": goals[0], "y": goals[1]})
        others = [x for x in page.all("div", "tr") if (x.tag == "div" and "h2h__row" in x.classes) or (x.tag == "tr" and "h2h" in x.classes)][:most]
        scores = [x.text() for x in (row.first("div", "span", part="score") for row in others) if x]
        yield "error" in said or "can't be displayed" in said, badges, results, scores

    found = picked(pages, ["page_id"], "failed boolean, badges array<struct<i:int,title:string,text:string>>, results array<struct<i:int,x:string,y:string>>, scores array<string>", rule)

    def mark(b: Column) -> Column:
        out = F.when(F.lit(False), "")
        for letter, (word, *texts) in RESULT_MARKS.items():
            out = out.when(b["title"].contains(word) | b["text"].isin(*texts), letter)
        return out

    def result(x: Column, y: Column) -> Column:
        a, b = _whole(x), _whole(y)
        return F.when(a > b, "W").when(a < b, "L").when(a == b, "D")

    parts = lambda s: F.split(s, F.when(F.contains(s, F.lit(":")), ":").otherwise("-"))
    two = F.transform(F.filter("scores", lambda s: F.size(parts(s)) == 2), parts)
    letters = lambda xs, of: F.array_join(F.transform(xs, of), "")
    of = lambda c, i: F.filter(c, lambda x: x["i"] == i)

    def ways(i: int, own: str, other: str) -> Column:
        """A side's form by badges, by its own section's results and by all scores."""
        return F.array(letters(of("badges", i), mark), letters(of("results", i), lambda r: result(r[own], r[other])), letters(two, lambda p: result(p[i], p[1 - i])))

    found = found.select("page_id", "failed", ways(0, "x", "y").alias("home"), ways(1, "y", "x").alias("away"))
    way = F.get(F.filter(F.array(*map(F.lit, range(3))), lambda k: (F.get("home", k) != "") | (F.get("away", k) != "")), 0)
    form = lambda side: F.when(F.col("failed") | way.isNull(), "").otherwise(F.get(side, way)).alias(f"{side}_form")
    return found.select("page_id", form("home"), form("away"))


def surface_counts(pages: DataFrame, matches: DataFrame) -> DataFrame:
    """(page_id, player, surface, wins, total, win_rate, by_page) for pages(page_id, player, html), three rows each: what the last section
    about a surface says as wins and losses; for players whose page counts no match on any, what their matches say (momentum.surfaces).
    Texts of a section's elements count as apart. Without any match: zeros."""

    def rule(page: Node) -> Iterator[tuple]:
        yield ([x.text(" ").lower() for x in page.all("div", "section", part="surface")],)

    found = picked(pages, ["page_id", "player"], "texts array<string>", rule)
    pattern = r"(\d+)[\s\-–—/]+(\d+)"
    number = lambda t, i: F.nullif(F.regexp_extract(t, pattern, i), F.lit("")).try_cast("long")
    said = F.filter(F.transform("texts", lambda t: F.struct(_surface(t, FIELD_WORDS).alias("s"), number(t, 1).alias("w"), number(t, 2).alias("l"))), lambda x: x["s"].isNotNull() & x["l"].isNotNull())
    found = found.select("page_id", "player", said.alias("said"))
    last = lambda s: F.try_element_at(F.filter("said", lambda x: x["s"] == s), F.lit(-1))
    each = F.array(*(F.struct(F.lit(s).alias("surface"), F.coalesce(last(s)["w"], F.lit(0)).alias("w"), F.coalesce(last(s)["w"] + last(s)["l"], F.lit(0)).alias("n")) for s in SURFACES))
    rows = found.select("page_id", "player", each.alias("each")).withColumn("by_page", F.exists("each", lambda x: x["n"] > 0)).select("page_id", "player", "by_page", F.explode("each").alias("e")).select("page_id", "player", "by_page", "e.*")
    played = surfaces(matches).select(F.col("team").alias("player"), "surface", "wins", "total")
    met = rows.join(played, ["player", "surface"], "left")
    pick = lambda own, other: F.when(F.col("by_page"), F.col(own)).otherwise(F.coalesce(other, F.lit(0)))
    met = met.select("page_id", "player", "surface", pick("w", "wins").alias("wins"), pick("n", "total").alias("total"), "by_page")
    return met.select("page_id", "player", "surface", "wins", "total", F.when(F.col("total") > 0, F.col("wins") / F.col("total")).otherwise(F.lit(0.0)).alias("win_rate"), "by_page")


def page_court(pages: DataFrame) -> DataFrame:
    """(page_id, surface) of pages(page_id, url, html): the first element about a surface whose classes name one; else by words of the
    page's text or address; else hard."""

    def rule(page: Node) -> Iterator[tuple]:
        yield page.text(" "), [" ".join(x.classes) for x in page.all(part="surface")]

    found = picked(pages, ["page_id", "url"], "text string, classes array<string>", rule)
    either = F.concat_ws("\n", "text", "url")
    return found.select("page_id", F.coalesce(_first("classes", lambda c: _surface(c, CLASS_WORDS)), _surface(either, COURT_WORDS), F.lit("hard")).alias("surface"))


_NAME = lambda side, team: f"""CASE WHEN k % 3 = 0 THEN '<span class="{side}Team"><i>no</i><span itemprop="name">' || {team} || '</span></span>' ELSE '<span class="{side}Team x">' || {team} || '</span>' END"""
_ROW = lambda i: f"""CASE WHEN h % 4 = 0 THEN '<tr class="tr_{i}"><td>' ELSE '<div class="y rcnt">' END || {_NAME("home", "home_team")} || CASE WHEN k % 7 = 6 THEN '' ELSE {_NAME("away", "away_team")} END
 || CASE k % 6 WHEN 0 THEN '<span class="forepr">1</span>' WHEN 1 THEN '<span class="x pred_y">Home</span>' WHEN 2 THEN '<span class="fprc">?</span><span class="foremark">X2</span>' WHEN 3 THEN '<span class="fprc">A</span>' WHEN 4 THEN '<span class="forepr"> X </span>' ELSE '<b>1</b>' END
 || CASE k % 4 WHEN 0 THEN '<span class="prob">' || CAST(30 + k % 60 AS STRING) || '%</span>' WHEN 1 THEN '<span class="fpr">x</span><span class="fprob">55.5</span>' WHEN 2 THEN '' ELSE '<span class="fpr"><b>4</b>0%</span>' END
 || CASE k % 5 WHEN 0 THEN '<span class="ou_a">Over 2.5</span>' WHEN 1 THEN '<span class="under">3</span>' WHEN 2 THEN '<span class="over">-</span><span class="ou_">under</span>' ELSE '' END
 || CASE k % 3 WHEN 0 THEN '<span class="btts">Yes</span>' WHEN 1 THEN '<span class="both">yes</span><span class="btts">No</span>' ELSE '<span class="btts">?</span>' END
 || CASE k % 5 WHEN 0 THEN '<div class="fprc"><span>' || CAST(k % 60 AS STRING) || '</span><span>' || CAST(k % 40 AS STRING) || '</span><span>' || CAST(k % 50 AS STRING) || '</span></div>' WHEN 1 THEN '<div class="fprc"><span>' || CAST(k % 60 AS STRING) || '</span><span>' || CAST(k % 70 AS STRING) || '</span></div>' WHEN 2 THEN '<div class="fprc"><span>5</span><span>7%</span></div>' ELSE '' END
 || CASE k % 4 WHEN 0 THEN '<div class="ex_sc">' || CAST(k % 3 AS STRING) || '<br>' || CAST(k % 2 AS STRING) || '</div>' WHEN 1 THEN '<div class="ex_sc"> ' || CAST(k % 5 AS STRING) || ' - ' || CAST(k % 3 AS STRING) || ' </div>' WHEN 2 THEN '<div class="ex_sc">1<br></div>' ELSE '' END
 || CASE k % 3 WHEN 0 THEN '<div class="avg_sc">' || CAST(CAST((k % 90) / 10.0 AS DECIMAL(3,1)) AS STRING) || '</div>' WHEN 1 THEN '<div class="avg_sc">-</div>' ELSE '' END || CASE WHEN h % 4 = 0 THEN '</td></tr>' ELSE '</div>' END""".replace("k %", f"(h + {i}) %")  # noqa: E731
#: A saved page of each match with two rows of predictions.
PREDICTED = f"SELECT match_id AS page_id, sport, '<table>' || {_ROW(0)} || {_ROW(1)} || '</table>' AS html FROM <matches> m"
_EACH = "(SELECT match_id AS page_id, sport, home_team, away_team, h + i AS k, i + 1 AS nth FROM <matches> m CROSS JOIN (VALUES (0), (1)) AS v(i)) r WHERE k % 7 <> 6"
_BADGE = lambda i: f"""CASE (h + {i}) % 6 WHEN 0 THEN '<div class="x wcl-badgeForm" title="Zwycięstwo">?</div>' WHEN 1 THEN '<div class="badgeform">R</div>' WHEN 2 THEN '<div class="badgeform">P</div>' WHEN 3 THEN '<div class="badgeform" title="Porażka"></div>' WHEN 4 THEN '<div class="badgeform">Z</div>' ELSE '<div class="badgeform">-</div>' END"""
_SPAN = lambda i: f"""'<span class="x_form">' || CASE (h + {i}) % 3 WHEN 0 THEN 'W' WHEN 1 THEN 'D' ELSE 'L' END || '</span>'"""
_MET = lambda i: f"""'<a class="h2h__row"><span class="h2h__result"><span>' || CAST((h + {i}) % 3 AS STRING) || '</span><span>' || CASE WHEN (h + {i}) % 7 = 0 THEN '-' ELSE '1' END || '</span></span></a>'"""
_SCORED = lambda i: f"""'<div class="h2h__row"><b>x</b><span class="my_score">' || CAST((h + {i}) % 3 AS STRING) || CASE WHEN (h + {i}) % 2 = 0 THEN ':' ELSE '-' END || '1' || CASE WHEN (h + {i}) % 5 = 0 THEN ':0' ELSE '' END || '</span></div>'"""
_OF = lambda f, start: " || ".join(f(i) for i in range(start, start + 6))
#: A saved page of each match with two sections of form, of four kinds.
FORMS = f"""SELECT match_id AS page_id, '<p>' || CASE WHEN h % 13 = 0 THEN 'Error 404' ELSE 'ok' END || '</p>' || CASE h % 4
 WHEN 0 THEN '<div class="h2h__section">' || {_OF(_BADGE, 0)} || '</div><div class="h2h__section">' || {_OF(_BADGE, 3)} || '</div>' WHEN 1 THEN '<div class="h2h__section">' || {_OF(_SPAN, 0)} || '</div><div class="h2h__section"></div>'
 WHEN 2 THEN '<div class="h2h__section">' || {_OF(_MET, 0)} || '</div><div class="h2h__section">' || {_OF(_MET, 1)} || '</div><div class="h2h__section">' || {_OF(_SPAN, 0)} || '</div>' ELSE {_OF(_SCORED, 0)} END AS html FROM <matches> m"""
_JOIN = lambda cases, start=0: " || ".join(cases.replace("?", f"(h + {i})") for i in range(start, start + 5))
_BADGES = "CASE ? % 6 WHEN 0 THEN 'W' WHEN 1 THEN 'D' WHEN 2 THEN 'L' WHEN 3 THEN 'L' WHEN 4 THEN 'W' ELSE '' END"
_RESULTS = lambda win, loss: f"CASE WHEN ? % 7 = 0 THEN '' ELSE CASE ? % 3 WHEN 0 THEN '{loss}' WHEN 1 THEN 'D' ELSE '{win}' END END"
_SECTION = lambda name, words, i: f"""CASE WHEN h % 7 >= {i} THEN '<section class="surface__{i}"><b>{name}</b> ' || CAST((h + {i}) % 40 AS STRING) || '{words}' || CAST(h % 30 AS STRING) || '</section>' ELSE '' END"""
#: A saved page of each tennis match's first player; some count no match.
PLAYED = f"""SELECT match_id AS page_id, home_team AS player, CASE WHEN h % 5 = 0 THEN '<div class="surface">Clay -</div>' ELSE {_SECTION("Clay 2024", " x ", 6)} || {_SECTION("Ziemia", "/", 1)} || {_SECTION("Twarda", " - ", 2)} || {_SECTION("TRAWA", "–", 3)} || {_SECTION("hard", " / ", 4)} END AS html FROM <matches> m WHERE sport = 'tennis'"""
COURTS = """SELECT match_id AS page_id, 'https://x.example/' || CASE h % 3 WHEN 0 THEN 'Wimbledon' ELSE 'cup' END AS url, '<p>' || CASE h % 4 WHEN 0 THEN 'Roland <b>Garros</b>' WHEN 1 THEN 'Miami' ELSE 'Final' END || '</p>' || CASE h % 5 WHEN 0 THEN '<i class="surface x"></i><i class="surface Trawiasta"></i>' WHEN 1 THEN '<i class="clay"></i>' ELSE '' END AS html FROM <matches> m WHERE sport = 'tennis'"""
QUERIES = {
    "prediction_rows": (
        lambda t: prediction_rows(t.spread(PREDICTED)),
        f"""SELECT page_id, CAST(nth AS INTEGER) AS nth, home_team, away_team, CASE k % 6 WHEN 0 THEN '1' WHEN 1 THEN '1' WHEN 2 THEN 'X2' WHEN 3 THEN '2' WHEN 4 THEN 'X' END AS prediction,
 CASE k % 4 WHEN 0 THEN CAST(30 + k % 60 AS DOUBLE) WHEN 1 THEN 55.5::DOUBLE WHEN 3 THEN 40::DOUBLE END AS probability, CASE k % 5 WHEN 0 THEN 'Over 2.5' WHEN 1 THEN '3' WHEN 2 THEN 'under' END AS over_under,
 CASE k % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END AS btts, sport FROM {_EACH}""",
    ),
    "row_details": (
        lambda t: row_details(t.spread(PREDICTED)),
        f"""SELECT page_id, CAST(nth AS INTEGER) AS nth, home_team, away_team, COALESCE(CASE k % 5 WHEN 0 THEN CASE WHEN a >= b AND a >= c THEN '1' WHEN b >= c THEN 'X' ELSE '2' END WHEN 1 THEN CASE WHEN a > d THEN '1' ELSE '2' END END, CASE k % 6 WHEN 0 THEN '1' WHEN 4 THEN 'X' END) AS prediction,
 CASE k % 5 WHEN 0 THEN CAST(GREATEST(a, b, c) AS DOUBLE) WHEN 1 THEN CAST(GREATEST(a, d) AS DOUBLE) END AS probability, exact_score, CAST(g AS DOUBLE) AS avg_goals,
 CASE WHEN sport = 'football' THEN CASE WHEN g > 2.5 THEN 'Over 2.5' WHEN g <= 2.5 THEN 'Under 2.5' END WHEN sport = 'hockey' THEN CASE WHEN g > 5.5 THEN 'Over 5.5' WHEN g <= 5.5 THEN 'Under 5.5' END END AS over_under,
 CASE WHEN sport IN ('football', 'hockey') AND k % 4 < 2 THEN CASE WHEN x > 0 AND y > 0 THEN 'Yes' ELSE 'No' END END AS btts FROM (
 SELECT *, k % 60 AS a, k % 40 AS b, k % 50 AS c, k % 70 AS d, CASE WHEN k % 3 = 0 THEN CAST((k % 90) / 10.0 AS DECIMAL(3,1)) END AS g, CASE k % 4 WHEN 0 THEN k % 3 ELSE k % 5 END AS x, CASE k % 4 WHEN 0 THEN k % 2 ELSE k % 3 END AS y,
 CASE k % 4 WHEN 0 THEN CAST(k % 3 AS VARCHAR) || '-' || CAST(k % 2 AS VARCHAR) WHEN 1 THEN CAST(k % 5 AS VARCHAR) || ' - ' || CAST(k % 3 AS VARCHAR) WHEN 2 THEN '1' END AS exact_score FROM {_EACH}) s""",
    ),
    "section_form": (
        lambda t: section_form(t.spread(FORMS)),
        f"""SELECT match_id AS page_id, CASE WHEN h % 13 = 0 THEN '' ELSE CASE h % 4 WHEN 0 THEN {_JOIN(_BADGES)} WHEN 1 THEN {_JOIN("CASE ? % 3 WHEN 0 THEN 'W' WHEN 1 THEN 'D' ELSE 'L' END")} WHEN 2 THEN {_JOIN(_RESULTS("W", "L"))} ELSE {_JOIN(_RESULTS("W", "L").replace("% 7", "% 5"))} END END AS home_form,
 CASE WHEN h % 13 = 0 THEN '' ELSE CASE h % 4 WHEN 0 THEN {_JOIN(_BADGES, 3)} WHEN 1 THEN '' WHEN 2 THEN {_JOIN(_RESULTS("L", "W"), 1)} ELSE {_JOIN(_RESULTS("L", "W").replace("% 7", "% 5"))} END END AS away_form FROM <matches> m""",
    ),
    "surface_counts": (
        lambda t: surface_counts(t.spread(PLAYED), t.matches),
        """SELECT match_id AS page_id, player, surface, wins, total, CASE WHEN total > 0 THEN CAST(wins AS DOUBLE) / total ELSE 0::DOUBLE END AS win_rate, by_page FROM (
 SELECT e.match_id, e.player, e.surface, e.by_page, CASE WHEN by_page THEN COALESCE(w, 0) ELSE COALESCE(p.wins, 0) END AS wins, CASE WHEN by_page THEN COALESCE(n, 0) ELSE COALESCE(p.total, 0) END AS total FROM (
 SELECT match_id, home_team AS player, s.surface, h % 5 <> 0 AND h % 7 >= 1 AND (h % 30 > 0 OR (h % 7 >= 1 AND (h + 1) % 40 > 0) OR (h % 7 >= 3 AND (h + 3) % 40 > 0) OR (h % 7 >= 4 AND (h + 4) % 40 > 0) OR (h % 7 IN (2, 3) AND (h + 2) % 40 > 0)) AS by_page,
  CASE s.surface WHEN 'clay' THEN CASE WHEN h % 7 >= 1 THEN (h + 1) % 40 END WHEN 'grass' THEN CASE WHEN h % 7 >= 3 THEN (h + 3) % 40 END ELSE CASE WHEN h % 7 >= 4 THEN (h + 4) % 40 WHEN h % 7 >= 2 THEN (h + 2) % 40 END END AS w, w + h % 30 AS n
 FROM <matches> m CROSS JOIN (VALUES ('clay'), ('grass'), ('hard')) AS s(surface) WHERE sport = 'tennis') e
 LEFT JOIN (SELECT team, surface, COUNT(*) AS total, COUNT(CASE WHEN won THEN 1 END) AS wins FROM (SELECT home_team AS team, actual_result = '1' AS won, CASE CAST(right(league, 1) AS INTEGER) % 3 WHEN 0 THEN 'clay' WHEN 1 THEN 'hard' ELSE 'grass' END AS surface FROM <matches> a WHERE sport = 'tennis' AND actual_result IS NOT NULL
  UNION ALL SELECT away_team, actual_result = '2', CASE CAST(right(league, 1) AS INTEGER) % 3 WHEN 0 THEN 'clay' WHEN 1 THEN 'hard' ELSE 'grass' END FROM <matches> b WHERE sport = 'tennis' AND actual_result IS NOT NULL) u GROUP BY team, surface) p ON p.team = e.player AND p.surface = e.surface) x""",
    ),
    "page_court": (
        lambda t: page_court(t.spread(COURTS)),
        "SELECT match_id AS page_id, CASE WHEN h % 5 = 0 THEN 'grass' WHEN h % 4 = 0 THEN 'clay' WHEN h % 3 = 0 THEN 'grass' ELSE 'hard' END AS surface FROM <matches> m WHERE sport = 'tennis'",
    ),
}
