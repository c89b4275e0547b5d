"""Values parsed out of the texts that sources give: dates, odds, votes, form, links, sets, replies, and labels of tips.

TEXTS derives such texts from the predictions; each query is one pass of column expressions over them, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

_DOTTED = "substr(d, 9, 2) || '.' || substr(d, 6, 2) || '.' ||"
_EVENT = "'K' || CAST(100000 + id % 900000 AS STRING)"
#: Texts of each prediction in the shapes that sources write them in, missing and broken ones included. Read by Spark and DuckDB.
TEXTS = f"""SELECT id, sport, match_date,
 CASE id % 7 WHEN 0 THEN {_DOTTED} substr(d, 3, 2) || ' ' || match_time WHEN 1 THEN {_DOTTED} substr(d, 1, 4) || ' ' || match_time WHEN 2 THEN {_DOTTED} substr(d, 3, 2) WHEN 3 THEN {_DOTTED} substr(d, 1, 4) WHEN 4 THEN d WHEN 5 THEN '31.02.1999' END AS day_text,
 CASE id % 8 WHEN 0 THEN '[''' || a || ''', ''' || b || ''', ''' || c || ''']' WHEN 1 THEN a || '-' || b || '-' || c || '-' || a WHEN 2 THEN a || ',' || b || ', ' || c WHEN 3 THEN lower(a || ' ' || b || ' ' || c || ' ' || b || ' ' || a)
  WHEN 4 THEN a || ';' || b WHEN 5 THEN a || b || c || c || b WHEN 6 THEN 'NaN' END AS form_text,
 CASE id % 7 WHEN 0 THEN CAST(1 + id % 4 AS STRING) || ',' || CAST(10 + id % 90 AS STRING) WHEN 1 THEN ' ' || CAST(1 + id % 4 AS STRING) || '.' || CAST(10 + id % 90 AS STRING) || ' ' WHEN 2 THEN CAST(1 + id % 9 AS STRING) || '/' || CAST(1 + id % 5 AS STRING)
  WHEN 3 THEN 'none' WHEN 4 THEN 'NaN' WHEN 5 THEN '5/0' END AS odds_text,
 CASE id % 6 WHEN 0 THEN 'Total votes: ' || CAST(1 + id % 900 AS STRING) || '.' || CAST(id % 10 AS STRING) || 'k' WHEN 1 THEN 'Total votes: 1,5M' WHEN 2 THEN 'of fans. Total votes:' || CAST(id % 5000 AS STRING) || ' so far' WHEN 3 THEN 'Total votes: 1.234.5' WHEN 4 THEN 'no votes' END AS votes_text,
 CASE id % 8 WHEN 0 THEN 'https://x.example/pl/mecz/pilka-nozna/a-b/' || {_EVENT} || '/h2h/ogolem/' WHEN 1 THEN 'https://x.example/match/?mid=' || {_EVENT} WHEN 2 THEN 'https://x.example/hockey/#id/' || {_EVENT} WHEN 3 THEN 'https://x.example/pl/tenis/wimbledon-2001/'
  WHEN 4 THEN 'https://x.example/en/ice-hockey/overall/' WHEN 5 THEN 'https://x.example/en/table-tennis-news/' || {_EVENT} WHEN 6 THEN ' https://x.example/PL/Koszykowka/' || {_EVENT} || '/' END AS url_text,
 CASE id % 7 WHEN 0 THEN 'Wimbledon' WHEN 1 THEN 'Roland Garros' WHEN 2 THEN 'ATP 500 Halle' WHEN 3 THEN 'hala TWARDA' WHEN 4 THEN 'Rome Masters' WHEN 5 THEN 'Sopot Cup' END AS court_text,
 CASE id % 6 WHEN 0 THEN '6-4, 7-5' WHEN 1 THEN '2-1' WHEN 2 THEN '6:4 3:6 7:5' WHEN 3 THEN 'w.o.' WHEN 4 THEN '4-6 6-6 10-8' END AS sets_text,
 CASE id % 5 WHEN 0 THEN 'PREDICTION: 1' || chr(10) || 'CONFIDENCE: ' || CAST(id % 100 AS STRING) || '%' || chr(10) || 'REASONING: good form' || chr(10) || 'RECOMMENDATION: high' WHEN 1 THEN '  PREDICTION:  X ' || chr(10) || 'CONFIDENCE: sure' || chr(10) || 'RECOMMENDATION: LOCK'
  WHEN 2 THEN 'no labels, ' || repeat('word ', 60) WHEN 3 THEN '' END AS reply_text,
 CASE id % 5 WHEN 0 THEN CAST(id % 4 AS STRING) || '-' || CAST(id % 3 AS STRING) WHEN 1 THEN CAST(id % 3 AS STRING) || ' - ' || CAST(id % 4 AS STRING) WHEN 2 THEN 'x-1' WHEN 3 THEN '1-2-3' END AS exact_text, CAST(id % 80 AS DOUBLE) / 10 AS average
FROM (SELECT id, sport, match_date, match_time, CAST(match_date AS STRING) AS d, substr('WDLWWLDLDW', CAST(1 + id % 10 AS INT), 1) AS a, substr('LWWDLDWWLD', CAST(1 + id % 9 AS INT), 1) AS b, substr('DLWLWWDLWW', CAST(1 + id % 7 AS INT), 1) AS c FROM <predictions> p) q"""


def days(texts: DataFrame, today) -> DataFrame:
    """The date inside each text, the text as a date, its time, and the match's date in words."""
    t = F.col("day_text")
    return texts.select("id", X.dotted_day(t).alias("day"), X.any_day(t).alias("whole_day"), X.clock(t).alias("clock"), X.friendly_day(F.col("match_date"), today).alias("friendly"))


def odds(texts: DataFrame) -> DataFrame:
    t = F.col("odds_text")
    return texts.select("id", X.missing(t).alias("is_missing"), X.number(t, -1.0).alias("number"), X.shown_odds(t).alias("shown"), X.decimal_comma(t).alias("comma_odds"), X.fractional(t).alias("fraction_odds"))


def votes(texts: DataFrame) -> DataFrame:
    n = X.votes(F.col("votes_text"))
    return texts.select("id", n.alias("votes"), X.shown_votes(n).alias("shown"))


def forms(texts: DataFrame) -> DataFrame:
    """Results of each text, arrays joined by commas."""
    f = texts.select("id", X.form_list(F.col("form_text")).alias("form"))
    return f.select("id", F.array_join("form", ",").alias("form"), X.form_marks(F.col("form")).alias("marks"), X.form_score(F.col("form")).alias("score"), F.array_join(X.form_points(F.col("form")).cast("array<string>"), ",").alias("points"), F.array_join(X.padded_form(F.col("form")), "").alias("padded"))


def links(texts: DataFrame) -> DataFrame:
    u = F.col("url_text")
    return texts.select("id", X.sport_of_path(u).alias("path_sport"), X.sport_of_words(u).alias("word_sport"), X.event_id(u).alias("event_id"), X.surface_of(F.coalesce("court_text", u)).alias("surface"))


def sets(texts: DataFrame) -> DataFrame:
    return texts.select("id", X.sets_won(F.col("sets_text")).alias("sets"))


def replies(texts: DataFrame) -> DataFrame:
    return texts.select("id", X.reply_fields(F.col("reply_text")).alias("r")).select("id", "r.prediction", "r.confidence", X.shortened(F.col("r.reasoning"), 300).alias("reasoning"), "r.recommendation")


def goals(texts: DataFrame) -> DataFrame:
    return texts.select("id", X.over_under(F.col("average"), F.col("sport")).alias("over_under"), X.both_score(F.col("exact_text"), F.col("sport")).alias("both_score"))


def labels(predictions: DataFrame) -> DataFrame:
    """Of each prediction: the fans' pick of three outcomes and of two; the label shown (the tip, else the fans' pick); a tier of
    confidence; bars in percent; the shortest odds; expected value and edge of the home side in percent where the value is over 5."""
    h, d, a = (F.col(f"fan_{o}").cast("double") for o in ("home_win_prob", "draw_prob", "away_win_prob"))
    total, odds_, p = h + d + a, F.col("tip_home_odds").cast("double"), F.col("tip_probability") / F.lit(100.0)
    value = p * odds_ - 1
    three, two = X.pick_of(h, d, a), X.pick_of(h, F.lit(None).cast("double"), a)
    tip = F.struct(F.col("tip_prediction").alias("pick"), F.col("tip_probability").cast("double").alias("probability"))
    shown = F.when(F.col("tip_prediction").isNotNull() & (F.col("tip_probability") != 0), tip).otherwise(three)
    rows = predictions.withColumns({"three": three, "two": two, "shown": shown, "value": F.when(value > 0.05, value * 100)})
    shortest = F.least("tip_home_odds", F.when(F.col("sport") == "football", F.col("tip_draw_odds")), "tip_away_odds").cast("double")
    bars = [(x * 100 / F.nullif(total, F.lit(0.0))).alias(f"{n}_bar") for x, n in ((h, "home"), (d, "draw"), (a, "away"))]
    edge = F.when(F.col("value").isNotNull(), (p - 1 / odds_) * 100).alias("edge")
    return rows.select("id", F.col("three.pick").alias("pick3"), F.col("three.probability").alias("probability3"), F.col("two.pick").alias("pick2"), F.col("shown.pick").alias("label"), F.col("shown.probability").alias("label_confidence"), X.confidence_tier(F.col("shown.probability")).alias("tier"), *bars, shortest.alias("shortest_odds"), "value", edge)


def _words(column: str, words: tuple[str, ...], mark: str = "") -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{mark}{w}{mark}')" for w in words) + ")"


def _cases(column: str, names: dict[str, tuple[str, ...]], order: tuple[str, ...], mark: str = "", other: str = "") -> str:
    return "CASE " + " ".join(f"WHEN {_words(column, names[n], mark)} THEN '{n}'" for n in order) + (f" ELSE '{other}'" if other else "") + " END"


_FULL = "CASE WHEN length(y) = 2 THEN CAST(CAST(y AS INT) + CASE WHEN CAST(y AS INT) <= {last} THEN 2000 ELSE 1900 END AS STRING) ELSE y END"
_MISSING = "(odds_text IS NULL OR trim(odds_text) = '' OR lower(odds_text) IN ('nan', 'none'))"
_NUMBER = f"COALESCE(CASE WHEN NOT {_MISSING} THEN TRY_CAST(odds_text AS DOUBLE) END, %s)"
_LINES = "list_filter(string_split(reply_text, chr(10)), lambda x: starts_with(trim(x), '{0}:'))"
_AFTER = f"list_transform({_LINES}, lambda x: trim(replace(x, '{{0}}:', '')))"

def match_marks(matches: DataFrame) -> DataFrame:
    """Of each match: the teams in its page's title, its keys for lookups, the home team's initials."""
    title = F.concat(F.col("home_team"), F.element_at(F.array(*map(F.lit, (" - ", " vs ", " v ", "-"))), (F.col("match_id") % 4 + 1).cast("int")), F.col("away_team"), F.lit(" | x"))
    sides = X.title_teams(title)
    names = (F.col("home_team"), F.col("away_team"), F.col("sport"))
    return matches.select("match_id", sides["home"].alias("title_home"), sides["away"].alias("title_away"), X.lookup_key(*names).alias("key"), X.lookup_key(*names, F.col("match_date")).alias("day_key"), X.initials(F.col("home_team")).alias("initials"))


QUERIES = {
    "match_marks": (
        lambda t: match_marks(t.matches),
        """SELECT match_id, CASE WHEN match_id % 4 = 3 THEN home_team || '-' || away_team ELSE home_team END AS title_home, CASE WHEN match_id % 4 = 3 THEN 'x' ELSE away_team END AS title_away, md5(lower(home_team) || '|' || lower(away_team) || '|' || sport) AS key,
 sport || '|' || lower(home_team) || '|' || lower(away_team) || '|' || CAST(match_date AS VARCHAR) AS day_key, upper(CASE WHEN contains(home_team, ' ') THEN substr(home_team, 1, 1) || substr(split_part(home_team, ' ', 2), 1, 1) ELSE substr(home_team, 1, 2) END) AS initials FROM <matches> m""",
    ),
    "parsed_days": (
        lambda t: days(t.rows(TEXTS), F.expr("DATE '1998-01-01'")),
        f"""SELECT id, CASE WHEN regexp_matches(day_text, '\\d{{2}}\\.\\d{{2}}\\.\\d{{2}}') THEN TRY_CAST({_FULL.format(last=50)} || '-' || m || '-' || dd AS DATE) END AS day,
 CASE WHEN regexp_full_match(day_text, '\\d+\\.\\d+\\.\\d+') THEN TRY_CAST({_FULL.format(last=68)} || '-' || m || '-' || dd AS DATE) ELSE TRY_CAST(CASE WHEN regexp_full_match(day_text, '\\d+-\\d+-\\d+') THEN day_text END AS DATE) END AS whole_day,
 CASE WHEN contains(day_text, ':') THEN string_split(day_text, ' ')[2] ELSE '99:99' END AS clock, CASE match_date - DATE '1998-01-01' WHEN 0 THEN 'Today' WHEN 1 THEN 'Tomorrow' ELSE strftime(match_date, '%a, %-d %b %Y') END AS friendly
 FROM (SELECT *, regexp_extract(day_text, '(\\d+)\\.(\\d+)\\.(\\d+)', 1) AS dd, regexp_extract(day_text, '(\\d+)\\.(\\d+)\\.(\\d+)', 2) AS m, regexp_extract(day_text, '(\\d+)\\.(\\d+)\\.(\\d+)', 3) AS y FROM ({TEXTS}) t) u""",
    ),
    "parsed_odds": (
        lambda t: odds(t.rows(TEXTS)),
        f"""SELECT id, {_MISSING} AS is_missing, {_NUMBER % "-1.0"} AS number, CASE WHEN {_NUMBER % "0.0"} > 0 THEN printf('%.2f', {_NUMBER % "0.0"}) ELSE '—' END AS shown,
 TRY_CAST(replace(NULLIF(regexp_extract(odds_text, '\\d+[.,]\\d+'), ''), ',', '.') AS DOUBLE) AS comma_odds,
 CASE WHEN x > 1 AND NOT isnan(x) THEN round(x, 2) END AS fraction_odds FROM (SELECT *, CASE WHEN odds_text NOT LIKE '%/%' THEN TRY_CAST(odds_text AS DOUBLE) ELSE TRY_CAST(split_part(odds_text, '/', 1) AS DOUBLE) / NULLIF(TRY_CAST(split_part(odds_text, '/', 2) AS DOUBLE), 0) + 1 END AS x FROM ({TEXTS}) t) u""",
    ),
    "parsed_votes": (
        lambda t: votes(t.rows(TEXTS)),
        f"""SELECT id, votes, CASE WHEN votes >= 1000000 THEN printf('%.1f', round(votes / 1000000, 1)) || 'M' WHEN votes >= 1000 THEN printf('%.1f', round(votes / 1000, 1)) || 'k' ELSE CAST(votes AS STRING) END AS shown FROM (
 SELECT id, CAST(trunc(COALESCE(TRY_CAST(replace(n, ',', '.') AS DOUBLE), TRY_CAST(replace(n, '.', '') AS DOUBLE)) * CASE unit WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 ELSE 1 END) AS BIGINT) AS votes
 FROM (SELECT id, NULLIF(regexp_extract(votes_text, 'votes: ?([0-9.,]+)', 1), '') AS n, lower(regexp_extract(votes_text, 'votes: ?[0-9.,]+([kKmM])', 1)) AS unit FROM ({TEXTS}) t) u) v""",
    ),
    "parsed_forms": (
        lambda t: forms(t.rows(TEXTS)),
        f"""SELECT id, array_to_string(f, ',') AS form, array_to_string(list_transform(f, lambda r: r || CASE r WHEN 'W' THEN '✅' WHEN 'L' THEN '❌' ELSE '🟡' END), ' ') AS marks,
 CASE WHEN len(f) = 0 THEN 'N/A' ELSE printf('%.1f', round(CAST(3 * w + d AS DOUBLE) / (3 * len(f)) * 10, 1)) || '/10' END AS score, array_to_string(list_transform(f, lambda r: CASE r WHEN 'W' THEN '3' WHEN 'D' THEN '1' ELSE '0' END), ',') AS points,
 CASE WHEN len(f) = 0 THEN 'WWWLL' ELSE substr(array_to_string(f, '') || CASE WHEN w > len(f) - w - d THEN 'WWWWW' ELSE 'LLLLL' END, 1, 5) END AS padded
 FROM (SELECT id, f, len(list_filter(f, lambda r: r = 'W')) AS w, len(list_filter(f, lambda r: r = 'D')) AS d FROM (SELECT id, CASE WHEN form_text IS NULL OR form_text = 'NaN' THEN [] ELSE regexp_extract_all(upper(form_text), '[WDL]') END AS f FROM ({TEXTS}) t) u) v""",
    ),
    "link_parts": (
        lambda t: links(t.rows(TEXTS)),
        f"""SELECT id, {_cases("url_text", X.SPORT_PATHS, tuple(X.SPORT_PATHS), "/", "football")} AS path_sport, {_cases("url_text", X.SPORT_PATHS, X.SPORT_WORD_ORDER, "", "unknown")} AS word_sport, NULLIF(regexp_extract(url_text, 'K[0-9]{{6}}'), '') AS event_id,
 {_cases("COALESCE(court_text, url_text)", X.SURFACE_WORDS, tuple(X.SURFACE_WORDS))} AS surface FROM ({TEXTS}) t""",
    ),
    "set_scores": (
        lambda t: sets(t.rows(TEXTS)),
        # sets are counted, and what isn't the first player's is the second's
        f"""SELECT id, CASE WHEN regexp_full_match(sets_text, '[0-9]-[0-9]') THEN sets_text WHEN len(x) > 0 THEN CAST(len(w) AS VARCHAR) || '-' || CAST(len(x) - len(w) AS VARCHAR) END AS sets FROM (
 SELECT id, sets_text, x, [i FOR i IN range(1, len(x) + 1) IF x[i] > y[i]] AS w FROM (SELECT id, sets_text, CAST(regexp_extract_all(COALESCE(sets_text, ''), '(\\d+)[-:](\\d+)', 1) AS INTEGER[]) AS x,
 CAST(regexp_extract_all(COALESCE(sets_text, ''), '(\\d+)[-:](\\d+)', 2) AS INTEGER[]) AS y FROM ({TEXTS}) t) u) v""",
    ),
    "advice_replies": (
        lambda t: replies(t.rows(TEXTS)),
        f"""SELECT id, CASE WHEN bare THEN substr(reply_text, 1, 200) ELSE COALESCE(p, '') END AS prediction, CASE WHEN bare THEN 50 ELSE COALESCE(n, 0) END AS confidence, substr(CASE WHEN bare THEN reply_text ELSE COALESCE(why, '') END, 1, 300) AS reasoning,
 CASE WHEN bare THEN 'MEDIUM' WHEN rec IN ('HIGH', 'MEDIUM', 'LOW', 'SKIP') THEN rec ELSE 'SKIP' END AS recommendation FROM (SELECT *, COALESCE(p, '') = '' AND COALESCE(reply_text, '') <> '' AS bare FROM (
 SELECT id, reply_text, {_AFTER.format("PREDICTION")}[-1] AS p, TRY_CAST(regexp_extract({_AFTER.format("CONFIDENCE")}[-1], '[0-9]+') AS INT) AS n, {_AFTER.format("REASONING")}[-1] AS why, upper({_AFTER.format("RECOMMENDATION")}[-1]) AS rec FROM ({TEXTS}) t) u) v""",
    ),
    "goal_tips": (
        lambda t: goals(t.rows(TEXTS)),
        f"""SELECT id, CASE WHEN sport = 'football' THEN CASE WHEN average > 2.5 THEN 'Over 2.5' ELSE 'Under 2.5' END WHEN sport = 'hockey' THEN CASE WHEN average > 5.5 THEN 'Over 5.5' ELSE 'Under 5.5' END END AS over_under,
 CASE WHEN sport IN ('football', 'hockey') AND regexp_full_match(exact_text, '\\d+ ?- ?\\d+') THEN CASE WHEN regexp_full_match(exact_text, '[1-9]\\d* ?- ?[1-9]\\d*') THEN 'Yes' ELSE 'No' END END AS both_score FROM ({TEXTS}) t""",
    ),
    "tip_labels": (
        lambda t: labels(t.predictions),
        """SELECT id, pick3, probability3, pick2, label, label_confidence, CASE WHEN label_confidence >= 85 THEN 'Very High' WHEN label_confidence >= 70 THEN 'High' WHEN label_confidence >= 55 THEN 'Medium' ELSE 'Low' END AS tier,
 h * 100 / NULLIF(h + d + a, 0) AS home_bar, d * 100 / NULLIF(h + d + a, 0) AS draw_bar, a * 100 / NULLIF(h + d + a, 0) AS away_bar, shortest_odds, CASE WHEN v > 0.05 THEN v * 100 END AS value, CASE WHEN v > 0.05 THEN (tp - 1 / o) * 100 END AS edge FROM (
 SELECT *, CASE WHEN tipped THEN tip_prediction ELSE pick3 END AS label, CASE WHEN tipped THEN tp100 ELSE probability3 END AS label_confidence FROM (SELECT *, tip_prediction IS NOT NULL AND COALESCE(tp100, 0) <> 0 AS tipped, tp * o - 1 AS v,
 CASE WHEN h IS NULL THEN NULL WHEN h >= d AND h >= a THEN '1' WHEN d >= a THEN 'X' ELSE '2' END AS pick3, CASE WHEN h IS NOT NULL THEN GREATEST(h, d, a) END AS probability3, CASE WHEN h > a THEN '1' WHEN h <= a THEN '2' END AS pick2 FROM (
 SELECT id, tip_prediction, CAST(tip_probability AS DOUBLE) AS tp100, CAST(tip_probability AS DOUBLE) / 100 AS tp, CAST(tip_home_odds AS DOUBLE) AS o, CAST(fan_home_win_prob AS DOUBLE) AS h, CAST(fan_draw_prob AS DOUBLE) AS d, CAST(fan_away_win_prob AS DOUBLE) AS a,
 CAST(LEAST(tip_home_odds, CASE WHEN sport = 'football' THEN tip_draw_odds END, tip_away_odds) AS DOUBLE) AS shortest_odds FROM <predictions> p) q) r) s""",
    ),
}
