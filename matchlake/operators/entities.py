"""Which predicted match a result belongs to, where team names are written differently.

Names are resolved first: pairs of a sport's distinct names, few beside the matches, that an index proposes are scored once. Matches then
join on equal keys.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.functions.name_keys import proposed

# Letters with a mark and those they are written as without it, one for one, and those that take two.
MARKED, PLAIN = "ąćęłńóśźżàáâãäåèéêëìíîïòôõöøùúûüýñçšžčřďťňőűðğış", "acelnoszzaaaaaaeeeeiiiiooooouuuuyncszcrdtnoudgis"
WIDE = (("ß", "ss"), ("æ", "ae"), ("þ", "th"))
SIMILAR = 0.6
#: Days around a match's date, in the order of preference.
OFFSETS = (0, -1, 1, -2, 2, -3, 3)


def plain_name(name: Column) -> Column:
    """A team's name in lower case, without marks and without all but letters and digits. Null stays null."""
    return F.regexp_replace(F.translate(F.lower(name), MARKED, PLAIN), "[^a-z0-9]", "")


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters, 0 to 1 (Ratcliff and Obershelp)."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def possible(a: Column, b: Column, least: float) -> Column:
    """Whether the ratio of two names can reach `least`: it is twice the matching characters over all of both, and no more of them match
    than the shorter name has."""
    return (a != "") & (b != "") & (F.least(F.length(a), F.length(b)) * 2 >= least * (F.length(a) + F.length(b)))


def similar_names(left: DataFrame, right: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(sport, left_name, right_name, likeness): pairs of plain names of left(sport, name) and right that are alike to `least` or more.
    An index proposes them. Empty names match none."""
    met = proposed(left, right, least).select("sport", F.col("a").alias("left_name"), F.col("b").alias("right_name"))
    return met.where(possible(F.col("left_name"), F.col("right_name"), least)).withColumn("likeness", ratio("left_name", "right_name")).where(F.col("likeness") >= least)


def match_results(results: DataFrame, predictions: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(result_id, id, likeness): of each result, the prediction of the same sport and day whose teams are most alike, both to `least`
    or more; ties go to the smallest id. Results without one, or with nulls in a key, are left out."""
    sides = lambda df, i: df.select(F.col(i), "sport", "match_date", plain_name(F.col("home_team")).alias("home"), plain_name(F.col("away_team")).alias("away"))
    names = lambda df: df.select("sport", F.explode(F.array("home", "away")).alias("name"))
    r, p = sides(results, "result_id"), sides(predictions, "id")
    alike = similar_names(names(r), names(p), least)
    known = lambda side: alike.select("sport", F.col("left_name").alias(side), F.col("right_name").alias(f"{side}_p"), F.col("likeness").alias(f"{side}_like"))
    met = r.join(known("home"), ["sport", "home"]).join(known("away"), ["sport", "away"]).select("result_id", "sport", "match_date", "home_p", "away_p", (F.col("home_like") + F.col("away_like")).alias("likeness"))
    met = met.join(p.withColumnsRenamed({"home": "home_p", "away": "away_p"}), ["sport", "match_date", "home_p", "away_p"])
    return met.groupBy("result_id").agg(F.max_by(F.struct("id", "likeness"), F.struct("likeness", -F.col("id"))).alias("m")).select("result_id", "m.id", (F.col("m.likeness") / 2).alias("likeness"))


def nearby_dates(results: DataFrame, predictions: DataFrame, offsets: tuple[int, ...] = OFFSETS) -> DataFrame:
    """(result_id, id, days): of each result, the prediction with the same sport and plain team names on its date or, else, on the
    nearest one, the day before first; ties go to the smallest id."""
    rank = F.posexplode(F.array(*map(F.lit, offsets))).alias("rank", "days")
    keys = [plain_name(F.col(f"{s}_team")).alias(s) for s in ("home", "away")]
    asked = results.select("result_id", "sport", *keys, "match_date", rank).withColumn("match_date", F.date_add("match_date", F.col("days")))
    met = asked.join(predictions.select("id", "sport", *keys, "match_date"), ["sport", "home", "away", "match_date"])
    best = Window.partitionBy("result_id").orderBy("rank", "id")
    return met.withColumn("n", F.row_number().over(best)).where("n = 1").select("result_id", "id", "days")


def reported(matches: DataFrame, moved: bool = False) -> DataFrame:
    """Finished matches as another source reports them: names in upper case without marks, some with a club's prefix; moved: dates up to
    two days later."""
    bare = lambda c: F.upper(F.translate(F.lower(c), MARKED, PLAIN))
    home = F.concat(F.when(F.col("h") % 3 == 0, F.lit("FC ")).otherwise(F.lit("")), bare(F.col("home_team"))) if not moved else bare(F.col("home_team"))
    date = F.date_add("match_date", (F.col("h") % 3).cast("int")) if moved else F.col("match_date")
    return matches.where(F.col("actual_result").isNotNull()).select(F.col("match_id").alias("result_id"), "sport", date.alias("match_date"), home.alias("home_team"), bare(F.col("away_team")).alias("away_team"))


_PLAIN = lambda c: f"regexp_replace(translate(lower({c}), '{MARKED}', '{PLAIN}'), '[^a-z0-9]', '', 'g')"
QUERIES = {
    "results_matched": (lambda t: match_results(reported(t.matches), t.predictions), None),
    "results_nearby": (
        lambda t: nearby_dates(reported(t.matches, moved=True), t.predictions),
        f"""SELECT result_id, id, days FROM (SELECT r.match_id AS result_id, p.id, CAST(o.days AS INTEGER) AS days, ROW_NUMBER() OVER (PARTITION BY r.match_id ORDER BY o.rank, p.id) AS n
 FROM <matches> r CROSS JOIN (VALUES (0, 0), (1, -1), (2, 1), (3, -2), (4, 2), (5, -3), (6, 3)) AS o(rank, days)
 JOIN <predictions> p ON p.sport = r.sport AND {_PLAIN("p.home_team")} = {_PLAIN("r.home_team")} AND {_PLAIN("p.away_team")} = {_PLAIN("r.away_team")}
  AND p.match_date = r.match_date + CAST(r.h % 3 AS INTEGER) + CAST(o.days AS INTEGER) WHERE r.actual_result IS NOT NULL) x WHERE n = 1""",
    ),
}
