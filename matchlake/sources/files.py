"""Match and bet files: JSON documents and CSV in, partitioned JSON and CSV out, and tables that take results later on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A match as the JSON files have it, and both envelopes: a bare array, or an object with "matches".
MATCH = """id bigint, homeTeam string, awayTeam string, time string, date string, league string, country string, sport string, matchUrl string, qualifies boolean,
 h2h struct<home: int, draw: int, away: int, total: int, winRate: int>, homeForm array<string>, awayForm array<string>, homeFormHome array<string>, awayFormAway array<string>, formAdvantage boolean,
 odds struct<home: double, draw: double, away: double, bookmaker: string>, focusTeam string"""
BET = """id bigint, prediction_id bigint, match_date string, match_time string, home_team string, away_team string, sport string, league string, bet_selection string,
 odds_at_bet double, stake double, status string, profit double, notes string, created_at string"""
NULLS = ("", "nan", "none", "null")
# What columns of rows are called in the table of predictions.
PREDICTION_COLUMNS = {"home_odds": "tip_home_odds", "draw_odds": "tip_draw_odds", "away_odds": "tip_away_odds", "win_rate": "h2h_win_rate", "date": "match_date", "url": "match_url"}


def or_null(c: Column) -> Column:
    """Text without what stands for nothing: blank, nan, none, null in any case."""
    return F.when(~F.lower(F.trim(c)).isin(*NULLS), c)


def read_matches(spark: SparkSession, path: str, more: str = "") -> DataFrame:
    """A row for each match of the JSON files under path, with file_date and file_sport from the file's name
    (matches_YYYY-MM-DD_sport.json, null where it has neither). Each file is one document; a byte order mark is skipped. more: further
    fields, as in MATCH, such as the structs of the services that a file has."""
    fields = _colons(f"{MATCH}, {more}" if more else MATCH)
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"), F.col("_metadata.file_name").alias("name"))
    bare = F.from_json("value", f"array<struct<{fields}>>")
    inside = F.when(F.col("value").rlike(r"^\s*\["), bare).otherwise(F.from_json("value", f"struct<matches: array<struct<{fields}>>>")["matches"])
    rows = files.select("name", F.explode(inside).alias("m"))
    of = lambda i: F.nullif(F.regexp_extract("name", r"_(\d{4}-\d{2}-\d{2})(?:_([a-z]+))?\.json$", i), F.lit(""))
    return rows.select("m.*", F.try_to_date(of(1)).alias("file_date"), of(2).alias("file_sport"))


def _colons(fields: str) -> str:
    """Fields of a table as fields of a struct: "a int, b string" to "a: int, b: string", outside of brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(fields + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = fields[start:i].split(None, 1)
            out.append(f"{name}: {kind}")
            start = i + 1
    return ", ".join(out)


def read_bets(spark: SparkSession, path: str) -> DataFrame:
    """A row for each bet of the JSON files under path, each an object with the array "bets", or that array. A file that can't be read, or
    has no bets, gives none."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))
    bare = F.from_json("value", f"array<struct<{_colons(BET)}>>")
    inside = F.when(F.col("value").rlike(r"^\s*\["), bare).otherwise(F.from_json("value", f"struct<bets: array<struct<{_colons(BET)}>>>")["bets"])
    return files.select(F.explode(inside).alias("b")).select("b.*").withColumn("status", F.coalesce("status", F.lit("pending")))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """(link): the lines of text files, trimmed, without blank ones and those that begin with #."""
    return spark.read.text(path).select(F.trim("value").alias("link")).where("link <> '' AND NOT startswith(link, '#')")


def read_saved(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the first, by name, of the JSON files under path that match: older runs' files of one day are passed by."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_file", F.col("_metadata.file_path"))
    return rows.join(rows.agg(F.min("_file").alias("_first")), F.col("_file") == F.col("_first")).drop("_file", "_first")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; text columns without what stands for nothing."""
    got = spark.read.csv(path, header=True, schema=schema)
    return got.select(*(or_null(F.col(c)).alias(c) if k == "string" else F.col(c) for c, k in got.dtypes))


def write_matches(matches: DataFrame, path: str) -> None:
    """JSON in folders by date and sport, so that readers of a day or a sport read no other."""
    matches.write.partitionBy("date", "sport").mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; arrays, maps and structs as JSON."""
    rows.select(*(F.to_json(c).alias(c) if k.startswith(("array", "map", "struct")) else F.col(c) for c, k in rows.dtypes)).write.mode("overwrite").csv(path, header=True)


def write_qualifying(rows: DataFrame, path: str) -> None:
    """JSON of the rows that qualify, by date and sport."""
    write_matches(rows.where("qualifies"), path)


def chosen(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """rows with those of the wanted columns that it has, in this order."""
    return rows.select(*(F.col(f"`{c}`") for c in wanted if c in rows.columns))


def flat(rows: DataFrame, names: dict[str, str], zero: tuple[str, ...] = ()) -> DataFrame:
    """A sheet of rows: columns, or fields of structs, under other names; truths as Yes and No (null: No), nulls of the columns in zero
    as 0, other nulls empty."""

    def cell(path: str) -> Column:
        kind = rows.select(path).dtypes[0][1]
        if kind == "boolean":
            return F.when(F.col(path), "Yes").otherwise("No")
        return F.coalesce(F.col(path), F.lit(0)) if path in zero else F.col(path)

    return rows.select(*(cell(path).alias(name) for path, name in names.items()))


def merged(table: DataFrame, updates: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """table with the values of updates where those aren't null, and its new keys' rows; columns of table. Of several updates of a key
    that with the greatest value of the column `order` counts (when they were made); without it, and among equal ones, the greatest by all
    columns. Rows without a key stay as they are. One shuffle of either side by key."""
    shared = [c for c in updates.columns if c not in (key, order) or c in table.columns and c != key]
    at = [F.col(order).alias("_at")] if order else []
    last = updates.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*at, *shared)).alias("_new"))
    both = table.join(last, F.col(key) == F.col("_key"), "full")
    return both.select(*(F.coalesce(key, "_key").alias(c) if c == key else F.coalesce(F.col("_new")[c], F.col(c)).alias(c) if c in shared else F.col(c) for c in table.columns))


def settled(bets: DataFrame, results: DataFrame) -> DataFrame:
    """bets(match_id, bet_selection, status, ...) with the status of pending ones set from results(match_id, actual_result)."""
    known = results.where(F.col("actual_result").isNotNull()).groupBy(F.col("match_id").alias("_m")).agg(F.max("actual_result").alias("_r"))
    status = F.when((F.col("status") == "pending") & F.col("_r").isNotNull(), F.when(F.col("_r") == F.col("bet_selection"), "won").otherwise("lost")).otherwise(F.col("status"))
    return bets.join(known, F.col("match_id") == F.col("_m"), "left").withColumn("status", status).select(*bets.columns)


def checked_bets(bets: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): bets that have a match, a selection of 1, X or 2 and odds above 1, one for each match, none of a match in
    known(match_id); the rest with a reason. The first by placed_on of several bets on a match is kept."""
    order = Window.partitionBy("match_id").orderBy("placed_on", "bet_selection", "odds_at_bet")
    there = known.select(F.col("match_id").alias("_known")).distinct()
    wrong = F.when(F.col("match_id").isNull(), "no match").when(~F.coalesce(F.col("bet_selection").isin("1", "X", "2"), F.lit(False)), "selection").when(~F.coalesce(F.col("odds_at_bet") > 1, F.lit(False)), "odds")
    rows = bets.withColumn("reason", wrong)
    bad = rows.where("reason IS NOT NULL").select(*bets.columns, "reason")  # apart, so that bets without a match don't meet in one task
    fine = rows.where("reason IS NULL").drop("reason").join(there, F.col("match_id") == F.col("_known"), "left").withColumn("_n", F.row_number().over(order))
    fine = fine.withColumn("reason", F.when(F.col("_known").isNotNull(), "known").when(F.col("_n") > 1, "repeated"))
    return fine.where("reason IS NULL").select(*bets.columns), bad.unionByName(fine.where("reason IS NOT NULL").select(*bets.columns, "reason"))


def kept_days(table: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Rows of the last `days` days before as_of and later; on a table partitioned by match_date whole partitions go."""
    return table.where(F.col("match_date") >= F.date_sub(F.to_date(F.lit(as_of)), days))


def save_batch(rows: DataFrame, path: str, batch: int | str) -> None:
    """rows into a table of batches. A batch that is written again, whole or after a failure, takes the place of what it wrote before, and
    touches no other: a partition of its own, overwritten alone."""
    rows.withColumn("batch", F.lit(str(batch))).write.partitionBy("batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches of a table, each row once, with the batch that wrote it."""
    return spark.read.schema(f"{schema}, batch string").parquet(path)


def insert_predictions(rows: DataFrame, path: str, batch: int | str, names: dict[str, str] | None = None) -> None:
    """save_batch with columns renamed to the table's; rows without teams are left out, and of a match's rows in a batch one stays: the
    greatest by all columns. Names that rows don't have are passed by."""
    named = rows.withColumnsRenamed({k: v for k, v in (names or PREDICTION_COLUMNS).items() if k in rows.columns})
    keys = ["match_date", "home_team", "away_team"]
    rest = [c for c in named.columns if c not in keys]
    one = named.where("home_team IS NOT NULL AND away_team IS NOT NULL").groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r"))
    save_batch(one.select(*keys, "r.*"), path, batch)


def without(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """table without the rows whose key is in gone; rows without a key stay."""
    return table.join(gone.select(key).where(F.col(key).isNotNull()), key, "left_anti").select(*table.columns)


def save_weights(weights: DataFrame, path: str, calibrated_at: str) -> None:
    """weights(source, weight, accuracy) as the snapshot of this time; the same one again takes its place."""
    weights.coalesce(1).withColumn("calibrated_at", F.lit(calibrated_at)).write.partitionBy("calibrated_at").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def latest_weights(spark: SparkSession, path: str, as_of: str | None = None) -> DataFrame:
    """(source, weight, accuracy, calibrated_at) of the newest snapshot, or the newest one up to as_of. Times compare as text, so they are
    written year first."""
    rows = spark.read.schema("source string, weight double, accuracy double, calibrated_at string").parquet(path)
    rows = rows if as_of is None else rows.where(F.col("calibrated_at") <= as_of)
    newest = rows.agg(F.max("calibrated_at").alias("newest"))  # one row
    return rows.join(newest, F.col("calibrated_at") == F.col("newest")).drop("newest")
