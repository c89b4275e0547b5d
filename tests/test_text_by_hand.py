"""Text functions on rows made by hand: shapes that the derived texts don't have."""

import datetime

from pyspark.sql import functions as F

from matchlake.functions import text as X


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t")).alias("x")).first()["x"]


def test_numbers_and_odds(spark):
    assert one(spark, "nOnE", X.missing) and one(spark, "  ", X.missing) and not one(spark, "0", X.missing)
    assert one(spark, "abc", X.number) == 0.0
    assert [one(spark, v, X.fractional) for v in ("11/4", "1/3", "0/5", "a/b", "1/2/3", None)] == [3.75, 1.33, None, None, None, None]
    assert one(spark, "kurs 1,95 (was 2.10)", X.decimal_comma) == 1.95
    assert one(spark, "0", X.shown_odds) == "—"


def test_days(spark):
    assert one(spark, "on 05.11.50 20:30", X.dotted_day) == datetime.date(2050, 11, 5)
    assert one(spark, "05.11.51", X.dotted_day) == datetime.date(1951, 11, 5)
    assert one(spark, "5.1.68", X.any_day) == datetime.date(2068, 1, 5)
    assert one(spark, "5.1.69", X.any_day) == datetime.date(1969, 1, 5)
    assert one(spark, "30.02.2001", X.any_day) is None and one(spark, "soon", X.dotted_day) is None


def test_form(spark):
    assert one(spark, "w-l--d", X.form_list) == ["W", "L", "D"]
    assert one(spark, "WQ", X.form_list) == [] and one(spark, None, X.form_list) == []
    assert one(spark, ["L", "W"], X.padded_form, "array<string>") == ["L", "W", "L", "L", "L"]
    assert one(spark, ["W"], X.padded_form, "array<string>") == ["W"] * 5
    assert one(spark, [], X.form_score, "array<string>") == "N/A"


def test_links_and_sets(spark):
    assert one(spark, "https://x.example/mecz/a-b/KQAaF7d2/h2h/ogolem/", X.event_id) == "KQAaF7d2"
    assert one(spark, "https://x.example/?a=1&mid=Zz1", X.event_id) == "Zz1"
    assert one(spark, "7-6(4), 3-6, 6–2", X.sets_won) == "2-1"
    assert one(spark, "", X.sets_won) is None
