import datetime as dt
import random

from matchlake.operators import players, views
from matchlake.sources import files
from matchlake.streaming import status


def test_rankings_in_their_places(spark):
    names = '<a class="participant__participantName">Iga Swiatek</a><a class="participant__participantName">Coco Gauff</a>'
    both = '"rank":["WTA","3","x"] "rank":["wta","7",1]'
    html = [("Iga Swiatek", f"{names}<p>Iga Swiatek (12)</p><script>{both}</script>"), ("gauff", f"{names}<script>{both}</script>"), ("Nobody", f"{names}<script>{both}</script>"), ("Nobody", '<script>"rank":["ATP","9",</script>'),
            ("Coco Gauff", f"{names}<i>WTA: 4</i> <i>WTA: 5</i>"), ("A (b", '<b class="xranking">A (b no 31</b>'), ("A", None), ("", "x"), ("A", "")]
    df = spark.createDataFrame([(i, *x, "t") for i, x in enumerate(html)], "page_id long, player string, html string, text string")
    assert {r.page_id: r.ranking for r in players.rankings(df).collect()} == {0: 12, 1: 7, 2: None, 3: 9, 4: 5, 5: 31, 6: None, 8: None}


def test_page_odds(spark):
    html = ['<b data-home-odds="1.5"></b><b data-home-odds="x" data-away-odds="2"></b>', '<div class="odds">1.20 x 3.45</div>', '<div class="odds">1.20</div>', '<b data-away-odds="4"></b><div class="odds">1.20<span class="odds">2.00</span></div>', None]
    df = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    assert sorted(map(tuple, players.page_odds(df).collect())) == [(0, 1.5, 2.0), (1, 1.2, 3.45), (2, None, None), (3, 1.2, 2.0), (4, None, None)]


def test_surface_rates(spark):
    df = spark.createDataFrame([("abc", 5, 9, 9), ("", 5, 1, 1), ("é", None, 0, 0), (None, 1, 1, 1)], "name string, ranking int, wins int, total int")
    got = {r.name: tuple(x and round(x, 6) for x in (r.clay, r.grass, r.hard)) for r in players.surface_rates(df).collect()}
    n = sum(map(ord, "abc"))
    assert got["abc"][n % 3] == round(min(0.98, max(0.30, 0.98 + (n % 7 - 3) / 100)), 6) and got[""] == got[None] == (None, None, None) and len(set(got["é"])) == 2


def events(n=400):
    r, start = random.Random(5), dt.datetime(2024, 1, 1)
    return [(r.randrange(6), start + dt.timedelta(seconds=37 * i + r.randrange(30)), i, r.choice(["scheduled", "live", "live", "halftime", "finished"])) for i in range(n)]


FEED = "key long, at timestamp, id long, status string"


def test_changes_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    rows = events()
    mixed = sorted(rows, key=lambda x: x[1].timestamp() + random.Random(x[2]).randrange(1500))  # out of order, by 25 minutes at most
    parts = [mixed[i : i + 90] + mixed[i : i + 7] for i in range(0, len(mixed), 90)] + [[(99, dt.datetime(2024, 3, 1), 10_000, "end")]]
    for i, part in enumerate(parts):
        spark.createDataFrame([*part, (None, part[0][1], 5, "live"), (1, None, 6, "live"), (1, part[0][1], 7, None)], FEED).coalesce(1).write.mode("append").parquet(str(tmp_path / f"feed/{i:02}"))
        [(f.rename(tmp_path / f"feed/{i:02}.parquet")) for f in (tmp_path / f"feed/{i:02}").glob("*.parquet")]
    feed = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed/*.parquet"))
    q = status.changes_as_they_come(feed, "30 minutes").writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got, want = spark.table("changes").collect(), status.changes(spark.createDataFrame(rows, FEED)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len(want) > 200


def test_settle_counts(spark):
    pending = spark.createDataFrame([(1,), (2,), (3,), (4,)], "match_id long")
    results = spark.createDataFrame([(1, 1, 0, True), (1, None, 0, True), (2, None, 0, True), (3, 1, 1, False), (9, 1, 1, True)], "match_id long, home_score int, away_score int, finished boolean")
    assert tuple(status.settle_counts(pending, results).first()) == (4, 1, 2, 1)
    assert tuple(status.settle_counts(pending.limit(0), results).first()) == (0, 0, 0, 0)


def test_a_repeated_batch_leaves_one_copy(spark, tmp_path):
    path, df = str(tmp_path / "t"), lambda *rows: spark.createDataFrame(rows, "id long, v string")
    files.save_batch(df((1, "a"), (2, "b")), path, 7)
    files.save_batch(df((3, "c")), path, 8)
    files.save_batch(df((1, "a"), (2, "b")), path, 7)  # again
    files.save_batch(df((3, "c"), (4, "d")), path, 8)  # half done before
    back = files.read_batches(spark, path, "id long, v string")
    assert sorted(map(tuple, back.collect())) == [(1, "a", "7"), (2, "b", "7"), (3, "c", "8"), (4, "d", "8")]
    assert sorted(r.id for r in files.without(back, df((2, ""), (None, ""))).collect()) == [1, 3, 4]


def test_inserted_predictions_are_renamed_and_single(spark, tmp_path):
    rows = spark.createDataFrame([("d", "A", "B", 1.5), ("d", "A", "B", 1.7), ("d", None, "B", 1.0)], "date string, home_team string, away_team string, home_odds double")
    for _ in range(2):
        files.insert_predictions(rows, str(tmp_path / "p"), "one")
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).select("match_date", "home_team", "tip_home_odds", "batch").collect()] == [("d", "A", 1.7, "one")]


def test_weights_by_snapshot(spark, tmp_path):
    path, df = str(tmp_path / "w"), lambda w: spark.createDataFrame([("tips", w, 0.5)], "source string, weight double, accuracy double")
    for at, w in (("2024-01-01T00:00", 1.0), ("2024-02-01T00:00", 2.0), ("2024-02-01T00:00", 3.0)):
        files.save_weights(df(w), path, at)
    assert [r.weight for r in files.latest_weights(spark, path).collect()] == [3.0]
    assert [r.weight for r in files.latest_weights(spark, path, "2024-01-15").collect()] == [1.0]


def test_the_newest_update_counts(spark):
    table = spark.createDataFrame([(1, "X", 9)], "id long, result string, home_score int")
    new = spark.createDataFrame([(1, "2", 5, 1), (1, "1", 2, 3), (1, "X", 9, 2)], "id long, result string, home_score int, at int")
    assert [tuple(r) for r in files.merged(table, new, order="at").collect()] == [(1, "1", 2)]


def test_a_missing_sport_is_not_the_total(spark):
    rows = [(None, True), ("tennis", True)]
    df = spark.createDataFrame(rows, "sport string, qualifies boolean").selectExpr("*", "DATE '2024-01-01' as match_date", "'1' as actual_result", "'1' as tip_prediction", "1 as fan_home_win_prob", "2.0 as tip_home_odds")
    got = sorted(((r.sport, r.total) for r in views.period(df, "DATE '2024-01-02'", 7).collect()), key=str)
    assert got == [("all", 2), ("tennis", 1), (None, 1)]
