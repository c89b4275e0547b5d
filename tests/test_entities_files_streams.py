import datetime as dt
import difflib
import json
import re

from pyspark.sql import functions as F

from matchlake.operators import entities
from matchlake.sources import derived, files
from matchlake.streaming import live


def test_results_match_like_brute_force(spark, sf_dir):
    t = derived.Tables(spark, sf_dir)
    predictions = t.predictions.where("id < 400")
    results = entities.reported(t.matches.where("match_id < 400"))
    got = {r.result_id: r.id for r in entities.match_results(results, predictions).collect()}
    marks = str.maketrans(entities.MARKED, entities.PLAIN)
    plain = lambda s: re.sub("[^a-z0-9]", "", s.lower().translate(marks))
    like = lambda a, b: difflib.SequenceMatcher(None, plain(a), plain(b)).ratio()
    rows, want = predictions.collect(), {}
    for r in results.collect():
        found = [(-(like(r.home_team, p.home_team) + like(r.away_team, p.away_team)), p.id) for p in rows if (p.sport, p.match_date) == (r.sport, r.match_date) and like(r.home_team, p.home_team) >= 0.6 and like(r.away_team, p.away_team) >= 0.6]
        if found:
            want[r.result_id] = min(found)[1]
    assert got == want and len(want) > 20


def test_match_files_of_both_envelopes(spark, tmp_path):
    a = {"id": 1, "homeTeam": "A", "awayTeam": "B", "date": "2024-12-16", "sport": "football", "h2h": {"home": 3, "total": 5}, "homeForm": ["W", "L"]}
    (tmp_path / "matches_2024-12-16_football.json").write_text("﻿" + json.dumps({"date": "2024-12-16", "matches": [a]}, indent=1))
    (tmp_path / "matches_2024-12-17_tennis.json").write_text(json.dumps([a | {"id": 2, "sport": "tennis", "more": 1}]))
    (tmp_path / "other.json").write_text("{}")
    got = files.read_matches(spark, str(tmp_path)).orderBy("id")
    rows = got.collect()
    assert [(r.id, str(r.file_date), r.file_sport, r.h2h.home) for r in rows] == [(1, "2024-12-16", "football", 3), (2, "2024-12-17", "tennis", 3)]
    files.write_matches(got, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).where("sport = 'tennis'").collect()
    assert [(r.id, r.homeForm) for r in back] == [(2, ["W", "L"])]
    files.write_csv(got, str(tmp_path / "csv"))
    text = files.read_csv(spark, str(tmp_path / "csv"), got.selectExpr("id", "homeTeam").schema.simpleString()[7:-1].replace(":", " "))
    assert text.count() == 2


def test_nulls_in_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\nnan,1\nvalid,\nNone,2\n")
    assert [(r.a, r.b) for r in files.read_csv(spark, str(tmp_path / "x.csv"), "a string, b int").collect()] == [(None, 1), ("valid", None), (None, 2)]


def test_merge_settle_check_and_retention(spark):
    table = spark.createDataFrame([(1, None, 0), (2, "X", 5), (None, "1", 1)], "id long, actual_result string, home_score int")
    new = spark.createDataFrame([(1, "1"), (3, "2"), (2, None), (None, "X")], "id long, actual_result string")
    assert sorted(map(tuple, files.merged(table, new).collect()), key=str) == sorted([(1, "1", 0), (2, "X", 5), (None, "1", 1), (3, "2", None)], key=str)
    bets = spark.createDataFrame([(1, "1", "pending"), (1, "2", "pending"), (2, "1", "void"), (9, "1", "pending")], "match_id long, bet_selection string, status string")
    got = files.settled(bets, new.withColumnRenamed("id", "match_id"))
    assert sorted(r.status for r in got.collect()) == ["lost", "pending", "void", "won"]
    day = dt.date(2024, 1, 1)
    bets = spark.createDataFrame([(1, "1", 2.0, day), (1, "2", 2.0, day), (2, "Z", 2.0, day), (None, "1", 2.0, day), (3, "1", 1.0, day), (4, "1", 2.0, day)], "match_id long, bet_selection string, odds_at_bet double, placed_on date")
    ok, bad = files.checked_bets(bets, spark.createDataFrame([(4,)], "match_id long"))
    assert [(r.match_id, r.bet_selection) for r in ok.collect()] == [(1, "1")]
    assert sorted(r.reason for r in bad.collect()) == ["known", "no match", "odds", "repeated", "selection"]
    days = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 5, 1),)], "match_date date")
    assert files.kept_days(days, "2024-05-02").count() == 1


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "feed"))
    feed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "feed"))
    key = lambda rows: sorted(str(r) for r in rows)
    q = live.latest(feed, "user_id", late="30 days").writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert key(spark.table("latest").collect()) == key(live.latest(events, "user_id").collect())
    q = live.once(feed, ["user_id", "event_type"], ttl="400 days").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert spark.table("once").count() == events.select("user_id", "event_type").distinct().count()


def test_settling_stream_and_join(spark, tmp_path):
    rows = [(1, "A", "B", None, dt.datetime(2024, 1, 1, 12)), (1, "A", "B", "1", dt.datetime(2024, 1, 1, 13)), (2, "C", "D", "X", dt.datetime(2024, 1, 1, 13))]
    feed = spark.createDataFrame(rows, "match_id long, home_team string, away_team string, actual_result string, ts timestamp")
    feed.write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(feed.schema).parquet(str(tmp_path / "feed"))
    apply = lambda done, number: done.write.mode("overwrite").parquet(str(tmp_path / f"out/{number}"))
    q = stream.writeStream.foreachBatch(live.settle_each(apply)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out/0")).collect())) == [(1, "1"), (2, "X")]
    matches = spark.createDataFrame([(7, "a", "b")], "match_id long, home_team string, away_team string")
    assert live.with_live(feed.drop("match_id"), matches).count() == 2


def test_further_fields_bets_links_and_saved_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/matches_2024-12-16_football.json").write_text(json.dumps([{"id": 1, "homeFormHome": ["W"], "tips": {"prediction": "1", "probability": 55.0}}]))
    row = files.read_matches(spark, str(tmp_path / "m"), "tips struct<prediction: string, probability: double>, votes struct<home: double>").first()
    assert (row.homeFormHome, row.tips.prediction, row.tips.probability, row.votes) == (["W"], "1", 55.0, None)
    (tmp_path / "b").mkdir()
    bet = {"id": 1, "bet_selection": "1", "odds_at_bet": 1.8, "stake": 10}
    for name, text in (("a", json.dumps({"bets": [bet, bet | {"id": 2, "status": "won"}]})), ("b", json.dumps([bet | {"id": 3}])), ("c", "{broken"), ("d", "{}")):
        (tmp_path / f"b/{name}.json").write_text(text)
    assert sorted((r.id, r.status, r.stake) for r in files.read_bets(spark, str(tmp_path / "b")).collect()) == [(1, "pending", 10.0), (2, "won", 10.0), (3, "pending", 10.0)]
    (tmp_path / "links.txt").write_text("https://a\n\n# no\n  https://b  \n")
    assert sorted(r.link for r in files.read_links(spark, str(tmp_path / "links.txt")).collect()) == ["https://a", "https://b"]
    (tmp_path / "s").mkdir()
    for n in (2, 1):
        (tmp_path / f"s/predictions_{n}.json").write_text(json.dumps([{"id": n}, {"id": n * 10}]))
    assert sorted(r.id for r in files.read_saved(spark, str(tmp_path / "s"), "id int").collect()) == [1, 10]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A", True, None, (3,), "2024-01-01", "tennis"), (2, "B", None, 2.5, None, "2024-01-01", "tennis")], "id long, home string, qualifies boolean, odds double, h2h struct<home: int>, date string, sport string")
    assert files.chosen(rows, ["odds", "nothing", "id"]).columns == ["odds", "id"]
    sheet = files.flat(rows, {"home": "Home Team", "qualifies": "Qualifies", "h2h.home": "Wins", "odds": "Odds"}, ("h2h.home",))
    files.write_csv(sheet.orderBy("Home Team").coalesce(1), str(tmp_path / "sheet"))
    text = next((tmp_path / "sheet").glob("*.csv")).read_text()
    assert text.splitlines() == ["Home Team,Qualifies,Wins,Odds", "A,Yes,3,", "B,No,0,2.5"]
    files.write_qualifying(rows, str(tmp_path / "q"))
    assert [r.id for r in spark.read.json(str(tmp_path / "q")).collect()] == [1]


def test_reports_by_hand(spark):
    from matchlake.operators import reports

    rows = [(1, "d", "later", "b", "home", 1, 9), (2, "d", "9:05", "A", "away", 9, 3), (3, "d", "01.01.24 10:00", None, None, None, 2), (4, "e", None, "c", "away", 1, None)]
    df = spark.createDataFrame(rows, "id long, match_date string, match_time string, home_team string, focus_team string, home_wins int, away_wins int")
    order = lambda by: [r.id for r in reports.report_order(df, by).where("match_date = 'd'").orderBy("place").collect()]
    assert (order("time"), order("wins"), order("team")) == ([3, 1, 2], [2, 1, 3], [3, 2, 1])  # as text, 10:00 comes before 9:05
    many = spark.range(5000).selectExpr("id", "id * 7919 % 1000 as x")
    got = {r.id: r["rank"] for r in reports.ranked_over_all(many, [F.desc("x"), F.col("id")]).collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(5000), key=lambda i: (-(i * 7919 % 1000), i)), 1)}
    assert reports.ranked_over_all(many.limit(0), [F.col("id")]).count() == 0
    votes = spark.createDataFrame([(1, 1, 0, 1, 1, 2), (2, 0, None, None, 1, 1), (3, 1, 7, 0, None, 0)], "id long, home int, draw int, away int, yes int, no int")
    assert sorted(map(tuple, reports.vote_shares(votes).collect())) == [(1, 50, None, 50, 2, 33, 67), (3, 12, 88, 0, 8, None, None)]
