from pyspark.sql import functions as F

from matchlake.operators import entities, names
from matchlake.sources import derived


def test_light(spark):
    rows = [("FC Porto U21", "porto"), ("Śląsk  Wrocław", "slask wroclaw"), ("fc fc Köln", "fc koln"), ("Großaspach", "grossaspach"), ("Arsenal Women", "arsenal"), ("", ""), (None, None), ("A.C. Milan", "ac milan")]
    df = spark.createDataFrame(rows, "name string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", names.light(F.col("name"))).collect())


def test_scores():
    assert names.like_loose("psg", "psg paris") >= 0.85 and names.like_loose("", "a") == 0.0 and names.like_tips("a", "a") == 1.0
    assert names.like_loose("leeds united", "leeds") == max(0.85, 5 / 12) and names.like_tips("leeds united", "leeds") == 0.85 + 5 / 12 * 0.10
    assert names.like_tips("real sociedad", "real madrid") == 0.8  # equal first words


def brute(left, right, rules, like, light):
    out = {}
    for a in left:
        found = []
        for b in right:
            if (a.sport, a.match_date) == (b.sport, b.match_date):
                x, y = ((light[p], light[q]) for p, q in ((a.home_team, b.home_team), (a.away_team, b.away_team)))
                h, w = like(*x), like(*y)
                word = all(any(len(t) >= 3 and t in q for t in p.split()) or any(len(t) >= 3 and t in p for t in q.split()) for p, q in (x, y))
                ok = min(h, w) >= rules["both"] or h + w >= rules["sum"] or any(max(h, w) >= m and min(h, w) >= n for m, n in rules["one"]) or (rules["words"] and word)
                if ok and h + w > 0:
                    found.append((-(h + w), b.right_id))
        if found:
            out[a.left_id] = min(found)[1]
    return out


def test_joins_as_brute_force(spark, sf_dir):
    t = derived.Tables(spark, sf_dir)
    left = entities.reported(t.matches.where("match_id < 300")).withColumnRenamed("result_id", "left_id").cache()
    right = t.matches.where("match_id < 300").select(F.col("match_id").alias("right_id"), "sport", (F.col("match_date")).alias("match_date"), "home_team", "away_team").withColumn("match_date", F.trunc("match_date", "month")).cache()
    left = left.withColumn("match_date", F.trunc("match_date", "month"))
    both = left.select("home_team", "away_team").unionByName(right.select("home_team", "away_team"))
    light = {r.n: r.l for r in both.select(F.explode(F.array("home_team", "away_team")).alias("n")).distinct().withColumn("l", names.light(F.col("n"))).collect()}
    for rules, how, like in ((names.LOOSE, "loose", names.like_loose), (names.TIPS, "tips", names.like_tips), (names.RELAXED, "loose", names.like_loose)):
        got = {r.left_id: r.right_id for r in names.joined(left, right, rules, how).collect()}
        assert got == brute(left.collect(), right.collect(), rules, like, light) and len(got) > 20
    twice = names.joined_twice(left, right)
    assert twice.count() == twice.select("left_id").distinct().count() >= names.joined(left, right).count()


def shuffled(spark, query):
    """How many rows the stages of a call write to shuffles."""
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    known = stages()
    known = {known.apply(i).stageId() for i in range(known.size())}
    query()
    found = stages()
    return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()) if found.apply(i).stageId() not in known)


def test_a_busy_day_shuffles_no_pairs(spark):
    name = lambda i: F.concat(F.lit("team "), F.char(97 + i % 7), F.char(97 + i % 11))
    rows = lambda n, i: spark.range(n).select(F.col("id").alias(i), F.lit("football").alias("sport"), F.expr("DATE '2024-01-01'").alias("match_date"), name(F.col("id")).alias("home_team"), name(F.col("id") * 5 + 3).alias("away_team"))
    left, right = rows(800, "left_id").withColumn("away_team", F.concat("away_team", F.when(F.col("left_id") % 4 == 0, F.lit("x")).otherwise(F.lit("")))), rows(800, "right_id")
    for rules, how in ((names.TIPS, "tips"), (names.LOOSE, "loose")):
        got = {}
        assert shuffled(spark, lambda: got.update((r.left_id, r.right_id) for r in names.joined(left, right, rules, how).collect())) < 12 * 1600  # noqa: B023
        light = {n: n for r in [*left.collect(), *right.collect()] for n in (r.home_team, r.away_team)}
        some = [r for r in left.collect() if r.left_id < 60]
        assert len(got) == 800 and {i: got[i] for i in range(60)} == brute(some, right.collect(), rules, {"tips": names.like_tips, "loose": names.like_loose}[how], light)


def test_a_busy_day_joined_twice(spark):
    name = lambda i, end="": F.concat(F.lit("team "), F.char(97 + i % 7), F.char(97 + i % 11), F.lit(end))
    rows = lambda n, i, *names_: spark.range(n).select(F.col("id").alias(i), F.lit("football").alias("sport"), F.expr("DATE '2024-01-01'").alias("match_date"), names_[0].alias("home_team"), names_[1].alias("away_team"))
    left = rows(800, "left_id", F.when(F.col("id") % 5 == 0, F.lit("qvk")).otherwise(name(F.col("id"), "x")), name(F.col("id") * 5 + 3))
    right, got = rows(800, "right_id", name(F.col("id")), name(F.col("id") * 5 + 3, "y")), {}
    assert shuffled(spark, lambda: got.update((r.left_id, r.right_id) for r in names.joined_twice(left, right).collect())) < 24 * 1600
    some, all_right = [r for r in left.collect() if r.left_id < 40], right.collect()
    light = {n: n for r in [*some, *all_right] for n in (r.home_team, r.away_team)}
    want = brute(some, all_right, names.RELAXED, names.like_loose, light) | brute(some, all_right, names.LOOSE, names.like_loose, light)
    assert {i: m for i, m in got.items() if i < 40} == want and len(got) > 600


def test_joins_of_odd_rows_in_short_lists(spark, monkeypatch):
    monkeypatch.setattr(names, "ASKED", 2)
    monkeypatch.setattr(names, "HELD", 3)
    schema = "{} long, sport string, match_date string, home_team string, away_team string"
    right = [(9, "s", "d", "porto b", "lyon"), (4, "s", "d", "x porto", "lyon x"), (3, "s", "d", "x porto", "lyon x"), (7, "s", "d", "zenit", ""), (8, "s", "d", "leeds", None), (2, None, "d", "porto", "lyon")]
    right += [(20 + i, "s", "d", f"alpha {c}", "omega") for i, c in enumerate("qvyzk")] + [(1, "t", "d", "porto", "lyon"), (None, "s", "e", "porto", "lyon"), (6, "s", "e", "porto", "lyon")]
    left = [(1, "s", "d", "porto x", "x lyon"), (1, "s", "d", "nobody", "zzz"), (2, "s", "d", "zenit", "qqq"), (3, "s", "d", "alpha u", "omega"), (4, "s", "d", "", ""), (5, "s", "d", "porto", None), (6, None, "d", "porto", "lyon"), (7, "s", "e", "porto", "lyon"), (8, "s", "d", "alpha k", "omegas"), (None, "s", "d", "leed", "lyon")]
    l, r = spark.createDataFrame(left, schema.format("left_id")), spark.createDataFrame(right, schema.format("right_id"))
    got = {x.left_id: (x.right_id, x.likeness) for x in names.joined(l, r, names.TIPS, "tips").collect()}
    # words in another order are alike to 1, and so to the least id; an empty side counts as 0 where the other is 0.9; of equal ones the least id
    assert got[1] == (3, 2.0) and got[2] == (7, 1.0) and got[3][0] == 20 and got[7] == (6, 2.0) and got[8][0] == 24 and not {4, 5, 6} & set(got)


def test_short_names_are_not_lost(spark):
    one = spark.createDataFrame([(1, "football", "abc", "axc")], "i long, sport string, home_team string, away_team string").withColumn("match_date", F.expr("DATE '2024-01-01'"))
    got = entities.match_results(one.withColumnRenamed("i", "result_id"), spark.createDataFrame([(5, "football", "axc", "abc")], "id long, sport string, home_team string, away_team string").withColumn("match_date", F.expr("DATE '2024-01-01'")))
    assert [(r.result_id, r.id) for r in got.collect()] == [(1, 5)]


def test_marks_of_all_languages_fold(spark):
    rows = [("Beşiktaş", "besiktas"), ("Győr", "gyor"), ("Plzeň Dvořák", "plzen dvorak"), ("Iğdır", "igdir"), ("Þór Æsir", "thor aesir"), ("Ďuro Ťažký", "duro tazky")]
    df = spark.createDataFrame(rows, "name string, want string")
    assert all(r.got == r.want and r.plain == r.want.replace(" ", "") or "Æ" in r.name for r in df.select("*", names.light(F.col("name")).alias("got"), entities.plain_name(F.col("name")).alias("plain")).collect())


def test_thorough_rule(spark):
    rows = {
        "FC Real Madrid": "madrid", "Real FC": "fc", "Hapoel Haifa": "haifa", "Leeds United U21": "leeds united", "Manchester City": "manchester",
        "Bayern München": "bayern munich", "1. FC Köln": "1 fc cologne", "Śląsk Wrocław": "slask", "Dynamo Kyiv": "kiev",
        "Skra Bełchatów": "belchatow", "St. Pauli": "sainter pauli", "Norwich City": "norwich", "Tottenham Hotspur FC": "tottenham",
        "Lech Poznań": "lech", "Red Bull Salzburg": "salzburg", "Stal Rzeszow": "rzeszow", "Man Utd": "manchester united", "": "", None: "",
    }
    got = {r.name: r.bare for r in names.thorough(spark.createDataFrame([(n,) for n in rows], "name string"), "name").collect()}
    assert got == rows


def test_index_loses_no_pair(spark):
    import difflib
    import random

    r = random.Random(7)
    made = lambda n: list({"".join(r.choice("abcde xy") for _ in range(r.randrange(1, 9))).strip() or "z" for _ in range(n)})
    left, right = made(80), made(80)
    sport = lambda ns: spark.createDataFrame([("s", n) for n in ns], "sport string, name string")
    for least in (0.35, 0.6, 0.9):
        got = {(x.a, x.b) for x in names.proposed(sport(left), sport(right), least).collect()}
        for a in left:
            for b in right:
                if difflib.SequenceMatcher(None, a, b).ratio() >= least or a in b or b in a or set(a.split()) & set(b.split()):
                    assert (a, b) in got, (a, b, least)
        assert least < 0.9 or len(got) < len(left) * len(right)


def test_links_by_tokens_as_brute_force(spark, sf_dir):
    t = derived.Tables(spark, sf_dir)
    matches = t.matches.where("match_id < 300")
    links = names._links(t)
    plain = {r.name: r.bare for r in names.thorough(t.matches.select(F.explode(F.array("home_team", "away_team")).alias("name")), "name").collect()}
    all_links, want = sorted({(r.link, r.match_date, r.sport) for r in links.collect()}), {}
    for m in matches.collect():
        best = (0, None)
        for link in [x for x, *of in all_links if of == [m.match_date, m.sport]]:
            h, a = (sum(len(w) > 3 and w in link.lower() for w in plain[n].split()) for n in (m.home_team, m.away_team))
            if h and a and h + a > best[0]:
                best = (h + a, link)
        if best[1]:
            want[m.match_id] = best[::-1]
    got = {r.match_id: (r.link, r.tokens) for r in names.by_tokens(matches, links, ("match_date", "sport")).collect()}
    assert got == want and len(got) > 20


def test_links_of_a_busy_day(spark):
    teams = ["quartz hornet", "quartz walrus", "velvet hornet", "copper falcon", "copper walrus", "zephyr zephyr", "maple", None]
    pairs = [(i, "d" if i % 3 else "e", teams[i % 8], teams[(i * 5 + i // 8) % 8]) for i in range(1200)]
    links = [("/" + f"{h}-{a}".replace(" ", "-").title(), day) for _, day, h, a in pairs if h and a] + [("/maple", "d"), (None, "d"), ("/quartz-maple", None), ("x", "d")]
    matches = spark.createDataFrame(pairs, "match_id long, day string, home_team string, away_team string")
    plain = {r.name: r.bare for r in names.thorough(spark.createDataFrame([(t,) for t in teams], "name string"), "name").collect()}
    got, want = {}, {}
    count = shuffled(spark, lambda: got.update((r.match_id, (r.link, r.tokens)) for r in names.by_tokens(matches, spark.createDataFrame(links, "link string, day string"), ("day",)).collect()))
    known = sorted({x for x in links if x[0]})
    for i, day, h, a in pairs:
        sides = [(k, [sum(len(w) > 3 and w in k.lower() for w in plain[t].split()) if t else 0 for t in (h, a)]) for k, of in known if of == day]
        best = min(((-x - y, k) for k, (x, y) in sides if x and y), default=None)
        if best:
            want[i] = (best[1], -best[0])
    assert got == want and 600 < len(got) < 1200
    assert count < 6 * (len(pairs) + len(links))


def test_best_of_a_list(spark):
    df = lambda ns: spark.createDataFrame([(n,) for n in ns], "name string")
    asked, listed = ["FC Porto", "Bayern Munchen", "Nowhere", None, ""], ["Porto", "Porto B", "Bayern München", "Bayer Leverkusen", None, ""]
    got = {r.name: (r.match, r.likeness) for r in names.best_in_list(df(asked), df(listed), 0.6).collect()}
    assert got == {"FC Porto": ("Porto", 1.0), "Bayern Munchen": ("Bayern München", 1.0)}


def test_contained_names_and_the_second_feed(spark):
    asked = spark.createDataFrame([(1, "Ab", "d"), (2, "Porto", "d"), (3, "Porto", "e"), (4, "", "d"), (5, None, "d"), (6, "Lyon", "d")], "asked_id long, name string, day string")
    one = spark.createDataFrame([(10, "FC PORTO", "d"), (9, "porto b", "d"), (11, "x", "e")], "feed_id long, name string, day string")
    two = spark.createDataFrame([(20, "cab", "d"), (21, "Olympique Lyon", "d"), (22, "Porto", "d")], "feed_id long, name string, day string")
    assert sorted(map(tuple, names.looked_up(asked, [one, two], ("day",)).collect())) == [(1, 1, 20), (2, 0, 9), (6, 1, 21)]
