import random
import zlib

import zstandard

from matchlake.llm import toxicity as X


def made(n, seed=2):
    r, rows = random.Random(seed), []
    for i in range(n):
        words = ["".join(r.choices(["th", "er", "ing", "an", "on", "tion", "ble"], k=r.randint(1, 4))) for _ in range(r.randint(20, 200))]
        bad = i % 4 == 0
        if bad:
            for w in r.choices(["blimey", "rotten", "nastyful", "wicked"], k=6):
                words.insert(r.randrange(len(words)), w)
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_learns(spark):
    rows = made(600)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = X.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    test = made(200, 9)
    right = sum((X.score(m, t) >= 0.5) == bool(y) for _, t, y in test)
    assert right >= 190
    # the distance is that of the compressed lengths
    a, b = X.compressors(m.toxic, m.ordinary)
    w = X.words_of("Blimey, this rotten wicked nastyful thing!")
    x = b" blimey this rotten wicked nastyful thing "
    assert X.distances(w, m.toxic, m.ordinary)[1] == len(b(x)) - len(a(x)) > 0
    assert zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(m.toxic, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).decompress(a(x), max_output_size=100) == x


def test_edge_cases(spark):
    rows = made(100) + [(1000, None, 0), (1001, "", 1), (None, "the", 1), (1002, "x" * 80_000, None), (1002, "x" * 80_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").selectExpr("*", "'z' as score", "0 as label")
    m = X.train(df, df)
    got = X.scores(df, m).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert X.keep_ordinary(df, df).columns == df.columns
    none = df.where("1=0")
    assert X.scores(none, X.train(none, none)).count() == 0
    assert X.keep_ordinary(df, none).count() == len(rows)


def test_query(spark, sf_dir):
    got = X.op8_toxicity(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert {r.predicted for r in got} <= {0, 1} and all((r.score >= 0.5) == (r.predicted == 1) for r in got)


def test_drops_real_copies_only():
    r = random.Random(4)
    common = ["%c%c" % (a, b) for a in b"abcdefgh" for b in b"abcdefgh"]
    texts = [[w.encode() for w in r.sample(common, 25)] for _ in range(300)]
    copies = [t[:24] + [b"other"] for t in texts[:50]]
    sets = [set(t) for t in texts + copies + texts[:9]]
    want = []
    for s in sets:
        if not any(len(s & o) >= 0.8 * len(s | o) for o in want):
            want.append(s)
    got = X.distinct(texts + copies + texts[:9])
    assert got == want and 295 <= len(got) <= 300  # before: frequent words alone made most of them copies


def test_learns_the_stems_of_a_rare_language(spark):
    r, rows = random.Random(6), []
    for i in range(1600):
        few = i % 10 == 1  # a language of one text in ten, whose toxic words have a stem in common only
        parts = ["lich", "keit", "ung", "ö", "ver", "sch", "ach"] if few else ["th", "er", "ing", "an", "on", "tion", "ble"]
        words = ["".join(r.choices(parts, k=r.randint(2, 5))) for _ in range(r.randint(40, 150))]
        bad = r.random() < 0.3
        for _ in range(6 * bad):
            words.insert(r.randrange(len(words)), "pfuiba" + "".join(r.choices(parts, k=3)) if few else r.choice(["blimey", "rotten"]))
        rows.append((i, " ".join(words), int(bad), few))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, few boolean")
    m = X.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    rare = [(X.score(m, t) >= 0.5, bool(y)) for i, t, y, few in rows if few and zlib.crc32(str(i).encode()) % 5 == 0]
    toxic = [p for p, y in rare if y]
    assert len(toxic) >= 3 and sum(toxic) >= 0.9 * len(toxic) and sum(p for p, y in rare if not y) <= 1


def test_held_out_labels_are_unused(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = "crc32(cast(doc_id as string)) % 5 = 0"
    turned = labels.selectExpr("doc_id", "quality", f"if({out}, 1 - toxic, toxic) as toxic")
    assert labels.where(out).where("toxic is not null").count() > 0
    assert X.train(docs, turned) == X.train(docs, labels) == X.train(docs, labels.where(f"not {out}"))


def test_held_out_recall_by_language(spark):
    folder = "/root/testdata/sf0.1"
    labels, docs = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "documents"))
    got = X.op8_toxicity(spark, folder).where("held_out").join(labels.where("toxic is not null"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    found = lambda rows: sum(r.predicted for r in rows) / len(rows)
    toxic, clean = ([r for r in got if r.toxic == t] for t in (1, 0))
    assert len(toxic) > 80 and found(toxic) >= 0.9 and found(clean) <= 0.01
    for lang in {r.lang for r in toxic}:  # of few; some labelled texts are one word over and over, with nothing toxic left in them
        assert found([r for r in toxic if r.lang == lang]) >= 0.8


def test_labels_of_absent_documents_take_no_places(spark):
    rows = made(400)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    absent = spark.createDataFrame([(10_000 + i, i % 2) for i in range(3000)], "doc_id long, toxic int")
    assert X.train(df, absent.unionByName(df.select("doc_id", "toxic")), per_class=60).toxic == X.train(df, df, per_class=60).toxic


def test_texts_do_not_pass_through_the_driver(spark, monkeypatch):
    df = spark.createDataFrame(made(200), "doc_id long, text string, toxic int")
    kind, reached = type(df), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: reached.extend(rows := collect(self)) or rows)  # first() and take() call it
    X.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert reached and len(reached) <= 10 and not any("text" in r.asDict() for r in reached)
