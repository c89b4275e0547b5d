import random

from matchlake.llm import language as L


def longest_parse(text, sample):
    """Brute force: greedy longest matches in sample; a byte that isn't there is a phrase."""
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in sample:
            k += 1
        i, n = i + k, n + 1
    return n


def test_phrases_as_brute_force():
    r = random.Random(1)
    samples = [(n, bytes(r.choices(a, k=700))) for n, a in (("x", b"abc "), ("y", b"abde "), ("z", b"zz\xc3\xa9"))]
    m = L.learn(samples)
    texts = [b"", b"q", b"abc"] + [bytes(r.choices(b"abcdez q\xc3", k=r.randint(1, 2600))) for _ in range(40)]
    got = m.phrases(texts)
    for t, row in zip(texts, got, strict=True):
        for (_, s), n in zip(samples, row, strict=True):
            assert n == sum(longest_parse(t[i : i + L.WINDOW], s) for i in range(0, len(t), L.WINDOW))


def test_edge_cases(spark):
    rows = [(1, "der die das und", "de"), (2, "the of and to", "en"), (3, None, "en"), (4, "", None), (None, "the of", "en"), (5, "12 !", "de"), (5, "12 !", "de"), (6, "x" * 70_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'a' as score")
    m = L.learn(L.sample(df, held_out=None))
    got = {(r.doc_id, r.lang_pred) for r in L.predict(df, m).collect()}
    assert {(1, "de"), (2, "en"), (3, "und"), (4, "und"), (5, "und"), (None, "en")} <= got
    assert L.predict(df, m).count() == len(rows)
    none = L.learn(L.sample(df.where("1=0")))
    assert {r.lang_pred for r in L.predict(df, none).collect()} == {"und"}


def test_held_out_accuracy(spark, sf_dir):
    got = L.op9_language(spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_only_letters_make_a_language(spark):
    df = spark.createDataFrame([(1, "½ ²"), (2, "_ 4 ٣"), (3, "ª"), (4, "the ½")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in L.predict(df, L.learn([("en", b"the of and to"), ("de", b"der die das und")])).collect()}
    assert got == {1: "und", 2: "und", 3: "en", 4: "en"}  # row 3 is one phrase in either; the longer labelled text weighs more


def test_held_out_fold_is_unused(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = "crc32(cast(doc_id as string)) % 3 = 1"
    turned = docs.selectExpr("doc_id", f"if({out}, 'zz', text) as text", f"if({out}, 'xx', lang) as lang")
    assert L.sample(turned) == L.sample(docs) == L.sample(docs.where(f"not {out}"))


def test_sample_is_bounded_and_uses_few_long_documents_whole(spark):
    rows = [(i, "the of and to " * 3000, "en") for i in range(3)] + [(100 + i, "der die das", f"l{i}") for i in range(30)] + [(100 + i, "der die das", f"l{i}") for i in range(20)]
    got = dict(L.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), held_out=None))
    assert len(got["en"]) == L.BYTES_PER_LANGUAGE and len(got) == 31
    assert all(len(t) <= L.BYTES_PER_LANGUAGE for t in got.values())


def test_no_language_is_left_out(spark):
    r = random.Random(3)
    own = {f"l{i:03}": ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9))) for _ in range(30)] for i in range(230)}
    rows = [(i * 10 + j, " ".join(r.choices(words, k=400)), lang) for i, (lang, words) in enumerate(own.items()) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.sample(df, held_out=None)
    assert [n for n, _ in got] == sorted(own) and max(len(t) for _, t in got) <= 100 * L.BYTES_PER_LANGUAGE // 230
    found = L.predict(df, L.learn(got)).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert all(x.lang == x.lang_pred for x in found)


def test_states_beyond_15_bits_and_many_windows(monkeypatch):
    r = random.Random(4)
    text = bytes(r.choices(b"abcdefghij ", k=40_000))
    m = L.learn([("x", text), ("y", text[:300])])
    assert m.phrases([text[30_000:30_900]])[0, 0] == 1  # one phrase, found by states past 32,767
    texts = [bytes(r.choices(b"abcdefghij ", k=n)) for n in (0, 1, 5000, 1024, 1025, 700)]
    whole = m.phrases(texts)
    monkeypatch.setattr(L, "AT_ONCE", 6)
    assert (m.phrases(texts) == whole).all()
