import random
import re

import numpy as np

from matchlake.llm import rules as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    marked = set()
    for i in range(len(words) - 4):
        for j in range(len(words) - 4):
            if i != j and words[i : i + 5] == words[j : j + 5]:
                marked |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(marked)


def test_statistics_as_brute_force():
    r = random.Random(1)
    texts = [None, "", " \n", "a b c d e a b c d e", "a a a a a a a", "x\x1cy\xa0z\x85 é ü"]
    texts += ["".join(r.choices(["a", "b", " ", " ", "\n", "c#", "\t", "é", "\x0b"], k=r.randint(0, 90))) for _ in range(400)]
    for t in texts:
        assert Q.statistics(t) == brute(t), t


def test_forest():
    r = np.random.default_rng(0)
    x = np.vstack([r.normal(size=(2000, 3)), [[9, 9, 9], [-9, 9, 0]]])
    f = Q.grow(x)
    s = f.score(x)
    assert s[-2:].min() > np.quantile(s[:-2], 0.995) and ((s > 0) & (s < 1)).all()
    # the same path lengths as a walk down each tree
    want = []
    for row in x[:20]:
        total = 0
        for feature, cut, child, length in zip(f.feature, f.cut, f.child, f.length, strict=True):
            at = 0
            while feature[at] >= 0:
                at = child[at][int(row[feature[at]] >= cut[at])]
            total += length[at]
        want.append(2 ** (-total / len(f.feature) / f.normal))
    assert np.allclose(want, s[:20])


def test_edge_cases(spark):
    rows = [(i, "some good words in a line that is long enough %d" % i) for i in range(30)] + [(50, None), (51, ""), (None, "a"), (52, "w " * 60_000), (52, "w " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "1 as kept", "1 as quality")
    got = Q.judge(df, df).collect()
    assert len(got) == len(rows) and {r.kept for r in got if r.doc_id in (50, 51, 52, None)} == {False} and all(r.kept for r in got if r.doc_id in range(30))
    assert Q.judge(df.where("1=0"), df.where("1=0")).count() == 0


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in Q.op2_rules(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 1500").collect():
        x = got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute(r.text)
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words) and not (x.kept and x.base_failed)


def test_verdicts_as_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.judge(docs.select("doc_id", "text"), labels).collect()
    stats = Q.with_statistics(docs.select("doc_id", "text"))
    forest = Q.fit(stats)
    assert len(forest.feature) == Q.TREES
    for r, s in zip(got, forest.score(Q.rates(*(np.array([getattr(r, n) for r in got], float) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))), strict=True):
        assert np.isclose(r.score, s)
    label = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    known = [(min(int(r.score * Q.BINS), Q.BINS - 1), label[r.doc_id]) for r in got if not r.base_failed and r.doc_id in label]
    good, bad = ([b for b, q in known if q == x] for x in (1, 0))
    best, cut = 0, None
    for c in range(Q.BINS):
        lost, caught = (sum(b >= c for b in v) / len(v) for v in (good, bad))
        if lost <= Q.MAX_GOOD_LOST and caught - lost > best:
            best, cut = caught - lost, c
    for r in got:
        assert r.kept == (not r.base_failed and (cut is None or r.score < cut / Q.BINS))


def test_each_tree_has_its_own_rows(spark):
    rows = [(i % 500 if i < 3000 else 7, 20, 60 + i % 9, i % 4, 0, 0, False) for i in range(9000)]  # two thirds have one doc_id
    stats = spark.createDataFrame(rows, f"doc_id long, {Q.STATISTICS}, base_failed boolean")
    forest = Q.fit(stats, trees=20, sample=64)
    assert len(forest.feature) == 20 and len({tuple(t) for t in forest.cut.tolist()}) > 15
    assert len(Q.fit(stats.where("1=0")).feature) == 0
