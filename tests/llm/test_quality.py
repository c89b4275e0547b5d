import math
from collections import defaultdict

import numpy as np
import pytest

from matchlake.llm import quality as Q


def brute(rows):
    """(host rate, path rate, odds of the path against all) of each (host, path, p), the row itself left out."""
    by_path, by_host = defaultdict(list), defaultdict(list)
    for h, p, x in rows:
        by_path[h, p].append(x)
        by_host[h].append(x)
    m = np.mean([x for *_, x in rows])

    def moments(groups):
        g = [(len(v), np.mean(v), q) for v, q in groups if len(v) > 1]
        n = sum(k for k, *_ in g)
        between = (sum(k * (x - q) ** 2 for k, x, q in g) - sum(q * (1 - q) for *_, q in g)) / n
        return min(max(sum(k * q * (1 - q) for k, _, q in g) / n / between - 1, 1), 10_000) if between > 0 else 10_000

    a = moments([(v, m) for v in by_host.values()])
    b = moments([(v, (sum(by_host[h]) + a * m) / (len(by_host[h]) + a)) for (h, _), v in by_path.items()])
    out = []
    for h, p, x in rows:
        host = (sum(by_host[h]) - x + a * m) / (len(by_host[h]) - 1 + a)
        path = (sum(by_path[h, p]) - x + b * host) / (len(by_path[h, p]) - 1 + b)
        out.append((host, path, math.log(path / (1 - path)) - math.log(m / (1 - m))))
    return out


def test_posteriors_as_brute_force(spark):
    r = np.random.default_rng(1)
    words = ["plain", "words", "stand", "here", "##", "$$$", "%%"]
    rows = [(i, " ".join(r.choice(words, 20)), f"h{i % 7}" if i % 11 else None, f"p{i % 3}", int(r.integers(2))) for i in range(400)] + [(900, "plain ## words", "lone", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, quality int")
    model = Q.train(df, df)
    ps = [(s, p, 1 / (1 + math.exp(-model.evidence(t)))) for _, t, s, p, _ in rows]
    got = {x.row.doc_id: x for x in Q.judge(df, df).collect()}
    for (i, t, *_), (host, path, odds) in zip(rows, brute(ps), strict=True):
        x = got[i]
        assert (x.host_rate, x.path_rate, x.evidence) == (pytest.approx(host), pytest.approx(path), pytest.approx(model.evidence(t)))
        assert x.posterior == pytest.approx(1 / (1 + math.exp(-(model.evidence(t) + odds)))) and x.kept == (x.posterior >= Q.THRESHOLD)
    # a lone document is judged by its own text and what holds for all
    assert got[900].posterior == pytest.approx(1 / (1 + math.exp(-got[900].evidence)))


def test_held_out_accuracy(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rest = labels.where("crc32(cast(doc_id as string)) % 5 <> 0")
    got = Q.judge(docs, rest, columns=["doc_id"]).select("row.doc_id", "kept").join(labels.where("crc32(cast(doc_id as string)) % 5 = 0"), "doc_id").where("quality is not null").collect()
    good, bad = ([r.kept for r in got if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad) and len(bad) >= 5


def test_broadcast_and_salted_join_agree(spark, sf_dir, monkeypatch):
    a = {r.doc_id: r for r in Q.op1_quality(spark, sf_dir).collect()}
    monkeypatch.setattr(Q, "BROADCAST_SITES", 0)
    b = {r.doc_id: r for r in Q.op1_quality(spark, sf_dir).collect()}
    assert len(a) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and a == b
    for r in a.values():
        assert 0 <= r.posterior <= 1 and r.kept == (r.posterior >= Q.THRESHOLD) and math.isfinite(r.evidence)


def test_edge_cases(spark):
    rows = [(i, "Plain words stand here and there." if i % 2 else "#$ #$ %% ## " * 9, "s", "en") for i in range(40)]
    rows += [(100, None, None, None), (101, "", "s", None), (None, "words", None, "en"), (102, "# " * 40_000, "t", "en"), (102, "# " * 40_000, "t", "en")]
    names = "host path evidence p n good host_n host_good host_rate path_rate posterior kept row hash salt s h q label x".split()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "doc_id % 2 as quality", *(f"'x' as {n}" for n in names))
    got = Q.judge(df, df)
    assert got.count() == len(rows)
    by = {r.row.doc_id: r.kept for r in got.collect()}
    assert by[1] and not by[2] and not by[102]
    kept = Q.keep_good(df, df)
    assert kept.dtypes == df.dtypes and kept.where("doc_id < 40").count() == 20 and kept.first().evidence == "x"
    assert Q.judge(df.where("1=0"), df.where("1=0")).count() == 0
