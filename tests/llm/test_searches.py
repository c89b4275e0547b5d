"""The searches over embeddings and documents against brute force, on rows that hold nulls, ties, copies and unlike lengths."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlake.llm import lexical, negatives, topk, vectors

VECTORS = "vec_id long, embedding array<float>, label int, rank int, score string"


def vectors_of(n, dims=6, copies=7, seed=3):
    r = random.Random(seed)
    rows = [(i, [float(np.float32(r.uniform(-1, 1))) for _ in range(dims)], r.randrange(4), 0, "x") for i in range(n)]
    for i in range(0, n, copies):  # copies, so that scores tie
        rows[i] = (i, rows[0][1], *rows[i][2:])
    rows += [(n, None, 1, 0, ""), (n + 1, [0.5, None] * (dims // 2), 1, 0, ""), (n + 2, [float("nan")] * dims, 1, 0, ""), (n + 3, [float("inf")] * dims, 1, 0, "")]
    rows += [(None, [1.0] * dims, 1, 0, ""), (n + 4, [0.25] * (dims - 2), 2, 0, ""), (n + 5, [], 1, 0, ""), (n + 6, [0.5] * dims, None, 0, "")]
    return rows


def integers(rows, scale):
    """vec_id -> (integers, label): what takes part; of one vec_id the greatest."""
    out = {}
    for i, v, label, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            new = ([math.floor(scale * x) for x in v], label)
            out[i] = max(out.get(i, new), new)
    return out


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def top_by_hand(rows, k):
    has, out = integers([(*r[:2], 0) for r in rows], 1024), []
    for q in (i for i in has if i % 100 == 0):
        best = sorted((-product(has[q][0], v), i) for i, (v, _) in has.items() if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def top_of(rows, k=10):
    ints = rows.select("vec_id", vectors.whole("embedding", 1024).alias("ints"))
    ints = vectors.once(ints, ["ints"])
    return topk.search(topk.index(ints), ints.where("vec_id % 100 = 0"), k)


@pytest.mark.parametrize("block", [50, 16_384])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    rows = vectors_of(330)
    rows += [rows[5], rows[100], (7, [0.0] * 6, 1, 0, "again")]
    got = top_of(spark.createDataFrame(rows, VECTORS))
    assert sorted(map(tuple, got.collect())) == top_by_hand(rows, 10)


def test_top_k_of_few_rows_and_none(spark):
    few = [(0, [0.5, -0.5], 1, 0, ""), (3, [0.1, 0.2], 1, 0, ""), (100, [0.0, 0.0], 1, 0, "")]
    assert sorted(map(tuple, top_of(spark.createDataFrame(few, VECTORS)).collect())) == top_by_hand(few, 10)
    assert top_of(spark.createDataFrame([], VECTORS)).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_boundary_holds_the_best_rows_and_dropped_bits_lose_none(seed):
    r = np.random.default_rng(seed)
    n, d = int(r.integers(1, 300)), int(r.integers(1, 9))
    ints = r.integers(-(1 << r.integers(1, 15)), 1 << r.integers(1, 15), (n, d))
    slices, drop = topk.slices_of(ints)
    every = np.full(slices.shape[2], topk.ONES)
    if n % 64:
        every[-1] = np.uint64((1 << n % 64) - 1)
    for q in [*ints[:5], np.zeros(d, np.int64)]:
        scores = ints @ q
        kept = np.flatnonzero(np.unpackbits(topk.boundary(slices, drop, q, every, 4).view(np.uint8), bitorder="little"))
        assert set(np.flatnonzero(scores >= np.sort(scores)[-min(4, n)])) <= set(kept.tolist())


def test_sums_of_slices_and_their_kth():
    r = np.random.default_rng(1)
    ints = r.integers(0, 128, (130, 3))
    slices, drop = topk.slices_of(ints)
    assert drop == 0
    sums = topk.added({b: slices[:, b] for b in range(slices.shape[1])})
    bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(int) for s in sums]
    want = (ints - ints.min(axis=0)).sum(axis=1)
    assert (sum(b << i for i, b in enumerate(bits)) == want).all()
    every = np.array([topk.ONES, topk.ONES, np.uint64(3)])
    assert [topk.kth(sums, every, k) for k in (1, 10, 130)] == [int(np.sort(want)[-k]) for k in (1, 10, 130)]


def test_products_are_exact_whatever_their_size():
    big = np.array([[2**62, -(2**61)], [3, 5]])
    assert vectors.products(big, big).tolist() == [[2**124 + 2**122, 3 * 2**62 - 5 * 2**61], [3 * 2**62 - 5 * 2**61, 34]]
    assert vectors.longs(vectors.products(big, big))[0, 0] == 2**63 - 1


def mined_by_hand(rows, scale=256):
    has, out = integers([r for r in rows if r[2] is not None], scale), []
    for a in (i for i in has if i % 100 == 0):
        by = sorted((-product(has[a][0], v), i, label == has[a][1]) for i, (v, label) in has.items() if i != a)
        for s, p, _ in [x for x in by if x[2]][:5]:
            inside = [(-t, i) for t, i, same in by if not same and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, p, n, i, -s, t) for n, (t, i) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows):
    ints = spark.createDataFrame(rows, VECTORS).where("label IS NOT NULL").select("vec_id", "label", vectors.whole("embedding", 256).alias("ints"))
    ints = vectors.once(ints, ["ints", "label"])
    return sorted(map(tuple, negatives.mined(ints, ints.where("vec_id % 100 = 0")).collect()))


@pytest.mark.parametrize("block", [40, 16_384])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    rows = vectors_of(330)
    got = mined(spark, rows)
    assert got == mined_by_hand(rows) and len(got) > 50


def test_negatives_of_few_rows_and_none(spark):
    assert mined(spark, []) == []
    one_label = [(i, [0.5, 0.1 * i], 1, 0, "") for i in range(4)]
    assert mined(spark, one_label) == mined_by_hand(one_label) == []
    zero = [(0, [0.0, 0.0], 1, 0, ""), (1, [0.5, 0.5], 1, 0, ""), (2, [0.5, 0.1], 2, 0, "")]
    assert mined(spark, zero) == mined_by_hand(zero) == [(0, 1, 1, 2, 0, 0)]


def test_keys_sort_as_their_parts():
    r = random.Random(2)
    parts = [(r.choice([-5, 0, 2**40]), r.randint(-(2**63), 2**63 - 1), r.randrange(2), r.randint(-9, 9)) for _ in range(300)] + [(0, s, 0, 0) for s in (-1, 0, 1)]
    assert sorted(parts, key=lambda x: negatives.packed_key(*x)) == sorted(parts, key=lambda x: (x[0], -x[1], x[2], x[3]))


WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return WORD.findall((text or "").translate(UPPER))


def ranked_by_hand(docs, items, k=20):
    counted = [(i, Counter(terms(t))) for i, t, *_ in docs if terms(t)]
    total, tokens = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 100 - 25 + 25 * sum(c.values()) * total // tokens
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            scores += [(-s, i is None, i or 0)] if s > 0 else []
        out += [(item, n, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(n, seed=5):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Äö", "ÑZ", "ab-c", "x_y", "Q1", "日本"]
    text = lambda: " ".join(r.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=r.randrange(1, 40)))
    docs = [(i * 3 % n if i % 50 else i, text(), "s", 1) for i in range(n)]
    docs[4:9] = [(1000 + i, "w1 w2 w1", "s", 1) for i in range(5)]  # ties
    docs += [(2000, None, "s", 1), (2001, "", "s", 1), (2002, "-- \t!!", "s", 1), (None, "w3 w40 w41", "s", 1), (2003, "w5 " * 70_000 + "w59", "s", 1)]
    return docs, [(i, text()) for i in range(12)] + [(50, None), (51, "nowhere"), (52, "w1 w1 w1 W1"), (53, "ÄÖ äö Äö"), (None, "w1")]


@pytest.mark.parametrize("postings", [100, 3_000_000])
def test_lexical_search_equals_brute_force(spark, postings):
    docs, items = corpus(400)
    index = lexical.index(spark.createDataFrame(docs, "doc_id long, text string, term string, df int").repartition(3).select("doc_id", "text"), postings)
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"))
    want = ranked_by_hand(docs, [x for x in items if x[0] is not None])
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_lexical_search_without_rows(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "w1 w2")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.search(lexical.index(none), items).collect() == []
    assert lexical.search(lexical.index(one), items.limit(0)).collect() == []


def test_more_terms_than_are_broadcast_take_the_other_join(spark, monkeypatch):
    docs, items = corpus(90)
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(lexical, "QUERIES_A_BATCH", 4)
    index = lexical.index(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"))
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == ranked_by_hand(docs, [x for x in items if x[0] is not None])


def shard_of(docs):
    shard = lexical.Shard()
    for i, t in enumerate(docs):
        shard.add(i, t.encode())
    return shard.rows(0)


def test_lists_read_back_and_block_maxima_are_exact():
    r = random.Random(1)
    docs = [" ".join(["a"] * r.choice([1, 1, 2, 300]) + ["b"] * (i % 5 == 0) + ["c"] * r.randrange(0, 9)) for i in range(700)]
    lists, head = shard_of(docs)
    lengths = np.array(head.column("lengths")[0].as_py())
    total, tokens = len(docs), int(lengths.sum())
    parts = lexical.length_part(lengths, total, tokens)
    for row in lists.to_pylist():
        postings = lexical.Postings(row, total, tokens)
        found = [postings.read(b, parts) for b in range(len(postings.first))]
        at, impacts = (np.concatenate(x) for x in zip(*found, strict=True))
        tf = np.array([d.split().count(row["term"].decode()) for d in docs])
        assert (at == np.flatnonzero(tf)).all() and (impacts == lexical.impact(tf[at], parts[at])).all()
        assert postings.most.tolist() == [int(i.max()) for _, i in found]


def test_block_maxima_spare_decompression():
    r = random.Random(4)
    docs = [" ".join(["the"] * (1 if i > 100 else 9) + ["x"] * r.randrange(1, 30) + ["rare"] * (i % 500 == 3)) for i in range(6000)]
    lists, head = shard_of(docs)
    lengths = np.array(head.column("lengths")[0].as_py())
    total, tokens = len(docs), int(lengths.sum())
    parts = lexical.length_part(lengths, total, tokens)
    by = {row["term"]: lexical.Postings(row, total, tokens) for row in lists.to_pylist()}
    query = [(9000, by[b"rare"]), (3, by[b"the"])]
    docs_found, scores = lexical.best_of(query, parts, 5, span=512)
    full = np.zeros(total, np.int64)
    for w, p in query:
        for b in range(len(p.first)):
            d, i = p.read(b, parts)
            full[d] += w * i
    order = np.lexsort((np.arange(total), -full))[:5]
    assert docs_found.tolist() == order.tolist() and scores.tolist() == full[order].tolist()
    the = lexical.Postings(next(x for x in lists.to_pylist() if x["term"] == b"the"), total, tokens)
    lexical.best_of([(9000, by[b"rare"]), (3, the)], parts, 5, span=512)
    assert the.decompressed < len(the.first) / 2
