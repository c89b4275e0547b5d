import random

import numpy as np
import xxhash

from matchlake.llm import simhash as S
from matchlake.llm.components import components


def brute_fp(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_anchors_cover():
    r = np.random.default_rng(0)
    for bits in (1, 3, 5, 7):
        anchors = S.Anchors(bits)
        for _ in range(200):
            x = int(r.integers(0, 1 << 63))
            y = x
            for i in r.choice(64, bits, replace=False):
                y ^= 1 << int(i)
            row, key, asks = anchors.of(np.array([x, y], np.uint64))
            found = {k for i, k in zip(row, key, strict=True) if i == 1}
            assert any(k in found for i, k, q in zip(row, key, asks, strict=True) if i == 0 and q)


def test_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(300)]
    got = {x.id: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute_groups({x for p in links for x in p}, links)
    assert all(got.get(x, x) == y for x, y in want.items()) and set(got) == {x for p in links if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_as_brute_force(spark):
    r, texts = random.Random(3), [None, "", " ", "A b", "a B", "a b c", "x " * 30_000]
    vocabulary = ["".join(r.choices("abcdefgh", k=4)) for _ in range(400)]
    for _ in range(60):
        words = r.choices(vocabulary, k=r.randint(5, 200))
        for _ in range(r.randint(1, 12)):
            words = list(words)
            for _ in range(r.randint(0, 2)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            texts.append(" ".join(words))
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, texts[9]), (5000, "only here " * 3), (5000, "only here " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id", "3 as kind")
    got = S.near_groups(df).collect()
    assert len(got) == len(rows)
    fps = {t: brute_fp(t) for _, t in rows}
    distinct = sorted(set(fps.values()))
    group = brute_groups(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for i, t in rows:
        if i is not None:
            least[group[fps[t]]] = min(i, least.get(group[fps[t]], i))
    want = sorted((i is None, i or 0, "%016x" % fps[t], least[group[fps[t]]]) for i, t in rows)
    assert sorted((x.doc_id is None, x.doc_id or 0, x.fingerprint, x.component_id) for x in got) == want
    assert len(set(least)) < len(distinct)
    assert S.near_groups(df.where("1=0")).count() == 0


def test_dense_groups_stay_whole(spark):
    r = np.random.default_rng(4)
    centre, fps = 0x0123456789ABCDEF, set()
    while len(fps) < 700:
        x = centre
        for i in r.choice(63, 3, replace=False):
            x ^= 1 << int(i)
        fps.add(x)
    df = spark.createDataFrame([(0, x) for x in fps], "kind int, fp long")
    links = [(x.a, x.b) for x in S.link(df).collect()]
    near = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]
    assert brute_groups(fps, links) == brute_groups(fps, near) and all((a ^ b).bit_count() <= 3 for a, b in links)
    split = [(x.a, x.b) for x in S.link(df, split=50).collect()]  # crowded anchors in several tasks
    assert brute_groups(fps, split) == brute_groups(fps, near) and all((a ^ b).bit_count() <= 3 for a, b in split)
    assert S.link(df, split=50).select("kind").distinct().count() == 1 and S.link(df.limit(0)).count() == 0


def test_keep_one(spark):
    r = random.Random(5)
    base = [" ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(120)) for _ in range(25)]
    rows, n = [], 0
    for b in base:
        for k in range(5):
            w = b.split()
            for j in range(k // 2):
                w[10 + j * 30] = "edited"
            rows.append((n, " ".join(w), "x"))
            n += 1
    rows += [(n, None, "x"), (n + 1, "", "x"), (None, "null id", "x"), (None, "null id", "x"), (n + 2, "w " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").selectExpr("*", "1 as root", "2 as same")
    got = S.keep_one(df)
    assert got.columns == df.columns
    assert sorted(x.doc_id for x in got.where("doc_id is not null").collect()) == [*range(0, 125, 5), n, n + 2]
    assert got.where("doc_id is null").count() == 2
    assert S.keep_one(df.where("1=0")).count() == 0


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_copies(texts):
    sets = [shingle_set(t) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return {i for i, j in brute_groups(range(len(texts)), linked).items() if i != j}


def test_every_pair_from_similarity_of_one_level(spark):
    r, texts = random.Random(8), []
    for _ in range(60):
        words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(r.randint(100, 300))]
        more = ["".join(r.choices("abcdefgh", k=5)) for _ in range(len(words) * r.choice([5, 10, 15, 20, 24, 30]) // 100)]
        texts += [" ".join(words), " ".join(words + more)]
    want = brute_copies(texts)
    got = {x.doc_id for x in S.copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want and 40 <= len(want) < 60


def test_members_that_fail_meet_again(spark, monkeypatch):
    monkeypatch.setattr(S, "ASKERS", 5)  # in several blocks and chunks
    monkeypatch.setattr(S, "PASSING", 20)
    r = random.Random(9)
    head = ["".join(r.choices("abcdefgh", k=5)) for _ in range(120)]
    texts = [" ".join(r.sample(head, 120))]  # the same distinct words, so all links of fingerprints lead to it
    texts += [" ".join(head), " ".join(head[3:] + head[:3])]
    for k in range(3):  # more than may meet at once: three groups, each of near copies, of one long passage
        tail = ["".join(r.choices("abcdefgh", k=5)) for _ in range(60)]
        for _ in range(32):
            w = head + tail
            w[150 + r.randrange(25)] = "edited"
            texts.append(" ".join(w))
    want = brute_copies(texts)
    got = {x.doc_id for x in S.copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want and 2 in want and 1 not in want
