import hashlib
import random
import re
from collections import Counter

from matchlake.llm import fingerprints as C


def test_as_brute_force(spark):
    r = random.Random(8)
    vocabulary = ["w%d" % i for i in range(60)] + ["é", "漢字"]
    texts = [None, "", " ", "a", "a b c d", "x " * 20_000] + [" ".join(r.choices(vocabulary, k=r.randint(1, 150))) + r.choice(["", "\n", "  z"]) for _ in range(50)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "null id here"), (9, texts[3]), (1000, texts[8])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as same", "3 as n")
    got = C.fingerprinted(df).collect()
    assert len(got) == len(rows)
    ids = sorted({i for i, _ in rows if i is not None})
    text_of = {i: min(t or "" for j, t in rows if j == i) for i in ids}
    want = Counter()
    bags, near = {}, []
    for i, t in rows:
        t = t or ""
        head = text_of[ids[(ids.index(i) + 1) % len(ids)]] if i is not None else ""
        n = len(t) // 2
        new = t[: len(t) - n] + head[:n]
        want[i, len(t), hashlib.sha256(new.encode()).hexdigest()] += 1
        bags[i, len(t)] = [Counter(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in (t, new, head)]
    assert Counter((x.doc_id, x.n_chars, x.edited_sha256) for x in got) == want
    like = lambda a, b: sum((a & b).values()) / max(1, sum((a | b).values())) if a or b else 1.0
    for x in got:
        a, b, c = bags[x.doc_id, x.n_chars]
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
        near.append((x.near_edited - like(a, b), x.near_next - (like(a, c) if x.doc_id is not None else 0)))
    for side in zip(*near, strict=True):  # unbiased, and as precise as 32 samples allow
        assert abs(sum(side) / len(side)) < 0.05 and max(map(abs, side)) < 0.45, sorted(side)[-3:]
    by_text = {}
    for x, t in ((x, dict(rows)[x.doc_id]) for x in got):
        assert by_text.setdefault(t or "", x.fingerprint) == x.fingerprint
    assert C.fingerprinted(df.where("1=0")).count() == 0


def test_collision_rate_is_generalised_jaccard(spark):
    a = {1: 5, 2: 1, 3: 8, 4: 2, 5: 1}
    b = {1: 2, 2: 1, 3: 8, 6: 4, 7: 1}
    rows = [(0, w, a.get(w, 0), b.get(w, 0)) for w in a | b]
    x = C.sampled(spark.createDataFrame(rows, "d int, word long, a long, b long"), ["d"], ["a", "b"], 128).first()
    rate = sum(p == q for p, q in zip(x.a_fp, x.b_fp, strict=True)) / 128
    true = sum(min(a.get(w, 0), b.get(w, 0)) for w in a | b) / sum(max(a.get(w, 0), b.get(w, 0)) for w in a | b)
    assert abs(rate - true) < 0.13
