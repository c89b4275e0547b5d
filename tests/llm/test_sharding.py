from collections import Counter

import pytest

from matchlake.llm import sharding as H


def brute(shards, slots):
    orders = [[(a + j * b) % slots for j in range(slots)] for a, b in (H.preference(s, slots) for s in shards)]
    out, turn = {}, 0
    while len(out) < slots:
        slot = next(x for x in orders[turn % len(shards)] if x not in out)
        out[slot] = turn % len(shards)
        turn += 1
    return [out[i] for i in range(slots)]


def test_fill_as_brute_force():
    for n, slots in ((1, 7), (3, 31), (7, 101), (5, 5)):
        names = tuple(f"s{i}" for i in range(n))
        assert H.fill(names, slots).tolist() == brute(names, slots)
    with pytest.raises(ValueError):
        H.fill(("a", "a"))
    with pytest.raises(ValueError):
        H.fill(("a",), 12)


def test_even_and_stable():
    a, b = H.fill(H.SHARDS), H.fill(H.SHARDS[:-1])
    n = Counter(a.tolist())
    assert max(n.values()) - min(n.values()) <= 1 and len(n) == len(H.SHARDS)
    stays = (a == b)[a != len(H.SHARDS) - 1]
    assert stays.mean() > 0.95


def test_query(spark, sf_dir, tmp_path):
    got = H.op7_sharding(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    a, b = H.fill(H.SHARDS), H.fill(H.SHARDS[:-1])
    assert all(r.shard == H.SHARDS[a[r.slot]] and r.shard_after == H.SHARDS[b[r.slot]] for r in got)
    rows = [(1, "x"), (1, "x"), (None, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as shard", "7 as slot")
    out = H.placed(df, "doc_id", ("a", "b"), 11, ("s", "t")).collect()
    assert len(out) == 4 and len({r.t for r in out if r.doc_id == 1}) == 1
    assert H.placed(df.where("1=0"), "doc_id", columns=("s", "t")).count() == 0
    H.write_shards(df.drop("shard"), "doc_id", str(tmp_path / "out"), ("a", "b"), 11)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_null_keys_are_spread(spark, tmp_path):
    df = spark.range(2000).selectExpr("cast(null as long) as doc_id", "cast(id as string) as text", "map(1, id) as m")
    out = H.placed(df, "doc_id", ("a", "b", "c", "d"), 101).collect()
    n = Counter(r.shard for r in out)
    assert len(n) == 4 and max(n.values()) < 700 and len({r.slot for r in out}) == 101
    H.write_shards(df.drop("m"), "doc_id", str(tmp_path / "out"), ("a", "b"), 11)
    assert {r.shard for r in spark.read.parquet(str(tmp_path / "out")).select("shard").distinct().collect()} == {"a", "b"}
    query = H.placed(H.placed(df, "doc_id", spread=("text",)), "doc_id", H.SHARDS[:-1], H.SLOTS, ("again", "after"), ("text",))
    assert query.where("slot <> again").count() == 0
