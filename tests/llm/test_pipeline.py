import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, now = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, sf_dir).collect(), docs.schema)
        assert now.columns == docs.columns
        kept[name] = {r.doc_id: r for r in now.collect()}
    before, after = kept["toxicity"], kept["near_duplicates"]
    assert set(after) <= set(before) <= set(kept["quality"])
    sets = {i: shingles(r.text) for i, r in before.items()}
    for i in before:
        if i not in after:  # a copy of one that stays or stayed in its group
            assert max(like(sets[i], sets[j]) for j in before if j < i) >= 0.8
    alike = [(i, j) for i in after for j in after if i < j and like(sets[i], sets[j]) >= 0.8]
    assert not alike
    assert set(kept["private_data"]) == set(after)
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(after) and sum(r.length for r in rows if r.start == 0) > 0
