"""The corpus queries, by name: one for each operator. The three searches have SQL, over all rows of their tables. The others have none:
each uses trained models, XXH64, iteration or tokenizers, which DuckDB's SQL lacks; tests/llm holds each against a brute-force version, a
round trip or held-out labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, language, lexical, negatives, packing, prefix_bpe, quality, rules, sharding, simhash, surrogates, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_rules": rules.op2_rules,
    "op3_packing": packing.op3_packing,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_surrogates": surrogates.op5_surrogates,
    "op6_simhash": simhash.op6_simhash,
    "op7_sharding": sharding.op7_sharding,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_language": language.op9_language,
    "op10_prefix_bpe": prefix_bpe.op10_prefix_bpe,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_top_k": topk.op12_top_k,
    "op13_lexical": lexical.op13_lexical,
}
#: <scale>: what components are multiplied by. Products of integers are exact as doubles here.
_VECTORS = """SELECT vec_id, label, [floor(<scale> * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"""
ORACLE_SQL: dict[str, str] = {
    "op11_hard_negatives": f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, e FROM ({_VECTORS.replace("<scale>", "256")}) r WHERE label IS NOT NULL),
 s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
 SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
 FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
 WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10""",
    "op12_top_k": f"""WITH v AS ({_VECTORS.replace("<scale>", "1024")})
 SELECT q.vec_id AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id
 WHERE q.vec_id % 100 = 0 WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) QUALIFY row_number() OVER w <= 10""",
    "op13_lexical": r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
 c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY 1),
 l AS (SELECT count(*) AS docs, sum(n)::BIGINT AS tokens FROM d), m AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // tokens AS m FROM d, l),
 w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM c, l GROUP BY term, docs),
 q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
 s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN c USING (term) JOIN m USING (doc_id) GROUP BY ALL)
 SELECT item_id, CAST(row_number() OVER v AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 WINDOW v AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER v <= 20""",
}
