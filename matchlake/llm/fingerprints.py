"""4. Document fingerprints by consistent weighted sampling. DataFrame functions only.

A document is its distinct words, each weighted by how often it occurs. For each sample k, hashes of a word give r and c from
Gamma(2, 1) and b from U(0, 1); with weight w, t = floor(ln w / r + b) and ln a = ln c - r * (t - b + 1). The word with the least a is
the sample, together with its t: two documents have the same sample with a probability that equals their generalised Jaccard
similarity, sum of least over sum of greatest weights. a and the sample's hash share one long, so a grouped minimum finds it.

Texts are shuffled once by doc_id; words are counted and sampled in the same partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SAMPLES = 32
#: Null doc_ids are dealt by their text over so many keys (a power of two), the least of all longs, which are no doc_ids.
NO_IDS, LEAST = 65_536, -(1 << 63)
SPACES = "[\\x20\\x09-\\x0D]+"


def followed(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id) of the distinct doc_ids, in ascending order; the first one follows the last. Ids are dealt by range; in each
    range a window finds the next, and the ranges' first ids, one row for each, close the gaps. Carries n, the longest text's length."""
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("n").alias("n"))
    ids = stored(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    first = ids.groupBy("part").agg(F.min("doc_id").alias("first"))
    after = first.select("part", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.min("first").over(Window.partitionBy())).alias("after"))
    # as many rows as there are partitions
    return ids.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))).join(F.broadcast(after), "part").select("doc_id", F.coalesce("next_id", "after").alias("next_id"), "n")


def id_of(key: str) -> Column:
    return F.when(F.col(key) >= LEAST + NO_IDS, F.col(key))


def edited(docs: DataFrame) -> DataFrame:
    """(key, text, edited) for each row of docs(doc_id, text): key is doc_id, or one of NO_IDS for null; null texts: empty.

    The last half of the code points gives way to the first as many of the next document (all, if it has fewer). Of several texts of
    one doc_id, the least part counts as the next document. Without doc_id nothing follows. Texts are shuffled by doc_id, and of each
    again as much as the document before it needs, for the lengths are known beforehand."""
    docs = docs.select(F.coalesce("doc_id", F.xxhash64("text").bitwiseAND(NO_IDS - 1) + F.lit(LEAST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    order = followed(docs.select(id_of("key").alias("doc_id"), F.length("text").alias("n")))
    # once for all that follows: to the planner, too, no key can be null (a remainder could), so both branches below read the same shuffle
    docs = docs.repartition("key")
    before = order.select(F.col("next_id").alias("key"), F.col("doc_id").alias("before_id"), F.floor(F.col("n") / 2).cast("int").alias("need"))
    heads = docs.join(before, "key").groupBy(F.col("before_id").alias("key")).agg(F.min(F.substring("text", F.lit(1), F.col("need"))).alias("head"))
    half = F.floor(F.length("text") / 2).cast("int")
    new = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.coalesce("head", F.lit("")), F.lit(1), half))
    return docs.join(heads, "key", "left").select("key", "text", new.alias("edited"))


def uniform(h: Column, shift: int) -> Column:
    """21 bits of a hash as a number between 0 and 1, both excluded."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(0x1FFFFF) + 0.5) / 2097152.0


def sample_keys(word: Column, k: int, log_weights: list[Column]) -> list[Column]:
    """For each weight the least-first key of sample k: ln a in the upper bits, a hash of word, k and t in the lower 32."""
    g, h = F.xxhash64(word, F.lit(k)), F.xxhash64(word, F.lit(k + 1_000_000))
    r, log_c, b = -F.ln(uniform(g, 0) * uniform(g, 21)), F.ln(-F.ln(uniform(h, 0) * uniform(h, 21))), uniform(h, 42)
    out = []
    for log_w in log_weights:
        t = F.floor(log_w / r + b)
        log_a = log_c - r * (t - b + 1)
        mark = g.bitwiseXOR(t * 0x9E3779B1).bitwiseAND(0xFFFFFFFF)
        out.append(F.shiftleft(((log_a + 100) * 16777216.0).cast("long"), 32).bitwiseOR(mark))
    return out


def sampled(words: DataFrame, keys: list[str], weights: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and, for each of the weight columns, <weight>_fp array<long>: the samples of words(keys, word long, weights long).
    Null where no word has a weight."""
    logs = [F.when(F.col(w) > 0, F.ln(w)) for w in weights]
    columns = [f"_{w}_{k}" for k in range(samples) for w in weights]
    made = [x for k in range(samples) for x in sample_keys(F.col("word"), k, [F.col(f"_ln_{w}") for w in weights])]
    logged = words.select(*keys, "word", *(x.alias(f"_ln_{w}") for x, w in zip(logs, weights, strict=True)))
    least = logged.groupBy(*keys).agg(*(F.min(x).alias(c) for x, c in zip(made, columns, strict=True)))
    return least.select(*keys, *(F.when(F.col(f"_{w}_0").isNotNull(), F.array(*(F.col(f"_{w}_{k}").bitwiseAND(0x7FFFFFFF) for k in range(samples)))).alias(f"{w}_fp") for w in weights))


def likeness(a: Column, b: Column, samples: int) -> Column:
    """The share of equal samples; both without words: 1, one: 0."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / samples
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def written(fp: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))), ""), F.lit(""))


def fingerprinted(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each of docs(doc_id, text).

    Null and empty texts have no words and an empty fingerprint. The next document of the last is the first; if several texts have its
    doc_id, the least fingerprint counts. Rows without doc_id have no head from a next document, and likeness 0 to one.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    split = lambda c: F.split(F.col(c), SPACES)
    sides = F.array(F.struct(split("text").alias("w"), one.alias("a"), none.alias("b")), F.struct(split("edited").alias("w"), none.alias("a"), one.alias("b")))
    both = edited(docs).select("key", "text", "edited", F.xxhash64("text").alias("same"))
    words = both.select("key", "same", F.explode(sides).alias("x")).select("key", "same", "x.a", "x.b", F.explode("x.w").alias("w")).where("w <> ''")
    counted = words.select("key", "same", F.xxhash64("w").alias("word"), "a", "b").groupBy("key", "same", "word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    known = both.select("key", "same", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    known = stored(known.groupBy("key", "same", "n_chars", "edited_sha256").agg(F.count("*").alias("copies")))
    # rows that repeat doc_id and text were counted together: n copies give n times the weight
    again = known.where("copies > 1").select("key", "same", "copies")
    counted = counted.join(again, ["key", "same"], "left").select("key", "same", "word", *((F.col(w) / F.coalesce("copies", F.lit(1))).alias(w) for w in "ab"))
    fps = sampled(counted, ["key", "same"], ["a", "b"], samples).select("key", "same", *(F.transform(f"{w}_fp", lambda x: x.cast("int")).alias(w) for w in "ab"))
    at = stored(known.join(fps, ["key", "same"], "left").withColumn("doc_id", id_of("key")).drop("key"))
    order = followed(at.select("doc_id", F.lit(0).alias("n")))
    following = at.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("a")).alias("f")).select(F.col("doc_id").alias("next_id"), F.col("f.a").alias("next_fp"))
    at = at.join(order.select("doc_id", "next_id"), "doc_id", "left").join(following, "next_id", "left")
    near_next = F.when(F.col("doc_id").isNull(), 0.0).otherwise(likeness(F.col("a"), F.col("next_fp"), samples))
    return at.select("doc_id", "n_chars", "edited_sha256", written(F.col("a")).alias("fingerprint"), written(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b"), samples).alias("near_edited"), near_next.alias("near_next"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_n")).drop("_n")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases: see fingerprinted. Texts count whole, however long: their words are exploded to rows, and grouped."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return fingerprinted(docs)
