"""1. Quality classifier with hierarchical empirical Bayes.

A logistic model over the shares of each ASCII character gives a document's own evidence. Grouped aggregation sums it by path and by
host: a host's rate of good documents is shrunk towards the global rate, a path's towards its host's, each with the strength that the
spread of the rates between groups asks for (moments), so a site with few documents hardly moves its documents. A document's posterior
replaces the global prior in its evidence by its path's, from which the document itself is left out, so that a site of one document
says nothing but its host's rate.

`documents` has no addresses: `source` is its host, and the part of a source in one language is the path.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled, map_texts, stored, table
from .toxicity import fit_logistic

#: Labelled documents of each class that the classifier may be fitted on. The only sample.
PER_CLASS = 3000
#: Up to so many sites are broadcast (some tens of bytes each); more are joined, with each host dealt over SALTS tasks.
BROADCAST_SITES, SALTS = 50_000, 32
THRESHOLD = 0.5


def shares(text: str | None) -> np.ndarray:
    """Of a whole text: the root of each ASCII character's share of its bytes (letters by case together), of other bytes, the share of
    repeated words and the logarithm of its length."""
    data = (text or "").encode()
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    words = data.split()
    kinds = [n[65:91].sum(), n[97:123].sum(), n[48:58].sum(), n[128:].sum(), *n[:48], *n[58:65], *n[91:97], *n[123:128]]
    return np.array([*np.sqrt(np.array(kinds) / max(1, len(data))), 1 - len(set(words)) / max(1, len(words)), math.log1p(len(words)) / 10])


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray

    def evidence(self, text: str | None) -> float:
        """Log odds that a text is good."""
        return float(np.clip(shares(text) @ self.weights[:-1] + self.weights[-1], -12, 12))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Classifier:
    """Fitted on labelled rows of docs; without rows of both classes, each text's odds are the labels' or even. Texts become shares in
    the tasks, so what is collected is bounded whatever their length."""

    def featured(ids, texts, ys) -> Iterator[tuple]:
        for i, t, y in zip(ids, texts, ys, strict=True):
            yield i, y, shares(t).tobytes()

    some = map_texts(labelled(docs, labels, "quality", 1, None, per_class), ["doc_id", "text", "label"], "doc_id long, label int, x binary", featured)
    rows = some.groupBy("doc_id", "label").agg(F.min("x").alias("x")).orderBy("doc_id").collect()  # 2 * per_class at most
    y = np.array([r.label for r in rows], float)
    if not len(y):
        return Classifier(np.zeros(len(shares("")) + 1))
    w = fit_logistic(np.array([np.frombuffer(r.x) for r in rows]), y, 0.02)
    share = labels.where("quality in (0, 1)").agg(F.avg(F.col("quality").cast("double"))).first()[0]
    odds = lambda p: math.log(min(max(p, 1e-3), 1 - 1e-3) / (1 - min(max(p, 1e-3), 1 - 1e-3)))
    w[-1] += odds(share) - odds(y.mean())  # the sample has another share of good documents than the labels
    return Classifier(w)


def evidence_column(spark: SparkSession, model: Classifier, text: str = "text") -> Column:
    at = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([at.value.evidence(t) for t in texts], dtype="float64")

    return of(F.col(text))


def strength(groups: DataFrame, n: str, rate: str, prior: str) -> float:
    """How many documents the prior of a level weighs, by moments: the spread of the groups' rates beyond what sampling explains.
    One row comes to the driver, at any number of groups."""
    p, w, x = F.col(prior), F.col(n), F.col(rate)
    r = groups.where(w > 1).agg(F.sum(w * p * (1 - p)).alias("own"), F.sum(w * (x - p) ** 2).alias("spread"), F.sum(w).alias("n"), F.sum(p * (1 - p)).alias("noise")).first()
    if not r.n:
        return 100.0
    between = (r.spread - r.noise) / r.n  # variance of the true rates
    own = r.own / r.n
    return float(min(max(own / between - 1, 1.0), 10_000.0)) if between > 0 else 10_000.0


def sites(evidence: DataFrame) -> tuple[DataFrame, float, float, float]:
    """(host, path, n, good, host_n, host_good) of evidence(host, path, p), null host and path as groups of their own; the global rate,
    and how many documents it weighs against a host's own, and a host's rate against a path's own."""
    paths = stored(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")))
    rate = paths.agg((F.sum("good") / F.sum("n")).alias("r")).first().r
    rate = min(max(rate, 1e-3), 1 - 1e-3) if rate is not None else 0.5
    hosts = paths.groupBy(F.col("host").alias("h")).agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    of_host = strength(hosts.select("host_n", (F.col("host_good") / F.col("host_n")).alias("r"), F.lit(rate).alias("p")), "host_n", "r", "p")
    both = stored(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"))
    prior = (F.col("host_good") + of_host * rate) / (F.col("host_n") + of_host)
    of_path = strength(both.select("n", (F.col("good") / F.col("n")).alias("r"), prior.alias("p")), "n", "r", "p")
    return both, rate, of_host, of_path


def judge(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = THRESHOLD, columns: list[str] | None = None) -> DataFrame:
    """(row, evidence, host_rate, path_rate, posterior, kept) for each row of docs: those of its columns that are asked for (all) as a
    struct, log odds, rates without the row itself, probability, verdict.

    Null and empty texts are judged by their lengths and characters as any other; null hosts and paths form their own site; repeated
    rows count as often as they stand there; no documents, no rows. Columns of docs can have any names. Texts are read once.
    """
    spark = docs.sparkSession
    host = F.col("source").cast("string") if host is None else host
    path = F.col("lang").cast("string") if path is None else path
    kept_columns = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)))
    each = stored(docs.select(kept_columns.alias("row"), host.alias("host"), path.alias("path"), evidence_column(spark, train(docs, labels)).alias("evidence"), F.xxhash64("text").alias("hash")))
    each = each.withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))
    known, rate, of_host, of_path = sites(each.select("host", "path", "p"))
    right = known.withColumnsRenamed({"host": "h", "path": "q"})
    same = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q"))
    if known.count() <= BROADCAST_SITES:
        judged = each.join(F.broadcast(right), same)
    else:
        each = each.withColumn("salt", F.pmod("hash", F.lit(SALTS)))
        right = right.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        judged = each.join(right, same & (F.col("salt") == F.col("s")))
    judged = judged.withColumn("host_rate", (F.col("host_good") - F.col("p") + of_host * rate) / (F.col("host_n") - 1 + of_host))
    judged = judged.withColumn("path_rate", (F.col("good") - F.col("p") + of_path * F.col("host_rate")) / (F.col("n") - 1 + of_path))
    odds = F.col("evidence") - math.log(rate / (1 - rate)) + F.log(F.col("path_rate") / (1 - F.col("path_rate")))
    judged = judged.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return judged.select("row", "evidence", "host_rate", "path_rate", "posterior", (F.col("posterior") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs without those that are likelier bad than good; all columns stay."""
    return judge(docs, labels, **how).where("kept").select("row.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases: see judge. Texts are read whole, however long; a task holds one at a time beside its batch. Other columns aren't read."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "source", "lang")
    return judge(docs, table(spark, sf_dir, "labels"), columns=["doc_id"]).select("row.doc_id", "evidence", "host_rate", "path_rate", "posterior", "kept")
