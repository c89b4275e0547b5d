"""2. Quality rules judged by an isolation forest.

Each document's rule statistics become a row of rates. Trees of random splits, each grown on its own small hash sample of all documents
that pass the base rules, as the method asks for, isolate odd rows after few splits; the mean path length over the trees gives a score between 0 and 1. The scores' histogram by label,
summed over all labelled documents, calibrates the threshold above which a document is rejected.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, stored, table

TREES, SAMPLE, SEED = 100, 256, 7
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20
#: Of the labelled good documents that pass the base rules, the share that the forest may reject at most.
MAX_GOOD_LOST = 0.01
BINS = 1000
SYMBOLS = b"#*$%&|<>"
BLANK = bytes(range(9, 14)) + b" "
STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in five-word windows found at least twice in words; the first one counts too."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    total = end = 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            total += 5 - max(0, end - i)
            end = i + 5
    return total


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; a null text has none of them."""
    data = (text or "").encode()
    words = data.split()  # at blank and \t to \r
    chars = len(text or "") - (len(data) - len(data.translate(None, BLANK)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(BLANK)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def rates(n_words: np.ndarray, word_chars: np.ndarray, n_symbols: np.ndarray, n_dup_lines: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    """What the forest sees of each document: mean word length and the share of symbols. Repetition is left to the base rule, whose
    figures vary widely among good documents as well, and length by itself is no fault."""
    return np.column_stack([word_chars / np.maximum(n_words, 1), n_symbols / np.maximum(word_chars, 1)])


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at leaves), cut, left and right child, path length at leaves."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    length: np.ndarray
    normal: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), 0.5)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, child, length in zip(self.feature, self.cut, self.child, self.length, strict=True):
            at = np.zeros(len(x), np.int64)
            while (f := feature[at]).max() >= 0:
                at = np.where(f >= 0, child[at, (x[rows, f] >= cut[at]).astype(np.int64)], at)
            total += length[at]
        return 2.0 ** (-total / len(self.feature) / self.normal)


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """A forest on samples of the rows x."""
    r = np.random.default_rng(seed)
    return grow_each([x[r.choice(len(x), min(sample, len(x)), replace=False)] for _ in range(trees if len(x) else 0)], sample, seed + 1)


def grow_each(samples: list[np.ndarray], sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """A forest with a tree on each of samples."""
    r, grown = np.random.default_rng(seed), []
    deepest = math.ceil(math.log2(max(2, sample)))
    for x in samples:
        nodes: list[list] = []

        def node(rows: np.ndarray, depth: int, nodes=nodes) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, [0, 0], depth + mean_path(len(rows))])
            low, high = rows.min(0), rows.max(0)
            open_ = np.flatnonzero(high > low)
            if depth < deepest and len(rows) > 1 and len(open_):
                f = int(r.choice(open_))
                cut = r.uniform(low[f], high[f])
                right = rows[:, f] >= cut
                if right.any() and not right.all():
                    nodes[at][:2] = f, cut
                    nodes[at][2] = [node(rows[~right], depth + 1), node(rows[right], depth + 1)]
            return at

        node(x, 0)
        grown.append(nodes)
    most = max(map(len, grown), default=0)
    pad = [[*t, *[[-1, 0.0, [0, 0], 0.0]] * (most - len(t))] for t in grown]
    cols = [np.array([[n[i] for n in t] for t in pad]) for i in range(4)] if pad else [np.zeros((0, 0))] * 4
    return Forest(cols[0].astype(np.int64), cols[1], cols[2].astype(np.int64), cols[3], mean_path(min(sample, max(map(len, samples), default=0))) or 1.0)


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics, base_failed) for each row of docs(doc_id, text)."""

    def rows(ids, texts) -> Iterator[tuple]:
        for i, t in zip(ids, texts, strict=True):
            yield i, *statistics(t)

    got = map_texts(docs, ["doc_id", "text"], f"doc_id long, {STATISTICS}", rows)
    return got.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """stats with the forest's score."""
    at = stats.sparkSession.sparkContext.broadcast(forest)
    names = [f.split()[0] for f in STATISTICS.split(", ")]

    @F.pandas_udf("double")
    def of(a, b, c, d, e):
        import pandas as pd

        return pd.Series(at.value.score(rates(*(x.to_numpy(np.float64) for x in (a, b, c, d, e)))))

    return stats.withColumn("score", of(*names))


def fit(stats: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> Forest:
    """A forest whose trees each grow on `sample` of the distinct rows that pass the base rules, those with the least hash of tree and
    row. A bound on the hash, which leaves some more than that of all rows, keeps the others from travelling."""
    names = [f.split()[0] for f in STATISTICS.split(", ")]
    passed = stored(stats.where(~F.col("base_failed")).select("doc_id", *names).distinct())
    share = (sample + 10 * sample**0.5) / max(1, passed.count())
    least = int(-(2**63) + min(share, 1) * (2**64 - 1))
    drawn = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda k: F.struct(k.alias("tree"), F.xxhash64(k, "doc_id", *names).alias("mark"))), lambda d: d["mark"] <= least)
    rows = passed.select(*names, F.explode(drawn).alias("d")).select("d.*", *names).toPandas()  # trees * (sample + 10 * sample**0.5) on average
    rows = rows.sort_values(["tree", "mark", *names])
    return grow_each([rates(*(x[n].to_numpy(np.float64)[:sample] for n in names)) for _, x in rows.groupby("tree")], sample)


def calibrate(judged: DataFrame, labels: DataFrame, max_good_lost: float = MAX_GOOD_LOST) -> float:
    """The score from which on documents are rejected: of the cuts that lose max_good_lost of the good ones at most, the one with the
    largest lead of bad over good rejected. All labelled rows count, as a histogram. Without labels of both kinds: above 1."""
    y = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    bins = judged.where(~F.col("base_failed")).join(y, "doc_id").groupBy(F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"), "quality").count().collect()
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for r in bins:
        (good if r.quality else bad)[r.bin] += r["count"]
    if not good.sum() or not bad.sum():
        return 2.0
    lost, caught = (np.cumsum(v[::-1])[::-1] / v.sum() for v in (good, bad))
    lead = np.where(lost <= max_good_lost, caught - lost, -1)
    best = int(lead.argmax())
    return best / BINS if lead[best] > 0 else 2.0


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, statistics, base_failed, score, kept) for each row of docs(doc_id, text).

    Null and empty texts have no words and fail the base rules; repeated rows get equal verdicts; no documents, no rows. The statistics
    are stored once, then read for the sample, the calibration and the result.
    """
    stats = stored(with_statistics(docs))
    judged = scored(stats, fit(stats))
    threshold = calibrate(judged, labels)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") < threshold))


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases: see judge. Texts are read whole, however long; all counts of a text are made in one task, which holds its words."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return judge(docs, table(spark, sf_dir, "labels"))
