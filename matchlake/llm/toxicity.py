"""8. Toxicity by compression distance.

Two zstandard dictionaries are trained on a bounded sample of labelled texts: both hold the words that the sample's texts share, and
each the words and stems (beginnings of words) that its own class has far more often. A text is cut into windows of a few words, and
each window is compressed with either dictionary; how many bytes the toxic one saves is its distance. Of stems with common endings the
ordinary dictionary has parts too, so a stem saves a byte or two only, and once in a window: how many words begin with toxic units is
counted besides. Compression distances alone find too few here, and the counts do most of the work: see README for figures. A logistic
curve over the text's distances and counts gives the score, so that 0.5 is the calibrated threshold. It is fitted on each third of the
sample as dictionaries trained on the other two thirds see it; the final dictionaries see the whole sample.

zstandard's own trainer picks what texts of a class have in common, which is their language: trained by it on all windows of each
class, the two dictionaries told 4 to 6 % of the held-out toxic texts at sf0.1 (1 % of the others rejected), and 24 to 59 % when it
chose among the words with toxic units only.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, labelled, map_texts, parts_of, table

#: Labelled texts of each class that may be used, and of each the parts and their characters: all of texts up to 32,000 characters.
#: The only sample; scores read whole texts.
PER_CLASS, PARTS, CHARS = 2000, 16, 2000
#: Parts of the sample for the curve, each seen by dictionaries of the others.
THIRDS = 3
#: Bytes of a dictionary, words of a window.
DICTIONARY, WINDOW = 16_384, 20
#: A word or stem is telling if its share of texts differs by so many standard errors, and fewer than CHANCE of all of them would split
#: as far by chance. No share of the class is asked for, so that the few texts of a rare language tell too.
TELLING, CHANCE = 5.0, 0.01
#: Bytes of a stem. Texts whose word sets have this Jaccard similarity to one earlier text are copies of it.
STEM, COPY = (4, 10), 0.8
BLANKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(BLANKS).split()


def firsts(texts: list[list[bytes]]) -> list[int]:
    """Which texts have words and don't copy one earlier text: exact, by an index of each word set's rarest words, of which two sets
    that are alike to COPY share one."""
    sets = [set(w) for w in texts]
    often = Counter(w for t in sets for w in t)
    index: dict[bytes, list[int]] = defaultdict(list)
    out: list[int] = []
    for at, words in enumerate(sets):
        rare = sorted(words, key=lambda w: (often[w], w))[: len(words) - math.ceil(COPY * len(words)) + 1]
        near = {i for w in rare for i in index[w]}
        if not words or any(len(words & sets[i]) >= COPY * len(words | sets[i]) for i in near if COPY * len(words) <= len(sets[i]) <= len(words) / COPY):
            continue
        for w in rare:
            index[w].append(at)
        out.append(at)
    return out


def distinct(texts: list[list[bytes]]) -> list[set[bytes]]:
    """The word sets of the firsts."""
    return [set(texts[i]) for i in firsts(texts)]


def units(words: set[bytes]) -> set[bytes]:
    """Whole words, which end in a blank, and stems of longer ones."""
    return {w + b" " for w in words} | {w[:n] for w in words for n in range(STEM[0], min(STEM[1] + 1, len(w)))}


class Sample:
    """Of texts, those that copy no other of their class, with their units as numbers."""

    def __init__(self, texts: list[list[bytes]], toxic: np.ndarray):
        classes = [np.flatnonzero(toxic == side) for side in (True, False)]
        self.at = np.concatenate([c[firsts([texts[i] for i in c])] for c in classes])
        self.toxic = toxic[self.at]
        number: dict[bytes, int] = {}
        self.rows = [np.fromiter((number.setdefault(u, len(number)) for u in units(set(texts[i]))), np.int64) for i in self.at]
        self.names = list(number)

    def often(self, rows: np.ndarray) -> np.ndarray:
        """How many of the texts have each unit."""
        chosen = [self.rows[i] for i in rows]
        return np.bincount(np.concatenate(chosen), minlength=len(self.names)) if chosen else np.zeros(len(self.names), np.int64)


def telling(sample: Sample, rows: np.ndarray) -> tuple[dict[bytes, float], list[tuple[int, bytes]]]:
    """Of the words and stems that tell toxic texts (of those rows) from others, the standard errors (negative: ordinary), and the units
    that three texts have, with their number. Of units that begin one another, the one that tells most; of equal ones the longest."""
    toxic = sample.toxic[rows]
    na, nb = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    in_a, in_b = sample.often(rows[toxic]), sample.often(rows[~toxic])
    some = np.flatnonzero(in_a + in_b >= 3)
    x, y = in_a[some].astype(float), in_b[some].astype(float)
    n, q = x + y, na / (na + nb)
    p = n / (na + nb)
    z = (x / na - y / nb) / np.maximum(1e-9, np.sqrt(p * (1 - p) * (1 / na + 1 / nb)))
    # Chernoff's bound on the chance that so many of n texts are of one class
    far = sum(k * np.log(np.maximum(k, 1e-9) / n / e) for k, e in ((x, q), (y, 1 - q)))
    tells = (np.abs(z) > TELLING) & (far > math.log(max(1, len(some)) / CHANCE))
    out = {sample.names[i]: float(v) for i, v in zip(some[tells], z[tells], strict=True)}
    best: set[bytes] = set()
    for u in sorted(out, key=lambda u: (-abs(out[u]), -len(u), u)):
        if not any(u.startswith(v) or v.startswith(u) for v in best):
            best.add(u)
    return {u: out[u] for u in best}, [(int(k), sample.names[i]) for i, k in zip(some, n, strict=True)]


def dictionaries(sample: Sample, rows: np.ndarray) -> tuple[bytes, bytes, frozenset[bytes]]:
    """Contents of the toxic and the ordinary dictionary, and the toxic units, as those rows of the sample have them: the class's own
    words and stems, then the shared words, the commonest last. What they share lies at the same distance from a window in both, so a
    window without own words is compressed alike."""
    own, often = telling(sample, rows)
    stems = [u for u in own if not u.endswith(b" ")]
    shared = sorted((n, u) for n, u in often if u.endswith(b" ") and u not in own and not any(s in u for s in stems))
    own_text = [b"".join(u.rstrip() + b" " for _, u in sorted((abs(z), u) for u, z in own.items() if z * side > 0))[-DICTIONARY // 2 :] for side in (1, -1)]
    body = b"".join(u for _, u in shared)[-(DICTIONARY - max(map(len, own_text))) :]
    return own_text[0] + body, own_text[1] + body, frozenset(u for u, z in own.items() if z > 0)


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    units: frozenset[bytes]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


@lru_cache(maxsize=4)
def compressors(toxic: bytes, ordinary: bytes):
    """The compress methods of both dictionaries; made once in each worker. The hash tables are wide, so that no part of a dictionary
    hides another."""
    how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=17, chain_log=17, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    return tuple(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress for d in (toxic, ordinary))


def distances(words: list[bytes], toxic: bytes, ordinary: bytes) -> list[float]:
    """Of the bytes that the toxic dictionary saves in each window: sum over the root of their number, mean, mean of the three largest."""
    by_toxic, by_ordinary = compressors(toxic, ordinary)
    saved = []
    for i in range(0, len(words), WINDOW):
        x = b" " + b" ".join(words[i : i + WINDOW]) + b" "
        saved.append(len(by_ordinary(x)) - len(by_toxic(x)))
    if not saved:
        return [0.0, 0.0, 0.0]
    most = sorted(saved)[-3:]
    return [sum(saved) / len(saved) ** 0.5, sum(saved) / len(saved), sum(most) / 3]


@lru_cache(maxsize=4)
def heads(units: frozenset[bytes]) -> frozenset[bytes]:
    """The first bytes of the units' words: most words have none of them and need no closer look."""
    return frozenset(u.rstrip()[: STEM[0]] for u in units)


def features(words: list[bytes], toxic: bytes, ordinary: bytes, units: frozenset[bytes]) -> list[float]:
    """The distances, and how many words are or begin with toxic units: the logarithm, and over the root of the number of words."""
    known, ends = heads(units), range(STEM[0], STEM[1] + 1)
    n = sum(w + b" " in units or any(w[:e] in units for e in ends if e < len(w)) for w in words if w[: STEM[0]] in known)
    return [*distances(words, toxic, ordinary), math.log1p(n), n / max(1, len(words)) ** 0.5]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of x and, last, the intercept: Newton's method, with a small ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[int, list[bytes], int]], share: float) -> Model:
    """The model of (doc_id, words, label) rows; share: of toxic texts among the labels. Without rows, all texts score 0.5 - just below,
    so nothing is rejected."""
    texts, y = [w for _, w, _ in rows], np.array([x for *_, x in rows], float)

    sample = Sample(texts, y == 1)
    every = np.arange(len(sample.at))
    learned = dictionaries(sample, every)
    if not len(every):
        return Model(*learned, (0.0,) * 5, (1.0,) * 5, (0.0,) * 5 + (-1e-6,))
    x, y = np.zeros((len(every), 5)), y[sample.at]
    part = np.array([zlib.crc32(b"%d" % rows[i][0]) % THIRDS for i in sample.at])
    for k in range(THIRDS):  # as dictionaries see texts that they weren't trained on
        others = dictionaries(sample, every[part != k])
        for i in np.flatnonzero(part == k):
            x[i] = features(texts[sample.at[i]], *others)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    w = fit_logistic((x - centre) / scale, y)
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    share = min(max(share, 1e-3), 1 - 1e-3)
    w[-1] += np.log(share / (1 - share)) - np.log(p / (1 - p))  # the sample has more toxic texts than the labels have
    return Model(*learned, tuple(centre), tuple(scale), tuple(w))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int | None = 0, per_class: int = PER_CLASS) -> Model:
    """Learn from labelled rows outside the held-out fold. One task fits the model to the sample, so that the driver holds no texts."""
    some = labelled(docs, labels, "toxic", folds, held_out, per_class)
    some = some.groupBy("doc_id", "label").agg(F.min(parts_of(F.coalesce("text", F.lit("")), F.col("doc_id"), PARTS, CHARS)).alias("text"))
    known = labels.where("toxic in (0, 1)")
    if held_out is not None:
        known = known.where(fold("doc_id", folds) != held_out)
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(i, words_of(t), y) for batch in batches for i, t, y in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sorted(rows), share))], pa.binary())], ["model"])

    # 2 * per_class rows of PARTS * CHARS characters at most
    learned = some.select("doc_id", "text", "label").coalesce(1).mapInArrow(fitted, "model binary").first()
    return pickle.loads(learned.model) if learned else fit([], 0.5)


def score(model: Model, text: str | None) -> float:
    x = (np.array(features(words_of(text or ""), model.toxic, model.ordinary, model.units)) - model.centre) / model.scale
    return float(1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30))))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs(doc_id, text), whole texts; null and empty texts score as texts without windows."""
    at = docs.sparkSession.sparkContext.broadcast(model)

    def rows(ids, texts) -> Iterator[tuple]:
        for i, t in zip(ids, texts, strict=True):
            yield i, score(at.value, t)

    return map_texts(docs, ["doc_id", "text"], "doc_id long, score double", rows)


def score_column(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """The score as a column, for filters that keep all other columns."""
    at = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([score(at.value, t) for t in texts], dtype="float64")

    return of(F.col(text))


def keep_ordinary(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those that score at least threshold; all columns stay."""
    return docs.where(score_column(docs.sparkSession, train(docs, labels)) < threshold)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases: see scores and train. Texts are scored whole, however long, window by window; copies and ties score alike."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    got = scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
