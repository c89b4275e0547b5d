"""11. Hard negatives by a secondary sort.

Rows and anchors meet in blocks. A block passes on, for each anchor, only what can be in its result: first the best rows of its label, of
which the first over all blocks are its positives; then, with their scores known, the best rows of other labels in each positive's window.
These go as packed keys (anchor, descending score, positives first, id) through repartitionAndSortWithinPartitions; an iterator reads the
sorted keys, opens a window at each positive, and gives out negatives as they come by. It holds an anchor's open windows, never its rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectors
from .common import stored, table
from .vectors import Block

POSITIVES, NEGATIVES, SCALE = 5, 10, 256
#: A negative's score is between these hundredths of the positive's.
LEAST, MOST = 30, 90
#: Products below this can be multiplied by 100 as longs.
SMALL = 1 << 53
KEY = struct.Struct(">QQBQ")
SIGN, LAST = 1 << 63, (1 << 64) - 1


def first_of(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k of the rows with the highest scores, ties by id, in this order."""
    if len(rows) > 4 * k and scores.dtype != object:
        part = scores[rows]
        rows = rows[part >= np.partition(part, len(part) - k)[len(part) - k]]  # all that tie with the k-th
    return rows[np.lexsort((ids[rows], -scores[rows]))[:k]]


def joined(found: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3


def positives_of(block: Block, batch: Block, k: int) -> list[np.ndarray]:
    """(anchor_id, id, score) of the k best rows of each anchor's label, itself, by vec_id, excepted."""
    scores = vectors.products(block.ints, batch.ints, SMALL)
    by_label = {label: np.flatnonzero(block.labels == label) for label in set(batch.labels.tolist())}
    found = []
    for j, anchor in enumerate(batch.ids):
        rows = by_label[int(batch.labels[j])]
        rows = first_of(rows[block.ids[rows] != anchor], scores[:, j], block.ids, k)
        found.append((np.full(len(rows), anchor), block.ids[rows], vectors.longs(scores[rows, j])))
    return joined(found)


def negatives_of(block: Block, batch: Block, k: int) -> list[np.ndarray]:
    """(anchor_id, id, score) of rows of other labels: for each of the anchor's positive scores, in its column tops, the k best ones in
    that window. A row is given once."""
    scores = vectors.products(block.ints, batch.ints, SMALL)
    found = []
    for j, anchor in enumerate(batch.ids):
        column = scores[:, j]
        others, hundredfold = np.flatnonzero(block.labels != batch.labels[j]), column * 100
        taken: set[int] = set()
        for positive in {int(x) for x in batch.tops[j] if x >= 0}:  # below zero a window is empty; absent ones are -1
            inside = others[(hundredfold[others] >= LEAST * positive) & (hundredfold[others] <= MOST * positive)]
            taken.update(first_of(inside, column, block.ids, k).tolist())
        rows = np.array(sorted(taken), dtype=np.int64)
        found.append((np.full(len(rows), anchor), block.ids[rows], vectors.longs(column[rows])))
    return joined(found)


def packed_key(anchor: int, score: int, kind: int, row_id: int) -> bytes:
    """Bytes in the order of anchor, then descending score, kind 0 (positives) before 1, then id."""
    return KEY.pack(anchor + SIGN, LAST - (score + SIGN), kind, row_id + SIGN)


def windows(keys: Iterator[tuple[bytes, None]], positives: int, negatives: int) -> Iterator[tuple]:
    """Rows (anchor, positive, rank, negative, positive score, negative score) from sorted keys."""
    now, seen, open_windows = None, 0, []
    for key, _ in keys:
        anchor, score, kind, row_id = KEY.unpack(key)
        anchor, score, row_id = anchor - SIGN, LAST - score - SIGN, row_id - SIGN
        if anchor != now:
            now, seen, open_windows = anchor, 0, []
        if kind == 0:
            if seen < positives:
                seen += 1
                open_windows.append([row_id, score, 0])
            continue
        still = []
        for w in open_windows:
            if 100 * score < LEAST * w[1]:
                continue  # scores only fall from here: the window is closed
            if 100 * score <= MOST * w[1]:
                w[2] += 1
                yield anchor, w[0], w[2], row_id, w[1], score
            if w[2] < negatives:
                still.append(w)
        open_windows = still


def mined(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows and anchors(vec_id, label, ints), distinct in
    vec_id. Positives: the first rows of the anchor's label; negatives: the first of other labels in each one's window; both by descending
    inner product, ties by ascending id. An anchor without a positive has no rows, nor has a positive with an empty window."""
    spark = rows.sparkSession
    blocks = vectors.store_packed(rows, vectors.BLOCK_ROWS)
    schema = "anchor long, id long, score long"
    best = vectors.over_cells(blocks, vectors.store_packed(anchors, vectors.BATCH_ROWS), schema, lambda block, batch: positives_of(block, batch, positives))
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    best = stored(best.withColumn("rank", rank).where(F.col("rank") <= positives).select("anchor", "id", "score"))
    tops = best.groupBy("anchor").agg(F.collect_list("score").alias("tops"))  # so many as positives at most
    # batches differ in how many scores a row has: shorter lists end in -1, whose window is empty
    filled = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("tops", i), F.lit(-1)))
    facing = anchors.join(tops.select(F.col("anchor").alias("vec_id"), "tops"), "vec_id").withColumn("tops", filled)
    near = vectors.over_cells(blocks, vectors.store_packed(facing, vectors.BATCH_ROWS), schema, lambda block, batch: negatives_of(block, batch, negatives))
    pairs = best.select("anchor", "score", F.lit(0).alias("kind"), "id").unionByName(near.select("anchor", "score", F.lit(1).alias("kind"), "id"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = pairs.rdd.map(lambda r: (packed_key(*r), None))
    ordered = keys.repartitionAndSortWithinPartitions(tasks, lambda key: int.from_bytes(key[:8], "big") * 0x9E3779B97F4A7C15 >> 17)
    found = ordered.mapPartitions(lambda part: windows(part, positives, negatives))
    return spark.createDataFrame(found, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long", verifySchema=False)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: vec_id divisible by 100. Rows without vec_id or label, and vectors null or with null or non-finite components, take no
    part; of several rows of one vec_id the one with the greatest (vector, label) does. Vectors of unlike lengths: missing components are
    zero; empty ones score zero. Scores beyond a long are put at its ends. An empty table gives no rows; other columns aren't read."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), "label", "embedding").where("label IS NOT NULL")
    rows = stored(vectors.once(rows.select("vec_id", label.cast("int").alias("label"), vectors.whole("embedding", SCALE).alias("ints")), ["ints", "label"]))
    return mined(rows, rows.where("vec_id % 100 = 0"))
