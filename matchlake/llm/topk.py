"""12. Exact top-k search by inner product, over a bit-sliced index.

A block's vectors are kept as bit slices: bitmap (d, b) has a bit for each row, set where bit b of component d is set; components count
from the block's least, and the DROP lowest bits of long ones have no slice. A query adds the slices of each component once for every set
bit of its own coefficient there (complements, where the coefficient is negative) with carry-save adders of bitmap words, so sums of all
rows come out as slices again. From the most significant slice downward the k-th greatest sum is found by counting bits. What the dropped
bits can add or take is known; rows within that of the k-th, the boundary, get their exact products, and order and ties are decided there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectors
from .common import stored, table
from .vectors import Block

TOP, SCALE = 10, 1024
#: Bits without a slice, of components that take more than KEPT.
DROP, KEPT = 3, 7
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def slices_of(ints: np.ndarray) -> tuple[np.ndarray, int]:
    """(bitmaps by component and bit, dropped bits) of rows of integers; the bitmaps' words hold 64 rows each, the lowest bit first."""
    up = ints.astype(np.int64) - ints.min(axis=0).astype(np.int64)
    up = up.view(np.uint64)  # a difference of longs can pass a long's greatest
    bits = max(1, int(up.max(initial=0)).bit_length())
    drop = min(DROP, max(0, bits - KEPT))
    n, d = ints.shape
    out = np.zeros((d, bits - drop, -(-n // 64) * 8), np.uint8)
    for b in range(bits - drop):
        out[:, b, : -(-n // 8)] = np.packbits((up >> np.uint64(b + drop)).astype(np.uint8) & 1, axis=0, bitorder="little").T
    return out.view("<u8"), drop


def added(levels: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Slices of the rows' sums, lowest first; levels: stacks of bitmaps by the power of two that they count."""
    zero = np.zeros((1, next(iter(levels.values())).shape[1]), np.uint64)
    out, carried, at = [], [], 0
    while at <= max(levels) or carried:
        stack = np.concatenate([levels.get(at, zero[:0]), *carried])
        stack, carried = stack if len(stack) else zero, []
        while len(stack) > 1:
            third = max(1, len(stack) // 3)
            a, b = stack[:third], stack[third : 2 * third]
            if len(stack) == 2:
                carried.append(a & b)
                stack = a ^ b
                continue
            c = stack[2 * third : 3 * third]
            x = a ^ b
            carried.append((a & b) | (x & c))
            stack = np.concatenate([x ^ c, stack[3 * third :]])
        out.append(stack[0])
        at += 1
    return out


def size(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def kth(sums: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th greatest sum of the rows, of which there are k at least."""
    sure, maybe, value = np.zeros_like(rows), rows, 0
    for i in range(len(sums) - 1, -1, -1):
        more = sure | (maybe & sums[i])
        if size(more) >= k:
            maybe, value = maybe & sums[i], value | 1 << i
        else:
            sure, maybe = more, maybe & ~sums[i]
    return value


def at_least(sums: list[np.ndarray], rows: np.ndarray, value: int) -> np.ndarray:
    """The rows whose sum is value or more."""
    above, same = np.zeros_like(rows), rows
    for i in range(len(sums) - 1, -1, -1):
        if value >> i & 1:
            same = same & sums[i]
        else:
            above, same = above | (same & sums[i]), same & ~sums[i]
    return above | same


def boundary(slices: np.ndarray, drop: int, query: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """A bitmap of the rows that may be among the k greatest products with the query; it holds all that are."""
    if size(rows) <= k:
        return rows
    d = min(len(query), len(slices))
    sizes = [abs(int(q)) for q in query[:d]]
    signed = np.where((np.asarray(query[:d]) < 0)[:, None, None], ~slices[:d], slices[:d])
    loss = sum(sizes) * ((1 << drop) - 1)
    stacks: dict[int, list] = {}
    for p in range(max(sizes, default=0).bit_length()):
        chosen = [i for i, q in enumerate(sizes) if q >> p & 1]
        for b in range(signed.shape[1]):
            stacks.setdefault(p + b, []).append(signed[chosen, b])
    if not stacks:
        return rows  # the query is zero: all rows tie
    sums = added({w: np.concatenate(s) for w, s in stacks.items()})
    least = kth(sums, rows, k) - (loss >> drop)
    return at_least(sums, rows, least) if least > 0 else rows


def best_of(block: Block, batch: Block, slices: np.ndarray, drop: int, k: int) -> list[np.ndarray]:
    """(query_id, vec_id, score) of each query's k best rows of the block; its own, by vec_id, isn't one."""
    n = len(block.ids)
    every = np.full(slices.shape[2], ONES)
    if n % 64:
        every[-1] = np.uint64((1 << n % 64) - 1)
    order = np.argsort(block.ids)
    out: list[tuple] = []
    for query_id, query in zip(batch.ids, batch.ints, strict=True):
        rows, own = every, np.searchsorted(block.ids, query_id, sorter=order)
        if own < n and block.ids[order[own]] == query_id:
            rows = every.copy()
            rows[order[own] // 64] &= ~(np.uint64(1) << np.uint64(order[own] % 64))
        found = np.flatnonzero(np.unpackbits(boundary(slices, drop, query, rows, k).view(np.uint8), bitorder="little"))
        scores = vectors.longs(vectors.products(block.ints[found], query[None])[:, 0])
        first = np.lexsort((block.ids[found], -scores.astype(object) if scores.min(initial=0) == np.iinfo(np.int64).min else -scores))[:k]
        out.append((np.full(len(first), query_id), block.ids[found][first], scores[first]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def index(rows: DataFrame) -> DataFrame:
    """The bit-sliced index of rows(vec_id, ints): a stored table, one row for each block, with slices and exact components."""
    import pyarrow as pa

    def sliced(batches):
        for r in batches:
            made = [slices_of(np.frombuffer(b.as_py(), k.as_py()).reshape(n.as_py(), d.as_py())) for b, k, n, d in zip(r.column("ints"), r.column("kind"), r.column("rows"), r.column("dims"), strict=True)]
            yield r.append_column("slices", pa.array([x.tobytes() for x, _ in made], pa.binary())).append_column("dropped", pa.array([x for _, x in made], pa.int32())).append_column("words", pa.array([x.shape[2] for x, _ in made], pa.int32()))

    return stored(vectors.packed(rows, vectors.BLOCK_ROWS).mapInArrow(sliced, f"{vectors.PACKED}, slices binary, dropped int, words int"))


def search(blocks: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the top rows of an index for each of queries(vec_id, ints), by descending inner product, ties by
    ascending vec_id. Row and query share a vec_id: not a result. Each block keeps its best alone, and ranks are given over those."""

    def prepare(block: Block, has: dict) -> None:
        block.slices = np.frombuffer(has["slices"], np.uint64).reshape(block.ints.shape[1], -1, has["words"]) if block.ints.shape[1] else np.zeros((0, 1, has["words"]), np.uint64)
        block.drop = has["dropped"]

    batches = vectors.store_packed(queries, vectors.BATCH_ROWS)
    best = vectors.over_cells(blocks, batches, "query_id long, vec_id long, score long", lambda block, batch: best_of(block, batch, block.slices, block.drop, top), prepare, ("slices", "dropped", "words"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: vec_id divisible by 100. Rows without vec_id, and vectors null or with null or non-finite components, take no part; of
    several rows of one vec_id the greatest vector does. Vectors of unlike lengths: missing components are zero; empty ones score zero.
    Scores beyond a long are put at its ends. An empty table gives no rows; other columns aren't read."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), vectors.whole("embedding", SCALE).alias("ints"))
    rows = stored(vectors.once(rows, ["ints"]))
    return search(index(rows), rows.where("vec_id % 100 = 0"))
