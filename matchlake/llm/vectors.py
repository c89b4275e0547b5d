"""Blocks of integer vectors and cells of blocks against batches of queries: what the operators over `embeddings` share.

Vectors are dealt by vec_id and packed, some thousand at a time, into one row of bytes each. Blocks and batches of queries meet in cells:
a block has a group g and stands in every h, a batch has a group h and stands in every g, and they are joined on (g, h). So each block
meets each batch once, in an equi-join whose keys all hold about as many rows, and neither side passes through the driver or one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BLOCK_ROWS, BATCH_ROWS = 16_384, 128
#: So many blocks and so many batches share a cell, about.
BLOCKS_A_CELL, BATCHES_A_CELL = 4, 4
PACKED = "block long, rows int, dims int, kind string, ids binary, labels binary, ints binary, tops binary, dims_of_tops int"


def whole(vector: str, scale: int) -> Column:
    """The vector with each component as floor(scale * x), x as double; null if it, or a component, is null or not finite."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(v, lambda x: F.floor(x * scale).cast("long")))


def once(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each vec_id, which has the greatest of its columns (as a struct, in this order) where it stands on several rows; rows
    without vec_id or vector are left out. Copies go before the shuffle, so a vec_id on very many rows is no hot key."""
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("ints").isNotNull())
    return kept.groupBy("vec_id").agg(F.max(F.struct(*columns)).alias("v")).select("vec_id", *(F.col("v")[c].alias(c) for c in columns))


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column as int64; shorter ones end in zeros."""
    sizes = np.asarray(pa.compute.list_value_length(lists).fill_null(0), dtype=np.int64)
    flat = np.asarray(lists.flatten(), dtype=np.int64)
    most = int(sizes.max(initial=0))
    if len(flat) == most * len(sizes):
        return flat.reshape(len(sizes), most)
    out = np.zeros((len(sizes), most), np.int64)
    out[np.arange(most) < sizes[:, None]] = flat
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """In the smallest of three integer types that holds all of x."""
    lo, hi = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= lo and hi <= np.iinfo(k).max))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of so many rows at most of rows(vec_id, ints, label?, tops?): see PACKED. tops: an array of longs for each row."""
    named = set(rows.columns)
    rows = rows.select("vec_id", "ints", (F.col("label") if "label" in named else F.lit(0)).cast("int").alias("label"), (F.col("tops") if "tops" in named else F.array().cast("array<long>")).alias("tops"))

    def block(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        ids, ints, tops = np.asarray(t["vec_id"], dtype=np.int64), matrix(t["ints"].chunk(0)), matrix(t["tops"].chunk(0))
        ints = narrow(ints)
        row = (number, len(ids), ints.shape[1], ints.dtype.str, ids.tobytes(), np.asarray(t["label"], dtype=np.int32).tobytes(), ints.tobytes(), tops.tobytes(), tops.shape[1])
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [f.split()[0] for f in PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == size:
                    yield block(number, held)
                    number, held, n = number + 1, [], 0
        if n:
            yield block(number, held)

    return rows.mapInArrow(run, PACKED)


class Block:
    """Arrays of a packed row."""

    def __init__(self, rows: int, dims: int, kind: str, ids: bytes, labels: bytes, ints: bytes, tops: bytes, dims_of_tops: int):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int32)
        self.ints = np.frombuffer(ints, kind).reshape(rows, dims)
        self.tops = np.frombuffer(tops, np.int64).reshape(rows, dims_of_tops)


def in_cells(blocks: DataFrame, batches: DataFrame, blocks_a_cell: int = BLOCKS_A_CELL, batches_a_cell: int = BATCHES_A_CELL) -> DataFrame:
    """Each row of blocks beside each row of batches, whose columns are named q_<column>. Both are stored tables with a column block;
    their row counts are known without reading them."""
    g, h = (max(1, -(-df.count() // size)) for df, size in ((blocks, blocks_a_cell), (batches, batches_a_cell)))
    left = blocks.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(g))).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("h", F.col("h").cast("long"))
    right = batches.select(*(F.col(c).alias(f"q_{c}") for c in batches.columns)).withColumn("h", F.pmod(F.xxhash64("q_block"), F.lit(h)))
    right = right.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(g - 1)))).withColumn("g", F.col("g").cast("long"))
    return left.repartition("g", "h").join(right, ["g", "h"])


def over_cells(blocks: DataFrame, batches: DataFrame, schema: str, made: Callable[[Block, Block], list[np.ndarray]], prepared: Callable[[Block, dict], None] | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """made(block, batch) in each cell gives the columns of schema, all of them longs. prepared gets each block with its extra columns."""
    columns = [f.split()[0] for f in PACKED.split(", ")][1:]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            at = {c: r.schema.get_field_index(c) for c in r.schema.names}
            for i in range(r.num_rows):
                value = lambda c: r.column(at[c])[i].as_py()  # noqa: B023, E731
                block, batch = (Block(*(value(p + c) for c in columns)) for p in ("", "q_"))
                if prepared:
                    prepared(block, {c: value(c) for c in extra})
                out = made(block, batch)
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)

    cells = in_cells(blocks, batches)
    return cells.select(*columns, *extra, *(f"q_{c}" for c in columns)).mapInArrow(run, schema)


def products(ints: np.ndarray, vectors: np.ndarray, exact_to: int = 1 << 53) -> np.ndarray:
    """Inner products (rows by vectors): by doubles where none of their sums can pass exact_to, else by Python's integers."""
    d = min(ints.shape[1], vectors.shape[1])
    a, b = ints[:, :d], vectors[:, :d]
    most = [max(-int(x.min(initial=0)), int(x.max(initial=0))) for x in (a, b)]
    if most[0] * most[1] * d < exact_to:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T


def longs(x: np.ndarray) -> np.ndarray:
    """As longs; what is beyond them, at their ends."""
    return np.clip(x, -(1 << 63), (1 << 63) - 1).astype(np.int64) if x.dtype == object else x


def store_packed(rows: DataFrame, size: int) -> DataFrame:
    return stored(packed(rows, size))
