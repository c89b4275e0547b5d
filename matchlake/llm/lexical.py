"""13. Ranked lexical search by Block-Max MaxScore.

Documents are dealt into shards. A shard's inverted lists, one row for each term, are in blocks of 128 postings, each compressed by itself;
a block keeps its pairs of occurrences and document length that no other pair of it dominates, from which its greatest impact is known,
exactly, without decompression, once the corpus's figures are. A query in a shard sorts its lists by their greatest scores. Lists whose
greatest scores together can't reach the k-th best score so far aren't essential: documents found in them alone can't enter. The essential
ones are read, a range of documents at a time; from the others, block maxima reject what can't enter any more, and only blocks with
documents left are decompressed. Each shard passes on its k best of each query, and those are merged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectors
from .common import ROWS_AT_ONCE, stored, table

TOP, BLOCK = 20, 128
#: A shard ends with the document that brings it to so many postings.
SHARD_POSTINGS = 3_000_000
#: So many documents of a shard are ranked at a time; so many queries are in a batch.
RANGE, QUERIES_A_BATCH = 4_096, 256
#: Up to so many distinct terms of the queries are broadcast (some 20 MB); more are joined by shuffles.
BROADCAST_TERMS = 200_000
#: Bytes as terms have them: A-Z in lower case, and a space for each of the ASCII bytes that are in no term.
_BETWEEN = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
LETTERS = bytes(0x20 if b in _BETWEEN else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
INDEX = "shard long, term binary, df long, first array<int>, last array<int>, start array<int>, widths array<int>, front_size array<int>, front_tf array<int>, front_n array<int>, body binary, ids array<long>, lengths array<int>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def spread(values: np.ndarray, widths: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Writes values as little-endian integers of so many bytes each to out, at these places."""
    for j in range(4):
        wide = widths > j
        if wide.any():
            out[at[wide] + j] = (values[wide] >> (8 * j)) & 255


def byte_width(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def fronts(block: np.ndarray, tf: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each block's pairs those that none of its others dominates with as many occurrences in no longer a document: (sizes, tf, n)."""
    order = np.lexsort((n, -tf, block))
    b, f, m = block[order], tf[order], n[order]
    low = m.astype(np.int64) - b.astype(np.int64) * (int(m.max(initial=0)) + 1)  # later blocks are lower throughout, so the minimum starts anew
    best = np.minimum.accumulate(low)
    kept = np.ones(len(b), bool)
    kept[1:] = low[1:] < best[:-1]
    return np.bincount(b[kept], minlength=int(b[-1]) + 1 if len(b) else 0), f[kept], m[kept]


class Shard:
    """Postings of some documents as they come in; rows() gives the shard's inverted lists and then its documents."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.term, self.tf, self.sizes, self.ids, self.lengths = [], [], [], [], []
        self.postings = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        terms = terms_of(text)
        if terms:
            counts, number = Counter(terms), self.vocabulary
            self.term.append(np.fromiter((number.setdefault(t, len(number)) for t in counts), np.int32, len(counts)))
            self.tf.append(np.fromiter(counts.values(), np.int32, len(counts)))
            self.ids.append(doc_id)
            self.lengths.append(len(terms))
            self.postings += len(counts)

    def rows(self, shard: int) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        ids, lengths = [self.ids[i] for i in order], np.array([self.lengths[i] for i in order], np.int64)
        sizes = [len(self.term[i]) for i in order]
        term, tf = (np.concatenate([x[i] for i in order]) for x in (self.term, self.tf))
        doc = np.repeat(np.arange(len(ids)), sizes)
        by_term = np.argsort(term, kind="stable")
        term, tf, doc = term[by_term], tf[by_term].astype(np.int64), doc[by_term]
        df = np.bincount(term, minlength=len(self.vocabulary))
        began = np.concatenate([[0], np.cumsum(df)])
        blocks = -(-df // BLOCK)
        first_block = np.concatenate([[0], np.cumsum(blocks)])
        in_list = np.arange(len(term)) - began[term]
        block = first_block[term] + in_list // BLOCK
        starts = np.flatnonzero(in_list % BLOCK == 0)
        ends = np.concatenate([starts[1:], [len(term)]]) - 1
        gap = np.diff(doc, prepend=0)
        gap[starts] = 0
        wide = [byte_width(np.maximum.reduceat(x, starts)) for x in (gap, tf)]
        count = ends - starts + 1
        bytes_of = count * (wide[0] + wide[1])
        at = np.concatenate([[0], np.cumsum(bytes_of)])
        body, nth = np.zeros(at[-1], np.uint8), np.arange(len(term)) - starts[block]
        spread(gap, wide[0][block], at[block] + nth * wide[0][block], body)
        spread(tf, wide[1][block], at[block] + count[block] * wide[0][block] + nth * wide[1][block], body)
        list_at = at[first_block]
        front_size, front_tf, front_n = fronts(block, tf, lengths[doc])
        front_at = np.concatenate([[0], np.cumsum(front_size)])[first_block]
        n = len(df)
        words = list(self.vocabulary)

        def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int32)))

        start = at[:-1] - list_at[np.repeat(np.arange(n), blocks)]
        of_terms = [
            pa.array(np.full(n, shard)), pa.array(words, pa.binary()), pa.array(df.astype(np.int64)),
            lists(doc[starts], first_block), lists(doc[ends], first_block), lists(start, first_block), lists(wide[0] * 8 + wide[1], first_block),
            lists(front_size, first_block), lists(front_tf, front_at), lists(front_n, front_at),
            pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(list_at.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())]),
            pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())),
        ]
        names = [f.split()[0] for f in INDEX.split(", ")]
        table_of = pa.RecordBatch.from_arrays(of_terms, names)
        row = {c: [None] for c in names} | {"shard": [shard], "ids": [ids], "lengths": [lengths.tolist()]}
        return table_of, pa.RecordBatch.from_pydict(row, schema=table_of.schema)


def index(docs: DataFrame, postings: int = SHARD_POSTINGS) -> DataFrame:
    """The inverted index of docs(doc_id, text), a stored table: rows of INDEX, one for each shard and term, and one for each shard, with
    null term, that has its documents' ids, ascending, and lengths. Documents without a term aren't in it. A task holds one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, Shard()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    if text.is_valid:
                        shard.add(doc_id, text.as_py())
                    if shard.postings >= postings:
                        yield from shard.rows(number)
                        number, shard = number + 1, Shard()
        if shard.postings:
            yield from shard.rows(number)

    return stored(docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, INDEX))


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of items(item_id, text), one row for each distinct term of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = Counter(terms_of(text)) if text else {}
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(counts), pa.int64()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["item_id", "term", "times"])

    found = items.where("item_id IS NOT NULL").select("item_id", F.col("text").cast("binary")).mapInArrow(run, "item_id long, term binary, times long")
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


class Postings:
    """A term's list in one shard, with the greatest impact of each block."""

    def __init__(self, row: dict, total: int, tokens: int):
        self.first, self.last, self.start, self.widths = (np.array(row[c], np.int64) for c in ("first", "last", "start", "widths"))
        self.df, self.body = row["df"], row["body"]
        sizes = np.array(row["front_size"], np.int64)
        impacts = impact(np.array(row["front_tf"], np.int64), length_part(np.array(row["front_n"], np.int64), total, tokens))
        self.most = np.maximum.reduceat(impacts, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        self.decompressed = 0

    def read(self, block: int, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block's documents and their impacts."""
        self.decompressed += 1
        count = min(BLOCK, self.df - block * BLOCK)
        gaps, tfs = divmod(int(self.widths[block]), 8)
        at = int(self.start[block])
        docs = self.first[block] + np.cumsum(np.frombuffer(self.body, f"<u{gaps}", count, at), dtype=np.int64)
        return docs, impact(np.frombuffer(self.body, f"<u{tfs}", count, at + count * gaps).astype(np.int64), parts[docs])


def length_part(n: np.ndarray, total: int, tokens: int) -> np.ndarray:
    """m of documents with n terms, of so many with so many in all."""
    return 100 - 25 + 25 * n * total // tokens


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def best_of(lists: list[tuple[int, Postings]], parts: np.ndarray, top: int, span: int = RANGE) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the top best of a shard for one query: lists with their weights. parts: m of the shard's documents. Higher
    scores come first, then lower documents; scores are above 0."""
    lists = sorted(((w, p, w * p.most) for w, p in lists), key=lambda x: int(x[2].max()))
    reach = np.cumsum([int(x[2].max()) for x in lists])  # what the lists up to each can give together
    best_docs, best_scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for low in range(0, len(parts), span):
        high = min(low + span, len(parts))
        optional = int(np.searchsorted(reach, least, side="right"))  # lists that together can't pass the least score that counts
        if optional == len(lists):
            break
        scores = np.zeros(high - low, np.int64)
        for weight, postings, _ in lists[optional:]:
            for block in range(int(np.searchsorted(postings.last, low)), int(np.searchsorted(postings.first, high))):
                docs, impacts = postings.read(block, parts)
                inside = slice(*np.searchsorted(docs, (low, high)))
                scores[docs[inside] - low] += weight * impacts[inside]
        left = np.flatnonzero(scores)
        if optional:
            left = left[scores[left] + reach[optional - 1] > least]
        for i in range(optional - 1, -1, -1):
            if not len(left):
                break
            weight, postings, most = lists[i]
            at = np.minimum(np.searchsorted(postings.last, left + low), len(postings.last) - 1)
            there = (postings.first[at] <= left + low) & (left + low <= postings.last[at])
            kept = scores[left] + np.where(there, most[at], 0) + (reach[i - 1] if i else 0) > least
            left, at, there = left[kept], at[kept], there[kept]
            for block in np.unique(at[there]):
                docs, impacts = postings.read(int(block), parts)
                wanted = left[there & (at == block)] + low
                place = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
                scores[wanted - low] += np.where(docs[place] == wanted, weight * impacts[place], 0)
        left = left[scores[left] > least]
        if len(left):
            docs, points = np.concatenate([best_docs, left + low]), np.concatenate([best_scores, scores[left]])
            order = np.lexsort((docs, -points))[:top]
            best_docs, best_scores = docs[order], points[order]
            least = int(best_scores[-1]) if len(order) == top else 0
    return best_docs, best_scores


def search(indexed: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each of items(item_id, text)'s best documents of an index, by score, ties by ascending doc_id."""
    shards = indexed.where("term IS NULL").select(F.col("shard").alias("block"), "ids", "lengths")
    figures = shards.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("tokens")).first()
    total, tokens = figures["n"] or 0, figures["tokens"] or 0
    asked = stored(query_terms(items))
    distinct = asked.select("term").distinct()
    small = asked.count() <= BROADCAST_TERMS
    own = indexed.where("term IS NOT NULL").join(F.broadcast(distinct) if small else distinct, "term", "left_semi")
    own = stored(own.drop("ids", "lengths"))
    df = own.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * total + 2) / (2 * F.col("df") + 1)))
    batches = max(1, -(-items.count() // QUERIES_A_BATCH))
    asked = stored(asked.join(df, "term").select(F.pmod(F.xxhash64("item_id"), F.lit(batches)).alias("batch"), "item_id", "term", (F.col("times") * weight).alias("weight")).where("weight > 0"))
    by_batch = asked.groupBy(F.col("batch").alias("block")).agg(F.collect_list("item_id").alias("items"), F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    heads = vectors.in_cells(shards, stored(by_batch), 64, 1).select(F.col("block").alias("shard"), F.col("q_block").alias("batch"), "ids", "lengths", "q_items", "q_terms", "q_weights")
    wanted = asked.select("batch", "term").distinct()
    lists = own.join(F.broadcast(wanted) if small else wanted, "term")
    both = lists.unionByName(heads, allowMissingColumns=True)

    def ranked(group: pa.Table) -> pa.Table:
        head, lists = None, {}
        for r in group.to_batches():
            for row in r.to_pylist():
                if row["term"] is None:
                    head = row
                else:
                    lists[row["term"]] = Postings(row, total, tokens)
        out: list[tuple] = []
        if head:
            parts, ids = length_part(np.array(head["lengths"], np.int64), total, tokens), head["ids"]
            queries: dict[int, list] = {}
            for item, term, w in zip(head["q_items"], head["q_terms"], head["q_weights"], strict=True):
                if term in lists:
                    queries.setdefault(item, []).append((w, lists[term]))
            for item, query in queries.items():
                docs, scores = best_of(query, parts, top)
                out += [(item, ids[d], s) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
        return pa.table({c: pa.array([x[i] for x in out], pa.int64()) for i, c in enumerate(("item_id", "doc_id", "score"))})

    found = both.groupBy("shard", "batch").applyInArrow(ranked, "item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no terms: such documents aren't counted or found, such items have no rows, nor have items without id.
    Rows that repeat a doc_id are documents of their own, each with its rank; those without doc_id come last among equal scores. Texts
    are read whole, however long: a text's own terms are what a task holds beside its shard. Items that share an id are one query.
    An empty table gives no rows; other columns aren't read."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long"), "text")
    return search(index(docs), items)
