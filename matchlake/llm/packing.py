"""3. Packing by shortest-pack-first over the length histogram.

Documents become token ids; those above the sequence length are cut into full pieces and a rest. The histogram of piece lengths has
max_tokens bins at most, so it fits on the driver at any corpus size. Lengths are placed longest first, each into the pattern with
the fewest tokens that still leaves room; one piece goes to each sequence of the pattern at once, which splits a pattern's count when it
has more sequences than the bin has pieces left. Each step so takes a range of ranks among the pieces of a length to a range of
sequences, and a piece finds its sequence by its rank. The task that cuts a text numbers its pieces of each length; the numbers of pieces
that other tasks have before it are summed per length, so no length is gathered or sorted.
"""

from __future__ import annotations

import bisect
import json
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import rows_to_arrow, stored, table

MAX_TOKENS = 4096
END = 2
#: Words, of up to so many characters, whose ids a Python worker remembers; beyond that and one batch it starts anew, and longer ones
#: are forgotten with their batch. Bounds memory, not results.
REMEMBERED, LONGEST = 600_000, 64


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordCodes:
    """Ids of whole texts, as little-endian 32-bit bytes. The vocabulary's tokenizer drops white space and nothing crosses it, so each
    run of characters between blanks and line ends is encoded once and remembered. Runs of Latin-1 characters, which no normal form
    changes, go straight to the tokenizer's model in lower case, cut by its own pattern; all others through the whole tokenizer."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = regex.compile(json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.plain = regex.compile(r"(?!.*<\|)[\x21-\x7e\xa1-\xff]*").fullmatch
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # byte-level BPE writes these bytes as themselves
        rest = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(256 + i) for i, b in enumerate(rest)}
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.known_pieces: dict[str, bytes] = {}

    def learn_piece(self, piece: str) -> bytes:
        if len(self.known_pieces) > REMEMBERED // 2:
            self.known_pieces.clear()
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        code = pack_ids([t.id for t in self.model.tokenize(shown)])
        if len(piece) <= LONGEST:
            self.known_pieces[piece] = code
        return code

    def learn(self, words: set[str]) -> None:
        known, of_piece, learn_piece, odd = self.known, self.known_pieces.get, self.learn_piece, []
        for w in words:
            if not (w.isascii() and w.isprintable() and "<|" not in w or self.plain(w)):
                odd.append(w)
                continue
            x = w.lower()
            if x.isalpha():
                known[w] = of_piece(x) or learn_piece(x)
            elif x[:-1].isalpha() and x[-1] in ".,":
                known[w] = (of_piece(x[:-1]) or learn_piece(x[:-1])) + (of_piece(x[-1]) or learn_piece(x[-1]))
            else:
                known[w] = b"".join([of_piece(p) or learn_piece(p) for p in self.pieces(x)])
        for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            known[w] = pack_ids(e.ids)

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        cut, known = [t.replace("\n", " ").split(" ") for t in texts], self.known
        new = set().union(*cut).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set().union(*cut)
        self.learn(new)
        for words in cut:
            yield b"".join(map(known.__getitem__, words))
        for w in new:
            if len(w) > LONGEST:
                del known[w]


@lru_cache(maxsize=2)
def word_codes(path: str) -> WordCodes:
    return WordCodes(path)


def cut(docs: DataFrame, path: str, end: int = END, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, task, nth): the pieces of every document (null text: only the end id), each with
    its number among the task's pieces of its length."""
    last = np.array([end], "<u4").tobytes()
    schema = T._parse_datatype_string("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, nth long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), Counter()

        def rows(ids, texts) -> Iterator[tuple]:
            for i, x in zip(ids, word_codes(path).encode_all([t or "" for t in texts]), strict=True):
                x += last
                n = len(x) // 4
                for start in range(0, n, max_tokens):
                    part = x[4 * start : 4 * (start + max_tokens)]
                    length = len(part) // 4
                    yield i, start, length, zlib.crc32(part), n, task, seen[length]
                    seen[length] += 1

        yield from rows_to_arrow(schema, ["doc_id", "text"], rows)(batches)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def assign(histogram: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, sequence, offset, times, n): the n pieces of a length from rank `first` on go to the sequences from `sequence` on,
    `times` to each, at `offset`. Shortest-pack-first: of the sequences with room, the one with the fewest tokens takes the next piece.
    A new sequence, made where none has room, is then the only one that has some, and takes pieces of the same length until it has none.
    Sequences with equal tokens are ranges of numbers, so a step has one row, whatever their earlier pieces."""
    open_at: dict[int, list[tuple[int, int]]] = {}  # tokens so far -> ranges (first sequence, how many)
    fills: list[int] = []
    rows, made = [], 0

    def put(tokens: int, first: int, count: int) -> None:
        if tokens == max_tokens:
            return
        if tokens not in open_at:
            bisect.insort(fills, tokens)
            open_at[tokens] = []
        ranges = open_at[tokens]
        if ranges and sum(ranges[-1]) == first:
            ranges[-1] = (ranges[-1][0], ranges[-1][1] + count)
        else:
            ranges.append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if fills and fills[0] + length <= max_tokens:
                tokens = fills[0]
                first, count = open_at[tokens].pop()
                if not open_at[tokens]:
                    del open_at[tokens]
                    fills.pop(0)
                n = min(count, left)
                if n < count:
                    put(tokens, first + n, count - n)
                put(tokens + length, first, n)
                rows.append((length, rank, first, tokens, 1, n))
            else:
                times = min(max_tokens // length, left)
                count = left // times
                put(times * length, made, count)
                n = count * times
                rows.append((length, rank, made, 0, times, n))
                made += count
            rank += n
            left -= n
    return rows


def places(rows: list[tuple[int, int, int, int, int, int]]) -> dict[str, np.ndarray]:
    """The ranges of ranks, sorted by (length, first rank): a piece whose rank is first + k is in sequence + k // times, at
    offset + length * (k % times)."""
    return dict(zip(("length", "first", "sequence", "offset", "times"), np.array([r[:5] for r in sorted(rows)] or np.empty((0, 5)), np.int64).T, strict=True))


def pack(docs: DataFrame, path: str, end: int = END, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece of docs(doc_id, text).

    Null and empty texts are one end id; repeated rows are packed as often as they stand there; null doc_ids stay null; no documents,
    no rows. Sequences are gapless; a power of two and max_tokens need no padding.
    """
    pieces = stored(cut(docs, path, end, max_tokens))
    counts = stored(pieces.groupBy("length", "task").agg(F.max("nth").alias("n")).withColumn("n", F.col("n") + 1))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_tokens rows at most
    at = docs.sparkSession.sparkContext.broadcast(places(assign(histogram, max_tokens)))
    before = counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = pieces.join(before, ["length", "task"]).select(*columns, (F.col("before") + F.col("nth")).alias("rank"))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, wide = at.value, 1 << 40
        keys = p["length"] * wide + p["first"]
        for x in batches:
            length, rank = x["length"].to_numpy(np.int64), x["rank"].to_numpy(np.int64)
            row = np.searchsorted(keys, length * wide + rank, "right") - 1
            k, times = rank - p["first"][row], p["times"][row]
            yield x[columns].assign(sequence_id=p["sequence"][row] + k // times, offset=p["offset"][row] + length * (k % times))

    return ranked.mapInPandas(placed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases: see pack and cut. Texts are encoded whole, however long: a long one gives many pieces, which join its row by rank."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
