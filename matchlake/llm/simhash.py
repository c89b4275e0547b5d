"""6. SimHash near-duplicates by anchor-point covering.

Fingerprints within `bits` differing bits agree, but for one bit at most, in one of (bits + 1) / 2 blocks. In a block, the words of a
perfect Hamming code are the anchors: each value lies within the covering radius 1 of just one, so two values that differ in one bit
both lie within 2 of the anchor nearest to either. Each distinct fingerprint goes once to its nearest anchor of each block, as the one
that asks, and to all anchors within 2, to be found. An anchor compares the former with the latter, and keeps only as many links as
connect what it found. Blocks of 32 bits (bits = 3) leave 2^26 anchors, each fingerprint at about 16. The askers of an anchor with more
than SPLIT fingerprints are dealt over tasks, each of which reads the anchor's fingerprints as a stream.

The near-duplicate stage verifies what three fingerprints propose by the sets of five-word shingles. Texts whose sets are alike to 0.8
needn't have such fingerprints: bands of MinHash signatures of those sets propose the rest (see banded_links).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, stored, table
from .components import components

BITS, WORDS, SEED = 3, 3, 42
#: Runs of one anchor up to SHORT are compared together with others, up to SPLIT one by one, longer ones in several tasks.
SHORT, SPLIT = 8, 8192
#: Near-duplicate stage: shingles of five words and a similarity of 0.8 decide; three fingerprints of the distinct words propose.
SHINGLE, SIMILAR, SEEDS = 5, 0.8, (42, 43, 44)
#: Signatures: bands of so many minima. Of pairs alike to 0.8, 1 in 2,800 has no equal band; of pairs alike to 0.5, half have one.
BANDS, MINIMA = 20, 5
#: Pairs are verified from this share of equal minima on: three standard errors below 0.8.
PROMISING = 0.68
#: A task compares about so many askers of a band's bucket with so many of its texts.
ASKERS, PASSING = 256, 4096


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z only; blank and \t to \r


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """All runs of size words, joined by a blank; of fewer words the whole sequence, of none nothing."""
    if not words:
        return []
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    return [joined[a:b] for a, b in zip(starts, ends[size - 1 :] or ends[-1:], strict=False)]


def fingerprint(pieces: list[bytes], seed: int = SEED) -> int:
    """A bit is 1 if more than half of the pieces' XXH64 have it; signed 64 bits."""
    if not pieces:
        return 0
    of = xxhash.xxh64_digest
    bits = np.unpackbits(np.frombuffer(b"".join([of(p, seed) for p in pieces]), np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(pieces)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) for each row of docs(doc_id, text)."""

    def rows(ids, texts) -> Iterator[tuple]:
        for i, t in zip(ids, texts, strict=True):
            yield i, fingerprint(shingles(words_of(t), words))

    return map_texts(docs, ["doc_id", "text"], "doc_id long, fp long", rows)


class Anchors:
    """The anchors of each block: what to change in a block's value to reach its nearest anchor, and those within 2."""

    def __init__(self, bits: int):
        self.blocks = (bits + 1) // 2
        self.width = 64 // self.blocks
        self.checks = (self.width + 1).bit_length() - 1
        self.length = (1 << self.checks) - 1
        if bits % 2 == 0 or self.blocks > 8:
            raise ValueError("bits: 1, 3, 5 ... 15")
        one = [0, *(1 << (i - 1) for i in range(1, self.length + 1))]
        #: By syndrome: the change of one bit to the nearest anchor, then those of two.
        self.changes = [[one[s], *(one[i] | one[i ^ s] for i in range(1, self.length + 1) if s and 0 < i < i ^ s)] for s in range(self.length + 1)]
        most = max(map(len, self.changes))
        self.table = np.array([c + [c[0]] * (most - len(c)) for c in self.changes], np.uint64)
        self.some = np.array([[j < len(c) for j in range(most)] for c in self.changes])

    def of(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor's number, whether it asks) of every copy of fps (uint64)."""
        out = []
        for block in range(self.blocks):
            v = (fps >> np.uint64(block * self.width)) & np.uint64((1 << self.length) - 1)
            syndrome = np.zeros(len(v), np.int64)
            for j in range(self.checks):
                mask = np.uint64(sum(1 << (i - 1) for i in range(1, self.length + 1) if i >> j & 1))
                syndrome |= (np.bitwise_count(v & mask).astype(np.int64) & 1) << j
            anchors, some = v[:, None] ^ self.table[syndrome], self.some[syndrome]
            row, column = np.nonzero(some)
            out.append((row, anchors[row, column] + np.uint64(block << self.length), column == 0))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def within(fps: np.ndarray, asks: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect what lies within bits of one another, among the fps of one anchor; between equal groups one link."""
    group, links = np.arange(len(fps)), []
    for i in np.flatnonzero(asks):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= bits)
        groups, first = np.unique(group[near], return_index=True)
        if len(groups) > 1:
            links += [(i, near[k]) for k in first if group[near[k]] != group[i]]
            group[np.isin(group, groups)] = group[i]
    return links


def link(fps: DataFrame, bits: int = BITS, split: int = SPLIT) -> DataFrame:
    """(kind, a, b): links between the distinct fps of one kind, of fps(kind int, fp long). All that are within bits of one another
    are connected, though not each with each."""
    schema = "key long, kind int, fp long, asks boolean"
    fields = [("key", pa.int64()), ("kind", pa.int32()), ("fp", pa.int64()), ("asks", pa.bool_())]
    out = [("key", pa.int64()), ("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("asks", pa.bool_())]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(bits)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                kind, fp = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
                row, key, asks = anchors.of(fp.view(np.uint64))
                key = key.astype(np.int64) | kind[row].astype(np.int64) << 40
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip((key, kind[row], fp[row], asks), fields, strict=True)], [n for n, _ in fields])

    def links(key: np.ndarray, kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip((key, kind, a, b), out, strict=False)] + [pa.nulls(len(a), pa.bool_())], [n for n, _ in out])

    def crowded(key: np.ndarray, kind: np.ndarray, fp: np.ndarray, asks: np.ndarray) -> pa.RecordBatch:
        """Rows of a long run, to be dealt anew: b is null."""
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind, pa.int32()), pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(asks)], [n for n, _ in out])

    def compare(key: np.ndarray, kind: np.ndarray, fp: np.ndarray, asks: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole runs of equal keys."""
        u = fp.view(np.uint64)
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[begins, len(key)])
        a, b = [], []
        short = np.repeat(sizes <= SHORT, sizes)
        for d in range(1, SHORT):
            x = np.flatnonzero((key[d:] == key[:-d]) & short[d:] & (asks[d:] | asks[:-d]))
            x = x[np.bitwise_count(u[x] ^ u[x + d]) <= bits]
            a.append(x)
            b.append(x + d)
        for begin, size in zip(begins[sizes > SHORT], sizes[sizes > SHORT], strict=True):
            run = slice(begin, begin + size)
            if size > split:
                yield crowded(key[run], kind[run], fp[run], asks[run])
                continue
            found = within(u[run], asks[run], bits)
            if found:
                i, j = np.array(found).T
                a.append(begin + i)
                b.append(begin + j)
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        yield links(key[a], kind[a], fp[a], fp[b])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by key. At most a batch and `split` rows of the last run are held."""
        kept, long_key = None, None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if long_key is not None:  # a long run goes on
                cut = int(np.searchsorted(now[0], long_key, "right"))
                if cut:
                    yield crowded(*(x[:cut] for x in now))
                now = [x[cut:] for x in now]
                long_key = long_key if not len(now[0]) else None
            if not len(now[0]):
                continue
            kept = now if kept is None else [np.concatenate(x) for x in zip(kept, now, strict=True)]
            cut = int(np.searchsorted(kept[0], kept[0][-1]))  # the last run may go on in the next batch
            yield from compare(*(x[:cut] for x in kept))
            kept = [x[cut:] for x in kept]
            if len(kept[0]) > split:
                yield crowded(*kept)
                kept, long_key = None, kept[0][0]
        if kept is not None:
            yield from compare(*kept)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by (key, salt, asks first): the askers of one salt are held, all fingerprints of the key pass by."""
        at, mine, group = None, None, None
        for batch in batches:
            key, salt, kind, fp, asks = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            u = fp.view(np.uint64)
            begins = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
            for begin, end in zip(begins, [*begins[1:], len(key)], strict=True):
                if (key[begin], salt[begin]) != at:
                    at, mine, group = (key[begin], salt[begin]), np.zeros(0, np.uint64), np.zeros(0, np.int64)
                own = np.flatnonzero(asks[begin:end]) + begin
                mine = np.concatenate([mine, u[own]])
                group = np.concatenate([group, np.arange(len(group), len(mine))])
                a, b = [], []
                for i in np.flatnonzero(~asks[begin:end]) + begin:
                    near = np.flatnonzero(np.bitwise_count(mine ^ u[i]) <= bits)
                    if len(near):
                        groups, first = np.unique(group[near], return_index=True)
                        a += mine[near[first]].view(np.int64).tolist()
                        b += [fp[i]] * len(first)
                        if len(groups) > 1:
                            group[np.isin(group, groups)] = groups[0]
                if a:
                    yield links(np.full(len(a), key[begin]), np.full(len(a), kind[begin]), np.array(a), np.array(b))

    copies = fps.select(F.col("kind").cast("int"), "fp").mapInArrow(spread, schema)
    met = stored(copies.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "key long, kind int, a long, b long, asks boolean"))
    found, left = met.where("b is not null").select("kind", "a", "b"), met.where("b is null").select("key", "kind", F.col("a").alias("fp"), "asks")
    if not left.isEmpty():
        salts = F.ceil(F.col("n") / split).cast("int")
        left = left.join(left.groupBy("key").agg(F.count("*").alias("n")), "key")
        asking = left.where("asks").select("key", F.pmod(F.xxhash64("fp"), salts).cast("int").alias("salt"), "kind", "fp", "asks")
        passing = left.select("key", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "kind", "fp", F.lit(False).alias("asks"))
        dealt = asking.unionByName(passing).repartition("key", "salt").sortWithinPartitions("key", "salt", F.desc("asks"))
        found = found.unionByName(dealt.mapInArrow(ask, "key long, kind int, a long, b long, asks boolean").where("a <> b").select("kind", "a", "b"))
    return found.distinct()


def near_groups(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs(doc_id, text).

    Null and empty texts have fingerprint zero and link like any other. Copies share a fingerprint, so only distinct ones are spread.
    A component of rows without doc_id only has a null component_id. No documents, no rows.
    """
    each = stored(fingerprints(docs, words))
    distinct = stored(each.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = components(link(distinct.select(F.lit(0).alias("kind"), "fp"), bits).select("a", "b"))
    linked = stored(linked.join(distinct.withColumnRenamed("fp", "id"), "id"))
    roots = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of = distinct.join(linked.join(roots, "root").select(F.col("id").alias("fp"), "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return each.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def candidates(nodes: DataFrame, bits: int) -> DataFrame:
    """(a, b): links of nodes(id, fps array<long>) that have a fingerprint of one kind within bits."""
    each = nodes.select("id", F.posexplode("fps").alias("kind", "fp"))
    first = stored(each.groupBy("kind", "fp").agg(F.min("id").alias("first")))
    same = each.join(first, ["kind", "fp"]).where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    near = link(first, bits)
    ends = [first.select("kind", F.col("fp").alias(c), F.col("first").alias(f"id_{c}")) for c in "ab"]
    near = near.join(ends[0], ["kind", "a"]).join(ends[1], ["kind", "b"]).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return same.unionByName(near)


def alike(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(id, root, likeness): those of pairs(id, root) whose shingle sets are as alike as `similar`."""
    pairs = pairs.join(sets.select("id", "hashes"), "id").join(sets.select(F.col("id").alias("root"), F.col("hashes").alias("others")), "root")
    return pairs.mapInArrow(jaccard, T._parse_datatype_string("id long, root long, likeness double")).where(F.col("likeness") >= similar)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The MinHash signature of a set of 64-bit hashes: BANDS * MINIMA values of 32 bits. Of an empty set all zero."""
    out = np.full(BANDS * MINIMA, 0xFFFFFFFF if len(hashes) else 0, np.uint32)
    r = np.random.default_rng(11)
    turn, odd = (r.integers(0, 1 << 63, len(out), np.uint64) for _ in range(2))
    odd = odd << np.uint64(1) | np.uint64(1)
    for start in range(0, len(hashes), 1024):
        v = (hashes[start : start + 1024, None] ^ turn) * odd >> np.uint64(32)
        np.minimum(out, v.min(0).astype(np.uint32), out)
    return out


def band_keys(texts: DataFrame) -> DataFrame:
    """(key, id): a key for each band of the signatures of texts(id, signature)."""

    def rows(ids, signatures) -> Iterator[tuple]:
        for i, s in zip(ids, signatures, strict=True):
            for band in range(BANDS):
                yield xxhash.xxh64_intdigest(s[4 * MINIMA * band :][: 4 * MINIMA], band) - (1 << 63), i

    return map_texts(texts, ["id", "signature"], "key long, id long", rows)


def promising(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs(id, root) whose signatures in texts(id, signature) have a share of PROMISING equal minima."""

    def rows(ids, roots, a, b) -> Iterator[tuple]:
        for i, j, x, y in zip(ids, roots, a, b, strict=True):
            if (np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).mean() >= PROMISING:
                yield i, j

    both = pairs.join(texts.select("id", F.col("signature").alias("x")), "id").join(texts.select(F.col("id").alias("root"), F.col("signature").alias("y")), "root")
    return map_texts(both, ["id", "root", "x", "y"], "id long, root long", rows)


def ask_all(here: DataFrame, similar: float | None) -> DataFrame:
    """Of here(key, id, c, asks, blocks, chunks, signature, hashes): every text that asks is compared with every text of its key that has
    another c, by signature and, if promising, by set. Gives (key, id, root): links of those alike to `similar`, without links between
    what earlier ones of the task connect; with None, a row for each promising text of a key, from signatures alone. Askers are held,
    a block of them at a time, while the others pass by; no pairs are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, cs, signatures, sets, group, matrix = None, [], [], [], [], {}, None

        def find(x: int) -> int:
            while group.get(x, x) != x:
                x = group[x]
            return x

        for batch in batches:
            out = []
            for key, block, chunk, asks, i, c, signature, hashes in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if (key, block, chunk) != at:
                    at, ids, cs, signatures, sets, group, matrix = (key, block, chunk), [], [], [], [], {}, None
                mine = np.frombuffer(signature, np.uint32)
                if asks:
                    ids.append(i)
                    cs.append(c)
                    signatures.append(mine)
                    sets.append(hashes)
                    continue
                if matrix is None:
                    matrix = np.array(signatures).reshape(len(ids), -1)
                share = (matrix == mine).mean(1) if ids else np.zeros(0)
                for j in np.argsort(-share)[: int((share >= PROMISING).sum())]:
                    if find(c) == find(cs[j]):
                        continue
                    if similar is None:
                        out.append((key, i, i))
                        break
                    x, y = (np.frombuffer(v, np.uint64) for v in (hashes, sets[j]))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both >= similar * (len(x) + len(y) - both):
                        out.append((key, max(i, ids[j]), min(i, ids[j])))
                        group[find(c)] = find(cs[j])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], ["key", "id", "root"])

    columns = ["id", "c", "signature", "hashes"]
    asking = here.where("asks").select("key", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("asks"), *columns)
    passing = here.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), "chunks").alias("chunk"), F.lit(False).alias("asks"), *columns)
    return asking.unionByName(passing).repartition("key", "block", "chunk").sortWithinPartitions("key", "block", "chunk", F.desc("asks")).mapInArrow(run, "key long, id long, root long")


def banded_links(buckets: DataFrame, known: DataFrame, texts: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """known(id, root), links, and as many more that all texts alike to `similar` which share a bucket of buckets(key, id) are connected.

    First each text of a bucket is compared with one of it, picked by hash, so that copies become one group. Then the texts outside the
    largest group of a bucket ask all of its other groups, first by signatures, then, where any is promising, by sets.
    """
    sizes = stored(buckets.groupBy("key").agg(F.count("*").alias("m"), F.min_by("id", F.xxhash64("id", "key")).alias("root")))
    pairs = buckets.join(sizes, "key").where("id <> root").select(F.greatest("id", "root").alias("id"), F.least("id", "root").alias("root")).distinct()
    known = stored(known.unionByName(alike(promising(pairs, texts), sets, similar).select("id", "root")))
    roots = components(known.select(F.col("id").alias("a"), F.col("root").alias("b")))
    here = buckets.join(sizes.where("m > 2").select("key"), "key").join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("c"))
    groups = here.groupBy("key", "c").agg(F.count("*").alias("n"))
    largest = groups.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("largest"), F.count("*").alias("groups"), F.sum("n").alias("m"), F.max("n").alias("most")).where("groups > 1")
    largest = largest.select("key", "largest", F.ceil((F.col("m") - F.col("most")) / ASKERS).alias("blocks"), F.ceil(F.col("m") / PASSING).alias("chunks"))
    here = stored(here.join(largest, "key").withColumn("asks", F.col("c") != F.col("largest")).join(texts, "id"))
    some = ask_all(here.withColumn("hashes", F.lit(None).cast("binary")), None).select("key").distinct()
    found = ask_all(here.join(some, "key").join(sets, "id"), similar)
    return stored(known.unionByName(found.select("id", "root")).distinct())


def copies(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, similar: float = SIMILAR, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """(doc_id, copy_of): the documents of docs(doc_id, text) to drop so that one of each group stays.

    Equal texts (nulls count as empty) are copies of the smallest doc_id. Of distinct texts, the fingerprints of the distinct words
    propose links, then the bands of signatures of the shingle sets; those whose sets of five-word shingles have a Jaccard similarity of
    at least 0.8 count. Of each component of such links the smallest id stays. Rows without doc_id are never copies.
    """

    def rows(ids, texts) -> Iterator[tuple]:
        for i, t in zip(ids, texts, strict=True):
            words = words_of(t)
            pieces = list(dict.fromkeys(words))
            yield i, xxhash.xxh3_128_hexdigest((t or "").encode()), minima(hashed(words)).tobytes(), *(fingerprint(pieces, s) for s in seeds)

    def hashed(words: list[bytes]) -> np.ndarray:
        return np.unique(np.array([xxhash.xxh64_intdigest(x) for x in shingles(words, shingle)], np.uint64))

    def set_rows(ids, texts) -> Iterator[tuple]:
        for i, t in zip(ids, texts, strict=True):
            yield i, hashed(words_of(t)).tobytes()

    names = [f"f{i}" for i in range(len(seeds))]
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    each = stored(map_texts(docs, ["doc_id", "text"], "doc_id long, same string, signature binary, " + ", ".join(f"{n} long" for n in names), rows))
    texts = stored(each.groupBy("same").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"), *(F.first(n).alias(n) for n in names)))
    equal = each.select("doc_id", "same").join(texts.select("same", "id"), "same").where("doc_id <> id").select("doc_id", F.col("id").alias("copy_of"))

    proposed = stored(candidates(texts.select("id", F.array(*names).alias("fps")), bits).select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("root")).distinct())
    at = stored(band_keys(texts))
    buckets = stored(at.join(at.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "key"))
    some = buckets.select("id").unionByName(proposed.select("id")).unionByName(proposed.select(F.col("root").alias("id"))).distinct()
    # rows that repeat a doc_id with another text: the ids stand for the texts that have them as their least
    sets = stored(map_texts(docs.join(some.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), ["doc_id", "text"], "id long, hashes binary", set_rows).groupBy("id").agg(F.min("hashes").alias("hashes")))
    links = banded_links(buckets, stored(alike(proposed, sets, similar).select("id", "root")), texts.select("id", "signature"), sets, similar)
    groups = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    return equal.unionByName(groups.where("id <> root").select(F.col("id").alias("doc_id"), F.col("root").alias("copy_of")))


def jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, roots, a, b = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "root", "hashes", "others"))
        like = []
        for x, y in zip(a, b, strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            like.append(both / max(1, len(x) + len(y) - both) if len(x) or len(y) else 1.0)
        yield pa.RecordBatch.from_arrays([ids, roots, pa.array(like, pa.float64())], ["id", "root", "likeness"])


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each group of copies; all columns stay. Rows that repeat a doc_id stay or go together."""
    gone = copies(docs, **how).select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return near_groups(docs)
