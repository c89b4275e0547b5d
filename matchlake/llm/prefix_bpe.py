"""10. Byte-level BPE by prefix dynamic programming.

For each prefix of a piece there is exactly one token that can end its encoding; an array of these last tokens holds the encodings
of all prefixes at once. A token t may follow the last token of the prefix before it only if BPE would leave the two apart, which
undoing the merges of both, latest first, decides. So an append only extends the array, exactly, and an edit re-encodes from the
first changed byte on.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

#: Pieces, of up to so many characters, whose ids a Python worker remembers; beyond that and one batch it starts anew, and longer ones
#: are forgotten with their batch. Bounds memory, not results.
REMEMBERED, LONGEST = 600_000, 64


class PrefixEncoder:
    """Encoder of single pieces for the ranks of a byte-level BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.apart: dict[int, bool] = {}
        self.made: set[int] = set()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.made.add(rank)
                continue
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut], rank), ranks.get(token[cut:], rank)
                if left < rank and right < rank and left in self.made and right in self.made and self.stay_apart(left, right):
                    self.parts[rank], self.merged[left, right] = (left, right), rank
                    self.made.add(rank)
                    break
        #: Finds, at each byte of a piece, all tokens that end there.
        self.tokens_in, self.longest = ahocorasick.Automaton(), max(map(len, ranks), default=1)
        for token, rank in ranks.items():
            if rank in self.made:
                self.tokens_in.add_word(token.decode("latin-1"), (len(token), rank))
        self.tokens_in.make_automaton()

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes gives just these two: no merge across the border comes before the merges beside it."""
        a, b, before = left, right, len(self.bytes_of) + 1 << 32
        while True:
            if self.merged.get((a, b), before) < before:
                return False
            if a > b:  # a was merged last: undo it; from then on, only earlier merges could have crossed
                before = a
                if a in self.parts:
                    a = self.parts[a][1]
                    continue
                before = b + 1
                if b not in self.parts:
                    return True
                b = self.parts[b][0]
            else:
                before = b + 1
                if b in self.parts:
                    b = self.parts[b][0]
                    continue
                before = a
                if a not in self.parts:
                    return True
                a = self.parts[a][1]

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """last[i]: the last token of the first i + 1 bytes of piece. Fills in what is missing, in place."""
        apart, done = self.apart, len(last)
        if len(apart) >= REMEMBERED:
            apart.clear()
        for end, (size, token) in self.tokens_in.iter(piece.decode("latin-1"), max(0, done + 1 - self.longest)):  # longest first
            if end != done:  # known already
                continue
            if end >= size:
                pair = last[end - size] << 32 | token
                fits = apart.get(pair)
                if fits is None:
                    fits = apart[pair] = self.stay_apart(last[end - size], token)
                if not fits:
                    continue
            last.append(token)
            done += 1
        if done < len(piece):
            raise ValueError(f"the vocabulary can't spell {piece!r}")
        return last

    def ids_of(self, piece: bytes, last: list[int]) -> list[int]:
        """Read the encoding of piece off its array of last tokens."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        out, end = [], len(piece)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return self.ids_of(piece, self.extend(piece, []))

    def append(self, piece: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """piece + more and its last tokens; only the new bytes are worked on."""
        return piece + more, self.extend(piece + more, list(last))

    def replace(self, piece: bytes, last: list[int], start: int, end: int, by: bytes) -> tuple[bytes, list[int]]:
        """piece with bytes start to end replaced, and its last tokens. What stands before start is kept, and so is what follows once as
        many last tokens in a row as the longest token has bytes are the old ones: no later one can tell the two apart."""
        edited, moved = piece[:start] + by + piece[end:], start + len(by) - end
        new, at = last[:start], start + len(by)
        while at < len(edited):
            at = min(len(edited), at + self.longest)
            self.extend(edited[:at], new)
            if at - self.longest >= start + len(by) and new[at - self.longest :] == last[at - self.longest - moved : at - moved]:
                return edited, new + last[at - moved :]
        return edited, self.extend(edited, new)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    with open(path, "rb") as f:
        return PrefixEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class Ragged:
    """Byte strings by number, laid end to end, so that numpy can join many of them."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(x) for x in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, numbers: np.ndarray) -> bytes:
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[numbers] - ends + sizes, sizes)
        return self.data[at + np.arange(len(at))].tobytes()


class TextEncoder:
    """Encoder of whole texts: each match of pattern by itself. Ids are numpy arrays of little-endian 32-bit numbers."""

    def __init__(self, path: str, pattern: str):
        self.pieces = regex.compile(pattern).findall
        self.encoder = encoder(path)
        self.known: dict[str, bytes] = {}
        n = max(self.encoder.bytes_of, default=-1) + 1
        self.bytes_of = Ragged([self.encoder.bytes_of.get(i, b"") for i in range(n)])
        self.digits_of = Ragged([b"%d " % i for i in range(n)])

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        cut, known = [self.pieces(t) for t in texts], self.known
        new = set().union(*cut).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set().union(*cut)
        for p in new:
            known[p] = np.array(self.encoder.encode(p.encode()), "<u4").tobytes()
        for pieces in cut:
            yield np.frombuffer(b"".join(map(known.__getitem__, pieces)), "<u4")
        for p in new:
            if len(p) > LONGEST:
                del known[p]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes_of.join(ids)

    def written(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, with one space between them."""
        return self.digits_of.join(ids)[:-1]


class EncodedText:
    """A text with its pieces and, of those longer than one token, the last tokens of their prefixes, so that appends and edits work on
    the pieces that they change alone."""

    def __init__(self, encoder: PrefixEncoder, pattern: str, text: str = ""):
        self.encoder, self.pattern, self.text = encoder, regex.compile(pattern), ""
        #: Of each piece: where it begins in the text, its bytes, its last tokens.
        self.pieces: list[tuple[int, bytes, list[int]]] = []
        self.worked_on = 0
        self.edit(0, 0, text)

    def piece(self, begin: int, text: str) -> tuple[int, bytes, list[int]]:
        raw = text.encode()
        self.worked_on += len(raw)
        return begin, raw, [] if raw in self.encoder.ranks else self.encoder.extend(raw, [])

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, by: str) -> None:
        """Replaces characters start to end. Pieces are cut anew from the one that the edit touches, or what it may lengthen or what white
        space before that looked ahead to; as soon as a cut falls where one fell behind the edit, the old pieces go on: how a text is
        cut from some place on depends on nothing before it."""
        moved = len(by) - (end - start)
        begins = [b for b, *_ in self.pieces]
        first = max(0, bisect.bisect_left(begins, start) - 1)
        while first and self.pieces[first - 1][1].isspace():
            first -= 1
        self.text = self.text[:start] + by + self.text[end:]
        old = {b + moved: i for i, b in enumerate(begins) if b >= end}
        new, at, rest = [], begins[first] if begins else 0, len(self.pieces)
        while at < len(self.text):
            if at >= start + len(by) and at in old:
                rest = old[at]
                break
            m = self.pattern.search(self.text, at)
            if m is None or m.end() == m.start():
                break
            new.append(self.lengthened(first, len(new), m) or self.piece(m.start(), m.group()))
            at = m.end()
        self.pieces[first:] = new + [(b + moved, raw, last) for b, raw, last in self.pieces[rest:]]

    def lengthened(self, first: int, nth: int, found) -> tuple[int, bytes, list[int]] | None:
        """The piece if it only continues the old one at its place: then its array is continued."""
        if first + nth < len(self.pieces):
            begin, raw, last = self.pieces[first + nth]
            now = found.group().encode()
            if begin == found.start() and last and now.startswith(raw):
                self.worked_on += len(now) - len(raw)
                whole, more = self.encoder.append(raw, last, now[len(raw) :])
                return begin, whole, [] if whole in self.encoder.ranks else more
        return None

    def ids(self) -> list[int]:
        return [i for _, raw, last in self.pieces for i in self.encoder.ids_of(raw, last)]


@lru_cache(maxsize=2)
def text_encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids as little-endian 32-bit binary, n_tokens) of every whole text of docs(doc_id, text); null text: no ids."""
    def rows(ids, texts) -> Iterator[tuple]:
        enc = text_encoder(path, pattern)
        for i, x in zip(ids, enc.encode_all([t or "" for t in texts]), strict=True):
            yield i, x.tobytes(), len(x)

    return map_texts(docs, ["doc_id", "text"], "doc_id long, ids binary, n_tokens long", rows)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of what encode returned."""

    def rows(ids, tokens) -> Iterator[tuple]:
        enc = text_encoder(path, pattern)
        for i, x in zip(ids, tokens, strict=True):
            yield i, enc.decode(np.frombuffer(x or b"", "<u4"))

    return map_texts(encoded, ["doc_id", "ids"], "doc_id long, bytes binary", rows)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode what came out, in one pass; null text: empty.

    One output row for each input row, repeated and null doc_ids included; no shuffle.
    """

    def rows(ids, texts) -> Iterator[tuple]:
        enc = text_encoder(path, pattern)
        for i, x in zip(ids, enc.encode_all([t or "" for t in texts]), strict=True):
            yield i, len(x), hashlib.sha256(enc.written(x)).hexdigest(), hashlib.sha256(enc.decode(x)).hexdigest()

    return map_texts(docs, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)


def op10_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases: see digests. Texts are encoded whole, however long, piece by piece; a piece without a break is worked on in one go."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
