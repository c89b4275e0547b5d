"""9. Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text, which recognises all its substrings. A text is parsed into phrases, each the
longest match that starts where the last one ended; the language that needs fewest phrases, normalised by the logarithm of its
labelled text's length, wins. A task runs many texts in all automata at once: texts are laid out in windows side by side, and each
step moves every window by one byte in one numpy lookup. A phrase ends with its window, which adds one per window to each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold, map_texts, parts_of, stored, table

#: Labelled text: at most so many bytes of each language, from so many documents. More than 100 languages share the bytes of 100, with
#: FEWEST at least of each; none is left out. The only sample; predictions read whole texts. A byte takes some 500 in an automaton.
BYTES_PER_LANGUAGE, FEWEST = 14_000, 500
DOCUMENTS_PER_LANGUAGE = 64
#: Up to so many rows that name labelled documents are broadcast, some 5 MB.
BROADCAST_ROWS = 100_000
#: Bytes parsed without a break; windows of all languages that are parsed at once.
WINDOW, AT_ONCE = 1024, 1 << 19
#: This bit of a state tells that a phrase ended.
ENDED = 1 << 31
LETTER = regex.compile(r"\p{L}")
#: Signs and digits say nothing about the language.
SIGNS = bytes(b for b in range(128) if not chr(b).isalpha() and b != 32)


def letters_of(text: str) -> bytes:
    """text in lower case, without ASCII characters other than letters and single blanks."""
    return text.lower().replace("\n", " ").encode().translate(None, SIGNS).replace(b"  ", b" ")


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """The transitions of each state of the automaton that accepts just the substrings of text; state 0 is the start."""
    moves, link, longest, last = [{}], [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        at, last = last, new
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at < 0:
            continue
        to = moves[at][c]
        if longest[to] == longest[at] + 1:
            link[new] = to
            continue
        copy = len(moves)
        moves.append(dict(moves[to]))
        link.append(link[to])
        longest.append(longest[at] + 1)
        link[to] = link[new] = copy
        while at >= 0 and moves[at].get(c) == to:
            moves[at][c] = copy
            at = link[at]
    return moves


@dataclass
class Languages:
    """Automata of all languages as one table: move[base[l] + state * width + class of the byte] has the next state below the
    highest of 32 bits; that bit tells that a phrase ended and the next began with this byte."""

    names: list[str]
    classes: np.ndarray
    width: int
    base: np.ndarray
    move: np.ndarray
    weight: np.ndarray

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases needed, for each text and language. Whatever the texts' lengths, AT_ONCE windows are held at a time."""
        out = np.zeros((len(texts), len(self.names)))
        most, held = max(1, AT_ONCE // max(1, len(self.names))), []
        for i, t in enumerate(texts):
            for s in range(0, len(t), WINDOW):
                held.append((i, t[s : s + WINDOW]))
                if len(held) == most:
                    self.add_phrases(held, out)
                    held = []
        if held:
            self.add_phrases(held, out)
        return out

    def add_phrases(self, windows: list[tuple[int, bytes]], out: np.ndarray) -> None:
        """Adds the phrases of windows to the rows of out that they belong to."""
        owner, sizes = np.array([i for i, _ in windows]), np.array([len(w) for _, w in windows], np.int64)
        order = np.argsort(-sizes, kind="stable")
        data = self.classes[np.frombuffer(b"".join(w for _, w in windows), np.uint8)]
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])[order]
        sizes = sizes[order]
        live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(WINDOW), "right")  # windows longer than each step
        state = np.zeros((len(self.names), len(sizes)), np.int64)
        count = np.ones((len(self.names), len(sizes)), np.uint32)
        base = self.base[:, None]
        for step in range(int(sizes[0])):
            n = live[step]
            at = state[:, :n] * self.width
            at += base
            at += data[begins[:n] + step]
            got = self.move[at]
            count[:, :n] += got >> np.uint32(31)
            state[:, :n] = got & np.uint32(ENDED - 1)
        np.add.at(out, owner[order], count.T)


def learn(samples: list[tuple[str, bytes]]) -> Languages:
    """samples: a name and its labelled text, already lowered, for each language."""
    used = sorted({b for _, t in samples for b in t})
    classes = np.zeros(256, np.uint8)
    classes[used] = np.arange(1, len(used) + 1)
    width, tables = len(used) + 1, []
    for _, t in samples:
        moves = suffix_automaton(t)
        x = np.zeros((len(moves) + 1, width), np.uint32)
        for state, to in enumerate(moves):
            for c, s in to.items():
                x[state, classes[c]] = s
        # where no longer match goes on, the phrase ends and the byte begins the next; an unknown byte is a phrase, after which the
        # last state waits for the next one
        x[0] = np.where(x[0] == 0, len(moves), x[0])
        x[1:] = np.where(x[1:] == 0, x[0] | np.uint32(ENDED), x[1:])
        tables.append(x)
    sizes = [x.size for x in tables]
    return Languages([n for n, _ in samples], classes, width, np.cumsum([0, *sizes[:-1]]), np.concatenate([x.ravel() for x in tables]) if tables else np.zeros(0, np.uint32), np.array([np.log2(max(2, len(t))) for _, t in samples]))


def sample(docs: DataFrame, folds: int = 3, held_out: int | None = 1, bytes_per_language: int = BYTES_PER_LANGUAGE, documents_per_language: int = DOCUMENTS_PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """Labelled text of each language: documents_per_language documents, in the order of a hash of doc_id, and of each as much as their
    number asks for, in four parts at hashed places. A lang that is null doesn't count, nor does a document without letters. All languages
    count; see FEWEST. Of rows that repeat a doc_id, one."""
    ok = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull())
    if held_out is not None:
        ok = ok.where(fold("doc_id", folds) != held_out)
    ids = stored(ok.groupBy("lang", "doc_id").agg(F.count("*").alias("rows")))
    most = stored(ids.groupBy("lang").agg(F.count("*").alias("n_docs")))
    languages = most.count()
    bytes_per_language = max(min(bytes_per_language, FEWEST), min(bytes_per_language, 100 * bytes_per_language // max(1, languages)))
    first = ids.join(most, "lang").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("n") <= documents_per_language)
    need = F.ceil(F.lit(1.5 * bytes_per_language / 4) / F.least("n_docs", F.lit(documents_per_language))).cast("int")
    first = first.select(F.col("lang").alias("l"), F.col("doc_id").alias("d"), "n", need.alias("need"))
    # languages * documents_per_language rows: broadcast while that is bounded, else texts are shuffled to them
    first = F.broadcast(first) if languages * documents_per_language <= BROADCAST_ROWS else first
    mine = ok.join(first, (F.col("lang") == F.col("l")) & (F.col("doc_id") == F.col("d")))
    parts: dict[str, list[bytes]] = {}
    for r in mine.groupBy("lang", "n").agg(F.min(parts_of(F.col("text"), F.col("doc_id"), 4, F.col("need"))).alias("part")).orderBy("lang", "n").collect():
        parts.setdefault(r.lang, []).append(letters_of(r.part))
    out = []
    for lang in sorted(parts):
        share = bytes_per_language // len(parts[lang])
        text = b" ".join(p[: max(share, 1)] for p in parts[lang])
        if len(text) < bytes_per_language:  # short documents leave room
            text = b" ".join(parts[lang])
        out.append((lang, text[:bytes_per_language]))
    return out


def predict(docs: DataFrame, languages: Languages) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs(doc_id, text): score is the winner's share of the inverse entropies.

    A null text, one without a letter (empty ones too) or no languages at all: 'und' with score 0. Ties: the first name.
    """
    at = docs.sparkSession.sparkContext.broadcast(languages)

    def rows(ids, texts) -> Iterator[tuple]:
        m = at.value
        texts = [t if t and m.names and LETTER.search(t) else "" for t in texts]
        cost = (m.phrases([letters_of(t) for t in texts]) + 1e-9) * m.weight
        for i, t, c in zip(ids, texts, cost, strict=True):
            if not t:
                yield i, "und", 0.0
                continue
            best = int(c.argmin())
            yield i, m.names[best], float((1 / c[best]) / (1 / c).sum())

    return map_texts(docs, ["doc_id", "text"], "doc_id long, lang_pred string, score double", rows)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases: see predict and sample. Texts are parsed whole, however long, in bounded numbers of windows; copies are predicted alike."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    got = predict(docs, learn(sample(docs)))
    return got.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
