import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from matchlake.llm import packing as K

PATH = P.path("word_bpe_49k.json")


def fills(rows):
    """The tokens of each sequence; pieces lie one after another."""
    out = Counter()
    for length, _, sequence, offset, times, n in sorted(rows, key=lambda r: -r[0]):
        for k in range(n):
            assert out[sequence + k // times] == offset + length * (k % times)
            out[sequence + k // times] += length
    assert sorted(out) == list(range(len(out)))
    return sorted(out.values())


def test_assign_uses_each_length_once():
    r = random.Random(3)
    for top in (16, 100, 4096):
        h = {r.randint(1, top): r.randint(1, 50) for _ in range(60)}
        used, rows = Counter(), K.assign(h, top)
        for length, first, _, _, _, n in sorted(rows):
            assert first == used[length] and n > 0
            used[length] += n
        assert used == Counter(h) and max(fills(rows)) <= top
    assert K.assign({}) == []


def strict(histogram, top):
    """Shortest-pack-first, a piece at a time: the sorted fills of the sequences."""
    open_ = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            i = min(range(len(open_)), key=open_.__getitem__, default=None)
            if i is None or open_[i] + length > top:
                open_.append(0)
                i = len(open_) - 1
            open_[i] += length
    return sorted(open_)


def test_assign_as_strict_shortest_pack_first():
    r = random.Random(5)
    for top in (7, 16, 100):
        for _ in range(60):
            h = {r.randint(1, top): r.randint(1, 40) for _ in range(r.randint(1, 12))}
            assert fills(K.assign(h, top)) == strict(h, top)


def packed(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        end = 0
        for offset, length in sorted(v):
            assert offset == end
            end += length
        assert end <= K.MAX_TOKENS
    assert sorted(by) == list(range(len(by)))
    return by


def test_pack(spark, sf_dir):
    r = random.Random(4)
    texts = [None, "", " ", "don't STOP\tnow\x0bÉté ΑΣ Σ", "word " * 9000, "x" * 20000, "a b c", "a b c", "<|endoftext|> hi", "漢字 🎉"]
    texts += [" ".join(r.choices(["the", "Éa", "9!", "q" * 7], k=r.randint(1, 3000))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "z"), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as length", "1 as offset")
    got = K.pack(df, PATH).collect()
    tok, want = Tokenizer.from_file(PATH), Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        for s in range(0, len(ids), 4096):
            want[i, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()), len(ids)] += 1
    assert Counter((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in got) == want
    packed(got)
    assert K.pack(df.where("1=0"), PATH).count() == 0


def test_query_has_little_padding(spark, sf_dir):
    got = K.op3_packing(spark, sf_dir).collect()
    by = packed(got)
    total = sum(x.length for x in got)
    pad = sum(0 if (n := sum(b for _, b in v)) & (n - 1) == 0 else 4096 - n for v in by.values())
    assert pad < 0.02 * total + 4096


def test_words_as_tokenizer():
    r, tok = random.Random(7), Tokenizer.from_file(PATH)
    parts = ["the", "Éa", "9!", "'s", "'LL", " ", "\n", "\t", "<|", "endoftext", "|>", "ß", "\xa0", "\xad", "²", "ª", "µ", "Σ", "İ", "e\u0301", "漢", "🎉", "ÿ", "\x85", "\x1c", "_", "Dž"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(3000)]
    for t, code in zip(texts, K.WordCodes(PATH).encode_all(texts), strict=True):
        assert np.frombuffer(code, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t
