import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken

from matchlake.llm import prefix_bpe as B

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
PLAIN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", " ", "Hello world's  end\n\n", "aaaaaaaaaaaaaaaaaaaaaaaaa", "été ç ß ünïcode 漢字 🎉🎉 ́", "<|endoftext|>", "x" * 3000 + "\t" * 500, "a\x00b\x1f", "don't WE'LL 12345678901234567890 $$$###"]


def texts():
    r = random.Random(5)
    made = ["".join(r.choices(["th", "er", "ing", "e", " ", "é", "ß", "漢", "\n", "A", "9", "'s", "zz", "🎉"], k=r.randint(0, 60))) for _ in range(1500)]
    return TEXTS + made


def test_as_tiktoken():
    enc = B.TextEncoder(PATH, P.PATTERN)
    for t, ids in zip(texts(), enc.encode_all(texts()), strict=True):
        assert ids.tolist() == PLAIN.encode_ordinary(t), t
        assert enc.decode(ids) == enc.encoder.decode(ids.tolist()) == t.encode()
        assert enc.written(ids).decode() == " ".join(map(str, ids))


def test_append_and_edit():
    e, r = B.encoder(PATH), random.Random(6)
    for _ in range(300):
        a, b = (bytes(r.choices(b"therinaos ", k=r.randint(1, 25))) for _ in range(2))
        last = e.extend(a, [])
        whole, more = e.append(a, last, b)
        assert e.ids_of(whole, more) == PLAIN._encode_single_piece(whole) and len(last) == len(a)
        at = r.randint(0, len(a))
        edited, again = e.replace(a, last, at, min(len(a), at + 2), b)
        assert e.ids_of(edited, again) == PLAIN._encode_single_piece(edited)


def test_query(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (99, None), (1, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'a' as n_tokens", "'b' as ids_sha256")
    got = sorted(map(tuple, B.digests(df, PATH, P.PATTERN).collect()), key=str)
    want = []
    for i, t in rows:
        ids = PLAIN.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert B.digests(df.where("1=0"), PATH, P.PATTERN).count() == 0
    back = B.decode(B.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).where("doc_id = 2").collect()
    assert bytes(back[0].bytes) == TEXTS[2].encode()


def test_edits_stop_where_the_arrays_agree_again():
    e, r = B.encoder(PATH), random.Random(8)
    for _ in range(200):
        a, b = (bytes(r.choices(b"therinaos xq", k=k)) for k in (r.randint(1, 900), r.randint(0, 9)))
        last, at = e.extend(a, []), r.randint(0, len(a))
        edited, again = e.replace(a, last, at, min(len(a), at + r.randint(0, 5)), b)
        assert again == e.extend(edited, [])


def test_texts_append_and_edit():
    r, alphabet = random.Random(9), ["the", "ing", " ", "  ", "\n", "é", "漢", "'s", "7", "$", "x" * 70, "A"]
    words = lambda n: "".join(r.choices(alphabet, k=n))
    for _ in range(150):
        text = words(r.randint(0, 60))
        now = B.EncodedText(B.encoder(PATH), P.PATTERN, text)
        for _ in range(4):
            start = r.randint(0, len(text))
            end, by = min(len(text), start + r.randint(0, 6)), words(r.randint(0, 4))
            if r.random() < 0.4:
                start = end = len(text)
                now.append(by)
            else:
                now.edit(start, end, by)
            text = text[:start] + by + text[end:]
            assert now.text == text and now.ids() == PLAIN.encode_ordinary(text), (text, start, end, by)


def test_an_edit_works_on_its_surroundings_only():
    text = " ".join(f"word{i}" for i in range(20_000))
    now = B.EncodedText(B.encoder(PATH), P.PATTERN, text)
    before = now.worked_on
    now.edit(60_000, 60_003, "abc de")
    now.append("more")
    assert now.worked_on - before < 100 and now.ids() == PLAIN.encode_ordinary(now.text)


def test_long_pieces_are_forgotten():
    enc = B.TextEncoder(PATH, P.PATTERN)
    long_ = "x" * 5000 + " short"
    assert [x.tolist() for x in enc.encode_all([long_, long_])] == [PLAIN.encode_ordinary(long_)] * 2
    assert set(enc.known) == {" short"}
