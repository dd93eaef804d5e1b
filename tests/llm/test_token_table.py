"""The encoder's table of words, and texts longer than a part."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from marlstone.llm import token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return lambda t: [*tok.encode(t, add_special_tokens=False).ids, 0]


def check(e, texts, plain):
    ids, lens = e.encode(texts)
    want = [plain(t) for t in texts]
    assert lens.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_whole_text_ids(plain):
    rng = random.Random(5)
    parts = ["a", "b1", "Ab,", "x.", "é.", "naïve,", "\U0001f600", "7,", "it's", ".", ",", "12345678", "123456789", "sixteen-bytes-16", "seventeen-byte-17", "日本語", "q" * 40]
    gaps = [" "] * 30 + ["\n", "\n\n", "  ", " \n", "\n ", "\t", "\r\n", "\0", "\x1c", "\x85", "\xa0", "\u1680", "\u2000", "\u200a", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "\u2019", "\xc2", "\u2060"]
    e = token_store.Encoder(PATH, 0)
    for n in (1, 3, 40):
        for size in (0, 1, 2, 6, 30):
            check(e, ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(size)).strip(rng.choice(" ab")) for _ in range(n)], plain)
    check(e, ["", "", " ", "a", "", " a", "a ", "\n", "a\n", "\na b", "b a\0 c", "b a\0 c a", ""], plain)
    assert e.encode([])[0].tolist() == []


def test_words_of_one_hash_are_told_apart(plain, monkeypatch):
    monkeypatch.setattr(token_store, "_scatter", lambda lo, hi: lo & np.uint64(1))
    e = token_store.Encoder(PATH, 0)
    check(e, [" ".join(f"word{k}" for k in range(60))], plain)
    check(e, [" ".join(f"word{k}" for k in range(70, 0, -1))], plain)


def test_table_grows_and_frequent_words_stay(plain, monkeypatch):
    monkeypatch.setattr(token_store, "PIECES", 150_000)
    monkeypatch.setattr(token_store, "NEAR", 1_000)
    e = token_store.Encoder(PATH, 0)
    frequent = " ".join(f"f{k}" for k in range(900))
    check(e, [f"x {frequent}"], plain)
    for part in range(4):
        check(e, ["y " + " ".join(f"w{part}x{k}" for k in range(45_000))], plain)
    sent, ids = [], e._ids
    monkeypatch.setattr(e, "_ids", lambda texts: sent.extend(texts) or ids(texts))
    e._clear()
    check(e, [f"x {frequent}"], plain)
    assert sent == ["x"]  # the dictionary alone begins anew


def test_known_words_are_not_encoded_again(plain, monkeypatch):
    e, text = token_store.Encoder(PATH, 0), "on the one hand, and on the other; sixteen-bytes-16 naïve"
    check(e, [text], plain)
    monkeypatch.setattr(e, "_ids", None)
    check(e, [text] * 3, plain)


def test_a_file_with_a_text_longer_than_a_part(spark, tmp_path, plain):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(500_000))
    assert len(long) > token_store.PART
    rows = [(1, "first"), (2, long), (3, None), (4, "last one")]
    token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/t", PATH, files=1)
    at = 0
    got = sorted(token_store.read_tokens(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r["doc_id"])
    assert len(got) == 4
    for (d, t), r in zip(rows, got):
        ids = np.array(plain(t or ""), "<u4")
        assert tuple(r) == (d, at, len(ids), zlib.crc32(ids))
        at += len(ids)
