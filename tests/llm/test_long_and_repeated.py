"""Scores are functions of the text alone, long texts are read in pieces with
the same result, and nothing is left in machine-local folders."""

import random
import types

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import _common, decontaminate, language, near_dedup, quality, toxicity

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ru", "te") for b in ("n", "s", "v", "r") for c in ("ar", "el", "im", "ot", "u")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Of 0 to 64 bytes, some twice side by side, and longer ones; words and
    bytes of one text occur at the end of the one before."""
    rng = random.Random(31)
    out = [None, "", " ", "good dog", "good dog", "good dog", "worthless", "worthless", "you worthless", "worthless dog", "é", "x" * 64, "x" * 64]
    for n in range(65):
        out += [("abcdefgh" * 9)[:n]] * (1 + n % 2)
    for _ in range(60):
        t = prose(rng, rng.randint(1, 200))
        out += [t, t] if rng.random() < 0.3 else [t + rng.choice(["", "\n", "  ", " again again"])]
    return out


@pytest.fixture(scope="module")
def models():
    rng = random.Random(32)
    rows = [prose(rng, rng.randint(5, 60)) + rng.choice(["", " worthless", " ### ###"]) for _ in range(300)]
    y, one = np.array([float("worth" in t or "#" in t) for t in rows]), np.ones(300)
    return {"quality": quality.train(pa.array(rows), y, one, epochs=3), "toxic": toxicity.train(pa.array(rows), y, one, epochs=3)}


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_a_score_depends_on_its_text_alone(models, texts, name):
    score = models[name].score
    alone = np.array([score(pa.array([t], pa.string()))[0] for t in texts])
    for seed in range(4):
        order = np.random.default_rng(seed).permutation(len(texts))
        got = score(pa.array([texts[k] for k in order], pa.string()))
        assert np.abs(got - alone[order]).max() < 1e-9
    by_text = {}
    for t, s in zip(texts, alone):
        assert by_text.setdefault(t or "", s) == s
    assert len({round(s, 6) for s in alone}) > 20


@pytest.mark.parametrize(("name", "size"), [("quality", 64), ("quality", 1000), ("toxic", 5000), ("toxic", 9000)])
def test_a_long_text_scores_the_same_in_pieces(models, texts, monkeypatch, name, size):
    rng = random.Random(33)
    long_ = [prose(rng, 900), " ".join(t or "" for t in texts), "w" + " " * 3000 + prose(rng, 300), "a " * 2000, "again " * 900, " " * 5000]
    want = models[name].score(pa.array(long_))
    monkeypatch.setattr(_common, "STEP_BYTES", size)
    assert np.abs(models[name].score(pa.array(long_)) - want).max() < 1e-9


def test_a_run_without_white_space_is_read_whole(models, monkeypatch):
    """Overlong words are parted; an insult behind them still counts."""
    m = models["toxic"]
    calm, insult = m.score(pa.array(["z" * 200_000, "z" * 200_000 + " worthless"]))
    assert insult > calm
    monkeypatch.setattr(_common, "STEP_BYTES", 1 << 17)
    assert np.allclose(m.score(pa.array(["z" * 200_000, "z" * 200_000 + " worthless"])), [calm, insult], atol=1e-9)


@pytest.mark.parametrize("size", [1, 3, 7, 64])
def test_words_and_trigrams_in_pieces(monkeypatch, size):
    rng = random.Random(34)
    for _ in range(150):
        t = "".join(rng.choice("abC  \n1é.É") for _ in range(rng.randint(0, 90)))
        data, at = np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])
        monkeypatch.undo()
        starts, ends, first = _common.word_bounds(data, at)
        hashes = _common.word_hashes(data, starts, ends)
        sets = _common.shingles(hashes, first)[0]
        ids, first = language.trigrams(data, at)
        x, y = language._spans(first, len(ids))
        monkeypatch.setattr(_common, "STEP_BYTES", size)
        assert np.array_equal(np.concatenate([hashes[:0], *_common.text_words(data)]), hashes)
        assert np.array_equal(_common.text_shingles(data), sets)
        assert np.array_equal(np.concatenate(list(language.text_trigrams(data))), ids[x[0] : y[0]])


def test_operators_in_pieces(spark, texts, monkeypatch):
    """Language ID, near-duplicates and decontamination, text by text."""
    rng = random.Random(35)
    items = spark.createDataFrame([(k, f"{prose(rng, 30)}. {prose(rng, 4)}.") for k in range(5)], "item_id long, text string")
    leak = [r["text"] for r in items.orderBy("item_id").collect()]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)] + [(500 + k, f"{prose(rng, 700)} {leak[k]} {prose(rng, 300)}", "en", "s") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)

    def run():
        lang = sorted((r["doc_id"], r["lang_id"], round(r["posterior"], 6)) for r in language.identify(language.document_evidence(df)).collect())
        near = sorted(map(tuple, near_dedup.near_dedup(df).collect()))
        return lang, near, sorted((r["doc_id"], r["item_id"], r["share"]) for r in decontaminate.matches(df, items).collect())

    want = run()
    assert [d for d, *_ in want[2]] == [500 + k for k in range(5)]
    # Python workers are forked from this process's code: patch what they import
    old = _common.STEP_BYTES
    monkeypatch.setattr(_common, "STEP_BYTES", 512)
    got = [language_in(df), shingles_in(texts)]
    monkeypatch.setattr(_common, "STEP_BYTES", old)
    assert got == [language_in(df), shingles_in(texts)]


def language_in(df):
    batch = pa.array([r["text"] for r in df.collect()], pa.string())
    data, at = _common.utf8_buffers(batch)
    return [np.concatenate(list(language.text_trigrams(data[i:j]))).tolist() for i, j in zip(at[:-1], at[1:])]


def shingles_in(texts):
    return [s.tolist() for s in near_dedup.text_sets(pa.array(texts, pa.string()))]


def test_decontamination_pieces_hold_every_stretch(monkeypatch):
    """Pieces of a long text: each stretch of ``reach`` words lies in one whole."""
    monkeypatch.setattr(_common, "STEP_BYTES", 1024)
    words = [f"w{k}" for k in range(2000)]
    b = pa.RecordBatch.from_pydict({"text": [" ".join(words)]})
    whole = np.concatenate([h for _, _, h, _ in decontaminate._texts(b)])
    data, at = _common.utf8_buffers(b.column("text"))
    assert np.array_equal(whole, decontaminate.words(data, at)[0])
    seen = set()
    for _, _, h, _ in decontaminate._texts(b, 50):
        seen |= {tuple(h[k : k + 50].tolist()) for k in range(len(h) - 49)}
    assert {tuple(whole[k : k + 50].tolist()) for k in range(len(whole) - 49)} <= seen


# -- the shared folder -------------------------------------------------------


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_a_shared_folder(master):
    session = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d=None: d), sparkContext=types.SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _common.shared_dir(session)


def test_clean_deletes_what_was_cut(spark):
    df = _common.cut(spark.range(3), "gone-soon")
    assert df.count() == 3
    path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    import os

    assert os.path.isdir(path) and _common.clean(spark) > 0 and not os.path.isdir(path)
    assert _common.clean(spark) == 0
