"""What the search of op9 adds up, looks up and verifies."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from marlstone.llm import _common, decontaminate


class Here:
    """As much of a table as the search asks of it, run in this process."""

    def __init__(self, texts):
        self.sparkSession = self.sparkContext = self
        self.table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})

    def broadcast(self, value):
        return type("Held", (), {"value": value})

    def select(self, *_):
        return self

    def mapInArrow(self, f, _):
        self.out = list(f(iter(self.table.to_batches(max_chunksize=100))))
        return self

    def groupBy(self, _):
        return self

    def applyInArrow(self, f, _):
        blocks = {}
        for b in self.out:
            blocks.setdefault(b.column("block")[0], []).append(b)
        self.out = [x for k, v in blocks.items() for x in f((k,), iter(v))]
        return self

    def collect(self):
        return [r for b in self.out for r in b.to_pylist()]


def test_candidates_without_a_rare_word_of_their_item_are_not_verified(monkeypatch):
    verified = []

    class Counted(Counter):
        def keys(self):
            verified.append(1)
            return super().keys()

    monkeypatch.setattr(decontaminate, "Counter", Counted)
    docs, bench = (pq.read_table(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "benchmark"))
    texts = docs.column("text").to_pylist()
    found = decontaminate._search(Here(texts), bench.column("item_id").to_pylist(), bench.column("text").to_pylist()).collect()
    assert found and len(verified) < len(texts)  # was 2.8 a text


def test_sums_of_runs():
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((50, 7))
    for n, heads in ((500, [0, 1, 40, 41, 300]), (1, [0]), (64, [0, 32]), (33, [0]), (0, [])):
        index, heads = rng.integers(0, 50, n), np.array(heads, np.int64)
        got = decontaminate._sums(rows, index, heads)
        want = [rows[index[a:b]].sum(axis=0) for a, b in zip(heads, [*heads[1:], n])]
        assert got.shape == (len(heads), 7) and (not len(heads) or np.allclose(got, want))


def test_rows_of_passages():
    rng = np.random.default_rng(2)
    rows = rng.standard_normal((30, 5))
    first = np.cumsum([0, 3, 0, 100, 16, 33, 32, 1, 250])
    at = np.sort(rng.choice(first[-1], 170, replace=False))
    t = rng.integers(0, 30, len(at))
    text, a, e = decontaminate.passages(first)
    for on in (np.arange(len(a)), np.arange(0, len(a), 3), np.array([len(a) - 1])):
        got = decontaminate._rows_of(rows, first, at, t, text[on], a[on], e[on])
        assert np.allclose(got, [rows[t[(at >= x) & (at < y)]].sum(axis=0) for x, y in zip(a[on], e[on])])


def test_words_that_share_their_bits_are_found():
    bits = np.uint64(1) << np.uint64(44)
    known = np.array([k * bits + np.uint64(j) for k in (3, 9, (1 << 20) - 1) for j in (0, 5, 1 << 43)], np.uint64)
    other = known + np.uint64(1)
    words = np.concatenate([other, known[::-1], other, known])
    at, k = decontaminate.Vocabulary(known).find(words)
    want = [i for i, w in enumerate(words.tolist()) if w in set(known.tolist())]
    assert at.tolist() == want and np.array_equal(np.sort(known)[k], words[want])


@pytest.mark.parametrize("size", [1, 7, 1 << 19])
def test_spans_that_hold_a_word_of_their_item(monkeypatch, size):
    monkeypatch.setattr(_common, "STEP_BYTES", size)
    rng = np.random.default_rng(4)
    terms, rarest = rng.integers(0, 20, 100), np.unique(rng.integers(0, 60, 9))
    lo = rng.integers(0, 100, 80)
    hi, base = np.minimum(lo + rng.integers(0, 6, 80), 100), 20 * rng.integers(0, 3, 80)
    want = [k for k in range(80) if np.isin(terms[lo[k] : hi[k]] + base[k], rarest).any()]
    assert decontaminate._holding(rarest, terms, lo, hi, base).tolist() == want
    assert not len(decontaminate._holding(rarest, terms, lo[:0], hi[:0], base[:0]))
