"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's bag holds the hashed byte n-grams of the lower-cased word with its two
edges. Embeddings and softmax are trained jointly, so a
misspelling that no text had shares most of its n-gram vectors with the word.
A text is read in overlapping windows that cover all of it; each window's bag is
averaged and goes through the softmax, and the text's probability is that of
its most toxic window: one insult in a long text counts as in a short one. In
training, a toxic text teaches by its most toxic window, any other by its most
toxic and a random one.

As the softmax is linear, embedding times weight is folded to one number per
bucket for scoring; averaging these numbers gives the same logit. A window's sum
runs over its own entries alone, so a score is a function of the text: the same
in any batch, order and partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common
from ._common import LOWER, SEPARATOR, arrow_rows, steps, utf8_buffers, word_hashes
from ._labels import in_fold, training_rows

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 17
DIM = 8
WINDOW = 40
#: Null entries in every bag: a window of a few subwords says less.
NULLS = 60
#: A run of more bytes without white space counts as several words of this size.
WORD = 1024
_MULT = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263, 374761393, 1610612741)]


def subwords(data: np.ndarray, at: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """(word starts, positions per n-gram size, buckets per size, first word of
    each text, place in data of each word).

    The texts are laid out with one separator before, between and after; an
    n-gram may have a separator at its edges alone. A word that repeats one of
    the four words before it in its text adds nothing: a bag is about which
    words occur.
    """
    n = len(at) - 1
    size = len(data) + n + 1
    flat = np.full(size, 32, np.uint8)
    dest = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(at))
    flat[dest] = LOWER[data]
    sep = SEPARATOR[flat]
    flat[sep] = 32
    starts, ends = _words(sep)
    edge = at + np.arange(n + 1)
    place = starts - 1 - (np.searchsorted(edge, starts, "left") - 1)
    if len(starts) and (ends - starts).max() > WORD:
        # separators within overlong words, each WORD bytes further
        more = -(-(ends - starts) // WORD) - 1
        k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        where = np.repeat(starts, more) + (k + 1) * WORD
        place = np.sort(np.concatenate([place, np.repeat(place, more) + (k + 1) * WORD]))
        flat = np.insert(flat, where, 32)
        edge = edge + np.searchsorted(where, edge, "left")
        size, sep = len(flat), flat == 32
        starts, ends = _words(sep)
    wide = flat.astype(np.uint32)
    inner = np.cumsum(sep, dtype=np.int32)
    words = word_hashes(flat, starts, ends)
    first = np.searchsorted(starts, edge)
    nth = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))  # place in its text
    again = np.zeros(len(words), bool)
    for lag in range(1, 5):
        again[lag:] |= (words[lag:] == words[:-lag]) & (nth[lag:] >= lag)
    mark = np.zeros(size + 1, np.int8)
    mark[starts[again] - 1] += 1
    mark[ends[again]] -= 1
    repeated = np.cumsum(mark[:-1], dtype=np.int8) > 0
    positions, ids = [], []
    for k in SIZES:
        if size < k:
            positions.append(np.zeros(0, np.int64))
            ids.append(np.zeros(0, np.int64))
            continue
        m = size - k + 1
        h = np.full(m, k * 7919, np.uint32)
        for j in range(k):
            h ^= wide[j : j + m] * _MULT[j]
            h *= np.uint32(16777619)
        h ^= h >> np.uint32(15)
        ok = inner[k - 2 : k - 2 + m] == inner[:m]  # no separator strictly inside
        ok &= ~repeated[:m]
        pos = np.flatnonzero(ok)
        positions.append(pos)
        ids.append((h[pos] & np.uint32(buckets - 1)).astype(np.int64))
    return starts, positions, ids, first, place


def _words(sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(sep[:-1] & ~sep[1:]) + 1, np.flatnonzero(~sep[:-1] & sep[1:]) + 1


def windows(first: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, last word + 1) of windows that cover every word, each
    half a width further; a text without words has none."""
    half = width // 2
    words = np.diff(first)
    count = np.where(words > 0, np.maximum(1, -(-(words - width) // half) + 1), 0)
    text = np.repeat(np.arange(len(words)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    a = first[:-1][text] + k * half
    return text, a, np.minimum(a + width, first[1:][text])


@dataclass
class Softmax:
    """Folded model: a bucket's number and the bias."""

    table: np.ndarray
    bias: float
    base: float

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability of each text; a text without words has the base rate."""
        data, at = utf8_buffers(column)
        best = np.full(len(column), -np.inf)
        for i, j in steps(at):
            part = data[at[i] : at[j]]
            if j == i + 1 and len(part) > _common.STEP_BYTES:
                best[i] = self._long(part)
            else:
                text, z, _, _, _ = self._logits(part, at[i : j + 1] - at[i])
                np.maximum.at(best, i + text, z)
        return np.where(best > -np.inf, 1 / (1 + np.exp(-np.clip(best, -30, 30))), self.base)

    def _logits(self, data: np.ndarray, at: np.ndarray):
        """(text, logit, first word, last word + 1) of every window, and the
        place of each word."""
        starts, positions, ids, first, place = subwords(data, at, len(self.table))
        text, a, b = windows(first)
        # an n-gram belongs to the word that it starts in; its left edge is one before
        edges = np.append(starts - 1, np.iinfo(np.int64).max)
        sums, counts = np.zeros(len(text)), np.zeros(len(text), np.int64)
        spans = np.stack([a, b], axis=1).reshape(-1)
        for pos, bucket in zip(positions, ids):
            where = np.searchsorted(pos, edges)[spans]
            if len(where):
                own = np.add.reduceat(np.append(self.table[bucket], 0.0), where)[::2]
                n = np.diff(where)[::2]
                sums += np.where(n > 0, own, 0.0)
                counts += n
        return text, self.bias + sums / (counts + NULLS), a, b, place

    def _long(self, data: np.ndarray) -> float:
        """The largest logit of a long text, a piece at a time. A piece begins
        with a window of the text, one before the first that is new: that one
        gives the words before which a word may repeat."""
        gap = SEPARATOR[data]
        data = data[~(gap & np.concatenate(([True], gap[:-1])))]  # runs of separators as one
        lo, best, new = 0, -np.inf, 0
        while True:
            hi = min(lo + _common.STEP_BYTES, len(data))
            _, z, _, last, place = self._logits(data[lo:hi], np.array([0, hi - lo]))
            if hi == len(data):
                return max(best, z[new:].max(initial=-np.inf))
            whole = int(np.searchsorted(last, len(place) - 1, "right"))  # the last word may go on
            if whole < 2:
                raise ValueError("STEP_BYTES must hold two windows of words")
            best = max(best, z[new:whole].max(initial=-np.inf))
            lo, new = lo + int(place[(whole - 1) * (WINDOW // 2)]), 1


def train(texts: pa.Array, y: np.ndarray, weight: np.ndarray, buckets: int = BUCKETS, dim: int = DIM, epochs: int = 12, batch: int = 128, rate: float = 0.3, seed: int = 3) -> Softmax:
    """Joint training by Adagrad. Memory: the buckets of the sampled texts."""
    base = float((y * weight).sum() / weight.sum()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return Softmax(np.zeros(buckets), float(np.log(max(base, 1e-3) / max(1 - base, 1e-3))), base)
    data, at = utf8_buffers(texts)
    bags, owner, base_at = [], [], 0
    for i, j in steps(at):
        starts, positions, ids, first, _ = subwords(data[at[i] : at[j]], at[i : j + 1] - at[i], buckets)
        text, a, b = windows(first)
        edges = np.append(starts - 1, np.iinfo(np.int64).max)
        cuts = [np.searchsorted(p, edges) for p in positions]
        for t, x, z in zip(text.tolist(), a.tolist(), b.tolist()):
            bags.append(np.concatenate([d[c[x] : c[z]] for d, c in zip(ids, cuts)]).astype(np.int32))
            owner.append(i + t)
    owner = np.array(owner)
    begin = np.searchsorted(owner, np.arange(len(y) + 1))
    rng = np.random.default_rng(seed)
    e = (rng.standard_normal((buckets, dim)) * 0.1).astype(np.float32)
    w = (rng.standard_normal((dim, 2)) * 0.1).astype(np.float32)
    bias = np.array([0.0, np.log(base / (1 - base))], np.float32)
    ge, gw, gb = np.full(buckets, 1e-6, np.float32), np.full_like(w, 1e-6), np.full_like(bias, 1e-6)
    some = np.flatnonzero(np.diff(begin) > 0)
    for epoch in range(epochs):
        fold = (e @ (w[:, 1] - w[:, 0])).astype(np.float32)
        chosen = []
        for d in some.tolist():
            lo, hi = int(begin[d]), int(begin[d + 1])
            if epoch == 0:
                chosen += rng.integers(lo, hi, 2).tolist()
            else:
                best = lo + int(np.argmax([fold[bags[k]].sum() / (len(bags[k]) + NULLS) for k in range(lo, hi)]))
                chosen += [best] if y[d] else [best, int(rng.integers(lo, hi))]
        order = rng.permutation(len(chosen))
        for s in range(0, len(order), batch):
            ks = [chosen[o] for o in order[s : s + batch]]
            ks = [k for k in ks if len(bags[k])]
            if not ks:
                continue
            ids = np.concatenate([bags[k] for k in ks])
            lens = np.array([len(bags[k]) for k in ks])
            d = owner[ks]
            mean = np.add.reduceat(e[ids], np.cumsum(lens) - lens, axis=0) / (lens + NULLS)[:, None]
            z = mean @ w + bias
            p = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -30, 30)))
            g = ((p - y[d]) * weight[d]).astype(np.float32)
            delta = w[:, 1] - w[:, 0]
            dw = mean.T @ np.stack([-g, g], 1) / len(ks)
            db = np.array([-g.sum(), g.sum()], np.float32) / len(ks)
            de = np.bincount(ids, np.repeat(g / (lens + NULLS), lens), minlength=buckets).astype(np.float32) / len(ks)
            hit = np.flatnonzero(de)
            ge[hit] += de[hit] ** 2
            e[hit] -= rate * (de[hit] / np.sqrt(ge[hit]))[:, None] * delta
            gw += dw**2
            gb += db**2
            w -= 0.1 * dw / np.sqrt(gw)
            bias -= 0.05 * db / np.sqrt(gb)
    return Softmax((e @ (w[:, 1] - w[:, 0])).astype(np.float64), float(bias[1] - bias[0]), base)


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, rest: int = 2, threshold: float = 0.3, label: str = "toxic") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Trained on a bounded sample (``_labels.PER_CLASS`` of each class) of the
    labelled rows outside the fold; a score depends on the text alone, so rows
    with equal texts have equal scores. Empty and null texts score the base rate
    of the training rows; without labels every text scores 0.5. Very long texts
    are read in pieces, and a run of more than ``WORD`` bytes without white space
    counts as several words. Other columns are not read; an empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    rows, weights = training_rows(docs, labels, label, modulus, rest)
    y = rows.column("y").to_numpy().astype(np.float64)
    w = np.array([weights[int(v)] for v in y])
    model = spark.sparkContext.broadcast(train(rows.column("text").combine_chunks(), y, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.score(b.column(1)))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", in_fold(F.col("doc_id"), modulus, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
