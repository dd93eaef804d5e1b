"""Quality by a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over overlapping chunks of 16 bytes (a
chunk begins every 8), and each filter's largest response over the whole
document goes through a hidden layer into one probability. Besides the bytes a
filter sees one more channel per half chunk: whether its 8 bytes occurred a
short lag before, which a linear filter over bytes can't tell.

Every text lies apart from its neighbours by more bytes than a filter or a lag
reaches, and a response is a sum of table entries in one fixed order, so a score
is a function of the text alone: the same in any batch, order and partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_rows, pieces, steps, utf8_buffers
from ._labels import in_fold, training_rows

STEP = 8
DIM = 6
FILTERS = 32
HIDDEN = 16
#: Lags, in bytes, at which a half chunk is looked for before itself.
LAGS = range(2, 33)
#: Half chunks before each text: zeros, or what comes before a piece of it. They
#: are as long as the largest lag.
GAP = 4


@dataclass
class Net:
    """Parameters by name: emb [256, DIM], fil [2, STEP * DIM, FILTERS], rep [2,
    FILTERS], off [FILTERS], w1 [FILTERS, HIDDEN], b1, w2 [HIDDEN], b2."""

    p: dict[str, np.ndarray]
    base: float

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability of each text; an empty one is scored as all padding."""
        tables = self.tables()
        data, at = utf8_buffers(column)
        best = np.empty((len(column), FILTERS), np.float32)
        for i, j in steps(at):
            text = data[at[i] : at[j]]
            if j == i + 1:
                best[i] = np.max([tables.pool(*layout(text, np.array([lo, hi]), True)[:4]) for lo, hi in pieces(len(text))], axis=0)
            else:
                best[i:j] = tables.pool(*layout(text, at[i : j + 1] - at[i])[:4])
        return self.head(best.astype(np.float64), exact=True)[0]

    def tables(self) -> Tables:
        """What each byte at each of the 16 places of a chunk adds to a filter."""
        p = self.p
        fil = p["fil"].reshape(2 * STEP, DIM, FILTERS).astype(np.float64)
        return Tables(np.einsum("bd,sdf->sbf", p["emb"].astype(np.float64), fil).astype(np.float32), p["rep"], p["off"])

    def pool(self, blocks: np.ndarray, rep: np.ndarray, first: np.ndarray, last: np.ndarray, argmax: bool = False):
        """Largest response of each filter in each text, and where it is."""
        p = self.p
        x = p["emb"][blocks].reshape(len(blocks), -1)
        a, b = x @ p["fil"][0], x @ p["fil"][1]
        a += rep[:, None] * p["rep"][0]
        a[:-1] += b[1:]
        a[:-1] += rep[1:, None] * p["rep"][1]
        where = None
        if argmax:
            where = np.stack([i + a[i:j].argmax(axis=0) for i, j in zip(first, last)])
        return _most(a, first, last) + p["off"], where

    def head(self, best: np.ndarray, exact: bool = False):
        """Probability, rectified responses, hidden layer. exact: sums in an
        order that does not depend on the number of texts."""
        p = self.p
        r = np.maximum(best, 0)
        if exact:
            h = np.tanh(sum(r[:, k, None] * p["w1"][k] for k in range(r.shape[1])) + p["b1"])
            z = sum(h[:, k] * p["w2"][k] for k in range(h.shape[1])) + p["b2"]
        else:
            h = np.tanh(r @ p["w1"] + p["b1"])
            z = h @ p["w2"] + p["b2"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), r, h


@dataclass
class Tables:
    """Folded filters: table [2 * STEP, 256, FILTERS], rep [2, FILTERS], off."""

    table: np.ndarray
    rep: np.ndarray
    off: np.ndarray

    def pool(self, blocks: np.ndarray, rep: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each text."""
        a, b = self.table[0][blocks[:, 0]], self.table[STEP][blocks[:, 0]]
        for k in range(1, STEP):
            a += self.table[k][blocks[:, k]]
            b += self.table[STEP + k][blocks[:, k]]
        on = np.flatnonzero(rep)
        a[on] += self.rep[0]
        b[on] += self.rep[1]
        a[:-1] += b[1:]
        return _most(a, first, last) + self.off


def _most(a: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Largest of the rows first[k] to last[k] - 1; spans don't touch."""
    return np.maximum.reduceat(a, np.stack([first, last], axis=1).reshape(-1), axis=0)[::2]


def layout(data: np.ndarray, at: np.ndarray, piece: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(half chunks [n, STEP] of bytes, repeat channel, first and last + 1 own
    half chunk of each text).

    Text k is data[at[k]:at[k + 1]]. Each has GAP half chunks of zeros before it
    and at least one after its last byte, so neither a chunk nor a lag reaches
    another text. With ``piece`` at names one span of the one text in data; what
    lies before and behind it in the text fills the padding.
    """
    lens = np.diff(at)
    own = -(-lens // STEP) + 1
    first = np.cumsum(own + GAP + 1) - own - 1
    total = int(first[-1] + own[-1]) + 1 if len(lens) else 0
    flat = np.zeros((GAP + total) * STEP, np.uint8)
    if piece:
        lo, hi = max(0, int(at[0]) - GAP * STEP), min(len(data), int(at[1]) + STEP)
        begin = (GAP + int(first[0])) * STEP - (int(at[0]) - lo)
        flat[begin : begin + hi - lo] = data[lo:hi]
        if at[1] < len(data):
            own = own - 1  # the half chunk behind is the next piece's own
    else:
        flat[np.arange(len(data)) + np.repeat((GAP + first) * STEP - at[:-1], lens)] = data
    here = np.frombuffer(flat.data, "<u8", total, GAP * STEP)
    seen = np.zeros(total, bool)
    for lag in LAGS:
        seen |= here == np.frombuffer(flat.data, "<u8", total, GAP * STEP - lag)
    seen &= here != 0
    return flat[GAP * STEP :].reshape(-1, STEP), seen.astype(np.float32), first, first + own


def train(texts: pa.Array, y: np.ndarray, weight: np.ndarray, epochs: int = 14, batch: int = 32, rate: float = 0.01, seed: int = 11) -> Net:
    """Adam on weighted log loss; the gradient of a maximum goes to its chunk."""
    rng = np.random.default_rng(seed)
    base = float((y * weight).sum() / weight.sum()) if len(y) else 0.5
    p = {
        "emb": rng.standard_normal((256, DIM)) * 0.3, "fil": rng.standard_normal((2, STEP * DIM, FILTERS)) * 0.2, "rep": rng.standard_normal((2, FILTERS)) * 0.5,
        "off": np.zeros(FILTERS), "w1": rng.standard_normal((FILTERS, HIDDEN)) * 0.2, "b1": np.zeros(HIDDEN), "w2": rng.standard_normal(HIDDEN) * 0.2,
        "b2": np.array(np.log(max(base, 1e-3) / max(1 - base, 1e-3))),
    }
    p = {k: np.asarray(v, np.float32) for k, v in p.items()}
    p["emb"][0] = 0
    net = Net(p, base)
    if len(set(y.tolist())) < 2:
        p["w2"] *= 0
        return net
    data, at = utf8_buffers(texts)
    parts = [layout(data[at[k] : at[k + 1]], np.array([0, at[k + 1] - at[k]])) for k in range(len(y))]
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(order), batch):
            ks = order[s : s + batch]
            blocks = np.concatenate([parts[k][0] for k in ks])
            rep = np.concatenate([parts[k][1] for k in ks])
            begin = np.cumsum([0, *(len(parts[k][0]) for k in ks[:-1])])
            first, last = begin + np.concatenate([parts[k][2] for k in ks]), begin + np.concatenate([parts[k][3] for k in ks])
            best, where = net.pool(blocks, rep, first, last, True)
            prob, r, h = net.head(best)
            g = ((prob - y[ks]) * weight[ks] / len(ks)).astype(np.float32)
            d = {"w2": h.T @ g, "b2": g.sum()}
            gh = np.outer(g, p["w2"]) * (1 - h * h)
            d |= {"w1": r.T @ gh, "b1": gh.sum(0)}
            gr = (gh @ p["w1"].T) * (best > 0)  # [texts, filters]
            d["off"] = gr.sum(0)
            nxt = np.minimum(where + 1, len(blocks) - 1)
            inside = nxt < last[:, None]
            d["rep"] = np.stack([(gr * rep[where]).sum(0), (gr * rep[nxt] * inside).sum(0)])
            d["fil"], d["emb"] = np.zeros_like(p["fil"]), np.zeros_like(p["emb"])
            for half, (w, on) in enumerate(((where, None), (nxt, inside))):
                gg = gr if on is None else gr * on
                by = blocks[w]  # [texts, filters, STEP]
                d["fil"][half] = np.einsum("tf,tfi->if", gg, p["emb"][by].reshape(*w.shape, -1), optimize=True)
                back = gg[:, :, None] * p["fil"][half].T[None]  # [texts, filters, STEP * DIM]
                for c in range(DIM):
                    d["emb"][:, c] += np.bincount(by.reshape(-1), back.reshape(*w.shape, STEP, DIM)[..., c].reshape(-1), minlength=256)
            d["emb"][0] = 0
            t += 1
            step = rate * (1 - epoch / epochs) ** 0.5
            for k in p:
                m[k] += 0.1 * (d[k] - m[k])
                v[k] += 0.001 * (d[k] ** 2 - v[k])
                p[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return net


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, rest: int = 1, threshold: float = 0.5, label: str = "quality") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Trained on a bounded sample (``_labels.PER_CLASS`` of each class) of the
    labelled rows outside the fold; a score depends on the whole text and on
    nothing else, so rows with equal texts have equal scores. Null texts score
    as empty ones; without labels every text scores 0.5. Very long texts are
    read in pieces. Other columns are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    rows, weights = training_rows(docs, labels, label, modulus, rest)
    y = rows.column("y").to_numpy().astype(np.float64)
    w = np.array([weights[int(v)] for v in y])
    net = spark.sparkContext.broadcast(train(rows.column("text").combine_chunks(), y, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.value.score(b.column(1)).astype(np.float64))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", in_fold(F.col("doc_id"), modulus, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
