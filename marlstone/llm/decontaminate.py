"""Benchmark decontamination by latent semantic retrieval.

1. Passages: windows of words that cover every document. TF-IDF over the words
   that the benchmark has (no other word can add to a match); document
   frequencies are counted over all documents.
2. Latent space: a randomised decomposition of all passages, side by side.
   One pass gives Z = C'CO for the counts C and a fixed random O: each task adds
   up its own rows of Z, and the sum runs as a grouped aggregation over blocks
   of terms. With D the diagonal of inverse document frequencies, known only
   after that pass, X = CD and X'X(O/D) = DZ; from DZ and (O/D)'DZ = O'Z follow
   the leading right singular vectors and values of X (the one-pass scheme for
   positive matrices, applied to X'X).
3. Candidates: cosine between overlapping passages and benchmark items, item
   block by item block, without a cap. The leading directions (topics, function
   words) are damped to the level of the last one kept; what lies outside of
   them enters by a random projection.
4. Verification on the words themselves: longest common subsequence of the item
   and the passage with margins. A long one is a leak; a shorter one is a
   paraphrase and a leak only if the item's answer (its last sentence) is found.

A match at the least share holds one of the rarest words of its item, so a
passage is compared if such a word of any item lies in it or within the reach of
the words that verification looks at, and a candidate is verified if one of its
own item does; what is skipped holds no match. The cosine cut can
lose one: the tests measure its recall against all positions of all texts.
A large benchmark is searched part by part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common
from ._common import LOWER, SEPARATOR, arrow_rows, cut, small, steps, text_words, utf8_buffers, word_bounds, word_hashes

#: Directions kept, columns of the sketch, columns for what lies outside.
RANK, SKETCH, OUTSIDE = 16, 24, 48
#: Words of a passage and between passages; margin of words in verification.
WINDOW, STRIDE, MARGIN = 32, 16, 12
#: Least cosine of a candidate.
COSINE = 0.4
#: Share of the item's words in the common subsequence: a leak, a paraphrase;
#: share of the answer's words that a paraphrase must hold.
EXACT, PARAPHRASE, ANSWER = 0.75, 0.6, 0.75
#: Item windows in one block of the search; items in one part of the benchmark
#: (what a part broadcasts is bounded by it); terms in one block of the sum.
BLOCK, PART, BLOCK_ROWS = 1024, 20_000, 1024

#: Letters and digits make words; ASCII punctuation parts them.
_FOLD = LOWER.copy()
_FOLD[:128][~np.array([chr(c).isalnum() for c in range(128)])] = 32
_FOLD[SEPARATOR] = 32


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII punctuation as spaces and Latin letters, those of Latin-1
    too, in lower case."""
    data = _FOLD[data]
    upper = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = upper[(data[upper] >= 0x80) & (data[upper] <= 0x9E) & (data[upper] != 0x97)]
    data[upper] += 0x20
    return data


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit word hashes, first word of each text); punctuation and case don't
    count."""
    data = fold(data)
    starts, ends, first = word_bounds(data, at)
    return word_hashes(data, starts, ends), first


def passages(first: np.ndarray, width: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, last word + 1) of windows that cover every word."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, -(-(n - width) // stride) + 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    a = first[:-1][text] + k * stride
    return text, a, np.minimum(a + width, first[1:][text])


class Vocabulary:
    """Words of the benchmark by index; words of texts are found by a table of
    20 bits of the hash, then by the whole hash."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.gate = np.zeros(1 << 20, bool)
        at = (self.hashes >> np.uint64(44)).astype(np.int64)
        self.gate[at] = True
        self.some = np.zeros(1 << 20, np.int32)  # one of the words of these bits
        self.some[at] = np.arange(len(at))

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of known words, their indices)."""
        bits = (h >> np.uint64(44)).astype(np.int64)
        at = np.flatnonzero(self.gate[bits])
        h, k = h[at], self.some[bits[at]].astype(np.int64)
        same = self.hashes[k] == h
        other = np.flatnonzero(~same)
        if len(other):
            k[other] = np.minimum(np.searchsorted(self.hashes, h[other]), len(self.hashes) - 1)
            same[other] = self.hashes[k[other]] == h[other]
        return at[same], k[same]


def _texts(b: pa.RecordBatch, reach: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, word hashes, first word of each text) of runs of
    texts. A long text comes in pieces of whole strides, each with ``reach``
    words of the ones beside it: memory is 8 bytes a word beside the text."""
    data, at = utf8_buffers(b.column("text"))
    for i, j in steps(at):
        part = data[at[i] : at[j]]
        if j == i + 1:
            h = np.concatenate([np.zeros(0, np.uint64), *text_words(fold(part))])
            size, pad = _common.STEP_BYTES // 8 // WINDOW * WINDOW or WINDOW, -(-reach // WINDOW) * WINDOW
            for k in range(0, max(len(h), 1), size):
                piece = h[max(0, k - pad) : k + size + pad]
                yield i, j, piece, np.array([0, len(piece)])
        else:
            h, first = words(part, at[i : j + 1] - at[i])
            yield i, j, h, first


def omega(terms: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((terms, SKETCH)).astype(np.float32)


def _spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All positions of spans, one after the other."""
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())


def _sums(rows: np.ndarray, index: np.ndarray, heads: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """Sums of rows[index] over runs that begin at ``heads``. The k-th rows of
    all runs are added at once, longest runs first; runs of more than ``most``
    rows are added up in parts."""
    lens = np.diff(np.append(heads, len(index)))
    parts = -(-lens // most)
    begin = _spans(np.zeros_like(parts), parts) * most + np.repeat(heads, parts)
    lens = np.minimum(np.repeat(heads + lens, parts) - begin, most)
    order = np.argsort(-lens, kind="stable")
    begin, sums = begin[order], np.zeros((len(begin), rows.shape[1]), rows.dtype)
    for k, n in enumerate(len(lens) - np.searchsorted(np.sort(lens), np.arange(lens.max(initial=0)), "right")):
        sums[:n] += rows[index[begin[:n] + k]]
    out = np.empty_like(sums)
    out[order] = sums
    return out if len(out) == len(parts) else np.add.reduceat(out, np.cumsum(parts) - parts, axis=0)


def _heads(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))


def sketch(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, int]:
    """(C'CO, documents that hold a term, documents with words) over
    side-by-side passages of all docs. Blocks of terms are summed apart, so no
    task holds more than one task's own sketch."""
    terms = len(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, o = shared.value, omega(terms)
        z, df, n = np.zeros((terms, SKETCH), np.float32), np.zeros(terms, np.int64), 0
        for b in batches:
            last, held = -1, np.zeros(terms, bool)  # terms of the pieces of one text
            for i, j, h, first in _texts(b):
                if j == i + 1 and i == last:
                    n += int(len(h) > 0 and not words_)
                    words_ = words_ or len(h) > 0
                else:
                    n += int((np.diff(first) > 0).sum())
                    last, words_ = (i, len(h) > 0) if j == i + 1 else (-1, False)
                    held[:] = False
                at, t = known.find(h)
                if not len(at):
                    continue
                text = np.searchsorted(first, at, "right") - 1
                if j == i + 1:
                    df[np.unique(t[~held[t]])] += 1
                    held[t] = True
                for k in range(0, j - i if j > i + 1 else 0, 64):  # a table of 64 texts by all terms
                    x, y = np.searchsorted(text, (k, k + 64))
                    seen = np.zeros((min(64, j - i - k), terms), bool)
                    seen[text[x:y] - k, t[x:y]] = True
                    df += np.count_nonzero(seen, axis=0)
                heads = _heads(text * (1 << 40) + (at - first[text]) // WINDOW)
                y = _sums(o, t, heads)
                owner = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(t))))
                order = np.argsort(t.astype(np.int32), kind="stable")
                ts = t[order]
                per = _heads(ts)
                z[ts[per]] += _sums(y, owner[order], per)
        for k in range(0, terms, BLOCK_ROWS):
            if df[k : k + BLOCK_ROWS].any():
                yield part(k, z[k : k + BLOCK_ROWS].astype(np.float64), df[k : k + BLOCK_ROWS])
        yield part(-1, np.zeros(0), np.array([n]))

    def part(block: int, z: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "z": pa.array([z.tobytes()], pa.binary()), "df": pa.array([df.astype(np.int64).tobytes()], pa.binary())})

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = df = 0
        for b in batches:
            for x, y in zip(b.column("z").to_pylist(), b.column("df").to_pylist()):
                z, df = z + np.frombuffer(x, np.float64), df + np.frombuffer(y, np.int64)
        yield part(key[0].as_py(), z, df)

    schema = "block int, z binary, df binary"
    z, df, n = np.zeros((terms, SKETCH)), np.zeros(terms), 0
    for r in docs.select("text").mapInArrow(run, schema).groupBy("block").applyInArrow(add, schema).collect():  # SKETCH + 1 numbers a term of the benchmark
        counts = np.frombuffer(r["df"], np.int64)
        if r["block"] < 0:
            n = int(counts[0])
        else:
            df[r["block"] : r["block"] + len(counts)] = counts
            z[r["block"] : r["block"] + len(counts)] = np.frombuffer(r["z"], np.float64).reshape(-1, SKETCH)
    return z, df, n


def latent(z: np.ndarray, o: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(leading right singular vectors [terms, rank], singular values)."""
    o = o.astype(np.float64)
    size = np.linalg.norm(z) or 1.0
    shift = 1e-7 * size
    z = z + shift * o
    core = o.T @ z
    core = (core + core.T) / 2
    low = np.linalg.cholesky(core + 1e-9 * np.trace(core) / len(core) * np.eye(len(core)))
    u, s, _ = np.linalg.svd(np.linalg.solve(low, z.T).T, full_matrices=False)
    return u[:, :rank], np.sqrt(np.maximum(s[:rank] ** 2 - shift, 1e-12 * size))


def projection(v: np.ndarray, s: np.ndarray, idf: np.ndarray, seed: int = 6) -> np.ndarray:
    """[terms, rank + OUTSIDE] rows of words: damped leading directions, and a
    random projection of the rest."""
    r = np.random.default_rng(seed).standard_normal((len(idf), OUTSIDE)) / np.sqrt(OUTSIDE)
    return (np.hstack([v * (s[-1] / s), r - v @ (v.T @ r)]) * idf[:, None]).astype(np.float32)


def parts_of(benchmark: DataFrame, most: int = PART) -> Iterator[tuple[list[int], list[str]]]:
    """Items (identifiers, texts) in parts of about ``most`` items by hash, each
    ordered by identifier. An item without an identifier or a text is left out:
    there is nothing to report or to find."""
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("text"))
    n = items.count()
    parts = -(-n // most)
    for k in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("i", "text"), F.lit(parts)) == k)
        rows = part.orderBy("i", "text").collect()
        yield [r["i"] for r in rows], [r["text"] for r in rows]


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of a big integer."""
    masks: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << k
    full, v = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b.tolist():
        m = masks.get(x)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def is_leak(item: np.ndarray, answer: np.ndarray, text: np.ndarray) -> tuple[bool, float]:
    """Whether the words of a passage leak the item, and the common share."""
    share = lcs(item, text) / len(item)
    if share >= EXACT:
        return True, share
    if share >= PARAPHRASE and len(answer):
        held = lcs(answer, text) / len(answer)
        return held >= ANSWER, share
    return False, share


def matches(docs: DataFrame, benchmark: DataFrame, part: int = PART) -> DataFrame:
    """(doc_id, item_id, share): leaked items of each document, and the largest
    common share among its passages.

    Windows cover whole texts. Null and empty texts, and items without words,
    an identifier or a text, match nothing; an empty table on either side gives
    an empty result. A row with a null document identifier is searched and
    reported with a null doc_id; rows that repeat an identifier are reported
    together. Items longer than a passage are searched by each of their own
    windows; all are verified whole.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = spark.createDataFrame([], "doc_id long, item_id long, share double")
    for ids, texts in parts_of(benchmark, part):
        if (found := _search(docs, ids, texts)) is not None:
            out = out.union(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def _search(docs: DataFrame, ids: list[int], texts: list[str]) -> DataFrame | None:
    """(doc_id, item_id, share) of one part of the benchmark, once for each
    piece of a text; None if there is nothing to search."""
    spark = docs.sparkSession
    data, at = utf8_buffers(pa.array(texts))
    h, first = words(data, at)
    if not len(h):
        return None
    vocabulary = Vocabulary(h)
    z, df, n = sketch(docs, vocabulary)
    if not n:
        return None
    idf = np.log((n + 1) / (df + 1)) + 0.1
    v, s = latent(z * idf[:, None], omega(len(vocabulary)) / idf[:, None])
    rows = projection(v, s, idf)
    item_words = [h[a:b] for a, b in zip(first[:-1], first[1:])]
    answers = [_answer(t) for t in texts]
    # the rarest words of an item, of which a match at the least share has one
    _, term = vocabulary.find(h)
    telling, rarest = np.zeros(len(vocabulary), bool), []
    for m, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        own = term[a:b]
        own = own[np.argsort(df[own], kind="stable")[: (b - a) - int(np.ceil(PARAPHRASE * (b - a))) + 1]]
        telling[own] = True
        rarest.append(own + m * len(vocabulary))
    rarest = np.unique(np.concatenate(rarest))
    sizes = np.diff(first)
    owner, a, e = passages(first, WINDOW, WINDOW // 2)
    run_ = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows[term], axis=0, dtype=np.float64)])
    q = run_[e] - run_[a]
    q = (q / np.maximum(np.linalg.norm(q, axis=1), 1e-12)[:, None]).astype(np.float32)
    bags = [Counter(w.tolist()) for w in item_words]
    # how far from a passage a word of its match may lie
    reach = max(map(len, item_words)) + MARGIN
    shared = spark.sparkContext.broadcast((vocabulary, rows, telling, rarest, q, owner, a - first[owner], sizes, item_words, bags, answers, ids, COSINE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows, telling, rarest, q, owner, offset, sizes, item_words, bags, answers, ids, least = shared.value
        for b in batches:
            doc_ids, out = b.column("doc_id").to_pylist(), {}
            for i, _, h, first in _texts(b, reach + WINDOW):
                at, t = known.find(h)
                if not len(at):
                    continue
                text, a, e = passages(first)
                rare, rare_t = at[telling[t]], t[telling[t]]
                rares, knowns = _before(rare, len(h)), _before(at, len(h))
                lo_, hi_ = np.maximum(a - reach, first[text]), np.minimum(e + reach, first[text + 1])
                on = np.flatnonzero((rares[hi_] > rares[lo_]) & (knowns[e] > knowns[a]))
                if not len(on):
                    continue
                text, a, e = text[on], a[on], e[on]
                x = _rows_of(rows, first, at, t, text, a, e)
                x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
                for s in range(0, len(q), BLOCK):
                    p, k = np.divmod(np.flatnonzero(x @ q[s : s + BLOCK].T > least), len(q[s : s + BLOCK]))
                    k += s
                    # one of the rarest words of the item lies where verification looks
                    lo = a[p] - offset[k] - 2 * MARGIN
                    lo, hi = (np.clip(y, first[text[p]], first[text[p] + 1]) for y in (lo, lo + sizes[owner[k]] + 4 * MARGIN))
                    keep = _holding(rarest, rare_t, rares[lo], rares[hi], owner[k] * len(known))
                    for p_, k_ in zip(p[keep].tolist(), k[keep].tolist()):
                        m = int(owner[k_])
                        key = (i + int(text[p_]), m)
                        if out.get(key, 0.0) >= 1.0:
                            continue
                        from_, to = int(first[text[p_]]), int(first[text[p_] + 1])
                        lo, bag, size = int(a[p_]) - int(offset[k_]) - MARGIN, bags[m], len(item_words[m]) + 2 * MARGIN
                        # words in common, in any order, bound the subsequence
                        near = h[max(lo - MARGIN, from_) : max(lo + size + MARGIN, from_)][: to - max(lo - MARGIN, from_)]
                        if sum(map(bag.__getitem__, bag.keys() & near.tolist())) < PARAPHRASE * len(item_words[m]):
                            continue
                        for shift in (0, -MARGIN, MARGIN):  # the passage begins at a stride, the match anywhere
                            hit, share = is_leak(item_words[m], answers[m], h[max(lo + shift, from_) : min(max(lo + shift + size, from_), to)])
                            if hit:
                                out[key] = max(out.get(key, 0.0), share)
                            if hit or share < PARAPHRASE - 2 * MARGIN / len(item_words[m]):
                                break
            yield pa.RecordBatch.from_arrays([pa.array([doc_ids[r] for r, _ in out], pa.int64()), pa.array([ids[m] for _, m in out], pa.int64()), pa.array(list(out.values()), pa.float64())], ["doc_id", "item_id", "share"])

    return docs.mapInArrow(run, "doc_id long, item_id long, share double")


def _before(at: np.ndarray, n: int) -> np.ndarray:
    """For each of 0 to n the ascending positions ``at`` that are less."""
    out = np.zeros(n + 1, np.int64)
    out[at + 1] = 1
    return np.cumsum(out)


def _rows_of(rows: np.ndarray, first: np.ndarray, at: np.ndarray, t: np.ndarray, text: np.ndarray, a: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Sums of the rows of the known words of passages [a, e), by way of blocks of
    a stride, which overlapping passages share."""
    blocks = np.concatenate([[0], np.cumsum(-(-np.diff(first) // STRIDE))])
    own = blocks[text] + (a - first[text]) // STRIDE
    parts = [np.where(a + k < e, own + k // STRIDE, blocks[-1]) for k in range(0, WINDOW, STRIDE)]
    needed = np.zeros(blocks[-1] + 1, bool)
    for part in parts:
        needed[part] = True
    needed[-1] = False
    of = np.searchsorted(first, at, "right") - 1
    of = blocks[of] + (at - first[of]) // STRIDE
    on = needed[of]
    of, t = of[on], t[on]
    heads = _heads(of)
    sums = np.zeros((blocks[-1] + 1, rows.shape[1]), rows.dtype)
    sums[of[heads]] = _sums(rows, t, heads)
    return sum(sums[part] for part in parts)


def _holding(rarest: np.ndarray, terms: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Which of the spans terms[lo:hi] have a term in ``rarest`` after ``base`` is
    added, which tells the span's item."""
    out = [np.zeros(0, np.int64)]
    for i, j in steps(np.concatenate([[0], np.cumsum(hi - lo)])):
        lens = hi[i:j] - lo[i:j]
        key = terms[_spans(lo[i:j], lens)] + np.repeat(base[i:j], lens)
        own = rarest[np.minimum(np.searchsorted(rarest, key), len(rarest) - 1)] == key
        out.append(i + np.unique(np.repeat(np.arange(j - i), lens)[own]))
    return np.concatenate(out)


def _answer(text: str) -> np.ndarray:
    """Words of the last sentence or line of an item of several, else none."""
    parts = [p for p in text.replace("!", ".").replace("?", ".").replace("\n", ".").split(".") if p.strip()]
    if len(parts) < 2:
        return np.zeros(0, np.uint64)
    data, at = utf8_buffers(pa.array([parts[-1]]))
    return words(data, at)[0]


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, leaked, n_items, item_id (of the item
    with the largest share, the smallest of ties; null if none), share."""
    found = matches(docs, benchmark).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.max(F.struct("share", (-F.col("item_id")).alias("i"))).alias("top"))
    found = cut(found.select(F.col("doc_id").alias("d_"), "n_items", (-F.col("top.i")).alias("item_id"), F.round("top.share", 6).alias("share")), "leaks")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(small(found), F.col("doc_id").eqNullSafe(F.col("d_")), "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("leaked"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "item_id", "share")


def decontamination_pipeline(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no item; columns as in docs. Rows that repeat
    a leaking identifier go too."""
    gone = cut(matches(docs, benchmark).select(F.col("doc_id").alias("gone_")).distinct(), "leaking")
    return docs.join(small(gone), docs["doc_id"].eqNullSafe(F.col("gone_")), "left_anti")
