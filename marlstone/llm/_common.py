"""Shared pieces of the corpus operators: durable cuts, shared paths, and
vectorised views of UTF-8 text held in Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import clean, cut, new_path, shared_dir  # noqa: F401

#: Rows of an Arrow batch; documents are a few KB, so a batch stays in tens of MB.
ARROW_ROWS = 1000
#: Bytes of text that one numpy step handles; temporaries are about 60 times as
#: large. A longer text is read in pieces of this size.
STEP_BYTES = 1 << 19


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of an Arrow batch, unless the session has its own bound."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows up to which a table of ids and a few numbers may be broadcast (tens of MB).
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``rows`` rows, else as it is
    (then the join shuffles). df must be cheap to count: a cut table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ranges(df: DataFrame, per: int = 1 << 28) -> int:
    """Partitions to sort df into: one for each ``per`` bytes that the planner
    expects, and no fewer than spark.sql.shuffle.partitions, which alone counts
    where the planner knows no size."""
    least = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size >= 1 << 60 else max(least, -(-size // per))


# -- text in Arrow buffers ---------------------------------------------------


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, kind, n + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(at: np.ndarray, most: int = 0) -> list[tuple[int, int]]:
    """Split rows into runs of whole texts with at most ``most`` bytes (0:
    STEP_BYTES); a longer text is a run of its own."""
    n, most = len(at) - 1, most or STEP_BYTES
    out, i = [], 0
    while i < n:
        j = int(np.searchsorted(at, at[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        out.append((i, j))
        i = j
    return out


def pieces(n: int, most: int = 0) -> list[tuple[int, int]]:
    """Split a text of n bytes into spans of ``most`` bytes (0: STEP_BYTES); an
    empty text is one span."""
    most = most or STEP_BYTES
    return [(k, min(k + most, n)) for k in range(0, max(n, 1), most)]


#: Word separators: space and the controls TAB to CR.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A to Z, leaves all other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray, at: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the words of concatenated texts; words of text i
    are first[i]:first[i+1]. A word never spans two texts."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(at), np.int64)
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, STEP_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(up), np.cumprod(down)
        if size <= 8 * STEP_BYTES:
            _POWERS[0] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Of each word the sum of its bytes' numbers times powers of the base."""
    up, down = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[fold][data] * up[: len(data)], out=sums[1:])
        return (sums[ends] - sums[starts]) * down[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hashes of the words, bytes folded by ``fold`` first."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return mix(_word_sums(data, starts, ends, fold) + (ends - starts).astype(np.uint64))


def text_words(data: np.ndarray, fold: np.ndarray = LOWER, separator: np.ndarray = SEPARATOR) -> Iterator[np.ndarray]:
    """Hashes of the words of one text of any length, as ``word_hashes`` gives
    them, a piece at a time: memory is that of a piece. A word that spans
    pieces is summed up over them."""
    held, size = 0, 0  # sum and length of the word that the last piece left open
    mask = (1 << 64) - 1
    base = int(_BASE)
    for lo, hi in pieces(len(data)):
        part = data[lo:hi]
        starts, ends, _ = word_bounds(part, np.array([0, len(part)]), separator)
        begun = size and len(part) and not separator[part[0]]
        out = []
        if size and not begun:
            out.append((held, size))
            held = size = 0
        if len(starts):
            sums, lens = _word_sums(part, starts, ends, fold), ends - starts
            if begun:
                held = (held + int(sums[0]) * pow(base, size, 1 << 64)) & mask
                size += int(lens[0])
                starts, ends, sums, lens = starts[1:], ends[1:], sums[1:], lens[1:]
                if len(starts) or separator[part[-1]]:
                    out.append((held, size))
                    held = size = 0
            if len(starts) and not separator[part[-1]]:
                held, size = int(sums[-1]), int(lens[-1])
                sums, lens = sums[:-1], lens[:-1]
            first = np.array([h for h, _ in out], np.uint64), np.array([n for _, n in out], np.uint64)
            with np.errstate(over="ignore"):
                yield mix(np.concatenate([first[0], sums]) + np.concatenate([first[1], lens.astype(np.uint64)]))
        elif out:
            yield mix(np.array([(h + n) & mask for h, n in out], np.uint64))
    if size:
        yield mix(np.array([(held + size) & mask], np.uint64))


def _rolled(words: np.ndarray, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            rolled = rolled * _BASE + words[k : k + len(rolled)]
        return mix(rolled)


def text_shingles(data: np.ndarray, width: int = 5) -> np.ndarray:
    """``shingles`` of one text of any length: beside the text it takes about 16
    bytes a word."""
    held, parts = np.zeros(0, np.uint64), []
    for words in text_words(data):
        held = np.concatenate([held, words])
        parts.append(_rolled(held, width))
        held = held[max(0, len(held) - width + 1) :] if len(parts[-1]) else held
    if not sum(map(len, parts)):
        return shingles(held, np.array([0, len(held)]), width)[0]
    out = np.concatenate(parts)
    parts.clear()
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def shingles(words: np.ndarray, first: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; a shorter
    text has its whole word sequence as one, a text without words none."""
    rolled = _rolled(words, width)
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
        if j - i >= width:
            x = np.sort(rolled[i : j - width + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif j > i:
            with np.errstate(over="ignore"):
                h = np.uint64(j - i)
                for w in words[i:j]:
                    h = h * _BASE + w
            x = mix(np.array([h], np.uint64) ^ np.uint64(0x5BF03635))
        else:
            x = np.zeros(0, np.uint64)
        out.append(x)
    return out
