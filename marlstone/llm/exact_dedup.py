"""Exact deduplication by a tree-merge of sorted digest runs.

Every partition turns its rows into one sorted run of (digest, evidence, kept
identifier, rows). Partitions then exchange slices of their runs in rounds of
a binomial (radix ``fan``) exchange: in round t partition q sends to the
partition whose t-th digit is the t-th digit of the digest. What arrives is
merged multiway and equal digests collapse, so a digest that a third of all
rows share counts at most ``fan`` records per merge. After log_fan(P) rounds
each of the P partitions owns one slice of the digest space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_rows, cut, utf8_buffers

#: Record of a run: the digest as four big-endian words in sorting order, the
#: second hash and the length of the text as evidence, the identifier, the rows.
RECORD = np.dtype([("d0", "<u8"), ("d1", "<u8"), ("d2", "<u8"), ("d3", "<u8"), ("x", "<u8"), ("n", "<i8"), ("keep", "<i8"), ("rows", "<i8")])
KEY = ("d0", "d1", "d2", "d3", "x", "n")
#: Records in one row that is exchanged (64 bytes each).
RUN = 1 << 15


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, d0..d3, x, n): SHA-256 of the text after lower-casing A-Z as four
    longs, a second 64-bit hash and the length in bytes."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8_buffers(b.column(1))
            raw = memoryview(data.tobytes())
            sha, xs = [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                text = bytes(raw[i:j]).lower()  # bytes.lower() folds A-Z alone
                sha.append(hashlib.sha256(text).digest())
                xs.append(xxhash.xxh3_64_intdigest(text))
            d = np.frombuffer(b"".join(sha), ">u8").reshape(-1, 4).astype("<u8")
            cols = [b.column(0), *(pa.array(d[:, k].view("<i8")) for k in range(4)), pa.array(np.array(xs, np.uint64).view("<i8")), pa.array(np.diff(at))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "d0", "d1", "d2", "d3", "x", "n"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, d0 long, d1 long, d2 long, d3 long, x long, n long")


def merge(runs: list[np.ndarray], largest: bool) -> np.ndarray:
    """Multiway merge of sorted runs; equal records collapse into one that
    keeps the largest (or smallest) identifier and the sum of the rows. Only
    records whose digest, second hash and length all agree are equal."""
    runs = [r for r in runs if len(r)]
    if not runs:
        return np.zeros(0, RECORD)
    all_ = np.concatenate(runs)
    all_ = all_[np.lexsort([all_[k] for k in reversed(KEY)])]
    new = np.ones(len(all_), bool)
    if len(all_) > 1:
        new[1:] = np.logical_or.reduce([all_[k][1:] != all_[k][:-1] for k in KEY])
    at = np.flatnonzero(new)
    out = all_[at].copy()
    out["keep"] = (np.maximum if largest else np.minimum).reduceat(all_["keep"], at)
    out["rows"] = np.add.reduceat(all_["rows"], at)
    return out


def _slices(run: np.ndarray, fan: int, shift: int, place: int, own: int) -> Iterator[tuple[int, bytes]]:
    """(target partition, bytes of a sorted slice) by one digit of the digest."""
    digit = (run["d3"] >> np.uint64(shift)) % np.uint64(fan)
    base = own - (own // place % fan) * place
    for k in range(fan):
        mine = run[digit == k]
        for i in range(0, len(mine), RUN):
            yield base + k * place, mine[i : i + RUN].tobytes()


def tree_merge(table: DataFrame, fan: int = 8, keep: str = "largest") -> DataFrame:
    """One row per distinct text from ``digests``: d0..d3, x, n, keep, rows.

    ``table`` must give the same partitions when it is computed again (a cut
    table does). Memory of a task: the slice of the digest space that its
    partition owns, 64 bytes a distinct text.
    """
    largest = keep == "largest"
    parts = table.rdd.getNumPartitions()
    rounds = 1
    while fan**rounds < parts:
        rounds += 1
    p = fan**rounds
    low = np.iinfo(np.int64).min if largest else np.iinfo(np.int64).max

    def emit(pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in pairs], pa.int32()), pa.array([r for _, r in pairs], pa.binary())], ["target", "run"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = []
        for b in batches:
            r = np.zeros(b.num_rows, RECORD)
            for k in ("d0", "d1", "d2", "d3", "x"):
                r[k] = b.column(k).to_numpy(zero_copy_only=False).view(np.uint64)
            r["n"] = b.column("n").to_numpy(zero_copy_only=False)
            r["keep"] = b.column("id").fill_null(int(low)).to_numpy(zero_copy_only=False)
            r["rows"] = 1
            runs.append(r)
            if len(runs) >= 64:  # collapse what one partition repeats as it comes
                runs = [merge(runs, largest)]
        for pair in _slices(merge(runs, largest), fan, 0, 1, TaskContext.get().partitionId() % p):
            yield emit([pair])

    def step(t: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            runs, own = [], 0
            for b in batches:
                for target, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    own = target
                    runs.append(np.frombuffer(raw, RECORD))
            for pair in _slices(merge(runs, largest), fan, t * 8, fan**t, own):
                yield emit([pair])

        return run

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = merge([np.frombuffer(raw, RECORD) for b in batches for raw in b.column(1).to_pylist()], largest)
        for i in range(0, len(out), RUN):
            r = out[i : i + RUN]
            keep_ = pa.array(r["keep"], mask=r["keep"] == low)
            yield pa.RecordBatch.from_arrays([*(pa.array(r[k].view("<i8")) for k in ("d0", "d1", "d2", "d3", "x")), pa.array(r["n"]), keep_, pa.array(r["rows"])], ["d0", "d1", "d2", "d3", "x", "n", "keep", "rows"])

    runs = table.select("id", "d0", "d1", "d2", "d3", "x", "n").mapInArrow(first, "target int, run binary")
    for t in range(1, rounds):
        runs = runs.repartitionById(p, F.col("target")).mapInArrow(step(t), "target int, run binary")
    return runs.repartitionById(p, F.col("target")).mapInArrow(last, "d0 long, d1 long, d2 long, d3 long, x long, n long, keep long, rows long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan: int = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts
    as empty. Of equal texts the largest (or smallest) identifier stays. A null
    identifier loses against any other; where a group has none but null, keep_id
    is null and its rows are kept. Rows that repeat an identifier and its text
    are one group of which all rows with the kept identifier are kept. Columns
    other than the two named are not read. An empty table gives an empty one.
    """
    table = cut(digests(docs, id_col, text_col), "digests")
    groups = tree_merge(table, fan, keep).where(F.col("rows") > 1)
    on = ["d0", "d1", "d2", "d3", "x", "n"]
    joined = table.join(groups, on, "left")
    keep_id = F.when(F.col("rows").isNull(), F.col("id")).otherwise(F.col("keep"))
    sha = F.lower(F.concat(*(F.lpad(F.hex(F.col(k)), 16, "0") for k in on[:4])))
    return joined.select(
        F.col("id").alias("doc_id"), keep_id.alias("keep_id"), F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"), sha.alias("text_sha256"),
    )


ORACLE = """
with t as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as s from documents)
select doc_id, max(doc_id) over (partition by s) as keep_id, count(*) over (partition by s) as group_size,
       doc_id = max(doc_id) over (partition by s) as kept, s as text_sha256
from t
"""
