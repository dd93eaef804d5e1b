"""Folds and bounded training samples of labelled documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Training rows of each class at most, and bytes of a training text at most.
#: Both bound what reaches the driver; scoring reads every whole text.
PER_CLASS = 1500
TEXT_BYTES = 1 << 17


def in_fold(doc_id: Column, modulus: int, rest: int) -> Column:
    """crc32 of the identifier as text, modulo; a null identifier counts as the
    empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == rest


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, per_class: int = PER_CLASS, text_bytes: int = TEXT_BYTES) -> tuple[pa.Table, dict[int, float]]:
    """(table of text and y, weight of a row of each class).

    Rows outside the fold only. Of each class the ``per_class`` identifiers with
    the smallest hash are taken; a class's weight is the number of its labelled
    rows over the number taken, scaled to mean 1. Null labels, identifiers and
    texts are left out; where an identifier has several labels the largest
    counts, where it has several texts the smallest.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), modulus, rest)).groupBy(F.col("doc_id").cast("long").alias("i")).agg(F.max(label).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect() if r["y"] in (0, 1)}
    if not sizes:
        return pa.table({"text": pa.array([], pa.string()), "y": pa.array([], pa.int32())}), {}
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(per_class) for y in sorted(sizes)]
    ids = picked[0] if len(picked) == 1 else picked[0].union(picked[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= text_bytes)
    rows = texts.join(F.broadcast(ids), "i").groupBy("i", "y").agg(F.min("text").alias("text")).orderBy("i").select("text", "y").toArrow()  # at most 2 * per_class rows
    taken = {y: max(1, rows.column("y").to_pylist().count(y)) for y in sizes}
    raw = {y: sizes[y] / taken[y] for y in sizes}
    scale = sum(taken[y] for y in sizes) / sum(raw[y] * taken[y] for y in sizes)
    return rows, {y: raw[y] * scale for y in raw}
