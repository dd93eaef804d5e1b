"""Mixing sources to target weights by capped water-filling.

A source's target is its weight's share of the mix, clamped at a maximum number
of epochs; what a clamp frees is dealt to the other sources by weight until
none is above its clamp. Each document is then taken a whole number of times,
and a seeded order decides which documents are taken once more for the
fraction that remains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, ranges, small

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and TAB to CR; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df with ``rank`` (0-based) and ``before`` (sum of ``value`` over the rows
    before) in the given order over the whole table. Rows are dealt by ranges,
    so no task holds more than its range; only a row per range reaches the
    driver."""
    spark = df.sparkSession
    df = cut(df.repartitionByRange(ranges(df), *order).withColumn("range", F.spark_partition_id()), name)
    base, rank, total = [], 0, 0
    for r in sorted(df.groupBy("range").agg(F.count("*").alias("n"), F.sum(value).alias("v")).collect(), key=lambda r: r["range"]):
        base.append((r["range"], rank, total))
        rank, total = rank + r["n"], total + r["v"]
    from pyspark.sql import Window

    w = Window.partitionBy("range").orderBy(*order)
    df = df.withColumns({"r": F.row_number().over(w), "s": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    base_df = F.broadcast(spark.createDataFrame(base, "range int, rank0 long, before0 long"))
    return df.join(base_df, "range").withColumns({"rank": F.col("rank0") + F.col("r") - 1, "before": F.col("before0") + F.col("s") - F.col(value)}).drop("range", "r", "s", "rank0", "before0")


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sources (source_size, weight) with ``target`` added.

    Each round is one aggregation to two sums; no source reaches the driver.
    The clamped set only grows, so the rounds end.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, clamped = None, -1
    while True:
        over = F.lit(False) if level is None else F.lit(level) * F.col("weight") > cap
        row = sources.agg(F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, cap)).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        if row["n"] == clamped or not row["free"]:
            break
        clamped, level = row["n"], (total - (row["held"] or 0.0)) / row["free"]
    return sources.withColumn("target", F.least(cap, F.lit(level or 0.0) * F.col("weight")))


def draw_of(doc_id: Column, seed: int) -> Column:
    """The seeded lot of a document; that of a null identifier is of the empty text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _taken(docs: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int, seed: int) -> DataFrame:
    """(doc_id, source, size, draw, source_size, target, whole, extra) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    rows = cut(rows.withColumn("draw", draw_of(F.col("doc_id"), seed)), "sizes")
    by_source = [F.col("source").asc_nulls_last()]
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = running(sources, by_source, "source_size", "sources")
    sources = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    sources = cut(water_fill(cut(sources, "weights"), share, max_epochs), "targets")
    placed = running(rows, [*by_source, F.col("draw"), F.col("doc_id"), F.col("size")], "size", "order")
    s = small(sources.select(F.col("source").alias("s"), "source_size", "target", F.col("before").alias("base")))
    both = placed.join(s, F.col("source").eqNullSafe(F.col("s")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goal = F.col("target") - F.col("whole") * F.col("source_size")
    extra = (F.lit(2) * (F.col("before") - F.col("base")) + F.col("size") <= F.lit(2.0) * goal) & (goal > 0)
    return both.withColumn("whole", whole.cast("int")).withColumn("extra", F.when(extra, 1).otherwise(0))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row per row of docs.

    size: words of the text (null: 0). Sources by code point, the null source
    last, have the weights in turn, repeating. Within a source the seeded order
    (MD5 of seed and identifier, then identifier and size) decides which
    documents the fraction takes, so reruns agree; rows that agree in
    identifier, source and size may swap places. A null identifier hashes as
    empty. A source of only empty texts has target 0. An empty table gives an
    empty one. Other columns are not read.
    """
    copies = F.col("whole") + F.col("extra")
    return _taken(docs, weights, share, max_epochs, seed).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mix_pipeline(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of docs as often as the mix takes them, columns as in docs.

    The rows that a source's fraction takes come first in its seeded order, so
    the last of them says which these are: a row per source decides, and no
    text is shuffled. Rows that repeat the last one's identifier are all taken.
    """
    lot = lambda c: F.struct(draw_of(c, seed).alias("draw"), F.coalesce(c.cast("long"), F.lit(-(1 << 63))).alias("id"))
    last = _taken(docs, weights, share, max_epochs, seed).groupBy("source").agg(F.max("whole").alias("whole_"), F.max(F.when(F.col("extra") == 1, lot(F.col("doc_id")))).alias("last_"))
    last = cut(last.withColumnRenamed("source", "source_"), "lots")
    both = docs.join(small(last), docs["source"].cast("string").eqNullSafe(F.col("source_")))
    copies = F.col("whole_") + F.when(F.col("last_").isNotNull() & (lot(docs["doc_id"]) <= F.col("last_")), 1).otherwise(0)
    return both.withColumn("copies_", copies).where("copies_ > 0").withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies_")))).select(*docs.columns)


ORACLE = f"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         md5('{SEED}:' || coalesce(doc_id::varchar, '')) as draw from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select source, source_size, ([5.0, 2.0, 1.0]::double[])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from s),
r as (select *, 2.0::double * source_size as cap, 2.0::double * source_size / weight as ratio,
        sum(2.0::double * source_size) over (order by 2.0::double * source_size / weight, source nulls last rows between unbounded preceding and current row) - 2.0::double * source_size as held,
        sum(weight) over (order by 2.0::double * source_size / weight desc, source desc nulls first rows between unbounded preceding and current row) as free
      from w),
l as (select arg_min(level, ratio) as level from (select (1.5::double * (select sum(source_size) from s) - held) / free as level, ratio from r) where level <= ratio),
t as (select source, source_size, least(cap, (select level from l) * weight) as target from r),
p as (select d.*, t.source_size, t.target, case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as whole,
        coalesce(sum(size) over (partition by d.source order by draw, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, round(target, 6) as target, (size * copies)::bigint as taken, copies from (
  select *, (whole + case when 2 * before + size <= 2.0::double * (target - whole * source_size) and target - whole * source_size > 0 then 1 else 0 end)::int as copies from p)
"""
