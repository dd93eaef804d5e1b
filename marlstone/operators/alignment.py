"""From ragged prices to an aligned, gap-free panel of log returns.

Prices are long (date, asset, price, ...). Every step is an aggregate, a join
or a window per asset; the only windows without a partition run over one row
per date.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Days by which a history may begin after, or end before, the panel's.
TOLERANCE_DAYS = 7


def _day(c: str) -> Column:
    return F.col(c).cast("date")


@dataclass
class Panel:
    """prices: date, asset, price without gaps; report: a row per asset asked
    for (asset, status, reason, gaps, filled); summary: one row; placed: prices
    with ``pos``, the date's place in the calendar."""

    prices: DataFrame
    report: DataFrame
    summary: DataFrame
    placed: DataFrame


def align(prices: DataFrame, requested: DataFrame | None = None, limit: int = 3, start: str | None = None, end: str | None = None, tolerance: int = TOLERANCE_DAYS, by: list[str] = []) -> Panel:
    """Aligned panel of ``prices``, one for each value of the key columns ``by``.

    1. Dates from ``start`` to ``end`` inclusive; the calendar is the union of
       all assets' dates. 2. Assets whose first price is more than ``tolerance``
       days after the first date are dropped, the calendar is derived again. 3.
       So are those whose last price is more than ``tolerance`` days before the
       last date. 4. At most ``limit`` missing rows in a row are filled from the
       price before. 5. Assets that still have gaps are dropped: those that end
       in one run of gaps and have no other as delisted, else as unfillable.
    ``requested`` (asset) adds rows for assets without any price. The number of
    filled cells counts those of assets dropped in step 5. An empty range keeps
    no asset.

    No grid of assets by dates is made: a row's place in the calendar and that
    of the asset's next row say what is missing between them, and only rows
    that are filled are added. The prices are read once.
    """
    known = cut(prices.where(F.col("price").isNotNull()).select(*by, "date", "asset", "price"), "prices")
    inside = known
    if start is not None:
        inside = inside.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        inside = inside.where(F.col("date") < F.date_add(F.lit(end).cast("date"), 1))
    spans = inside.groupBy(*by, "asset").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    # a row per asset from here on: its span, and the panel's after each drop
    one = Window.partitionBy(*(by or [F.lit(1)]))
    spans = spans.withColumn("p0", F.min("first").over(one)).withColumn("late", F.datediff(_day("first"), _day("p0")) > tolerance)
    spans = spans.withColumn("p1", F.max(F.when(~F.col("late"), F.col("last"))).over(one)).withColumn("stale", ~F.col("late") & (F.datediff(_day("p1"), _day("last")) > tolerance))
    own = inside.join(spans.where(~F.col("late") & ~F.col("stale")).select(*by, "asset"), [*by, "asset"], "left_semi")
    # a row per date: its place, and how many dates there are
    calendar = own.select(*by, "date").distinct().withColumns({"pos": F.row_number().over(one.orderBy("date")) - 1, "dates": F.count("*").over(one)})
    w = Window.partitionBy(*by, "asset").orderBy("pos")
    missing = F.coalesce(F.lead("pos").over(w), F.col("dates")) - F.col("pos") - 1
    rows = own.join(calendar, [*by, "date"]).withColumns({"ends": F.lead("pos").over(w).isNull(), "head": F.when(F.lag("pos").over(w).isNull(), F.col("pos")).otherwise(0), "missing": missing})
    rows = cut(rows.withColumn("fill", F.least(F.col("missing"), F.lit(limit)).cast("int")), "placed")
    left = F.col("missing") - F.col("fill")
    gaps = rows.groupBy(*by, "asset").agg(F.sum("fill").alias("filled"), F.sum(left + F.col("head")).alias("gaps"), F.sum(F.when(F.col("ends"), left).otherwise(0)).alias("tail"))
    good = gaps.where("gaps = 0").select(*by, "asset")
    filled = rows.join(good, [*by, "asset"], "left_semi").select(*by, "asset", "price", F.explode(F.sequence("pos", F.col("pos") + F.col("fill"))).alias("pos"))
    placed = filled.join(rows.select(*by, "pos", "date").distinct(), [*by, "pos"]).select(*by, "date", "asset", "price", "pos")
    clean = placed.drop("pos")

    cached = known.groupBy(*by, "asset").agg(F.count("*").alias("n"))
    names = cached.select(*by, "asset") if requested is None else requested.select(*by, "asset").distinct()
    day = lambda c: F.date_format(_day(c), "yyyy-MM-dd")
    reason = (
        F.when(F.col("n").isNull(), F.lit("not cached"))
        .when(F.col("first").isNull(), F.lit("no data in requested range"))
        .when(F.col("late"), F.concat(F.lit("history starts "), day("first")))
        .when(F.col("stale"), F.concat(F.lit("history ends "), day("last")))
        .when((F.col("tail") > 0) & (F.col("tail") == F.col("gaps")), F.concat(F.lit("no data after "), day("last"), F.lit(" (delisting or halt); "), F.col("gaps"), F.lit(" missing sessions")))
        .when(F.col("gaps") > 0, F.concat(F.col("gaps"), F.lit(f" unfillable gaps (> {limit}d)")))
    )
    key = [*by, "asset"]
    report = (cached if requested is None else names.join(cached, key, "left")).join(spans, key, "left").join(gaps, key, "left").withColumn("reason", reason)
    report = report.select(*by, "asset", F.when(F.col("reason").isNull(), "retained").otherwise("dropped").alias("status"), "reason", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), F.coalesce("filled", F.lit(0)).cast("long").alias("filled"))
    dates = clean.groupBy(*by).agg(F.min("date").alias("start"), F.max("date").alias("end"), F.countDistinct("date").alias("n_obs"))
    counts = report.groupBy(*by).agg(F.count("*").alias("requested"), F.count(F.when(F.col("status") == "retained", 1)).alias("retained"), F.sum("filled").alias("filled_values"))
    return Panel(clean, report, counts.join(dates, by) if by else counts.crossJoin(dates), placed)


def log_returns(prices: DataFrame, guard: bool = True) -> DataFrame:
    """date, asset, ret: the log of each price over the one before; the first
    date has no row. A price of 0 or less fails the query, naming the asset."""
    p = F.col("price")
    if guard:
        p = F.when(F.col("price") > 0, F.col("price")).otherwise(F.raise_error(F.concat(F.lit("non-positive price: "), F.col("asset"))).cast("double"))
    w = Window.partitionBy("asset").orderBy("date")
    r = F.log(p) - F.lag(F.log(p)).over(w)
    return prices.select("date", "asset", r.alias("ret")).where(F.col("ret").isNotNull())


def returns_panel(prices: DataFrame, limit: int = 3, **how) -> DataFrame:
    return log_returns(align(prices, limit=limit, **how).prices)


def returns_report(prices: DataFrame, limit: int = 3, **how) -> tuple[DataFrame, Panel]:
    """(returns, panel) with the panel's summary restated on the returns: their
    first and last date and how many there are, one less than of prices."""
    panel = align(prices, limit=limit, **how)
    returns = log_returns(panel.prices)
    dates = returns.agg(F.min("date").alias("start"), F.max("date").alias("end"), F.countDistinct("date").alias("n_obs"))
    return returns, replace(panel, summary=panel.summary.drop("start", "end", "n_obs").crossJoin(dates))


def summary_text(panel: Panel) -> DataFrame:
    """One row, summary: the panel in a sentence."""
    day = lambda c: F.coalesce(F.date_format(_day(c), "yyyy-MM-dd"), F.lit("-"))
    return panel.summary.select(F.format_string("%d of %d assets, %d rows from %s to %s, %d values filled", "retained", "requested", "n_obs", day("start"), day("end"), "filled_values").alias("summary"))


def positions(returns: DataFrame) -> DataFrame:
    """returns with ``pos``: the date's 0-based place. The window runs over one
    row per date."""
    dates = returns.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)
    return returns.join(dates, "date")


def q_ratio(n_assets: Column, window: Column | int) -> Column:
    return F.try_divide(n_assets.cast("double"), F.lit(window).cast("double") if isinstance(window, int) else window.cast("double"))


def coverage_frontier(prices: DataFrame, starts: list[str], limit: int = 3) -> DataFrame:
    """start, n_assets, n_obs (price rows), q_at_252 for each candidate start:
    one aligned panel keyed by start. A start without any panel has zeros."""
    keys = prices.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(starts)], "start string")
    keyed = prices.select("date", "asset", "price").join(F.broadcast(keys), F.col("date") >= F.col("start").cast("date"))
    found = align(keyed, limit=limit, by=["start"]).prices.groupBy("start").agg(F.countDistinct("asset").alias("n_assets"), F.countDistinct("date").alias("n_obs"))
    rows = keys.join(found, "start", "left").select("start", F.coalesce("n_assets", F.lit(0)).alias("n_assets"), F.coalesce("n_obs", F.lit(0)).alias("n_obs"))
    return rows.withColumn("q_at_252", F.when(F.col("n_obs") > 0, F.round(q_ratio(F.col("n_assets"), 252), 3)))


def split(returns: DataFrame, fraction: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """The first floor(n * fraction) dates, and the rest."""
    placed = positions(returns)
    n = placed.select("date").distinct().agg(F.floor(F.count("*") * fraction).alias("cut_"))
    both = placed.crossJoin(F.broadcast(n))
    return both.where("pos < cut_").drop("cut_"), both.where("pos >= cut_").drop("cut_")
