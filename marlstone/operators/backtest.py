"""Signals, weights and cost-aware backtests as window functions.

Returns are long (date, asset, ret), optionally with further key columns ``by``
(a universe, a cell of a grid). A null weight means: no decision, hold. Log
returns are summed as they are, and weights count from the next date on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252.0


def _placed(returns: DataFrame, by: list[str]) -> DataFrame:
    """returns with pos (0-based place of the date) and n (assets)."""
    dates = returns.select(*by, "date").distinct()
    dates = dates.withColumn("pos", F.row_number().over(Window.partitionBy(*(by or [F.lit(1)])).orderBy("date")) - 1)
    n = returns.groupBy(*by).agg(F.countDistinct("asset").alias("n"))
    dates = dates.join(n, by) if by else dates.crossJoin(n)
    return returns.join(dates, [*by, "date"])


def _trailing(by: list[str], length: int):
    return Window.partitionBy(*by, "asset").orderBy("date").rowsBetween(-(length - 1), 0)


def trailing_return(returns: DataFrame, length: int, by: list[str] = []) -> DataFrame:
    """signal: sum of the last ``length`` returns; null before."""
    w = _trailing(by, length)
    return returns.withColumn("signal", F.when(F.count("ret").over(w) >= length, F.sum("ret").over(w)))


def _decides(length: int, every: int) -> Column:
    return (F.col("pos") >= length - 1) & ((F.col("pos") - (length - 1)) % every == 0)


def momentum_weights(returns: DataFrame, length: int = 252, every: int = 21, by: list[str] = [], concentrated: bool = False) -> DataFrame:
    """by, date, asset, weight: on decision dates one share to each asset with a
    positive trailing return, of all assets or, concentrated, of those that
    qualify; null on other dates."""
    s = _placed(trailing_return(returns, length, by), by)
    up = F.when(F.col("signal") > 0, 1.0).otherwise(0.0)
    if concentrated:
        total = F.sum(up).over(Window.partitionBy(*by, "date"))
        share = F.when(total > 0, up / F.nullif(total, F.lit(0.0))).otherwise(0.0)
    else:
        share = up / F.col("n")
    return s.select(*by, "date", "asset", F.when(_decides(length, every), share).alias("weight"))


def realised_volatility(returns: DataFrame, length: int, per_year: float, by: list[str] = []) -> DataFrame:
    w = _trailing(by, length)
    return returns.withColumn("vol", F.when(F.count("ret").over(w) >= length, F.stddev_samp("ret").over(w) * F.sqrt(F.lit(per_year))))


def volatility_managed_weights(returns: DataFrame, target: float, length: int = 63, cap: float = 1.5, every: int = 21, per_year: float = TRADING_DAYS, by: list[str] = []) -> DataFrame:
    """Equal weights scaled to ``target`` over the realised volatility of the
    mean return, at most ``cap`` (also where volatility is 0)."""
    base = returns.groupBy(*by, "date").agg(F.avg("ret").alias("ret")).withColumn("asset", F.lit("base"))
    v = _placed(realised_volatility(base, length, per_year, by), by).select(*by, "date", "vol", "pos")
    scale = F.when(F.col("vol") > 0, F.least(F.lit(target) / F.nullif(F.col("vol"), F.lit(0.0)), F.lit(cap))).when(F.col("vol") == 0, F.lit(cap))
    n = returns.groupBy(*by).agg(F.countDistinct("asset").alias("n"))
    rows = returns.select(*by, "date", "asset").join(v, [*by, "date"])
    rows = rows.join(n, by) if by else rows.crossJoin(n)
    return rows.select(*by, "date", "asset", F.when(_decides(length, every), scale / F.col("n")).alias("weight"))


def low_volatility_weights(returns: DataFrame, length: int = 252, fraction: float = 0.2, long_short: bool = False, every: int = 21, by: list[str] = []) -> DataFrame:
    """On decision dates equal shares of the quietest fraction of the assets
    (ties by name), minus equal shares of the wildest if ``long_short``; no
    decision where fewer than two legs of assets have a volatility."""
    v = _placed(realised_volatility(returns, length, 1.0, by), by)
    leg = F.greatest(F.lit(1), F.rint(F.col("n") * fraction).cast("int"))
    w = Window.partitionBy(*by, "date")
    ranked = v.withColumns({"r": F.row_number().over(w.orderBy(F.col("vol").asc_nulls_last(), "asset")), "m": F.count("vol").over(w), "leg": leg})
    share = F.when(F.col("vol").isNotNull() & (F.col("r") <= F.col("leg")), 1.0 / F.col("leg"))
    if long_short:
        share = share.when(F.col("vol").isNotNull() & (F.col("r") > F.col("m") - F.col("leg")), -1.0 / F.col("leg"))
    decides = _decides(length, every) & (F.col("m") >= 2 * F.col("leg"))
    return ranked.select(*by, "date", "asset", F.when(decides, share.otherwise(0.0)).alias("weight"))


def equal_weights(returns: DataFrame, every: int = 21, by: list[str] = []) -> DataFrame:
    p = _placed(returns, by)
    return p.select(*by, "date", "asset", F.when(F.col("pos") % every == 0, 1.0 / F.col("n")).alias("weight"))


def single_asset_weights(returns: DataFrame, asset: str, by: list[str] = []) -> DataFrame:
    """All in one asset; a name that no row has fails the query."""
    found = F.max(F.col("asset") == asset).over(Window.partitionBy(*(by or [F.lit(1)])))
    w = F.when(~found, F.raise_error(F.lit(f"unknown asset: {asset}")).cast("double")).when(F.col("asset") == asset, 1.0).otherwise(0.0)
    return returns.select(*by, "date", "asset", w.alias("weight"))


def daily(returns: DataFrame, weights: DataFrame, by: list[str] = []) -> DataFrame:
    """by, date, gross, turnover, exposure. Weights fill forward on the returns'
    dates, 0 before the first; the weight held is that of the date before;
    turnover is the change of targets, the first date's being their size."""
    w = Window.partitionBy(*by, "asset").orderBy("date")
    keyed = returns.select(*by, "date", "asset", "ret").join(weights.select(*by, "date", "asset", "weight"), [*by, "date", "asset"], "left")
    target = F.coalesce(F.last("weight", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    t = keyed.withColumn("target", target)
    t = t.withColumn("held", F.coalesce(F.lag("target").over(w), F.lit(0.0)))
    return t.groupBy(*by, "date").agg(F.sum(F.col("held") * F.col("ret")).alias("gross"), F.sum(F.abs(F.col("target") - F.col("held"))).alias("turnover"), F.sum("held").alias("exposure"))


def path(days: DataFrame, cost_bps: float = 25.0, by: list[str] = []) -> DataFrame:
    """by, date, gross, turnover, exposure, net, equity, drawdown."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    net = days.withColumn("net", F.col("gross") - F.col("turnover") * F.lit(cost_bps / 1e4))
    eq = net.withColumn("equity", F.product(F.lit(1.0) + F.col("net")).over(w))
    return eq.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def run(returns: DataFrame, weights: DataFrame, cost_bps: float = 25.0, by: list[str] = []) -> DataFrame:
    return path(daily(returns, weights, by), cost_bps, by)


def _per_year(n: Column, days: Column) -> Column:
    return F.when((n < 2) | (days <= 0), F.lit(TRADING_DAYS)).otherwise(n / (days / 365.25))


def periods_per_year(returns: DataFrame, by: list[str] = []) -> DataFrame:
    d = returns.groupBy(*by).agg(F.countDistinct("date").cast("double").alias("n"), F.datediff(F.max(F.col("date").cast("date")), F.min(F.col("date").cast("date"))).alias("d"))
    return d.select(*by, _per_year(F.col("n"), F.col("d")).alias("periods_per_year"))


def stats(curve: DataFrame, by: list[str] = []) -> DataFrame:
    """One row per group of a ``path``: sharpe, t_statistic, cagr, vol,
    max_drawdown, turnover_per_year, average_exposure, n_obs, periods_per_year;
    ratios null where returns do not vary, cagr null
    where equity falls below 0."""
    a = curve.groupBy(*by).agg(
        F.avg("net").alias("m"), F.stddev_samp("net").alias("s"), F.count("*").cast("double").alias("n"), F.datediff(F.max(F.col("date").cast("date")), F.min(F.col("date").cast("date"))).alias("d"),
        F.max_by("equity", "date").alias("e"), F.min("drawdown").alias("max_drawdown"), F.avg("turnover").alias("t"), F.avg("exposure").alias("average_exposure"),
    )
    a = a.withColumn("ppy", _per_year(F.col("n"), F.col("d"))).withColumn("years", F.col("n") / F.col("ppy"))
    sharpe = F.try_divide(F.col("m"), F.nullif(F.col("s"), F.lit(0.0))) * F.sqrt("ppy")
    return a.select(
        *by, sharpe.alias("sharpe"), (sharpe * F.sqrt("years")).alias("t_statistic"), F.when(F.col("e") >= 0, F.pow("e", 1 / F.col("years")) - 1).alias("cagr"), (F.col("s") * F.sqrt("ppy")).alias("vol"),
        "max_drawdown", (F.col("t") * F.col("ppy")).alias("turnover_per_year"), "average_exposure", F.col("n").cast("long").alias("n_obs"), F.col("ppy").alias("periods_per_year"),
    )


def summary_text(found: DataFrame, by: list[str] = []) -> DataFrame:
    """by, summary: a row of ``stats`` in a line; n/a for what is null."""
    parts = (("Sharpe ", "%+.3f", "sharpe", 1), ("  CAGR ", "%+.2f%%", "cagr", 100), ("  volatility ", "%.2f%%", "vol", 100), ("  drawdown ", "%.2f%%", "max_drawdown", 100), ("  turnover ", "%.1fx a year", "turnover_per_year", 1), ("  exposure ", "%.0f%%", "average_exposure", 100))
    words = [x for name, form, c, k in parts for x in (F.lit(name), F.when(F.col(c).isNull(), "n/a").otherwise(F.format_string(form, F.col(c) * k)))]
    return found.select(*by, F.concat(*words).alias("summary"))


def cost_sharpes(days: DataFrame, costs: tuple[int, ...] = (10, 25, 50), by: list[str] = []) -> DataFrame:
    """by, sharpe_by_cost (map), breakeven_bps. Net return is linear in cost, so
    five moments of (gross, turnover) give the ratio at any cost in one pass,
    and the cost at which the mean is 0 in closed form, between 0 and 500."""
    a = days.groupBy(*by).agg(
        F.avg("gross").alias("g"), F.avg("turnover").alias("t"), F.var_samp("gross").alias("vg"), F.var_samp("turnover").alias("vt"), F.covar_samp("gross", "turnover").alias("c"),
        F.count("*").cast("double").alias("n"), F.datediff(F.max(F.col("date").cast("date")), F.min(F.col("date").cast("date"))).alias("d"),
    ).withColumn("ppy", _per_year(F.col("n"), F.col("d")))
    entries = []
    for bps in costs:
        c = bps / 1e4
        var = F.col("vg") - 2 * c * F.col("c") + c * c * F.col("vt")
        entries += [F.lit(str(bps)), F.when(var > 0, (F.col("g") - c * F.col("t")) / F.sqrt(F.nullif(F.greatest(var, F.lit(0.0)), F.lit(0.0))) * F.sqrt("ppy"))]
    # a bisection of 40 steps on [0, 500] ends this far below its ceiling
    ceiling = 500.0 * (1 - 2.0**-41)
    level = F.when(F.col("g") <= 0, 0.0).when(F.col("t") == 0, ceiling).otherwise(F.least(F.col("g") / F.nullif(F.col("t"), F.lit(0.0)) * 1e4, F.lit(ceiling)))
    return a.select(*by, F.create_map(*entries).alias("sharpe_by_cost"), level.alias("breakeven_bps"))
