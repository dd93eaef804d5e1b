"""Pre-registered experiment grids: every cell of a grid is one key of the same
plan, so all cells of a universe run together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignment, backtest
from ..sources.shared import cut

COSTS = (10, 25, 50)
PRIMARY = 25
KILL = 0.30
HOLDOUT_T = {"momentum": 2.94, "volatility": 3.09}


@dataclass(frozen=True)
class Cell:
    """One cell: kind is momentum, managed, low_long or low_short."""

    name: str
    kind: str
    length: int
    target: float = 0.10


MOMENTUM = (Cell("3m", "momentum", 63), Cell("6m", "momentum", 126), Cell("12m", "momentum", 252))
MANAGED = (Cell("volmanaged_21d", "managed", 21), Cell("volmanaged_63d", "managed", 63))
LOW = tuple(Cell(f"lowvol_{n}d_{side}", f"low_{kind}", n) for n in (63, 252) for side, kind in (("long", "long"), ("ls", "short")))


def weights(returns: DataFrame, cell: Cell) -> DataFrame:
    if cell.kind == "momentum":
        return backtest.momentum_weights(returns, cell.length)
    if cell.kind == "managed":
        return backtest.volatility_managed_weights(returns, cell.target, cell.length)
    return backtest.low_volatility_weights(returns, cell.length, long_short=cell.kind == "low_short")


def cells(returns: DataFrame, universe: str, grid: tuple[Cell, ...], single: str | None = None) -> DataFrame:
    """One row per cell: universe, variant, n_assets, statistics at the primary
    cost, ratios at every cost, breakeven, benchmarks and the tests passed. A
    cell whose lookback the history doesn't fill has no row (momentum alone).
    """
    returns = cut(returns.select("date", "asset", "ret"), "returns")
    size = returns.agg(F.countDistinct("asset").alias("n_assets"), F.countDistinct("date").alias("n_dates")).first()
    grid = tuple(c for c in grid if c.kind != "momentum" or size["n_dates"] >= c.length + 21)
    if not grid or not size["n_assets"]:
        return returns.sparkSession.createDataFrame([], "universe string, variant string")
    w = reduce(DataFrame.unionByName, (weights(returns, c).withColumn("variant", F.lit(c.name)) for c in grid))
    keyed = returns.crossJoin(F.broadcast(returns.sparkSession.createDataFrame([(c.name,) for c in grid], "variant string")))
    days = cut(backtest.daily(keyed, w, ["variant"]), "days")
    stats = backtest.stats(backtest.path(days, PRIMARY, ["variant"]), ["variant"])
    costs = backtest.cost_sharpes(days, COSTS, ["variant"])
    bench = backtest.stats(backtest.run(returns, backtest.equal_weights(returns), PRIMARY)).select(F.col("sharpe").alias("equal_weight_sharpe"))
    if single is not None:
        one = backtest.stats(backtest.run(returns, backtest.single_asset_weights(returns, single), PRIMARY)).select(F.col("sharpe").alias("single_sharpe"))
    else:
        one = returns.sparkSession.createDataFrame([(None,)], "single_sharpe double")
    out = stats.join(costs, "variant").crossJoin(F.broadcast(bench)).crossJoin(F.broadcast(one))
    hurdle = F.greatest("equal_weight_sharpe", "single_sharpe")
    return out.select(
        F.lit(universe).alias("universe"), "variant", F.lit(size["n_assets"]).cast("int").alias("n_assets"), "n_obs", "sharpe", "t_statistic", "cagr", "vol", "max_drawdown", "turnover_per_year", "average_exposure",
        *(F.col("sharpe_by_cost")[str(c)].alias(f"sharpe_{c}") for c in COSTS), "breakeven_bps", "equal_weight_sharpe", "single_sharpe",
        F.coalesce(F.col("sharpe") >= KILL, F.lit(False)).alias("passes_kill"), F.coalesce(F.col("sharpe") > hurdle, F.lit(False)).alias("beats_benchmarks"),
    )


def explore(returns: DataFrame, universe: str, grid: tuple[Cell, ...], single: str | None = None, fraction: float = 0.7) -> DataFrame:
    """Cells on the first part of the history; signals warm up within it."""
    return cells(alignment.split(returns, fraction)[0], universe, grid, single)


def survivors(found: DataFrame, must_beat: bool) -> DataFrame:
    return found.where("passes_kill and beats_benchmarks" if must_beat else "passes_kill")


def holdout(returns: DataFrame, universe: str, grid: tuple[Cell, ...], names: DataFrame, bar: float, single: str | None = None, fraction: float = 0.7) -> DataFrame:
    """Cells of the surviving variants on the last part, with the verdict."""
    return judged(cells(alignment.split(returns, fraction)[1], universe, grid, single).join(names.select("variant").distinct(), "variant", "left_semi"), bar)


def judged(found: DataFrame, bar: float) -> DataFrame:
    """found with the verdict: survives if it beats the benchmarks with a t
    statistic beyond the bar and a positive ratio."""
    verdict = F.col("beats_benchmarks") & F.coalesce(F.abs("t_statistic") > bar, F.lit(False)) & F.coalesce(F.col("sharpe") > 0, F.lit(False))
    return found.withColumn("verdict", F.when(verdict, "survives").otherwise("fails"))


# fixed values: universe, first day and single-asset benchmark of each grid
MOMENTUM_UNIVERSES = {"crypto_core": ("2019-01-01", "BTCUSD"), "crypto_majors": ("2021-09-01", "BTCUSD"), "sector_etfs": ("2018-07-01", None), "cross_asset": ("2008-01-01", "SPY"), "core_equity": ("2000-01-01", None)}
MANAGED_UNIVERSES = {"core_equity": ("2000-01-01", None), "cross_asset": ("2008-01-01", "SPY"), "crypto_core": ("2019-01-01", "BTCUSD")}
LOW_UNIVERSES = {"core_equity": ("2000-01-01", None)}
# fixed values: target volatility of each universe
TARGETS = {"core_equity": 0.15, "cross_asset": 0.10, "crypto_core": 0.50, "crypto_majors": 0.50, "sector_etfs": 0.15}
#: Significance of a cell: 0.05 over the cells of its own programme.
MOMENTUM_ALPHA = 0.05 / (len(MOMENTUM_UNIVERSES) * len(MOMENTUM))
VOLATILITY_ALPHA = 0.05 / (len(MANAGED_UNIVERSES) * len(MANAGED) + len(LOW_UNIVERSES) * len(LOW))


def grid_of(universe: str, kind: str) -> tuple[Cell, ...]:
    """The cells of a universe in the momentum or the volatility programme."""
    if kind == "momentum":
        return MOMENTUM if universe in MOMENTUM_UNIVERSES else ()
    managed = tuple(Cell(c.name, c.kind, c.length, TARGETS[universe]) for c in MANAGED) if universe in MANAGED_UNIVERSES else ()
    return managed + (LOW if universe in LOW_UNIVERSES else ())


# fixed values: variants that reached the holdout of each programme
REACHED = {"momentum": {("core_equity", "6m"), ("core_equity", "12m")}, "volatility": {("core_equity", "volmanaged_21d"), ("core_equity", "volmanaged_63d"), ("core_equity", "lowvol_63d_long"), ("core_equity", "lowvol_252d_long")}}
_UNIVERSES = {"momentum": MOMENTUM_UNIVERSES, "volatility": MANAGED_UNIVERSES}


def explore_all(returns_of: Callable[[str, str], DataFrame | None], kind: str, only: set[tuple[str, str]] | None = None, part: str = "explore") -> DataFrame | None:
    """The cells of every universe of a programme on one part of its history.

    returns_of(universe, first day) gives its returns, or None where there are
    none: that universe has no cells. ``only`` restricts the cells to some
    (universe, variant). None if no universe has returns."""
    out = None
    for universe, (first, single) in _UNIVERSES[kind].items():
        grid = tuple(c for c in grid_of(universe, kind) if only is None or (universe, c.name) in only)
        rt = returns_of(universe, first) if grid else None
        if rt is None:
            continue
        found = cells(alignment.split(rt)[0 if part == "explore" else 1], universe, grid, single)
        if len(found.columns) > 2:
            out = found if out is None else out.unionByName(found)
    return out


def programme_survivors(found: DataFrame, kind: str) -> DataFrame:
    """Cells that go on: momentum by its ratio alone, volatility if it beats the
    benchmarks too."""
    return survivors(found, must_beat=kind == "volatility")


def holdout_all(returns_of: Callable[[str, str], DataFrame | None], kind: str, only: set[tuple[str, str]] | None = None) -> DataFrame | None:
    """The holdout cells of the variants that reached it, with the verdict."""
    found = explore_all(returns_of, kind, REACHED[kind] if only is None else only, "holdout")
    return None if found is None else judged(found, HOLDOUT_T[kind])


def header(kind: str, part: str) -> dict:
    """What is written beside the cells of a run."""
    return {"programme": kind, "partition": part, "primary_cost_bps": PRIMARY, "alpha": MOMENTUM_ALPHA if kind == "momentum" else VOLATILITY_ALPHA, "bar": HOLDOUT_T[kind], "survivors_tested": sorted(map("/".join, REACHED[kind])) if part == "holdout" else []}


def save_run(found: DataFrame, kind: str, part: str, path: str) -> None:
    """One JSON document: the header and all cells (a row a cell: a few dozen)."""
    h = header(kind, part)
    one = found.agg(F.array_sort(F.collect_list(F.struct(*found.columns))).alias("cells"))
    for k, v in h.items():
        one = one.withColumn(k, F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v))
    one.select(*h, "cells").coalesce(1).write.mode("overwrite").json(path)


def save(found: DataFrame, path: str) -> None:
    """Cells as lines of JSON in one file."""
    found.coalesce(1).write.mode("overwrite").json(path)
