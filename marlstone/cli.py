"""python -m marlstone universes | status | panel | coverage | diagnose | build | fetch"""

from __future__ import annotations

import argparse
import os
import sys
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions import kernels
from .functions.kernels import ESTIMATORS
from .operators import alignment, rolling
from .sources import store, universes, vendor
from .sources.shared import cut

#: First day that is fetched by default, by asset class.
STARTS = {"equity": "2000-01-01", "crypto": "2018-01-01"}


def session() -> SparkSession:
    return SparkSession.builder.appName("marlstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def root() -> str:
    return os.environ.get("MARLSTONE_DIR", "marlstone-data")


def bars(spark: SparkSession) -> store.Store:
    return store.Store(spark, f"{root()}/eod")


def prices(spark: SparkSession, u: universes.Universe) -> DataFrame:
    members = F.broadcast(u.table(spark).select("asset"))
    return bars(spark).read().select("date", F.col("ticker").alias("asset"), F.col("adj_close").alias("price")).join(members, "asset")


def panel(spark: SparkSession, u: universes.Universe, start: str | None, end: str | None) -> alignment.Panel:
    return alignment.align(prices(spark, u), u.table(spark).select("asset"), u.limit, start, end)


def cmd_universes(spark: SparkSession, a: argparse.Namespace) -> int:
    for u in universes.UNIVERSES.values():
        print(f"{u.key}: {u.title} ({len(u)}). {u.caveats}")
        u.table(spark).groupBy("grp").count().orderBy("grp").show(truncate=False)
    return 0


def cmd_status(spark: SparkSession, a: argparse.Namespace) -> int:
    u = universes.get(a.universe)
    s = store.summary(bars(spark).read(), u.table(spark).select(F.col("asset").alias("ticker"))).orderBy("ticker")
    s.show(len(u), truncate=False)
    s.agg(F.count(F.when(F.col("rows") > 0, 1)).alias("cached"), F.count(F.when(F.col("rows") == 0, 1)).alias("missing")).show()
    return 0


def cmd_panel(spark: SparkSession, a: argparse.Namespace) -> int:
    p = panel(spark, universes.get(a.universe), a.start, a.end)
    p.report.orderBy("asset").show(1000, truncate=False)
    alignment.summary_text(p).show(truncate=False)
    p.summary.show(truncate=False)
    n = p.summary.select("retained", F.explode(F.array(F.lit(90), F.lit(252), F.lit(504))).alias("window"))
    q = alignment.q_ratio(F.col("retained"), F.col("window"))
    n.select("window", F.round(q, 3).alias("q"), F.when(q >= 1, "singular").when(q > 0.25, "noisy").otherwise("").alias("flag")).show()
    mean = alignment.log_returns(p.prices).groupBy("date").agg(F.avg("ret").alias("r"))
    mean.agg((F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("equal_weight_volatility")).show()
    return 0


def cmd_coverage(spark: SparkSession, a: argparse.Namespace) -> int:
    u = universes.get(a.universe)
    alignment.coverage_frontier(prices(spark, u), a.starts, u.limit).show()
    return 0


def _tables(spark: SparkSession, a: argparse.Namespace) -> tuple[dict, alignment.Panel, universes.Universe, DataFrame]:
    u = universes.get(a.universe)
    _, p = alignment.returns_report(prices(spark, u), u.limit, requested=u.table(spark).select("asset"), start=a.start, end=a.end)
    r = cut(alignment.log_returns(p.prices), "returns")
    groups = u.table(spark).select("asset", "grp")
    return {**rolling.windows_table(r, groups, a.window, a.step, a.estimator), "returns": r}, p, u, groups


def cmd_diagnose(spark: SparkSession, a: argparse.Namespace) -> int:
    t, _, _, groups = _tables(spark, a)
    w = rolling.diagnostic_windows(t["matrices"], groups)
    rolling.diagnostic_summary(w, [c for c in w.columns if c != "window_end"]).show(50, truncate=False)
    return 0


def cmd_build(spark: SparkSession, a: argparse.Namespace) -> int:
    t, p, u, groups = _tables(spark, a)
    windows = t["windows"].join(rolling.layout_drift(t["layouts"]), "window_end", "left")
    out = store.Artifact(spark, f"{root()}/artifacts", u.key, a.estimator, a.window, a.step)
    spec = {"universe": u.key, "start": a.start, "end": a.end, "window": a.window, "step": a.step, "estimator": a.estimator}
    n = t["returns"].agg(F.countDistinct("asset")).first()[0]
    meta = store.artifact_meta(p, t["returns"], windows, groups, spec, __version__, u.group_label, u.caveats, kernels.n_components(n))
    out.save({"windows": windows, "edges": t["edges"], "layouts": t["layouts"], "returns": t["returns"]}, meta)
    w = out.load()["windows"]
    w.agg(F.count("*").alias("windows"), F.min("absorption_ratio"), F.max("absorption_ratio"), F.max_by("window_end", "absorption_ratio").alias("peak"), F.percentile("edge_survival", F.lit(0.5)).alias("median_survival")).show(truncate=False)
    return 0


def cmd_fetch(spark: SparkSession, a: argparse.Namespace) -> int:
    import requests

    failed = 0
    todo = universes.UNIVERSES.values() if a.universe == "all" else [universes.get(a.universe)]
    for u in todo:
        client = vendor.Client(requests.Session(), a.base, vendor.api_key())
        out = vendor.fetch(spark, bars(spark), client, u.tickers, a.start or STARTS[u.asset_class], a.end or date.today().isoformat(), u.asset_class == "crypto", a.force)
        bad = out.where(F.col("status").startswith("error"))
        bad.show(1000, truncate=False)
        failed += bad.count()
    return int(failed > 0)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="marlstone")
    sub = p.add_subparsers(required=True)
    for name, run in (("universes", cmd_universes), ("status", cmd_status), ("panel", cmd_panel), ("coverage", cmd_coverage), ("diagnose", cmd_diagnose), ("build", cmd_build), ("fetch", cmd_fetch)):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("--universe", default=universes.DEFAULT)
        c.add_argument("--start")
        c.add_argument("--end")
        if name == "coverage":
            c.add_argument("starts", nargs="*", default=["1998-01-01", "2000-01-01", "2005-01-01", "2010-01-01"])
        if name in ("diagnose", "build"):
            c.add_argument("--window", type=int, default=252)
            c.add_argument("--step", type=int, default=5)
            c.add_argument("--estimator", choices=ESTIMATORS, default="ledoit_wolf" if name == "diagnose" else "rmt_clipped")
        if name == "fetch":
            c.add_argument("--base", required=True)
            c.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    return a.run(session(), a)


if __name__ == "__main__":
    sys.exit(main())
