"""Rolling windows of rows, and the tables built from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources.shared import cut
from . import structure
from .alignment import positions


def hopping(returns: DataFrame, window: int = 252, step: int = 5) -> DataFrame:
    """returns once per window that holds the row: window_id, window_start,
    window_end added. Window k holds rows k * step to k * step + window - 1 of
    the calendar; the last partial one is left out."""
    placed = positions(returns)
    last = placed.agg(F.floor((F.max("pos") + 1 - window) / step).alias("k_"))
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - window + 1) / step).cast("int"))
    ids = F.filter(F.sequence(first, F.greatest(first, F.least(F.col("k_"), F.floor(F.col("pos") / step)).cast("int"))), lambda k: (k * step <= F.col("pos")) & (F.col("pos") < k * step + window) & (k <= F.col("k_")))
    rows = placed.crossJoin(F.broadcast(last)).withColumn("window_id", F.explode(ids)).drop("k_")
    ends = rows.groupBy("window_id").agg(F.min("date").alias("window_start"), F.max("date").alias("window_end"))
    return rows.join(F.broadcast(ends), "window_id")


def rolling_matrices(returns: DataFrame, window: int = 252, step: int = 5, estimator: str = "rmt_clipped", method: str = "average", n_clusters: int | None = None, fraction: float = 0.2, keep_matrix: bool = True) -> DataFrame:
    """window_id, window_start, window_end and structure.MATRIX_SCHEMA of every
    window.

    Dates travel as one vector each, and windows are worked on in chunks of
    consecutive ones, as many as overlap: a date is sent about twice, where
    sending each window its own rows would send it window / step times.
    """
    structure.check_estimator(estimator)
    chunk = max(1, -(-window // step))
    kind = dict(returns.dtypes)["date"]
    placed = positions(returns)
    days = placed.groupBy("pos", "date").agg(F.array_sort(F.collect_list(F.struct("asset", "ret"))).alias("v"))
    last = placed.agg(F.floor((F.max("pos") + 1 - window) / step).cast("int").alias("k_"))
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - window + 1) / step).cast("int"))
    most = F.least(F.col("k_"), F.floor(F.col("pos") / step).cast("int"))
    rows = days.crossJoin(F.broadcast(last)).where(first <= most)
    rows = rows.select("pos", "date", "k_", "v.asset", "v.ret", F.explode(F.sequence(F.floor(first / chunk).cast("int"), F.floor(most / chunk).cast("int"))).alias("chunk"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        names, x, dates, pos0 = list(rows["asset"].iloc[0]), np.stack(rows["ret"].to_list()), rows["date"].to_list(), int(rows["pos"].iloc[0])
        out = []
        for k in range(key[0] * chunk, min((key[0] + 1) * chunk - 1, int(rows["k_"].iloc[0])) + 1):
            a = k * step - pos0
            out.append({"window_id": k, "window_start": dates[a], "window_end": dates[a + window - 1], **structure.measures(x[a : a + window], names, estimator, method, n_clusters, fraction, keep_matrix)})
        return structure.measure_frame(out, ["window_id", "window_start", "window_end"])

    return rows.groupBy("chunk").applyInPandas(run, f"window_id int, window_start {kind}, window_end {kind}, {structure.MATRIX_SCHEMA}")


def windows_table(returns: DataFrame, groups: DataFrame, window: int = 252, step: int = 5, estimator: str = "rmt_clipped") -> dict[str, DataFrame]:
    """windows, edges and layouts of every window. The matrix stage is cut: it
    has one row per window, and every table comes from it."""
    m = cut(rolling_matrices(returns, window, step, estimator, keep_matrix=False), "matrices")
    edges = m.select("window_id", "window_end", F.inline("edges"))
    return {"matrices": m, "edges": edges, "windows": summarise(m, groups), "layouts": layouts(edges)}


def summarise(m: DataFrame, groups: DataFrame) -> DataFrame:
    """The wide row of each window, with tree, purity, hub and survival.

    A window's edges are an array of its row, so all of these are expressions
    on that row; survival looks one row back. groups (asset, grp) is a small
    dimension and comes along as one map.
    """
    label = groups.where("grp is not null").groupBy("asset").agg(F.min("grp").alias("grp")).agg(F.map_from_entries(F.collect_list(F.struct("asset", "grp"))).alias("label"))
    d = m.crossJoin(F.broadcast(label))
    name = lambda x: F.concat_ws("\u0001", x["source"], x["target"])
    of = lambda a: F.try_element_at("label", a)
    degree = lambda a: F.size(F.filter("edges", lambda x: (x["source"] == a) | (x["target"] == a)))
    mean = lambda xs: F.try_divide(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x), F.size(xs).cast("double"))
    known = F.filter("edges", lambda x: of(x["source"]).isNotNull() & of(x["target"]).isNotNull())
    marks = F.filter(F.transform("assets", of), lambda g: g.isNotNull())
    d = d.withColumns({
        "tree_length": mean(F.transform("edges", lambda x: x["distance"])),
        "top": F.array_max(F.transform("assets", lambda a, i: F.struct(degree(a).alias("degree"), (-i).alias("place")))),
        "purity": mean(F.transform(known, lambda x: (of(x["source"]) == of(x["target"])).cast("double"))),
        "marks": marks,
        "kept": F.transform("edges", name),
    })
    n = F.size("marks").cast("double")
    same = F.aggregate(F.transform("marks", lambda g: F.size(F.filter("marks", lambda h: h == g)) - 1), F.lit(0), lambda s, x: s + x)
    base = F.try_divide(same.cast("double"), n * (n - 1))
    before = Window.orderBy("window_end")  # a row per window
    d = d.withColumns({"baseline": base, "old": F.lag("kept").over(before), "was": F.lag("assets").over(before)})
    d = d.withColumn("shared", F.array_intersect("assets", "was"))
    d = d.withColumn("old", F.filter("old", lambda x: F.array_contains("shared", F.split(x, "\u0001")[0]) & F.array_contains("shared", F.split(x, "\u0001")[1])))
    survival = F.when(F.col("was").isNotNull() & (F.size("shared") >= 2) & (F.size("old") > 0), F.size(F.array_intersect("kept", "old")) / F.size("old"))
    return d.select(
        "window_end", "window_start", "n_assets", "n_obs", "q", "mean_correlation", "absorption_ratio", "pc1_share", "effective_dimension", "n_factors", "lambda_plus", "sigma_squared", "shrinkage", "condition_number", "cophenetic", "depth_ratio",
        "tree_length", F.get("assets", -F.col("top.place")).alias("hub"), "purity", F.when(F.col("baseline") > 0, F.col("purity") / F.col("baseline")).alias("purity_lift"), survival.alias("edge_survival"),
    )


def cluster_stability(m: DataFrame) -> DataFrame:
    """window_end, cluster_stability: adjusted Rand index of each window's flat
    clusters against those of the window before."""
    c = m.select("window_end", F.posexplode("assets").alias("k", "asset"), "clusters").select("window_end", "asset", F.col("clusters")[F.col("k")].alias("cluster"))
    ends = c.select("window_end").distinct().withColumn("before", F.lag("window_end").over(Window.orderBy("window_end")))
    prev = ends.where("before is not null").join(c.withColumnRenamed("window_end", "before"), "before").select("window_end", "asset", "cluster")
    return structure.adjusted_rand(c, prev, ["window_end"]).withColumnRenamed("ari", "cluster_stability")


def diagnostic_windows(m: DataFrame, groups: DataFrame) -> DataFrame:
    w = summarise(m, groups).select("window_end", "mean_correlation", "absorption_ratio", "pc1_share", "effective_dimension", "tree_length", "cophenetic", "depth_ratio", "edge_survival", "purity", "purity_lift")
    return w.join(cluster_stability(m), "window_end", "left")


def diagnostic_summary(windows: DataFrame, columns: list[str]) -> DataFrame:
    """metric, min, median, max, q25, q75 of each column, nulls left out."""
    long = windows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*")
    return long.where("v is not null and not isnan(v)").groupBy("metric").agg(F.min("v").alias("min"), F.percentile("v", F.lit(0.5)).alias("median"), F.max("v").alias("max"), F.percentile("v", F.lit(0.25)).alias("q25"), F.percentile("v", F.lit(0.75)).alias("q75"))


#: Measures of ``allocation``.
ALLOCATION = ("max_gap_hrp_ivp", "max_gap_hrp_ew", "corr_hrp_ivp", "eff_n_hrp", "eff_n_ivp", "max_weight_hrp", "turnover_hrp", "turnover_ivp")


def allocation(m: DataFrame) -> DataFrame:
    """window_end and how the hierarchical allocation differs from the inverse
    variance and the equal one; turnovers against the window before."""
    z = m.select("window_end", F.explode(F.arrays_zip("assets", "hrp", "ivp")).alias("x")).select("window_end", F.col("x.assets").alias("asset"), F.col("x.hrp").alias("h"), F.col("x.ivp").alias("v"))
    n = Window.partitionBy("window_end")
    z = z.withColumn("e", 1.0 / F.count("*").over(n))
    order = z.select("window_end").distinct().withColumn("k", F.row_number().over(Window.orderBy("window_end")))
    z = z.join(order, "window_end")
    before = z.select((F.col("k") + 1).alias("k"), "asset", F.col("h").alias("ph"), F.col("v").alias("pv"))
    z = z.join(before, ["k", "asset"], "left")
    return z.groupBy("window_end").agg(
        F.max(F.abs(F.col("h") - F.col("v"))).alias("max_gap_hrp_ivp"), F.max(F.abs(F.col("h") - F.col("e"))).alias("max_gap_hrp_ew"), F.try_divide(F.covar_samp("h", "v"), F.nullif(F.stddev_samp("h") * F.stddev_samp("v"), F.lit(0.0))).alias("corr_hrp_ivp"),
        (1 / F.sum(F.col("h") ** 2)).alias("eff_n_hrp"), (1 / F.sum(F.col("v") ** 2)).alias("eff_n_ivp"), F.max("h").alias("max_weight_hrp"),
        F.sum(F.abs(F.col("h") - F.col("ph"))).alias("turnover_hrp"), F.sum(F.abs(F.col("v") - F.col("pv"))).alias("turnover_ivp"),
    )


def allocation_summary(a: DataFrame) -> DataFrame:
    """One row over the windows of ``allocation``: medians, extremes, the 90th
    percentile of the turnovers and the ratio of their medians; nulls left out,
    and a null ratio where the median inverse-variance turnover is 0."""
    mid = lambda c: F.percentile(c, F.lit(0.5))
    return a.agg(
        F.count("*").alias("n_windows"), mid("max_gap_hrp_ivp").alias("median_max_gap_hrp_ivp"), F.max("max_gap_hrp_ivp").alias("largest_max_gap_hrp_ivp"), mid("max_gap_hrp_ew").alias("median_max_gap_hrp_ew"),
        mid("corr_hrp_ivp").alias("median_corr_hrp_ivp"), F.min("corr_hrp_ivp").alias("least_corr_hrp_ivp"), *(mid(c).alias(f"median_{c}") for c in ALLOCATION[3:]),
        *(F.percentile(c, F.lit(0.9)).alias(f"p90_{c}") for c in ALLOCATION[6:]), F.try_divide(mid("turnover_hrp"), mid("turnover_ivp")).alias("turnover_ratio"),
    )


def correlation_at(returns: DataFrame, end: str, window: int = 252, estimator: str = "rmt_clipped") -> DataFrame:
    """The matrix row of the window that ends on a trading day. Another day, or
    too short a history before it, fails the query."""
    placed = positions(returns)
    at = placed.where(F.col("date").cast("date") == F.lit(end).cast("date")).agg(F.max("pos").alias("p"))
    p = F.when(F.col("p").isNull(), F.raise_error(F.lit(f"{end} is no trading day")).cast("int")).when(F.col("p") < window - 1, F.raise_error(F.lit(f"no {window} rows up to {end}")).cast("int")).otherwise(F.col("p"))
    rows = placed.crossJoin(F.broadcast(at.select(p.alias("p")))).where((F.col("pos") <= F.col("p")) & (F.col("pos") > F.col("p") - window))
    return structure.matrices(rows.withColumn("window_end", F.lit(end).cast("date")), ["window_end"], estimator)


def clustering(returns: DataFrame, asof: str, window: int = 252, method: str = "average", estimator: str = "rmt_clipped") -> DataFrame:
    """The matrix row of the last ``window`` dates up to ``asof`` inclusive."""
    past = returns.where(F.col("date").cast("date") <= F.lit(asof).cast("date"))
    dates = past.select("date").distinct().withColumn("r", F.row_number().over(Window.orderBy(F.desc("date")))).where(F.col("r") <= window).drop("r")
    return structure.matrices(past.join(dates, "date").withColumn("asof", F.lit(asof).cast("date")), ["asof"], estimator, method)


def layouts(edges: DataFrame, seed: int = 7, cold: int = 300, warm: int = 12) -> DataFrame:
    """window_end, ticker, x, y: each tree's layout starts from the one before.
    A fold over all trees, so one task; its rows are the trees' edges."""
    kinds = dict(edges.dtypes)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out, last = [], {}
        for end, tree in rows.sort_values(["window_end", "source", "target"]).groupby("window_end", sort=True):
            names = sorted(set(tree["source"]) | set(tree["target"]))
            at = {x: k for k, x in enumerate(names)}
            e = [(at[s], at[t], d) for s, t, d in zip(tree["source"], tree["target"], tree["distance"])]
            if last:
                start = np.random.default_rng(seed).random((len(names), 2)) * 2 - 1  # for those that are new
                for x, k in at.items():
                    if x in last:
                        start[k] = last[x]
                pos = kernels.spring_layout(e, len(names), seed, start, warm)
            else:
                pos = kernels.spring_layout(e, len(names), seed, rounds=cold)
            last = {x: pos[k] for x, k in at.items()}
            out += [(end, x, float(pos[k][0]), float(pos[k][1])) for x, k in at.items()]
        return pd.DataFrame(out, columns=["window_end", "ticker", "x", "y"])

    one = edges.select("window_end", "source", "target", "distance").withColumn("one_", F.lit(1))
    return one.groupBy("one_").applyInPandas(run, f"window_end {kinds['window_end']}, ticker string, x double, y double")


def layout_drift(table: DataFrame) -> DataFrame:
    """window_end, layout_drift: mean way of a ticker since the window before;
    null for the first."""
    order = table.select("window_end").distinct().withColumn("k", F.row_number().over(Window.orderBy("window_end")))
    t = table.join(order, "window_end")
    p = t.select((F.col("k") + 1).alias("k"), "ticker", F.col("x").alias("px"), F.col("y").alias("py"))
    return t.join(p, ["k", "ticker"], "left").groupBy("window_end").agg(F.avg(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))).alias("layout_drift"))
