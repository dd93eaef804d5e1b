"""Correlation structure of returns: estimators, distances, trees, clusters and
the indices on top of them.

Relational forms take returns in long form (date, asset, ret) and group by any
further key columns ``by`` (such as a window id), so one plan serves a single
panel and all windows of a rolling one. Pairs are kept once, i < j. What needs
a dense matrix runs once per group in a grouped Arrow function that returns
every matrix-based quantity, so a spectrum is computed once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources.shared import cut

INDEPENDENT_DISTANCE = math.sqrt(2.0)
EPS = float(np.finfo(float).eps)


# -- estimators --------------------------------------------------------------


def constant_assets(returns: DataFrame, by: list[str] = []) -> DataFrame:
    """by, asset of the assets without variation (or with one observation)."""
    g = returns.groupBy(*by, "asset").agg(F.stddev_samp("ret").alias("sd"), F.max(F.abs("ret")).alias("m"))
    return g.where(F.col("sd").isNull() | (F.col("sd") <= 100 * EPS * F.greatest(F.col("m"), F.lit(1.0)))).select(*by, "asset")


def _standardised(returns: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by, "asset")
    z = (F.col("ret") - F.avg("ret").over(w)) / F.nullif(F.stddev_samp("ret").over(w), F.lit(0.0))
    return returns.select(*by, "date", "asset", z.alias("z"))


def sample_correlation(returns: DataFrame, by: list[str] = []) -> DataFrame:
    """by, i, j, rho for i < j; null where an asset does not vary."""
    z = _standardised(returns, by)
    a = z.select(*by, "date", F.col("asset").alias("i"), F.col("z").alias("zi"))
    b = z.select(*by, "date", F.col("asset").alias("j"), F.col("z").alias("zj"))
    rho = F.sum(F.col("zi") * F.col("zj")) / F.nullif(F.count("*") - 1, F.lit(0))
    return a.join(b, [*by, "date"]).where("i < j").groupBy(*by, "i", "j").agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho)).alias("rho"))


def ledoit_wolf(returns: DataFrame, by: list[str] = []) -> DataFrame:
    """by, i, j, rho, shrinkage: off-diagonal correlations shrunk towards 0 by
    the closed form on standardised returns."""
    z = _standardised(returns, by)
    days = z.groupBy(*by, "date").agg(F.sum(F.col("z") ** 2).alias("s"), F.count("*").alias("n"))
    per = days.groupBy(*by).agg(F.sum(F.col("s") ** 2).alias("b"), F.count("*").cast("double").alias("t"), F.max("n").cast("double").alias("n"))
    pairs = sample_correlation(returns, by)
    sums = pairs.groupBy(*by).agg(F.sum(F.col("rho") ** 2).alias("r"))
    one = per.crossJoin(sums) if not by else per.join(sums, by)
    t, n, a = F.col("t"), F.col("n"), (F.col("t") - 1) / F.col("t")
    delta0 = a * a * (n + 2 * F.col("r"))
    delta = (delta0 - 2 * a * n * a + n * a * a) / n
    beta = F.least((F.col("b") / t - delta0) / (n * t), delta)
    shrunk = one.select(*by, F.when(beta == 0, 0.0).otherwise(beta / delta).alias("shrinkage"))
    joined = pairs.crossJoin(F.broadcast(shrunk)) if not by else pairs.join(shrunk, by)
    return joined.select(*by, "i", "j", ((1 - F.col("shrinkage")) * F.col("rho")).alias("rho"), "shrinkage")


def covariance(pairs: DataFrame, returns: DataFrame, by: list[str] = []) -> DataFrame:
    """by, i, j, cov (i <= j) from correlations and sample deviations."""
    sd = returns.groupBy(*by, "asset").agg(F.stddev_samp("ret").alias("sd"))
    si, sj = sd.withColumnsRenamed({"asset": "i", "sd": "si"}), sd.withColumnsRenamed({"asset": "j", "sd": "sj"})
    off = pairs.join(si, [*by, "i"]).join(sj, [*by, "j"]).select(*by, "i", "j", (F.col("rho") * F.col("si") * F.col("sj")).alias("cov"))
    return off.union(sd.select(*by, F.col("asset").alias("i"), F.col("asset").alias("j"), (F.col("sd") ** 2).alias("cov")))


def inverse_variance_weights(returns: DataFrame, by: list[str] = []) -> DataFrame:
    v = returns.groupBy(*by, "asset").agg(F.var_samp("ret").alias("v"))
    w = Window.partitionBy(*(by or [F.lit(1)]))
    return v.select(*by, "asset", ((1 / F.col("v")) / F.sum(1 / F.col("v")).over(w)).alias("weight"))


def portfolio_variance(cov: DataFrame, weights: DataFrame, by: list[str] = []) -> DataFrame:
    """by, variance: w'Cw of weights (asset, weight) over covariances i <= j."""
    wi, wj = weights.withColumnsRenamed({"asset": "i", "weight": "wi"}), weights.withColumnsRenamed({"asset": "j", "weight": "wj"})
    terms = cov.join(wi, [*by, "i"]).join(wj, [*by, "j"])
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    return terms.groupBy(*by).agg(F.sum(twice * F.col("wi") * F.col("wj") * F.col("cov")).alias("variance"))


def effective_positions(weights: DataFrame, by: list[str] = []) -> DataFrame:
    return weights.groupBy(*by).agg((1 / F.sum(F.col("weight") ** 2)).alias("effective_positions"))


# -- distance ----------------------------------------------------------------


def distance_of(rho: Column) -> Column:
    return F.sqrt(2 * (1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))))


def distances(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("distance", distance_of(F.col("rho"))).drop("rho")


def both_ways(pairs: DataFrame) -> DataFrame:
    """Pairs i < j and their mirror images."""
    flip = pairs.select(*(F.col({"i": "j", "j": "i"}.get(c, c)).alias(c) for c in pairs.columns))
    return pairs.unionByName(flip)


def nearest(dist: DataFrame, k: int = 5, by: list[str] = []) -> DataFrame:
    """The k nearest of each asset, rank from 1; ties by name."""
    w = Window.partitionBy(*by, "i").orderBy("distance", "j")
    return both_ways(dist).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def metric_violations(dist: DataFrame, by: list[str] = [], tolerance: float = 1e-9) -> DataFrame:
    """by, i, j, k where going over k is shorter than the way from i to j, and
    pairs of negative distance (k null). Empty for a metric."""
    d = both_ways(dist)
    ik, kj = d.withColumnsRenamed({"j": "k", "distance": "a"}), d.withColumnsRenamed({"i": "k", "distance": "b"})
    over = dist.join(ik, [*by, "i"]).join(kj, [*by, "k", "j"]).where(F.col("distance") > F.col("a") + F.col("b") + tolerance)
    return over.select(*by, "i", "j", "k").union(dist.where(F.col("distance") < -tolerance).select(*by, "i", "j", F.lit(None).cast("string")))


# -- spanning tree -----------------------------------------------------------


def mst(dist: DataFrame, by: list[str] = []) -> DataFrame:
    """by, source, target, distance: the minimum spanning tree of each group;
    ties by the names of the ends. One Arrow group per tree."""
    keys = by or ["one_"]
    kinds = dict(dist.dtypes)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(rows["i"]) | set(rows["j"]))
        at = {x: k for k, x in enumerate(names)}
        d = np.full((len(names), len(names)), np.nan)
        np.fill_diagonal(d, 0.0)
        a, b = rows["i"].map(at).to_numpy(), rows["j"].map(at).to_numpy()
        d[a, b] = d[b, a] = rows["distance"].to_numpy()
        out = kernels.spanning_tree(d)
        return pd.DataFrame({**{c: v for c, v in zip(by, key)}, "source": [names[i] for i, _, _ in out], "target": [names[j] for _, j, _ in out], "distance": [w for _, _, w in out]})

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "source string, target string, distance double"])
    grouped = dist if by else dist.withColumn("one_", F.lit(1))
    return grouped.select(*keys, "i", "j", "distance").groupBy(*keys).applyInPandas(run, schema)


def minimax(dist: DataFrame, rounds: int, by: list[str] = []) -> DataFrame:
    """by, i, j, distance: over all paths the smallest largest step, by squaring
    the (min, max) matrix ``rounds`` times (paths of up to 2**rounds steps)."""
    m = both_ways(cut(dist.select(*by, "i", "j", "distance"), "distances"))
    for _ in range(rounds):
        a = m.withColumnsRenamed({"j": "k", "distance": "a"})
        b = m.withColumnsRenamed({"i": "k", "distance": "b"})
        over = a.join(b, [*by, "k"]).where("i <> j").select(*by, "i", "j", F.greatest("a", "b").alias("distance"))
        m = cut(m.union(over).groupBy(*by, "i", "j").agg(F.min("distance").alias("distance")), "minimax")  # read three times by the next round
    return m.where("i < j")


def mst_relational(dist: DataFrame, n_assets: int, by: list[str] = []) -> DataFrame:
    """The same tree without Python: an edge is in it if no path of shorter
    edges joins its ends. For few assets; distances must differ."""
    rounds = max(1, math.ceil(math.log2(max(2, n_assets - 1))))
    dist = cut(dist, "distances")
    m = minimax(dist, rounds, by).withColumnRenamed("distance", "bottleneck")
    return dist.join(m, [*by, "i", "j"]).where(F.col("distance") <= F.col("bottleneck")).select(*by, F.col("i").alias("source"), F.col("j").alias("target"), "distance")


def degrees(edges: DataFrame, by: list[str] = []) -> DataFrame:
    return edges.select(*by, F.explode(F.array("source", "target")).alias("asset")).groupBy(*by, "asset").agg(F.count("*").alias("degree"))


def hub(edges: DataFrame, by: list[str] = []) -> DataFrame:
    """by, hub: the asset of the largest degree, the first name of ties."""
    d = degrees(edges, by)
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc("degree"), "asset")
    return d.withColumn("r", F.row_number().over(w)).where("r = 1").select(*by, F.col("asset").alias("hub"), "degree")


def tree_length(edges: DataFrame, by: list[str] = []) -> DataFrame:
    return edges.groupBy(*by).agg(F.avg("distance").alias("tree_length"), F.count("*").alias("n_edges"))


def group_purity(edges: DataFrame, groups: DataFrame, by: list[str] = []) -> DataFrame:
    """by, purity, baseline, lift, n_edges. groups: asset, grp (a small
    dimension). Purity is the share of labelled edges within a group, the
    baseline that of all pairs of the tree's labelled assets."""
    s, t = groups.select(F.col("asset").alias("source"), F.col("grp").alias("gs")), groups.select(F.col("asset").alias("target"), F.col("grp").alias("gt"))
    marked = edges.join(s, "source").join(t, "target")
    p = marked.groupBy(*by).agg(F.avg((F.col("gs") == F.col("gt")).cast("double")).alias("purity"), F.count("*").alias("n_edges"))
    nodes = degrees(edges, by).join(groups.select("asset", "grp"), "asset")
    c = nodes.groupBy(*by, "grp").agg(F.count("*").cast("double").alias("c")).groupBy(*by).agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("w"), F.sum("c").alias("n"))
    base = F.try_divide("w", F.col("n") * (F.col("n") - 1))
    joined = p.join(c, by) if by else p.crossJoin(c)
    return joined.select(*by, "purity", base.alias("baseline"), F.when(base > 0, F.col("purity") / base).alias("lift"), "n_edges")


def edge_survival(edges: DataFrame, order: str) -> DataFrame:
    """order, edge_survival: share of the last tree's edges, among assets that
    both trees have, that this one keeps; null for the first, and where fewer
    than two assets or no edge are shared."""
    e = F.concat_ws("\u0001", F.least("source", "target"), F.greatest("source", "target"))
    sets = edges.groupBy(order).agg(F.collect_set(e).alias("e"), F.array_distinct(F.flatten(F.collect_list(F.array("source", "target")))).alias("v"))
    w = Window.orderBy(order)  # a row per window
    sets = sets.withColumns({"pe": F.lag("e").over(w), "pv": F.lag("v").over(w)})
    shared = F.array_intersect("v", "pv")
    old = F.filter("pe", lambda x: F.array_contains(shared, F.split(x, "\u0001")[0]) & F.array_contains(shared, F.split(x, "\u0001")[1]))
    kept = F.size(F.array_intersect("e", old))
    return sets.select(order, F.when(F.col("pe").isNotNull() & (F.size(shared) >= 2) & (F.size(old) > 0), kept / F.size(old)).alias("edge_survival"))


# -- indices -----------------------------------------------------------------


def coupling(pairs: DataFrame, by: list[str] = []) -> DataFrame:
    """by, mean_correlation, effective_dimension: no eigensolver, as the sum of
    squared eigenvalues is that of squared entries. Null of a single asset."""
    n = (1 + F.sqrt(1 + 8 * F.count("*"))) / 2
    return pairs.groupBy(*by).agg(F.avg("rho").alias("mean_correlation"), (n * n / (n + 2 * F.sum(F.col("rho") ** 2))).alias("effective_dimension"))


def adjusted_rand(a: DataFrame, b: DataFrame, by: list[str] = []) -> DataFrame:
    """by, ari of two partitions (asset, cluster) over shared assets; null for
    fewer than two, 1 where both are the same trivial partition."""
    both = a.withColumnRenamed("cluster", "ca").join(b.withColumnRenamed("cluster", "cb"), [*by, "asset"])
    cells = both.groupBy(*by, "ca", "cb").agg(F.count("*").cast("double").alias("n"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    x = cells.groupBy(*by).agg(F.sum(pairs("n")).alias("ij"), F.sum("n").alias("t"))
    y = cells.groupBy(*by, "ca").agg(F.sum("n").alias("m")).groupBy(*by).agg(F.sum(pairs("m")).alias("si"))
    z = cells.groupBy(*by, "cb").agg(F.sum("n").alias("m")).groupBy(*by).agg(F.sum(pairs("m")).alias("sj"))
    one = x.join(y, by).join(z, by) if by else x.crossJoin(y).crossJoin(z)
    e = F.try_divide(F.col("si") * F.col("sj"), F.col("t") * (F.col("t") - 1) / 2)
    top = (F.col("si") + F.col("sj")) / 2 - e
    return one.select(*by, F.when(F.col("t") < 2, None).when(top == 0, 1.0).otherwise((F.col("ij") - e) / top).alias("ari"))


# -- everything that needs the matrix ----------------------------------------

MATRIX_SCHEMA = """n_assets int, n_obs int, q double, mean_correlation double, absorption_ratio double, pc1_share double, effective_dimension double,
n_factors int, lambda_plus double, sigma_squared double, shrinkage double, condition_number double, cophenetic double, depth_ratio double,
spectrum array<double>, assets array<string>, leaf_order array<string>, clusters array<int>, matrix array<array<double>>,
merges array<struct<left:int,right:int,height:double,size:int>>, edges array<struct<source:string,target:string,distance:double>>,
hrp array<double>, ivp array<double>"""


def measures(x: np.ndarray, names: list[str], estimator: str, method: str, n_clusters: int | None, fraction: float, keep_matrix: bool = True) -> dict:
    """MATRIX_SCHEMA's values for one complete panel, observations by assets."""
    t, n = x.shape
    c, info = kernels.estimate(x, estimator)
    d, w = kernels.distance(c), kernels.spectrum(c)
    out = {"n_assets": n, "n_obs": t, "q": n / t, "mean_correlation": info["mean_correlation"], "absorption_ratio": kernels.absorption_ratio(w, fraction=fraction), "pc1_share": float(w[0] / w.sum()), "effective_dimension": kernels.effective_dimension(w)}
    out |= {k: info.get(k) for k in ("n_factors", "lambda_plus", "sigma_squared", "shrinkage", "condition_number")}
    out |= {"spectrum": w.tolist(), "assets": names, "matrix": c.tolist() if keep_matrix else None}
    sd = x.std(axis=0, ddof=1)
    cov = c * sd * sd[:, None]
    out["ivp"] = kernels.inverse_variance(cov).tolist()
    if n > 1:
        z = kernels.linkage(d, method)
        order = kernels.leaf_order(z)
        out |= {"cophenetic": kernels.cophenetic_correlation(d, z), "depth_ratio": kernels.depth_ratio(z), "leaf_order": [names[i] for i in order], "clusters": kernels.flat_clusters(z, n_clusters or max(2, min(8, n // 4)))}
        out |= {"merges": [{"left": int(a), "right": int(b), "height": float(h), "size": int(s)} for a, b, h, s in z], "hrp": kernels.risk_parity(cov, order).tolist()}
        out["edges"] = [{"source": names[i], "target": names[j], "distance": v} for i, j, v in kernels.spanning_tree(d)]
    return out


def measure_frame(rows: list[dict], keys: list[str]) -> pd.DataFrame:
    """One line per dict, NaN as null, in the order of keys and MATRIX_SCHEMA."""
    return pd.DataFrame(rows).reindex(columns=[*keys, *MATRIX_FIELDS]).replace({np.nan: None})


def check_estimator(estimator: str) -> None:
    if estimator not in kernels.ESTIMATORS:
        raise ValueError(f"unknown estimator {estimator!r}; known: {', '.join(kernels.ESTIMATORS)}")


def matrices(returns: DataFrame, by: list[str], estimator: str = "rmt_clipped", method: str = "average", n_clusters: int | None = None, fraction: float = 0.2) -> DataFrame:
    """One row per group with every quantity that needs the dense matrix (see
    MATRIX_SCHEMA). Groups must be complete panels; a task holds one at a time."""
    check_estimator(estimator)
    kinds = dict(returns.dtypes)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="date", columns="asset", values="ret").sort_index()
        return measure_frame([{**dict(zip(by, key)), **measures(wide.to_numpy(float), list(wide.columns), estimator, method, n_clusters, fraction)}], by)

    return returns.select(*by, "date", "asset", "ret").groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), MATRIX_SCHEMA]))


def _top_level(schema: str) -> list[str]:
    """Fields of a schema text, commas within < > not counted."""
    out, depth, now = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now]


MATRIX_FIELDS = [f.strip().split()[0] for f in _top_level(MATRIX_SCHEMA)]
