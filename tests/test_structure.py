import numpy as np
import pytest
from helpers import factor_returns, long_frame

from marlstone.functions import figures, kernels
from marlstone.operators import rolling, structure


@pytest.fixture(scope="module")
def data(spark):
    x, names = factor_returns(8, 160, 2, 0.4, 1.0)
    return x, names, long_frame(spark, x, names).cache()


def square(df, names, value):
    m = np.eye(len(names))
    at = {a: k for k, a in enumerate(names)}
    for r in df.collect():
        m[at[r["i"]], at[r["j"]]] = m[at[r["j"]], at[r["i"]]] = r[value]
    return m


def test_relational_estimates_equal_the_kernels(data):
    x, names, rt = data
    assert np.allclose(square(structure.sample_correlation(rt), names, "rho"), kernels.estimate(x, "sample")[0])
    lw = structure.ledoit_wolf(rt)
    c, info = kernels.estimate(x, "ledoit_wolf")
    assert np.allclose(square(lw, names, "rho"), c) and lw.first()["shrinkage"] == pytest.approx(info["shrinkage"])
    k = structure.coupling(structure.sample_correlation(rt)).first()
    w = kernels.spectrum(kernels.estimate(x, "sample")[0])
    assert k["effective_dimension"] == pytest.approx(kernels.effective_dimension(w))


def test_tree_both_ways(data, spark):
    x, names, rt = data
    d = structure.distances(structure.sample_correlation(rt)).cache()
    pairs = lambda df: sorted((r["source"], r["target"], round(r["distance"], 9)) for r in df.collect())
    a = structure.mst(d)
    assert len(pairs(a)) == 7 and pairs(a) == pairs(structure.mst_relational(d, 8))
    groups = spark.createDataFrame([(n, str(k % 2)) for k, n in enumerate(names)], "asset string, grp string")
    p = structure.group_purity(a, groups).first()
    assert p["baseline"] == pytest.approx(2 * 6 / 28) and p["purity"] > 0.8 and p["lift"] == pytest.approx(p["purity"] / p["baseline"])
    assert structure.degrees(a).agg({"degree": "sum"}).first()[0] == 14
    top = structure.hub(a).first()
    assert top["degree"] == max(r["degree"] for r in structure.degrees(a).collect())
    assert structure.metric_violations(d).count() == 0
    assert structure.nearest(d, 3).groupBy("i").count().where("count <> 3").count() == 0


def test_metric_violations(spark):
    d = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0)], "i string, j string, distance double")
    assert [(r["i"], r["j"], r["k"]) for r in structure.metric_violations(d).collect()] == [("a", "c", "b")]


def test_constant_assets(spark):
    x = np.random.default_rng(0).standard_normal((30, 2))
    x[:, 1] = 0.02
    assert [r["asset"] for r in structure.constant_assets(long_frame(spark, x)).collect()] == ["B"]


def test_edge_survival(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (2, "c", "b"), (2, "a", "c"), (3, "x", "y")], "w int, source string, target string")
    assert {r["w"]: r["edge_survival"] for r in structure.edge_survival(e, "w").collect()} == {1: None, 2: 0.5, 3: None}


def test_adjusted_rand(spark):
    t = lambda c: spark.createDataFrame([(str(k), v) for k, v in enumerate(c)], "asset string, cluster int")
    ari = lambda a, b: structure.adjusted_rand(t(a), t(b)).first()["ari"]
    assert ari([0, 0, 1, 1], [7, 7, 3, 3]) == 1 and ari([0, 0, 0], [1, 1, 1]) == 1 and ari([0], [1]) is None
    assert ari([0, 0, 1, 1], [0, 1, 0, 1]) == pytest.approx(-0.5)


def test_windows(spark, data):
    x, names, rt = data
    rows = rolling.hopping(rt, 60, 20)
    per = {r["window_id"]: r["n"] for r in rows.groupBy("window_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert per == {k: 60 * 8 for k in range(6)}
    groups = spark.createDataFrame([(n, str(k % 2)) for k, n in enumerate(names)], "asset string, grp string")
    t = rolling.windows_table(rt, groups, 60, 20, "ledoit_wolf")
    w = t["windows"].orderBy("window_end").collect()
    assert len(w) == 6 and w[0]["edge_survival"] is None and all(0 <= r["edge_survival"] <= 1 for r in w[1:])
    assert t["edges"].groupBy("window_end").count().where("count <> 7").count() == 0
    e = t["edges"]
    lengths = {r["window_end"]: r["tree_length"] for r in structure.tree_length(e, ["window_end"]).collect()}
    tops = {r["window_end"]: r["hub"] for r in structure.hub(e, ["window_end"]).collect()}
    pure = {r["window_end"]: (r["purity"], r["lift"]) for r in structure.group_purity(e, groups, ["window_end"]).collect()}
    kept = {r["window_end"]: r["edge_survival"] for r in structure.edge_survival(e, "window_end").collect()}
    for r in w:
        assert r["tree_length"] == pytest.approx(lengths[r["window_end"]]) and r["hub"] == tops[r["window_end"]] and r["edge_survival"] == kept[r["window_end"]]
        assert (r["purity"], r["purity_lift"]) == pytest.approx(pure[r["window_end"]])
    c, _ = kernels.estimate(x[20:80], "ledoit_wolf")
    assert w[1]["mean_correlation"] == pytest.approx(c[~np.eye(8, dtype=bool)].mean())
    one = rolling.correlation_at(rt, str(w[1]["window_end"]), 60, "ledoit_wolf").first()
    assert np.allclose(np.array(one["matrix"]), c)
    asof = rolling.clustering(rt, str(w[1]["window_end"]), 60, estimator="ledoit_wolf").first()
    assert asof["leaf_order"] == one["leaf_order"]
    for bad, why in (("2000-01-08", "no trading day"), ("2000-01-10", "no 60 rows")):
        with pytest.raises(Exception, match=why):
            rolling.correlation_at(rt, bad, 60).collect()
    a = rolling.allocation(t["matrices"]).orderBy("window_end").collect()
    assert a[0]["turnover_hrp"] is None and all(r["max_gap_hrp_ivp"] >= 0 and r["eff_n_hrp"] <= 8 for r in a)
    s = rolling.cluster_stability(t["matrices"]).collect()
    assert len(s) == 5 and all(-1 <= r["cluster_stability"] <= 1 for r in s)
    d = rolling.layout_drift(t["layouts"]).orderBy("window_end").collect()
    assert d[0]["layout_drift"] is None and all(r["layout_drift"] >= 0 for r in d[1:])
    m = rolling.rolling_matrices(rt, 60, 20, "ledoit_wolf").where("window_id = 1")
    assert np.allclose(np.array(m.first()["matrix"]), c) and rolling.rolling_matrices(rt, 60, 7).count() == (160 - 60) // 7 + 1
    assert figures.heatmap(m).count() == 64 and figures.spectrum_series(m).count() == 8
    last = t["layouts"].where(f"window_end = '{w[-1]['window_end']}'")
    seg, nodes = figures.network(t["edges"].where(f"window_end = '{w[-1]['window_end']}'"), last, groups)
    assert seg.count() == 7 and nodes.count() == 8


def test_identical_trees_do_not_drift(spark):
    e = spark.createDataFrame([(w, f"T{k}", f"T{k + 1}", 1.0) for w in (1, 2) for k in range(7)], "window_end int, source string, target string, distance double")
    d = {r["window_end"]: r["layout_drift"] for r in rolling.layout_drift(rolling.layouts(e)).collect()}
    assert d[1] is None and d[2] < 0.05


def test_frames(spark):
    w = spark.createDataFrame([(f"2020-01-{k:02d}", float(k % 4)) for k in range(1, 11)], "window_end string, absorption_ratio double")
    got = [(r["window_end"], r["frame"], r["peak"]) for r in figures.frames(w, "2020-01-02", "2020-01-09").orderBy("frame").collect()]
    assert got == [("2020-01-02", 0, True), ("2020-01-04", 1, False), ("2020-01-06", 2, False), ("2020-01-08", 3, False)]
    assert figures.at_window(w, "2020-01-03").collect()[0].asDict() == {"absorption_ratio": 3.0} and figures.window_ends(w).count() == 10
