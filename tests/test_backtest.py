import numpy as np
import pandas as pd
import pytest
from helpers import long_frame, wide
from pyspark.sql import functions as F

from marlstone.operators import backtest as B
from marlstone.plans import experiments


@pytest.fixture(scope="module")
def data(spark):
    x = np.random.default_rng(0).normal(0.0003, 0.011, (400, 4))
    return x, long_frame(spark, x, list("ABCD"), "2015-01-01").cache()


def test_momentum(data):
    x, rt = data
    w = wide(B.momentum_weights(rt, 60, 21), "weight").to_numpy()
    c = wide(B.momentum_weights(rt, 60, 21, concentrated=True), "weight").to_numpy()
    for t in range(400):
        if t >= 59 and (t - 59) % 21 == 0:
            up = (x[t - 59 : t + 1].sum(0) > 0).astype(float)
            assert np.allclose(w[t], up / 4) and np.allclose(c[t], up / max(up.sum(), 1))
        else:
            assert np.isnan(w[t]).all() and np.isnan(c[t]).all()


def test_volatility(data, spark):
    x, rt = data
    v = wide(B.realised_volatility(rt, 21, 252.0), "vol").to_numpy()
    assert np.isnan(v[19]).all() and np.allclose(v[50], x[30:51].std(0, ddof=1) * np.sqrt(252))
    m = wide(B.volatility_managed_weights(rt, 0.5, 21), "weight").to_numpy()
    scale = min(0.5 / (x[:21].mean(1).std(ddof=1) * np.sqrt(252)), 1.5)
    assert np.allclose(m[20], scale / 4)
    g = np.random.default_rng(1).standard_normal((300, 10)) * 0.002 * np.arange(1, 11)
    gr = long_frame(spark, g, [f"A{k}" for k in range(10)])
    lo = wide(B.low_volatility_weights(gr, 63), "weight").to_numpy()
    assert np.allclose(lo[62], [0.5, 0.5] + [0] * 8)
    ls = wide(B.low_volatility_weights(gr, 63, long_short=True), "weight").to_numpy()
    assert np.allclose(ls[62], [0.5, 0.5] + [0] * 6 + [-0.5, -0.5])


def by_hand(x, w, bps):
    t = pd.DataFrame(w).ffill().fillna(0).to_numpy()
    held = np.vstack([np.zeros(x.shape[1]), t[:-1]])
    gross, turn = (held * x).sum(1), np.abs(t - held).sum(1)
    return gross, turn, held, gross - turn * bps / 1e4


def test_path_and_stats(data):
    x, rt = data
    w = B.momentum_weights(rt, 60, 21)
    gross, turn, held, net = by_hand(x, wide(w, "weight").to_numpy(), 25)
    got = B.run(rt, w).orderBy("date").toPandas()
    assert np.allclose(got["gross"], gross) and np.allclose(got["turnover"], turn) and np.allclose(got["net"], net)
    eq = np.cumprod(1 + net)
    assert np.allclose(got["equity"], eq) and np.allclose(got["drawdown"], eq / np.maximum.accumulate(eq) - 1)
    s = B.stats(B.run(rt, w)).first()
    days = (got["date"].iloc[-1] - got["date"].iloc[0]).days
    ppy = 400 / (days / 365.25)
    assert s["periods_per_year"] == pytest.approx(ppy) and s["sharpe"] == pytest.approx(net.mean() / net.std(ddof=1) * np.sqrt(ppy))
    assert s["cagr"] == pytest.approx(eq[-1] ** (ppy / 400) - 1) and s["average_exposure"] == pytest.approx(held.sum(1).mean())
    c = B.cost_sharpes(B.daily(rt, w)).first()
    for bps in (10, 25, 50):
        n = gross - turn * bps / 1e4
        assert c["sharpe_by_cost"][str(bps)] == pytest.approx(n.mean() / n.std(ddof=1) * np.sqrt(ppy))
    assert c["breakeven_bps"] == pytest.approx(np.clip(gross.mean() / turn.mean() * 1e4, 0, 500))


def test_no_lookahead(data, spark):
    """Tomorrow's sign as today's weight earns it; cutting the future changes
    nothing before."""
    x, rt = data
    sign = long_frame(spark, np.vstack([(x[1:] > 0) / 4.0, np.zeros((1, 4))]), list("ABCD"), "2015-01-01", "weight")
    assert B.stats(B.run(rt, sign, 0.0)).first()["sharpe"] > 5
    w = B.momentum_weights(rt, 60, 21)
    cut = str(rt.agg(F.max("date")).first()[0] - pd.Timedelta(days=100))
    a = B.run(rt, w).where(f"date <= '{cut}'").select("date", "net").orderBy("date").collect()
    short = rt.where(f"date <= '{cut}'")
    b = B.run(short, B.momentum_weights(short, 60, 21)).select("date", "net").orderBy("date").collect()
    assert np.allclose([r["net"] for r in a], [r["net"] for r in b])


def test_benchmarks(data, spark):
    x, rt = data
    e = B.run(rt, B.equal_weights(rt)).orderBy("date").collect()
    assert e[0]["turnover"] == pytest.approx(1) and all(abs(r["turnover"]) < 1e-12 for r in e[1:])
    with pytest.raises(Exception, match="unknown asset"):
        B.single_asset_weights(rt, "Z").collect()
    flat = rt.withColumn("ret", F.lit(0.0))
    s = B.stats(B.run(flat, B.equal_weights(flat).withColumn("weight", F.lit(0.0)))).first()
    assert s["sharpe"] is None and s["cagr"] == pytest.approx(0)


def test_experiment(data):
    _, rt = data
    grid = (experiments.Cell("60d", "momentum", 60), experiments.Cell("too_long", "momentum", 390), experiments.Cell("m", "managed", 21), experiments.Cell("l", "low_long", 63))
    got = {r["variant"]: r for r in experiments.cells(rt, "demo", grid, "A").collect()}
    assert set(got) == {"60d", "m", "l"}
    want = B.stats(B.run(rt, B.momentum_weights(rt, 60, 21))).first()
    assert got["60d"]["sharpe"] == pytest.approx(want["sharpe"]) and got["60d"]["sharpe_25"] == pytest.approx(want["sharpe"])
    assert got["l"]["passes_kill"] == (got["l"]["sharpe"] >= 0.3)


def test_grids(data, tmp_path):
    assert len(experiments.grid_of("core_equity", "volatility")) == 6 and experiments.grid_of("core_equity", "volatility")[0].target == 0.15
    assert sum(len(experiments.grid_of(u, "volatility")) for u in experiments.TARGETS) == 10 and sum(len(experiments.grid_of(u, "momentum")) for u in experiments.TARGETS) == 15
    found = experiments.cells(data[1], "demo", (experiments.Cell("60d", "momentum", 60),))
    experiments.save(found, f"{tmp_path}/cells")
    assert data[1].sparkSession.read.json(f"{tmp_path}/cells").first()["variant"] == "60d"
    assert experiments.survivors(found, True).count() <= experiments.survivors(found, False).count() <= 1


def test_programmes(data, tmp_path):
    """All universes of a programme, survivors, and the holdout of those that
    reached it; a universe without returns has no cells."""
    _, rt = data
    have = {"crypto_core", "core_equity"}
    asked = []

    def returns_of(universe, first):
        asked.append((universe, first))
        return rt.select("date", F.when(F.col("asset") == "A", "BTCUSD").otherwise(F.col("asset")).alias("asset"), "ret") if universe in have else None

    found = experiments.explore_all(returns_of, "volatility")
    assert dict(asked) == {"core_equity": "2000-01-01", "cross_asset": "2008-01-01", "crypto_core": "2019-01-01"}
    cells = {(r["universe"], r["variant"]) for r in found.collect()}
    assert {u for u, _ in cells} == have and len(cells) == 8
    rows = found.collect()
    want = {(r["universe"], r["variant"]) for r in rows if r["passes_kill"] and r["beats_benchmarks"]}
    assert {(r["universe"], r["variant"]) for r in experiments.programme_survivors(found, "volatility").collect()} == want
    held = experiments.holdout_all(returns_of, "volatility", {("core_equity", "volmanaged_21d"), ("core_equity", "lowvol_63d_long")})
    assert {(r["universe"], r["variant"]) for r in held.collect()} == {("core_equity", "volmanaged_21d"), ("core_equity", "lowvol_63d_long")}
    assert {r["verdict"] for r in held.collect()} <= {"survives", "fails"}
    assert experiments.explore_all(lambda u, f: None, "momentum") is None
    experiments.save_run(held, "volatility", "holdout", f"{tmp_path}/run")
    doc = rt.sparkSession.read.json(f"{tmp_path}/run").first()
    assert doc["partition"] == "holdout" and doc["primary_cost_bps"] == 25 and len(doc["cells"]) == 2 and "core_equity/lowvol_63d_long" in doc["survivors_tested"]
    line = B.summary_text(B.stats(B.run(rt, B.equal_weights(rt)))).first()[0]
    assert line.startswith("Sharpe ") and "exposure" in line
