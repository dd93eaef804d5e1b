"""The command line on a made store, from bars to an artifact and back."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone import cli
from marlstone.sources import store, universes


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Bars of six coins: two that end early, one that begins late."""
    root = tmp_path_factory.mktemp("data")
    rng = np.random.default_rng(51)
    days = pd.date_range("2021-01-01", periods=150)
    rows = []
    for k, t in enumerate(["BTCUSD", "ETHUSD", "XRPUSD", "LTCUSD", "DOGEUSD", "ADAUSD"]):
        price = 100 * np.exp(np.cumsum(0.02 * rng.standard_normal(150) + 0.01 * np.sin(np.arange(150) / 5)))
        span = range(40, 150) if k == 5 else range(60) if k == 4 else range(150)
        rows += [(t, str(days[d].date()), float(price[d])) for d in span]
    bars = spark.createDataFrame(rows, "ticker string, date string, adj_close double")
    store.Store(spark, f"file://{root}/eod").write(bars)
    return f"file://{root}"


@pytest.fixture(autouse=True)
def session(monkeypatch, spark, data):
    monkeypatch.setenv("MARLSTONE_DIR", data)
    monkeypatch.setattr(cli, "session", lambda: spark)


COIN = ["--universe", "crypto_core"]


def test_universes(capsys):
    assert cli.main(["universes"]) == 0
    said = capsys.readouterr().out
    assert all(f"{k}:" in said for k in universes.UNIVERSES) and "Payments" in said


def test_status(capsys):
    assert cli.main(["status", *COIN]) == 0
    said = capsys.readouterr().out
    assert "BCHUSD" in said and "|     6|      1|" in said


def test_panel(capsys):
    assert cli.main(["panel", *COIN]) == 0
    said = capsys.readouterr().out
    assert "not cached" in said and "history ends 2021-03-01" in said and "history starts 2021-02-10" in said
    assert "4 of 7 assets, 150 rows from 2021-01-01 to 2021-05-30" in said


def test_coverage(capsys):
    assert cli.main(["coverage", *COIN, "2021-01-01", "2021-04-01", "2030-01-01"]) == 0
    rows = [[x.strip() for x in line.split("|")[1:-1]] for line in capsys.readouterr().out.splitlines() if line.startswith("|2")]
    assert sorted(rows) == [["2021-01-01", "4", "150", "0.016"], ["2021-04-01", "5", "60", "0.02"], ["2030-01-01", "0", "0", "NULL"]]


def test_diagnose(capsys):
    assert cli.main(["diagnose", *COIN, "--window", "60", "--step", "30"]) == 0
    said = capsys.readouterr().out
    assert all(m in said for m in ("absorption_ratio", "cluster_stability", "edge_survival", "purity_lift"))


def test_build(spark, data, capsys):
    assert cli.main(["build", *COIN, "--window", "60", "--step", "30", "--estimator", "sample"]) == 0
    assert "peak" in capsys.readouterr().out
    (found,) = store.artifacts(spark, f"{data}/artifacts")
    assert found == {"name": "crypto_core_sample_w60_s30", "universe": "crypto_core", "estimator": "sample", "window": "60", "step": "30"}
    assert store.artifacts(spark, f"{data}/nothing") == []
    a = store.Artifact(spark, f"{data}/artifacts", "crypto_core", "sample", 60, 30)
    t = a.load()
    assert set(t) == {"windows", "edges", "layouts", "returns"} and t["windows"].count() == 3 and t["edges"].count() == 9
    meta = json.loads(spark.read.text(f"{a.path}/meta").first()[0])
    assert meta["n_windows"] == 3 and meta["assets"] == ["BTCUSD", "ETHUSD", "LTCUSD", "XRPUSD"] and meta["absorption_components"] == 1
    assert meta["spec"]["window"] == 60 and meta["version"] and meta["groups"]["BTCUSD"] == "Store of value"
    p = meta["panel"]
    assert (p["requested"], p["retained"], p["n_obs"], p["start"], p["forward_filled"]) == (7, 4, 149, "2021-01-02", 0)
    assert set(p["dropped"]) == {"ADAUSD", "BCHUSD", "DOGEUSD"} and p["dropped"]["BCHUSD"] == "not cached"
    with pytest.raises(FileNotFoundError, match="build"):
        store.Artifact(spark, f"{data}/artifacts", "crypto_core", "sample", 60, 31).load()


def test_unknown_command_and_universe():
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
    with pytest.raises(KeyError, match="known: core_equity"):
        cli.main(["panel", "--universe", "nothing"])


def test_rewritten_bars_and_window_of_returns(spark, data):
    s = store.Store(spark, f"{data}/eod")
    n = s.read().count()
    s.write(s.read("BTCUSD").where("date = '2021-01-05'").withColumn("adj_close", F.lit(1.0)))
    assert s.read().count() == n and s.read("BTCUSD").where("date = '2021-01-05'").first()["adj_close"] == 1.0
