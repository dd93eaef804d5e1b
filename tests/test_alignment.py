import datetime as dt

import numpy as np
import pandas as pd
import pytest
from helpers import wide

from marlstone.operators import alignment


def history(spark, spec):
    """spec: asset -> (start, periods, days left out)."""
    rows = []
    for k, (a, (start, n, holes)) in enumerate(spec.items()):
        rng = np.random.default_rng(k)
        p = 100 * np.exp(np.cumsum(0.01 * rng.standard_normal(n)))
        rows += [(d.date(), a, float(v)) for d, v in zip(pd.bdate_range(start, periods=n), p) if str(d.date()) not in holes]
    return spark.createDataFrame(rows, "date date, asset string, price double")


def reasons(panel):
    return {r["asset"]: r["reason"] for r in panel.report.collect()}


def test_drop_reasons(spark):
    days = [str(d.date()) for d in pd.bdate_range("2020-01-01", periods=120)]
    p = history(spark, {
        "OK": ("2020-01-01", 120, []), "LATE": ("2020-03-02", 77, []), "ENDS": ("2020-01-01", 60, []), "HOLE": ("2020-01-01", 120, days[30:36]),
        "DARK": ("2020-01-01", 120, days[-5:]), "ONE": ("2020-01-01", 120, days[24:25]), "SLOW": ("2020-01-03", 118, []),
    })
    asked = spark.createDataFrame([(a,) for a in ("OK", "LATE", "ENDS", "HOLE", "DARK", "ONE", "SLOW", "NONE")], "asset string")
    out = alignment.align(p, asked)
    why = reasons(out)
    assert why["OK"] is None and why["ONE"] is None and why["NONE"] == "not cached"
    assert why["LATE"] == "history starts 2020-03-02" and why["ENDS"].startswith("history ends ") and why["HOLE"] == "3 unfillable gaps (> 3d)"
    assert "(delisting or halt); 2 missing sessions" in why["DARK"]
    assert why["SLOW"] == "2 unfillable gaps (> 3d)"  # within the tolerance, but nothing before to fill from
    s = out.summary.first()
    assert (s["requested"], s["retained"], s["n_obs"]) == (8, 2, 120)
    r = wide(alignment.log_returns(out.prices), "ret")
    assert r.shape == (119, 2) and not r.isna().any().any() and r.loc[dt.date.fromisoformat(days[24]), "ONE"] == 0
    assert out.report.where("asset = 'ONE'").first()["filled"] == 1


def test_limit_counts_rows(spark):
    days = [str(d.date()) for d in pd.bdate_range("2020-01-01", periods=60)]
    p = history(spark, {"A": ("2020-01-01", 60, []), "B": ("2020-01-01", 60, days[20:22])})
    assert reasons(alignment.align(p, limit=3))["B"] is None
    assert reasons(alignment.align(p, limit=1))["B"] == "1 unfillable gaps (> 1d)"


def test_range_and_empty_range(spark):
    p = history(spark, {"A": ("2020-01-01", 60, [])})
    assert alignment.align(p, start="2020-01-06", end="2020-01-10").summary.first()["n_obs"] == 5
    out = alignment.align(p, start="2030-01-01")
    assert reasons(out)["A"] == "no data in requested range" and out.prices.count() == 0


def test_log_returns(spark):
    p = spark.createDataFrame([(dt.date(2020, 1, k + 1), "A", v) for k, v in enumerate((100.0, 110.0, 99.0))], "date date, asset string, price double")
    assert np.allclose(wide(alignment.log_returns(p), "ret")["A"], [np.log(1.1), np.log(0.9)])
    bad = p.withColumn("price", p["price"] - 100)
    with pytest.raises(Exception, match="non-positive price: A"):
        alignment.log_returns(bad).collect()


def test_split_and_q(spark):
    p = history(spark, {"A": ("2020-01-01", 12, []), "B": ("2020-01-01", 12, [])})
    a, b = alignment.split(alignment.log_returns(p))
    assert a.select("date").distinct().count() == 7 and b.select("date").distinct().count() == 4
    row = alignment.coverage_frontier(p, ["2020-01-01", "2031-01-01"]).orderBy("start").collect()
    assert (row[0]["n_assets"], row[0]["n_obs"], row[0]["q_at_252"]) == (2, 12, 0.008)
    assert (row[1]["n_assets"], row[1]["n_obs"], row[1]["q_at_252"]) == (0, 0, None)
