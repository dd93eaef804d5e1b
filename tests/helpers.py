"""Synthetic returns with planted structure."""

import numpy as np
import pandas as pd


def factor_returns(n=12, t=300, blocks=3, market=0.5, block=0.8, seed=0):
    rng = np.random.default_rng(seed)
    x = market * rng.standard_normal((t, 1)) + block * rng.standard_normal((t, blocks))[:, np.arange(n) % blocks] + rng.standard_normal((t, n))
    return x, [f"A{k:03d}" for k in range(n)]


def long_frame(spark, x, names=None, start="2000-01-03", value="ret"):
    names = names or [chr(65 + k) for k in range(x.shape[1])]
    days = pd.bdate_range(start, periods=len(x))
    rows = [(d.date(), a, float(v)) for d, line in zip(days, x) for a, v in zip(names, line)]
    return spark.createDataFrame(rows, f"date date, asset string, {value} double")


def wide(df, value):
    return df.toPandas().pivot(index="date", columns="asset", values=value).sort_index()
