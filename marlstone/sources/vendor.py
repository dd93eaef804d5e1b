"""HTTP client of a price vendor. It runs on the driver and lands payloads as
text; turning them into bars is Spark's part (store.equity_bars)."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

ATTEMPTS, BACKOFF = 4, 2.0


class VendorError(RuntimeError):
    pass


class RateLimited(VendorError):
    pass


class UnknownTicker(VendorError):
    pass


class ConfigError(RuntimeError):
    pass


def api_key(name: str = "MARLSTONE_VENDOR_KEY") -> str:
    key = os.environ.get(name, "").strip()
    if not key:
        raise ConfigError(f"set {name}")
    return key


@dataclass
class Client:
    """``session`` has get(url, params=..., headers=..., timeout=...) whose
    answer has status_code and text."""

    session: Any
    base: str
    key: str
    sleep: Any = time.sleep
    headers: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.headers = {"Authorization": f"Token {self.key}", **self.headers}

    def get(self, path: str, params: dict, ticker: str) -> str:
        """An unknown ticker or a refused key fails at once; rate limits, other
        statuses and broken connections are tried again, each wait twice the
        last."""
        last: Exception = VendorError(f"{ticker}: no answer")
        for k in range(ATTEMPTS):
            if k:
                self.sleep(BACKOFF * 2 ** (k - 1))
            try:
                answer = self.session.get(f"{self.base}/{path}", params=params, headers=self.headers, timeout=30)
            except OSError as e:
                last = VendorError(f"{ticker}: {e}")
                continue
            if answer.status_code == 200:
                return answer.text
            if answer.status_code == 404:
                raise UnknownTicker(ticker)
            if answer.status_code in (401, 403):
                raise VendorError(f"{ticker}: the key was refused")
            last = RateLimited(ticker) if answer.status_code == 429 else VendorError(f"{ticker}: status {answer.status_code}")
        raise last

    def equity(self, ticker: str, start: str) -> str:
        return self.get(f"daily/{ticker}/prices", {"startDate": start}, ticker)

    def crypto(self, ticker: str, start: str) -> str:
        return self.get("crypto/prices", {"tickers": ticker.lower(), "startDate": start, "resampleFreq": "1day"}, ticker)


def fetch(spark: SparkSession, bars: store.Store, client: Client, tickers: list[str], start: str, end: str, crypto: bool = False, force: bool = False) -> DataFrame:
    """Fetch what is missing; returns ticker, status, rows_added, start, end.
    A ticker's failure is its status and stops no other."""
    wanted = spark.createDataFrame([(t,) for t in dict.fromkeys(tickers)], "ticker string")
    before = store.summary(bars.read(), wanted).withColumnRenamed("rows", "before")
    starts = {r["ticker"]: str(r["fetch_start"]) for r in store.fetch_starts(wanted, bars.read(), start, force).collect()}  # a row per ticker asked for
    landed, status = [], []
    for k, t in enumerate(starts):
        if starts[t] >= end:
            status.append((t, "cached"))
            continue
        try:
            landed.append((t, (client.crypto if crypto else client.equity)(t, starts[t]), k))
            status.append((t, "fetched"))
        except VendorError as e:
            status.append((t, f"error: {type(e).__name__} {e}"))
    before = spark.createDataFrame(before.select("ticker", "before").collect(), "ticker string, before long")
    got = None
    if landed:
        rows = (store.crypto_bars if crypto else store.equity_bars)(spark.createDataFrame(landed, "ticker string, payload string, ord int"))
        bars.write(rows)
        got = {r["ticker"] for r in rows.select("ticker").distinct().collect()}
    status = [(t, "no-data" if s == "fetched" and t not in (got or ()) else s) for t, s in status]
    after = store.summary(bars.read(), wanted)
    out = spark.createDataFrame(status, "ticker string, status string").join(after, "ticker").join(before, "ticker")
    return out.select("ticker", "status", (F.col("rows") - F.col("before")).alias("rows_added"), "start", "end")
