import json

import pytest
from pyspark.sql import functions as F

from marlstone.sources import store, universes, vendor
from marlstone.streaming import upsert


def some(spark, rows):
    return spark.createDataFrame(rows, "ticker string, date string, close double")


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/eod")
    assert s.read().count() == 0
    first = some(spark, [("A", "2020-01-01", 1.0), ("A", "2020-01-02", 2.0), ("B", "2020-01-01", 5.0)])
    s.write(first)
    s.write(first)
    assert s.read().count() == 3
    s.write(some(spark, [("A", "2020-01-02", 9.0), ("A", "2020-01-03", 3.0)]))
    assert [(str(r["date"]), r["close"]) for r in s.read("A").orderBy("date").collect()] == [("2020-01-01", 1.0), ("2020-01-02", 9.0), ("2020-01-03", 3.0)]
    assert s.read("B").count() == 1 and s.read().columns == store.SCHEMA.names
    asked = spark.createDataFrame([("A",), ("Z",)], "ticker string")
    got = {r["ticker"]: (r["rows"], str(r["start"]), str(r["end"])) for r in store.summary(s.read(), asked).collect()}
    assert got == {"A": (3, "2020-01-01", "2020-01-03"), "Z": (0, "None", "None")}
    starts = lambda day, force=False: {r["ticker"]: str(r["fetch_start"]) for r in store.fetch_starts(asked, s.read(), day, force).collect()}
    assert starts("2020-01-01") == {"A": "2019-12-27", "Z": "2020-01-01"} and starts("2019-01-01")["A"] == "2019-01-01" and starts("2020-01-01", True)["A"] == "2020-01-01"


def test_normalise_keeps_the_last(spark):
    rows = spark.createDataFrame([("A", "2020-01-01 10:00:00", 1.0, 1, "x"), ("A", "2020-01-01 09:00:00", float("nan"), 2, "y")], "ticker string, date string, close double, ord int, other string")
    r = store.normalise(rows).collect()
    assert len(r) == 1 and r[0]["close"] is None and r[0]["volume"] is None
    assert spark.range(1).select(store.file_stem(F.lit(" brk.b/x "))).first()[0] == "BRK_B_X"


class Session:
    def __init__(self, *answers):
        self.answers, self.seen = list(answers), []

    def get(self, url, **how):
        self.seen.append((url, how))
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return type("Answer", (), {"status_code": a[0], "text": a[1]})


def client(*answers):
    waits = []
    return vendor.Client(Session(*answers), "http://x", "k", waits.append), waits


DAY = {"date": "2020-01-02T00:00:00.000Z", "open": 1, "high": 2, "low": 0.5, "close": 1.5, "adjClose": 1.4, "volume": 10, "divCash": 0, "splitFactor": 1, "other": 3}


def test_client():
    c, waits = client((429, ""), OSError("broken"), (200, "[]"))
    assert c.equity("A", "2020-01-01") == "[]" and waits == [2, 4] and c.session.seen[0][1]["headers"]["Authorization"] == "Token k"
    for status, error in ((404, vendor.UnknownTicker), (403, vendor.VendorError)):
        c, waits = client((status, ""))
        with pytest.raises(error):
            c.equity("A", "x")
        assert not waits
    c, waits = client(*[(429, "")] * 4)
    with pytest.raises(vendor.RateLimited):
        c.equity("A", "x")
    assert waits == [2, 4, 8]


def test_api_key(monkeypatch):
    monkeypatch.delenv("MARLSTONE_VENDOR_KEY", raising=False)
    with pytest.raises(vendor.ConfigError):
        vendor.api_key()


def test_fetch(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/eod")
    c, _ = client((200, json.dumps([DAY])), (404, ""), (200, "[]"))
    got = {r["ticker"]: r for r in vendor.fetch(spark, s, c, ["A", "B", "C"], "2020-01-01", "2020-02-01").collect()}
    assert {t: r["status"].split(" ")[0] for t, r in got.items()} == {"A": "fetched", "B": "error:", "C": "no-data"}
    assert got["A"]["rows_added"] == 1 and s.read("A").first()["adj_close"] == 1.4
    c, _ = client()
    assert vendor.fetch(spark, s, c, ["A"], "2020-01-01", "2019-12-20").first()["status"] == "cached"


def test_crypto_payload(spark):
    pay = json.dumps([{"ticker": "btcusd", "priceData": [{"date": "2020-01-02T00:00:00+00:00", "open": 1, "high": 2, "low": 1, "close": 1.5, "volume": 3}]}])
    r = store.crypto_bars(spark.createDataFrame([("BTCUSD", pay, 0), ("X", "[]", 1), ("Y", '[{"priceData": []}]', 2)], "ticker string, payload string, ord int")).collect()
    assert len(r) == 1 and (r[0]["adj_close"], r[0]["div_cash"], r[0]["split_factor"]) == (1.5, 0.0, 1.0)


def test_universes(spark):
    assert {k: len(u) for k, u in universes.UNIVERSES.items()} == {"core_equity": 81, "cross_asset": 20, "crypto_majors": 16, "sector_etfs": 11, "crypto_core": 7}
    core = universes.get("core_equity")
    assert len(set(core.tickers)) == 81 and len(set(core.groups.values())) == 11 and core.table(spark).count() == 81
    assert core.subset(["CVX", "AAPL"]).tickers == ["AAPL", "CVX"] and universes.get("crypto_core").limit == 1
    assert len(universes.all_tickers()) == len(set(universes.all_tickers())) == 128
    assert universes.resolve("cross_asset", ["SPY", "NEW"]).groups == {"SPY": "Equity", "NEW": "Other"}
    with pytest.raises(KeyError, match="core_equity, cross_asset"):
        universes.get("other")
    with pytest.raises(ValueError):
        universes.resolve()
    assert universes.events(spark).count() == 12


def test_artifact(spark, tmp_path):
    a = store.Artifact(spark, f"file://{tmp_path}/art", "demo", "rmt_clipped", 60, 5)
    with pytest.raises(FileNotFoundError, match="build"):
        a.load()
    a.save({"windows": spark.range(3), "edges": spark.range(2)}, spark.range(1))
    assert a.load()["windows"].count() == 3 and set(a.load()) == {"windows", "edges"}
    assert store.spec_of("core_equity_rmt_clipped_w252_s5") == {"universe": "core_equity", "estimator": "rmt_clipped", "window": "252", "step": "5"} and store.spec_of("x") is None


def test_stream_into_store(spark, tmp_path):
    src = f"{tmp_path}/in"
    rows = lambda r: some(spark, r).write.mode("append").json(src)
    rows([("A", "2020-01-01", 1.0), ("A", "2020-01-02", 2.0)])
    s = store.Store(spark, f"file://{tmp_path}/eod")
    stream = spark.readStream.schema("ticker string, date string, close double").json(src)
    upsert.into_store(stream, s, f"{tmp_path}/check").awaitTermination()
    rows([("A", "2020-01-02", 7.0)])
    upsert.into_store(stream, s, f"{tmp_path}/check").awaitTermination()
    assert {str(r["date"]): r["close"] for r in s.read("A").collect()} == {"2020-01-01": 1.0, "2020-01-02": 7.0}


def test_latest_bars(spark, tmp_path):
    spark.createDataFrame([("A", "2020-01-01 10:00:00", 1.0, 5.0), ("A", "2020-01-01 09:00:00", 3.0, 5.0), ("A", "2020-01-02 09:00:00", 4.0, 1.0)], "ticker string, ts string, price double, volume double").selectExpr("ticker", "cast(ts as timestamp) ts", "price", "volume").write.parquet(f"{tmp_path}/t")
    stream = spark.readStream.schema("ticker string, ts timestamp, price double, volume double").parquet(f"{tmp_path}/t")
    q = upsert.latest_bars(stream).writeStream.format("memory").queryName("bars_now").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {str(r["date"]): (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in spark.table("bars_now").collect()}
    assert got == {"2020-01-01": (3.0, 3.0, 1.0, 1.0, 10.0), "2020-01-02": (4.0, 4.0, 4.0, 4.0, 1.0)}
