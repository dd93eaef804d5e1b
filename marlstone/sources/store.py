"""Store of end-of-day bars, one dataset partitioned by ticker, and the tables
derived from it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

FIELDS = ("open", "high", "low", "close", "adj_close", "volume", "div_cash", "split_factor")
SCHEMA = StructType([StructField("ticker", StringType()), StructField("date", DateType()), *(StructField(f, DoubleType()) for f in FIELDS)])
#: Days before the end of the stored history from which a fetch begins again.
OVERLAP_DAYS = 7


def file_stem(ticker: Column) -> Column:
    """Upper case, and one underscore for each run of other characters than
    letters and digits."""
    return F.regexp_replace(F.upper(F.trim(ticker)), "[^A-Z0-9]+", "_")


def normalise(bars: DataFrame) -> DataFrame:
    """bars in SCHEMA: missing fields null, others dropped, NaN as null, dates at
    midnight; of rows that agree in ticker and date the last by ``ord`` stays
    (without that column any one of them)."""
    have = set(bars.columns)
    order = F.col("ord") if "ord" in have else F.lit(0)
    field = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) if c in have else F.lit(None).cast("double")
    rows = bars.select(F.col("ticker"), F.col("date").cast("date").alias("date"), *(field(c).alias(c) for c in FIELDS), order.alias("ord"))
    return _last(rows, [F.desc("ord")]).drop("ord")


def _last(rows: DataFrame, order: list[Column]) -> DataFrame:
    w = Window.partitionBy("ticker", "date").orderBy(*order)
    return rows.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def merged(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored and incoming bars; incoming ones win on the same ticker and date."""
    both = normalise(stored).withColumn("v_", F.lit(0)).unionByName(normalise(incoming).withColumn("v_", F.lit(1)))
    return _last(both, [F.desc("v_")]).drop("v_")


class Store:
    """Bars under one path. Writing rewrites only the partitions of the tickers
    that come in, from a staged copy, so a failed write leaves them as they were."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _there(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, ticker: str | None = None) -> DataFrame:
        """All bars, or those of one ticker (partition pruning); none if there
        are none."""
        if not self._there():
            return self.spark.createDataFrame([], SCHEMA)
        bars = self.spark.read.schema(SCHEMA).parquet(self.path).select(*SCHEMA.names)
        return bars if ticker is None else bars.where(F.col("ticker") == ticker)

    def write(self, incoming: DataFrame) -> DataFrame:
        """Merge ``incoming``; returns the merged bars of its tickers."""
        tickers = incoming.select("ticker").distinct()
        new = merged(self.read().join(tickers, "ticker", "left_semi"), incoming)
        stage = f"{self.path.rstrip('/')}.staged"
        new.write.mode("overwrite").parquet(stage)
        staged = self.spark.read.schema(SCHEMA).parquet(stage)
        (staged.repartition("ticker").sortWithinPartitions("ticker", "date").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("ticker").parquet(self.path))
        return self.read().join(tickers, "ticker", "left_semi")


def coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.min("date").alias("start"), F.max("date").alias("end"))


def tickers(bars: DataFrame) -> DataFrame:
    return bars.select("ticker").distinct()


def summary(bars: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """ticker, rows, start, end of stored or of requested tickers; one without
    data has 0 rows."""
    have = bars.groupBy("ticker").agg(F.count("*").alias("rows"), F.min("date").alias("start"), F.max("date").alias("end"))
    if requested is None:
        return have
    return requested.select("ticker").distinct().join(have, "ticker", "left").withColumn("rows", F.coalesce("rows", F.lit(0)).cast("long"))


def fetch_starts(requested: DataFrame, bars: DataFrame, start: str, force: bool = False) -> DataFrame:
    """ticker, fetch_start: the whole range if forced, unknown or known only
    from a later day on; else the stored end less the overlap."""
    first = F.lit(start).cast("date")
    c = requested.select("ticker").distinct().join(coverage(bars), "ticker", "left")
    again = F.date_sub("end", OVERLAP_DAYS)
    return c.select("ticker", F.when(F.lit(force) | F.col("end").isNull() | (F.col("start") > first), first).otherwise(again).alias("fetch_start"))


# -- vendor payloads ---------------------------------------------------------

#: Vendor field and ours.
EQUITY_FIELDS = {"open": "open", "high": "high", "low": "low", "close": "close", "adjClose": "adj_close", "volume": "volume", "divCash": "div_cash", "splitFactor": "split_factor"}
_EQUITY = "array<struct<date:string," + ",".join(f"{k}:double" for k in EQUITY_FIELDS) + ">>"
_CRYPTO = "array<struct<ticker:string,priceData:array<struct<date:string,open:double,high:double,low:double,close:double,volume:double>>>>"


def equity_bars(landed: DataFrame) -> DataFrame:
    """Bars from landed payloads (ticker, payload, ord): an array of days."""
    rows = landed.select("ticker", "ord", F.posexplode(F.from_json("payload", _EQUITY)).alias("k", "d"))
    return normalise(rows.select("ticker", F.struct("ord", "k").alias("ord"), F.to_date(F.substring("d.date", 1, 10)).alias("date"), *(F.col(f"d.{k}").alias(v) for k, v in EQUITY_FIELDS.items())))


def crypto_bars(landed: DataFrame) -> DataFrame:
    """Bars from landed payloads whose first element holds the days; adjusted
    close is the close, there are no dividends and no splits."""
    rows = landed.select("ticker", "ord", F.posexplode(F.get(F.from_json("payload", _CRYPTO), F.lit(0))["priceData"]).alias("k", "d"))
    return normalise(
        rows.select("ticker", F.struct("ord", "k").alias("ord"), F.to_date(F.substring("d.date", 1, 10)).alias("date"), *(F.col(f"d.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")), F.col("d.close").alias("adj_close"), F.lit(0.0).alias("div_cash"), F.lit(1.0).alias("split_factor"))
    )


# -- artifacts ---------------------------------------------------------------


class Artifact:
    """Tables of one rolling build under <root>/<name>, with a one-row meta."""

    TABLES = ("windows", "edges", "layouts", "returns")

    def __init__(self, spark: SparkSession, root: str, universe: str, estimator: str, window: int, step: int):
        self.spark, self.name = spark, f"{universe}_{estimator}_w{window}_s{step}"
        self.path = f"{root.rstrip('/')}/{self.name}"

    def save(self, tables: dict[str, DataFrame], meta: DataFrame) -> None:
        for name in self.TABLES:
            if name in tables:
                tables[name].write.mode("overwrite").parquet(f"{self.path}/{name}")
        meta.coalesce(1).write.mode("overwrite").json(f"{self.path}/meta")

    def load(self) -> dict[str, DataFrame]:
        out = {}
        for name in self.TABLES:
            try:
                out[name] = self.spark.read.parquet(f"{self.path}/{name}")
            except Exception as e:
                if name == "windows":
                    raise FileNotFoundError(f"no artifact {self.name}; make it with: python -m marlstone build") from e
        return out


def artifact_meta(panel, returns: DataFrame, windows: DataFrame, groups: DataFrame, spec: dict, version: str, group_label: str, caveats: str, components: int) -> DataFrame:
    """The one row beside a build: its spec and version, the number of windows,
    assets and groups, the panel's report with what was dropped and why."""
    assets = returns.agg(F.array_sort(F.collect_set("asset")).alias("assets"))
    labels = groups.join(returns.select("asset").distinct(), "asset", "left_semi").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("asset", "grp")))).alias("groups"))
    dropped = panel.report.where("status = 'dropped'").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset", "reason")))).alias("dropped"))
    report = panel.summary.crossJoin(dropped).select(F.struct("requested", "retained", "dropped", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "n_obs", F.col("filled_values").alias("forward_filled")).alias("panel"))
    one = windows.agg(F.count("*").alias("n_windows")).crossJoin(assets).crossJoin(labels).crossJoin(report)
    return one.select(F.struct(*(F.lit(v).alias(k) for k, v in spec.items())).alias("spec"), F.lit(version).alias("version"), F.current_timestamp().alias("built_at"), "n_windows", "assets", F.lit(group_label).alias("group_label"), "groups", F.lit(components).alias("absorption_components"), "panel", F.lit(caveats).alias("caveats"))


def artifacts(spark: SparkSession, root: str) -> list[dict[str, str]]:
    """Spec and name of each artifact under ``root`` that has windows, by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = sorted(f.getPath().getName() for f in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "windows")))
    return [{"name": n, **spec} for n in names if (spec := spec_of(n))]


def spec_of(name: str) -> dict[str, str] | None:
    """universe, estimator, window and step of an artifact's name."""
    m = re.fullmatch(r"(?P<universe>.+)_(?P<estimator>sample|ledoit_wolf|rmt_clipped)_w(?P<window>\d+)_s(?P<step>\d+)", name)
    return m.groupdict() if m else None
