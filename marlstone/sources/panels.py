"""Price panels in long form (date, asset, price, grp) from the driver's tables.

A panel has one row per date and asset that has data; what is missing has no
row. Every panel is one aggregation of a pruned scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name of each panel and what it holds.
PANELS = {
    "PN-E": "events: day by event type, mean value",
    "PN-H": "events: hour by event type, mean value",
    "PN-S": "line items: ISO week by supplier nation, mean unit price; groups are regions",
    "PN-M": "line items: month by supplier nation, mean unit price; groups are regions",
    "PN-F": "line items: day by return flag, mean unit price",
    "PN-P": "orders: day by priority, mean total price",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """The panel ``key``: date (timestamp for PN-H), asset, price, grp."""
    if key in ("PN-E", "PN-H"):
        date = F.to_date("ts") if key == "PN-E" else F.date_trunc("hour", F.col("ts").cast("timestamp"))
        rows = read(spark, sf_dir, "events").select(date.alias("date"), F.col("event_type").alias("asset"), F.col("value").alias("v"), F.col("event_type").alias("grp"))
    elif key in ("PN-S", "PN-M"):
        unit = "week" if key == "PN-S" else "month"
        items = read(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date(F.date_trunc(unit, F.col("l_shipdate").cast("timestamp"))).alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
        # nations and regions are fixed small dimensions; the planner broadcasts
        # suppliers only while their size allows it
        nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        suppliers = read(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("asset"), F.col("r_name").alias("grp"))
        rows = items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select("date", "asset", "v", "grp")
    elif key == "PN-F":
        rows = read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("asset"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"), F.col("l_returnflag").alias("grp"))
    elif key == "PN-P":
        rows = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("asset"), F.col("o_totalprice").alias("v"), F.col("o_orderpriority").alias("grp"))
    else:
        raise KeyError(f"unknown panel {key!r}; known: {', '.join(sorted(PANELS))}")
    return rows.groupBy("date", "asset", "grp").agg(F.avg("v").alias("price"))


#: The same panels as SQL.
SQL = {
    "PN-E": "select cast(ts as date) as date, event_type as asset, event_type as grp, avg(value) as price from events group by all",
    "PN-H": "select date_trunc('hour', ts) as date, event_type as asset, event_type as grp, avg(value) as price from events group by all",
    "PN-F": "select cast(l_shipdate as date) as date, l_returnflag as asset, l_returnflag as grp, avg(l_extendedprice / l_quantity) as price from lineitem group by all",
    "PN-P": "select cast(o_orderdate as date) as date, o_orderpriority as asset, o_orderpriority as grp, avg(o_totalprice) as price from orders group by all",
} | {
    key: f"""select cast(date_trunc('{unit}', l_shipdate) as date) as date, n_name as asset, r_name as grp, avg(l_extendedprice / l_quantity) as price
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all"""
    for key, unit in (("PN-S", "week"), ("PN-M", "month"))
}
