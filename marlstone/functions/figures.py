"""Plot-ready tables; drawing itself is left to whatever tool reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLOURS = 11


def group_colours(groups: DataFrame) -> DataFrame:
    """grp, colour: the place of the group in name order, modulo the palette."""
    names = groups.select("grp").distinct()
    return names.withColumn("colour", ((F.row_number().over(Window.orderBy("grp")) - 1) % COLOURS).cast("int"))


def network(edges: DataFrame, layout: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, nodes) of one window. Near edges are wider; edges without both
    positions are left out."""
    a = layout.select(F.col("ticker").alias("source"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    b = layout.select(F.col("ticker").alias("target"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    far = F.max("distance").over(Window.partitionBy(F.lit(1)))
    segments = edges.withColumn("width", 1 + 2.5 * (1 - F.coalesce(F.try_divide("distance", far), F.lit(1.0)))).join(a, "source").join(b, "target")
    nodes = layout.join(groups.select(F.col("asset").alias("ticker"), "grp"), "ticker", "left").join(group_colours(groups), "grp", "left")
    return segments.select("source", "target", "distance", "width", "x0", "y0", "x1", "y1"), nodes.select("ticker", "x", "y", "grp", "colour")


def index_series(windows: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """window_end, absorption_ratio, mean_correlation and the labels of events
    (date, label) since the window before."""
    w = windows.select("window_end", "absorption_ratio", "mean_correlation")
    if events is None:
        return w
    w = w.withColumn("since", F.lag("window_end").over(Window.orderBy("window_end")))
    e = F.broadcast(events.select("date", "label"))
    on = (e["date"] <= w["window_end"]) & (w["since"].isNull() | (e["date"] > w["since"]))
    return w.join(e, on, "left").groupBy("window_end", "absorption_ratio", "mean_correlation").agg(F.array_sort(F.collect_list("label")).alias("labels"))


def stability_series(windows: DataFrame, drift: DataFrame) -> DataFrame:
    return windows.select("window_end", "edge_survival").join(drift, "window_end", "left")


def heatmap(matrices: DataFrame) -> DataFrame:
    """row, column, rho with rows and columns in leaf order."""
    m = matrices.select(F.posexplode("matrix").alias("i", "line"), "assets", "leaf_order")
    m = m.select("i", F.posexplode("line").alias("j", "rho"), "assets", "leaf_order")
    place = lambda k: (F.array_position("leaf_order", F.col("assets")[F.col(k)]) - 1).cast("int")
    return m.select(place("i").alias("row"), place("j").alias("column"), F.col("assets")[F.col("i")].alias("a"), F.col("assets")[F.col("j")].alias("b"), "rho")


def spectrum_series(matrices: DataFrame) -> DataFrame:
    """rank from 1, eigenvalue, and the random-matrix edge."""
    return matrices.select(F.posexplode("spectrum").alias("rank", "eigenvalue"), "lambda_plus").withColumn("rank", F.col("rank") + 1)


def events_between(events: DataFrame, start: str, end: str) -> DataFrame:
    return events.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def at_window(table: DataFrame, window_end: str) -> DataFrame:
    """Rows of one window of an edges or layouts table, without the key."""
    return table.where(F.col("window_end").cast("date") == F.lit(window_end).cast("date")).drop("window_end")


def window_ends(windows: DataFrame) -> DataFrame:
    return windows.select("window_end").distinct().orderBy("window_end")


def frames(windows: DataFrame, start: str, end: str, stride: int = 2) -> DataFrame:
    """window_end, frame and peak of every ``stride``-th window from start to
    end; the peak is the frame of the largest absorption ratio."""
    inside = windows.where(F.col("window_end").cast("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    k = F.row_number().over(Window.orderBy("window_end")) - 1
    kept = inside.select("window_end", "absorption_ratio", k.alias("k")).where(F.col("k") % stride == 0)
    top = Window.partitionBy(F.lit(1)).orderBy(F.desc("absorption_ratio"), "window_end")
    return kept.select("window_end", (F.col("k") / stride).cast("int").alias("frame"), (F.row_number().over(top) == 1).alias("peak"))
