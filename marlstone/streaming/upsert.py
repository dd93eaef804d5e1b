"""Bars as a stream: micro-batches merged into the store, and rolling indices
kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import store


def into_store(stream: DataFrame, bars: store.Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merge a stream of bars into the store. A batch that is run again merges
    the same rows again, which changes nothing, so delivery at least once is
    enough."""
    w = stream.writeStream.foreachBatch(lambda rows, _: bars.write(rows) if rows.limit(1).count() else None).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def latest_bars(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Per ticker and day the bar's last state; days older than ``late`` behind
    the newest are closed. ``stream``: ticker, ts, price, volume."""
    day = F.window("ts", "1 day")
    g = stream.withWatermark("ts", late).groupBy("ticker", day)
    return g.agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume")).select("ticker", F.to_date("window.start").alias("date"), "open", "high", "low", "close", "volume")
