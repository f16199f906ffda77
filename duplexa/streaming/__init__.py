"""An extension: supports kept up to date over a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_support(edges: DataFrame, side: str = "item") -> DataFrame:
    """Rows of each node so far; write with output mode "update" or "complete"."""
    return edges.groupBy(side).agg(F.count("*").alias("support"))


def windowed_support(edges: DataFrame, time: str, window: str = "1 day", late: str = "1 day", side: str = "item") -> DataFrame:
    """Rows of each node by window of event time, closed once the watermark passes."""
    return edges.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), side).agg(F.count("*").alias("support")).select("window.start", side, "support")
