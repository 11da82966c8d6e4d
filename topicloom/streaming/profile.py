"""Profiles kept up to date while rows arrive (the reference profiles each table once and skips those it has; this is the same histogram, incrementally)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from topicloom.operators.profile import column_profile


def stream_profile(rows: DataFrame, dataset: str, name: str, time: str | None = None, delay: str = "1 hour") -> StreamingQuery:
    """Starts a query that keeps dataset, attr, value, cnt in an in-memory table. With a time column, counts are kept by hour and state older than the watermark is dropped."""
    if time is None:
        return column_profile(rows, dataset).writeStream.outputMode("complete").format("memory").queryName(name).start()
    cells = F.array(*[F.struct(F.lit(c).alias("attr"), F.col(f"`{c}`").cast("string").alias("value")) for c in rows.columns if c != time])
    hours = rows.withWatermark(time, delay).select(F.window(time, "1 hour").alias("hour"), F.explode(cells).alias("cell")).filter("cell.value is not null")
    return hours.groupBy("hour", F.col("cell.attr").alias("attr"), F.col("cell.value").alias("value")).agg(F.count("*").alias("cnt")).writeStream.outputMode("update").format("memory").queryName(name).start()
