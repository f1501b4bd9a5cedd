"""Streams: redaction of each row, and k-anonymous counts of closed windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import SUPPRESSED
from ..functions.redact import redact, redact_kinds


def redacted(stream: DataFrame, text: str = "text") -> DataFrame:
    """The stream with ``text`` redacted and the kinds found. Stateless; works in append mode."""
    return stream.withColumn("kinds", redact_kinds(F.col(text))).withColumn(text, redact(F.col(text)))


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, late: str, k: int = 11) -> DataFrame:
    """Counts by window and keys; windows below k are blanked whole.

    In append mode a window is emitted once, when the watermark has passed it, so its count is final;
    rows later than ``late`` are dropped. Update mode would show small counts growing and isn't safe.
    """
    n = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    small = (F.col("n") >= 1) & (F.col("n") < k)
    blank = lambda c: F.when(small, F.lit(SUPPRESSED)).otherwise(c.cast("string"))
    return n.select(blank(F.col("window.start")).alias("window_start"), *[blank(F.col(c)).alias(c) for c in keys], blank(F.col("n")).alias("n"))
