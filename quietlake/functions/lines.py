"""Texts as numbered lines, with the line ends that Python's splitlines knows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def lines(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """A row for each line: the kept columns, ``line_no`` from 1 and ``line``. A last empty line doesn't count; null and empty texts have none."""
    parts = F.split(F.regexp_replace(F.col(text), f"(?:{LINE_END})\\z", ""), LINE_END)
    some = df.filter(F.length(text) > 0).select(*keep, F.posexplode(parts).alias("_pos", "line"))
    return some.select(*keep, (F.col("_pos") + 1).alias("line_no"), "line")
