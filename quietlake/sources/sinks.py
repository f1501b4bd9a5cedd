"""Sinks of governed results: small, bounded by the row ceiling, written by the driver."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str | Path) -> None:
    """Header and rows in one file, complete or absent."""
    path = Path(path)
    part = path.with_suffix(".part")
    with part.open("w", newline="") as f:
        w = csv.writer(f)
        w.writerow(df.columns)
        w.writerows([["" if x is None else x for x in r] for r in df.collect()])
    part.replace(path)


def echo(df: DataFrame, rows: int = 60, width: int = 40) -> str:
    """A fixed-width listing."""
    got = [df.columns, *[["" if x is None else str(x) for x in r] for r in df.limit(rows).collect()]]
    cut = [[c[:width] for c in r] for r in got]
    widths = [max(len(r[i]) for r in cut) for i in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cut)


def write_text(df: DataFrame, path: str, column: str = "value") -> None:
    """One column of lines as text files."""
    df.select(column).write.mode("overwrite").text(path)
