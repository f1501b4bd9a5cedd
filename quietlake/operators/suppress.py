"""k-anonymity of results: small rows are blanked, mostly small results refused."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import SUPPRESSED, is_small, is_total
from ..functions.globs import Globs
from ..plans.policy import Policy


class Refused(Exception):
    """The result may not leave; nothing of it is written."""


@dataclass(frozen=True)
class Suppression:
    """What suppression did: rows in all, rows blanked (total lines included), cells changed."""

    rows: int
    rows_suppressed: int
    cells_suppressed: int

    @property
    def share(self) -> float:
        return self.rows_suppressed / self.rows if self.rows else 0.0


def count_positions(columns: list[str], patterns: Globs, names: Iterable[str] = (), positions: Iterable[int] = ()) -> list[int]:
    """Columns that hold counts: by pattern, by a verdict's alias, or by a verdict's position."""
    low = {n.lower() for n in names}
    return [i for i, c in enumerate(columns) if c in patterns or c.lower() in low or i in set(positions)]


def key_positions(columns: list[str], names: Iterable[str] = (), positions: Iterable[int] = ()) -> list[int]:
    low = {n.lower() for n in names}
    return [i for i, c in enumerate(columns) if c.lower() in low or i in set(positions)]


def _numbered(df: DataFrame) -> DataFrame:
    """Columns by position, so that equal or odd names do no harm."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def _small(df: DataFrame, counts: list[int], k: int) -> Column:
    test = F.lit(False)
    for i in counts:
        test = test | is_small(F.col(f"_{i}"), df.schema[i].dataType, k)
    return test


def suppress(df: DataFrame, k: int, counts: list[int], keys: list[int] | None = None) -> DataFrame:
    """``df`` with every cell of a row with a small count replaced by ``<11``; all columns become text.

    ``counts`` and ``keys`` are positions. If any row is blanked, lines whose keys are all totals are
    blanked too, as they would give the blanked counts away. Without count columns the result is
    unchanged. Whether any row is small is one aggregate over the result, joined back as one row.
    """
    if not counts:
        return df
    numbered = _numbered(df).withColumn("_small", _small(df, counts, k))
    if keys:
        total = F.lit(True)
        for i in keys:
            total = total & is_total(F.col(f"_{i}"))
        any_small = numbered.agg(F.coalesce(F.max("_small"), F.lit(False)).alias("_any"))
        numbered = numbered.crossJoin(F.broadcast(any_small)).withColumn("_blank", F.col("_small") | (F.col("_any") & total))
    else:
        numbered = numbered.withColumn("_blank", F.col("_small"))
    cells = [F.when(F.col("_blank"), F.lit(SUPPRESSED)).otherwise(F.col(f"_{i}").cast("string")) for i in range(len(df.columns))]
    return numbered.select(*[c.alias(f"_{i}") for i, c in enumerate(cells)]).toDF(*df.columns)


def measure(suppressed: DataFrame, original_columns: int, counts: list[int]) -> Suppression:
    """Counts of a suppressed result."""
    if not counts:
        return Suppression(suppressed.count(), 0, 0)
    numbered = _numbered(suppressed)
    hit = F.coalesce(F.col(f"_{counts[0]}") == SUPPRESSED, F.lit(False))
    n, b = numbered.agg(F.count(F.lit(1)), F.coalesce(F.sum(hit.cast("long")), F.lit(0))).first()
    return Suppression(n, b, b * original_columns)


def refuse(s: Suppression, tiny_rows: int = 5, most: float = 0.5) -> str | None:
    """Why a result must be refused as a whole; None if it needn't be."""
    if not s.rows or not s.rows_suppressed:
        return None
    if s.rows <= tiny_rows:
        return f"{s.rows} rows with {s.rows_suppressed} suppressed answer a question about few"
    if s.share > most:
        return f"{s.rows_suppressed} of {s.rows} rows are suppressed"
    return None


def anonymize(df: DataFrame, k: int, counts: list[int], keys: list[int] | None = None, tiny_rows: int = 5, most: float = 0.5) -> tuple[DataFrame, Suppression]:
    """Suppress, then refuse (by :class:`Refused`) what is mostly suppressed. ``df`` should be stored or small."""
    out = suppress(df, k, counts, keys)
    s = measure(out, len(df.columns), counts)
    if why := refuse(s, tiny_rows, most):
        raise Refused(why)
    return out, s


def check_columns(df: DataFrame, policy: Policy) -> None:
    """Refuse a result one of whose columns has a denied name."""
    if found := policy.denied_columns(df.columns):
        raise Refused("; ".join(f"column {c} is denied by {p}" for c, p in found))


def text_columns(schema: T.StructType) -> list[int]:
    return [i for i, f in enumerate(schema.fields) if isinstance(f.dataType, T.StringType)]
