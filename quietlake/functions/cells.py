"""Result cells: small counts, total lines, the suppression label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a suppressed cell shows, for any threshold.
SUPPRESSED = "<11"
#: Key cells of a total line, trimmed and lower-cased; null is one too.
TOTAL_CELLS = ("", "all", "total")


def is_small(cell: Column, kind: T.DataType, k: int) -> Column:
    """Whether a cell is a whole number from 1 to k - 1; thousands may have commas. Booleans never are."""
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    x = F.replace(cell.cast("string"), F.lit(","), F.lit("")).try_cast("double")
    return F.coalesce((x == F.floor(x)) & (x >= 1) & (x < k) & ~F.isnan(x), F.lit(False))


def is_total(cell: Column) -> Column:
    return F.coalesce(F.lower(F.trim(cell.cast("string"))).isin(*TOTAL_CELLS), F.lit(True))
