"""Redaction of every text cell of a result, and what it found."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import redact

#: Shorter cells aren't looked at.
LEAST_LENGTH = 3
#: Reports name so many cells at most.
MOST_HITS = 50
# Cells that an entity recogniser skips, and the characters of a result that it looks at.
NUMERIC = r"^-?[\d,]+(\.\d+)?$"
ENTITY_BUDGET = 400_000

Recogniser = Callable[[], Callable[[str], list[str]]]


@dataclass
class CellReport:
    """Hits by kind, kinds by column, dates with a day, and the first cells with a hit: row from 1, column, kinds."""

    kinds: dict[str, int] = field(default_factory=dict)
    columns: dict[str, list[str]] = field(default_factory=dict)
    day_precision_dates: int = 0
    entities: list[str] = field(default_factory=list)
    hits: list[tuple[int, str, list[str]]] = field(default_factory=list)

    @property
    def alarm(self) -> bool:
        return bool(self.kinds or self.entities)


class NotLookedAt(Exception):
    """A recogniser's budget ended before the result did."""


def scan_cells(df: DataFrame, list_hits: bool = False, recogniser: Recogniser | None = None, budget: int = ENTITY_BUDGET) -> tuple[DataFrame, CellReport]:
    """``df`` with identifiers in its text cells redacted, and a report; dates are counted, not redacted.

    The report is one aggregate over all cells; it never holds a value. ``list_hits`` and
    ``recogniser`` (names of entities found in a cell are reported, the cell isn't changed) number and
    look at all rows in one task: for results under a row ceiling.
    """
    names = df.columns
    numbered = df.toDF(*[f"_{i}" for i in range(len(names))])
    counted, total, report = [], [], CellReport()
    texts = [i for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.StringType)]
    for i in texts:
        long = F.length(f"_{i}") >= LEAST_LENGTH
        numbered = redact.staged(numbered.withColumn(f"_l{i}", F.when(long, F.col(f"_{i}"))), f"_l{i}", f"_c{i}_")
        numbered = numbered.withColumn(f"_d{i}", F.coalesce(F.regexp_count(F.col(f"_c{i}_text"), F.lit(redact.java(redact.DAY_DATE))), F.lit(0)))
    for i, f in enumerate(df.schema.fields):
        if i in texts:
            for kind, n in redact.staged_kinds(f"_c{i}_").items():
                counted.append((f.name, kind))
                total.append(F.coalesce(F.sum(n), F.lit(0)).alias(f"k{len(counted)}"))
            counted.append((f.name, "DATE"))
            total.append(F.coalesce(F.sum(f"_d{i}"), F.lit(0)).alias(f"k{len(counted)}"))
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            counted.append((f.name, "DATE"))
            total.append(F.count(F.col(f"_{i}")).alias(f"k{len(counted)}"))
    if total:
        for (name, kind), n in zip(counted, numbered.agg(*total).first(), strict=True):
            if n and kind == "DATE":
                report.day_precision_dates += n
            elif n:
                report.kinds[kind] = report.kinds.get(kind, 0) + n
                report.columns.setdefault(name, []).append(kind)
    if texts and (recogniser or list_hits and report.kinds):
        _list(numbered, names, texts, report, recogniser, budget)
    out = [F.coalesce(F.col(f"_c{i}_text"), F.col(f"_{i}")).alias(f"_{i}") if i in texts else F.col(f"_{i}") for i in range(len(names))]
    return numbered.select(*out).toDF(*names), report


def _list(numbered: DataFrame, names: list[str], texts: list[int], report: CellReport, recogniser: Recogniser | None, budget: int) -> None:
    """Fill in the first cells with a hit, and the entities."""
    rows = numbered.coalesce(1).withColumn("_row", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))
    cells = []
    for i in texts:
        n = redact.staged_kinds(f"_c{i}_")
        kinds = F.array_compact(F.array(*[F.when(n[k] > 0, F.lit(k)) for k in sorted(n)]))
        open_ = F.when(~F.col(f"_l{i}").rlike(NUMERIC), F.col(f"_c{i}_text"))
        cells.append(F.struct(F.lit(i).alias("i"), kinds.alias("kinds"), open_.alias("open")))
    flat = rows.select("_row", F.explode(F.array(*cells)).alias("c")).select("_row", "c.i", "c.kinds", "c.open")
    found = flat.withColumn("names", F.lit(None).cast("array<string>") if recogniser is None else entity_udf(recogniser, budget)("open"))
    kept = found.filter((F.size("kinds") > 0) | F.col("open").isNotNull() & (F.col("names").isNull() | (F.size("names") > 0))) if recogniser else found.filter(F.size("kinds") > 0)
    entities: set[str] = set()
    for r in kept.orderBy("_row", "i").collect():
        if recogniser and r["open"] is not None and r["names"] is None:
            raise NotLookedAt(f"more than {budget} characters")
        entities |= set(r["names"] or ())
        if len(report.hits) < MOST_HITS:
            report.hits.append((r["_row"], names[r["i"]], [*r["kinds"], *(r["names"] or ())]))
    report.entities = sorted(entities)


def entity_udf(load: Recogniser, budget: int = ENTITY_BUDGET):
    """A column function that names the entities a recogniser finds; ``load`` makes it, once a worker task.

    Each task looks at ``budget`` characters at most; cells beyond it have null, which a caller must
    treat as not looked at.
    """

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        recognise, left = load(), budget
        for batch in batches:
            out = []
            for x in batch:
                if x is None or len(x) > left:
                    out.append([] if x is None else None)
                    continue
                left -= len(x)
                out.append(sorted(set(recognise(x))))
            yield pd.Series(out)

    return found
