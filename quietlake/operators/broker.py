"""The broker: a statement is checked, run, suppressed, redacted, and only then handed out."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..plans.gate import Gate, Verdict
from ..plans.policy import Policy, Settings
from ..sources.sinks import write_csv
from . import cellscan, profile, suppress
from .audit import AuditLog, sha256

ALLOWED, DENIED, FAILED, SCRUB_REFUSED, OVER_CEILING = 0, 1, 3, 4, 5


class Denied(Exception):
    """The gate's refusal; ``verdict`` has the reasons."""

    def __init__(self, verdict: Verdict) -> None:
        super().__init__("; ".join(verdict.reasons[:3]))
        self.verdict = verdict


class OverCeiling(Exception):
    """The result has more rows than may leave; it is never cut."""


class QueryFailed(Exception):
    """Spark's failure, without its text, which may hold values."""


@dataclass
class Governed:
    """A result that may leave."""

    df: DataFrame
    verdict: Verdict
    suppression: suppress.Suppression
    cells: cellscan.CellReport
    ceiling: int
    kinds: dict = field(default_factory=dict)


class Broker:
    """``check`` a statement, or ``run`` it. Relations are those of the session's catalog.

    Schemas come from the catalog when a statement is checked; ``index`` adds descriptions and counts
    (see :mod:`profile`). ``recogniser`` makes a function from a text to the names of the entities in
    it; with ``Settings.require_entity_scan`` no result leaves without one having looked at all of it.
    """

    def __init__(self, spark: SparkSession, policy: Policy | None = None, settings: Settings | None = None, index: dict | None = None, audit: AuditLog | None = None, out: str | Path | None = None, recogniser: cellscan.Recogniser | None = None) -> None:
        self.spark, self.policy = spark, policy or Policy.default()
        self.settings = settings or Settings.of(spark)
        self.index, self.audit, self.out = index or {}, audit, Path(out) if out else None
        self.recogniser = recogniser

    def _live(self, verdict: Verdict) -> dict:
        live = {}
        for t in verdict.tables:
            try:
                live[t] = {"kind": "table", "columns": profile.describe(self.spark.table(t))}
            except PySparkException:
                continue  # a relation that isn't there has no columns that are known
        return profile.merged({k: v for k, v in self.index.items()}, live)

    def check(self, sql: str) -> Verdict:
        gate = Gate(self.spark, self.policy, self.index, self.settings.k, self.settings.person_key_ratio)
        first = gate.check(sql)
        if first.tables:
            first = Gate(self.spark, self.policy, self._live(first), self.settings.k, self.settings.person_key_ratio).check(sql)
        return first

    def run(self, sql: str, **about) -> Governed:
        """The governed result; else :class:`Denied`, :class:`OverCeiling`, :class:`QueryFailed` or :class:`suppress.Refused`."""
        verdict = self.check(sql)
        if not verdict.allowed:
            self._record(verdict, "DENY", DENIED, **about)
            raise Denied(verdict)
        ceiling = self.settings.ceiling(verdict.all_green)
        try:
            # one row more than may leave tells whether there are too many; what is held is bounded by it
            df = self.spark.sql(sql)
            kinds = df.schema
            rows = df.limit(ceiling + 1).collect()
        except PySparkException as e:
            self._record(verdict, "ERROR", FAILED, error=e.getCondition(), **about)
            raise QueryFailed(e.getCondition() or type(e).__name__) from None
        if len(rows) > ceiling:
            self._record(verdict, "ROW_CEILING", OVER_CEILING, ceiling=ceiling, **about)
            raise OverCeiling(f"more than {ceiling} rows")
        try:
            held = self.spark.createDataFrame(rows, kinds)
            got = self.scrub(held, verdict, ceiling)
        except suppress.Refused as e:
            self._record(verdict, "SCRUB_FAIL", SCRUB_REFUSED, why=str(e), **about)
            raise
        self._record(verdict, "ALLOW", ALLOWED, got, ceiling=ceiling, **about)
        return got

    def scrub(self, df: DataFrame, verdict: Verdict, ceiling: int) -> Governed:
        """Column names, suppression, refusal, redaction, in this order; of results of green relations too."""
        suppress.check_columns(df, self.policy)
        counts = suppress.count_positions(df.columns, self.policy.count_columns, verdict.count_cols, verdict.count_idx)
        keys = suppress.key_positions(df.columns, verdict.group_keys, verdict.key_idx)
        out, s = suppress.anonymize(df, self.settings.k, counts, [i for i in keys if i not in counts], self.settings.tiny_rows, self.settings.max_suppressed_share)
        if self.settings.require_entity_scan and self.recogniser is None:
            raise suppress.Refused("an entity scan is required, and there is no recogniser")
        try:
            out, cells = cellscan.scan_cells(out, list_hits=True, recogniser=self.recogniser)
        except (cellscan.NotLookedAt, PySparkException) as e:
            raise suppress.Refused(f"the cells could not be looked at: {type(e).__name__}") from None
        return Governed(out, verdict, s, cells, ceiling)

    def controls(self) -> dict[str, str]:
        """Digests of what decides: the policy's lists and the settings."""
        return {"policy_sha256": self.policy.digest(), "settings_sha256": sha256(repr(self.settings))}

    def _record(self, verdict: Verdict, outcome: str, code: int, got: Governed | None = None, **more) -> None:
        """Verdict, history and audit line; the result last, and a stale one removed first."""
        controls = self.controls()
        changed = [] if self.audit is None else self.audit.changed("run", **controls)
        doc = verdict.document() | {"outcome": outcome, "exit_code": code, "controls_changed": changed} | controls | more
        if got is not None:
            doc |= {"rows": got.suppression.rows, "rows_suppressed": got.suppression.rows_suppressed, "cells_suppressed": got.suppression.cells_suppressed, "alarm": got.cells.alarm, "kinds": got.cells.kinds, "day_precision_dates": got.cells.day_precision_dates, "entities": got.cells.entities, "hits": got.cells.hits}
        if self.out is not None:
            self.out.mkdir(parents=True, exist_ok=True)
            result = self.out / "result.csv"
            result.unlink(missing_ok=True)
            text = json.dumps(doc, indent=2, default=str)
            (self.out / "verdict.json").write_text(text)
            history = self.out / "history"
            history.mkdir(exist_ok=True)
            stem = f"{time.strftime('%Y%m%dT%H%M%S')}{time.time_ns() % 10**9:09d}-{sha256(verdict.sql)[:8]}"
            (history / f"{stem}.sql").write_text(verdict.sql)
            (history / f"{stem}.json").write_text(text)
            if got is not None:
                write_csv(got.df, result)
        if self.audit is not None:
            self.audit.append("run", verdict=outcome, sql=verdict.sql, sql_sha256=sha256(verdict.sql), k=self.settings.k, group_keys=sorted(verdict.group_keys), **controls, **{k: v for k, v in doc.items() if k in ("ceiling", "rows", "cells_suppressed", "alarm", "error", "why", "purpose", "controls_changed")})

    def exit_code(self, sql: str) -> int:
        """:meth:`run`, as a process's exit code."""
        try:
            self.run(sql)
        except Denied:
            return DENIED
        except QueryFailed:
            return FAILED
        except suppress.Refused:
            return SCRUB_REFUSED
        except OverCeiling:
            return OVER_CEILING
        return ALLOWED
