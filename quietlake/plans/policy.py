"""Policy and settings, and the classification of relations and columns by them."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field, fields
from pathlib import Path

import yaml

from ..functions.globs import Globs

RED, AMBER, GREEN = "RED", "AMBER", "GREEN"
ORDER = (RED, AMBER, GREEN)
# Names that no allow pattern opens; names of dates, and those that aren't even opened by truncation; developers' schemas.
HARD_DENY = re.compile(r"birth|dob|death|^age$|^age_|_age$")
DATEISH = re.compile(r"(?:_date$|_dt$|_ts$|_time$|_at$|timestamp|dttm|datetime|^dos$|^dod$|death|admit|discharge|birth|dob)")
NEVER_TRUNCATE = re.compile(r"birth|dob")
_DEV_SCHEMA = re.compile(r"dev_[a-z0-9]+(?:__(?P<real>.+))?", re.I)
LISTS = ("red", "amber", "green", "allow_columns", "deny_columns", "deny_descriptions", "count_columns")


@dataclass(frozen=True)
class Policy:
    """Seven lists of globs."""

    red: Globs = field(default_factory=lambda: Globs(()))
    amber: Globs = field(default_factory=lambda: Globs(()))
    green: Globs = field(default_factory=lambda: Globs(()))
    allow_columns: Globs = field(default_factory=lambda: Globs(()))
    deny_columns: Globs = field(default_factory=lambda: Globs(()))
    deny_descriptions: Globs = field(default_factory=lambda: Globs(()))
    count_columns: Globs = field(default_factory=lambda: Globs(()))

    @classmethod
    def of(cls, lists: dict[str, Iterable[str]]) -> Policy:
        unknown = set(lists) - set(LISTS)
        if unknown:
            raise ValueError(f"unknown policy lists: {sorted(unknown)}")
        return cls(**{k: Globs(v or ()) for k, v in lists.items()})

    @classmethod
    def load(cls, path: str | Path) -> Policy:
        return cls.of(yaml.safe_load(Path(path).read_text()) or {})

    @classmethod
    def default(cls) -> Policy:
        return cls.load(Path(__file__).with_name("default_policy.yml"))

    def digest(self) -> str:
        """SHA-256 of the lists, in their order."""
        return hashlib.sha256(json.dumps({k: getattr(self, k).patterns for k in LISTS}).encode()).hexdigest()

    def level(self, name: str) -> str:
        """RED, AMBER or GREEN of a dotted relation name. Whatever matches nothing is RED.

        A green match in a developer's schema or catalog is only AMBER, as it could be made there.
        """
        forms, in_dev = variants(name)
        if any(f in self.red for f in forms):
            return RED
        if any(f in self.green for f in forms):
            return AMBER if in_dev else GREEN
        return AMBER if any(f in self.amber for f in forms) else RED

    def column_denied(self, name: str) -> str | None:
        """The pattern that denies a column; None if it is allowed."""
        if name in self.allow_columns and not HARD_DENY.search(name.lower()):
            return None
        return self.deny_columns.first(name)

    def column_allowed(self, name: str) -> bool:
        return name in self.allow_columns and not HARD_DENY.search(name.lower())

    def denied_columns(self, names: Iterable[str]) -> list[tuple[str, str]]:
        """The names that are denied, each with its pattern."""
        return [(n, p) for n in names if (p := self.column_denied(n))]


def variants(name: str) -> tuple[list[str], bool]:
    """The dotted forms under which a relation is looked up, and whether it is in a developer's place.

    ``c.s.t`` is also ``s.t`` and ``t``; a schema ``dev_user__real`` is also ``real``, ``dev_user``
    is also none, and a catalog ``x_dev`` is also ``x``.
    """
    parts = [p for p in name.lower().split(".") if p]
    table = parts[-1] if parts else ""
    schema = parts[-2] if len(parts) > 1 else ""
    catalog = ".".join(parts[:-2])
    schemas, catalogs = [schema], [catalog]
    dev = False
    if m := _DEV_SCHEMA.fullmatch(schema):
        dev = True
        schemas.append((m["real"] or "").lower())
    if catalog.endswith("_dev"):
        dev = True
        catalogs.append(catalog[: -len("_dev")])
    forms = [".".join(x for x in (c, s, table) if x) for c in catalogs for s in schemas]
    forms += [".".join(x for x in (s, table) if x) for s in schemas] + [table]
    return list(dict.fromkeys(forms)), dev


def strictest(levels: Iterable[str]) -> str:
    return next((x for x in ORDER if x in set(levels)), GREEN)


@dataclass(frozen=True)
class Settings:
    """Limits of a broker. Read from the session as ``quietlake.<name>`` where set."""

    k: int = 11
    max_rows: int = 5000
    max_rows_sensitive: int = 200
    max_suppressed_share: float = 0.5
    tiny_rows: int = 5
    person_key_ratio: float = 0.5
    profile_columns: int = 60
    max_blob_bytes: int = 20_000_000
    require_entity_scan: bool = False

    @classmethod
    def of(cls, spark) -> Settings:
        got = {}
        for f in fields(cls):
            v = spark.conf.get(f"quietlake.{f.name}", None)
            if v is not None:
                got[f.name] = v.lower() == "true" if f.type == "bool" else float(v) if f.type == "float" else int(v)
        return cls(**got)

    def ceiling(self, all_green: bool) -> int:
        return self.max_rows if all_green else self.max_rows_sensitive
