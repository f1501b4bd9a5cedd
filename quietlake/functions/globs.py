"""Shell-style patterns as anchored regular expressions, for Python and for Spark."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_regex(pattern: str) -> str:
    """``*`` any run (dots and slashes too), ``?`` one character, ``[..]`` a set, ``[!..]`` its complement.

    The result means the same to Python and Java.
    """
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = re.sub(r"([\\\[&~^])", r"\\\1", pattern[i + 1 : end])
            out.append(f"[^{body[1:]}]" if body.startswith("!") else f"[{body}]")
            i = end
        else:
            out.append(c if c.isalnum() or c in "_/" else f"\\{c}" if ord(c) < 128 else c)
        i += 1
    return "(?s)^(?:" + "".join(out) + ")$"


class Globs:
    """A list of patterns, matched against lower-cased names."""

    def __init__(self, patterns: Iterable[str]) -> None:
        self.patterns = [p.lower() for p in patterns]
        self._compiled = [re.compile(to_regex(p)) for p in self.patterns]

    def first(self, name: str) -> str | None:
        low = name.lower()
        return next((p for p, r in zip(self.patterns, self._compiled, strict=True) if r.match(low)), None)

    def __contains__(self, name: str) -> bool:
        return self.first(name) is not None

    def matches(self, name: Column) -> Column:
        """The same test on a column; false without patterns."""
        low = F.lower(name)
        test = F.lit(False)
        for p in self.patterns:
            test = test | low.rlike(to_regex(p))
        return test

    def first_of(self, name: Column) -> Column:
        """The first pattern that matches a column; null if none does."""
        low = F.lower(name)
        return F.coalesce(*[F.when(low.rlike(to_regex(p)), F.lit(p)) for p in self.patterns], F.lit(None).cast("string"))
