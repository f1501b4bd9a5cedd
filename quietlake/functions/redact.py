"""Redaction of identifiers and secrets in text, as Spark expressions.

Patterns run one after another, each on what the ones before have left; the order is part of the
result. All run in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds and their patterns, in order.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("US_SSN", r"(?i)\b(?<![-\d])\d{9}(?![-\d])\b(?=[^\n]{0,20}\bssn\b)"),
    ("PHONE_NUMBER", r"(?<![\d-])(?:\+?1[-. ]?)?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}(?![\d-])"),
    ("EMAIL_ADDRESS", r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b"),
    ("RECORD_NUMBER", r"(?i)\b(?:mrn|medical\s+record(?:\s+(?:no|number|#))?|csn|contact\s+serial|acct|account(?:\s+(?:no|number|#))?|patient\s+(?:id|no|number|#))\b[^\w\n]{0,12}\d{5,14}\b"),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("CREDIT_CARD", r"\b(?:\d{4}[- ]){3}\d{4}\b"),
    ("TOKEN", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b"),
    ("TOKEN", r"\b(?:dapi[0-9a-f]{24,}|lin_api_[A-Za-z0-9]{20,})\b"),
    ("TOKEN", r"(?i)\b(?:token|secret|api[_-]?key|access[_-]?token|password|passwd|pat|bearer)\b[^\w\n]{0,4}['\"]?[A-Za-z0-9][A-Za-z0-9._-]{15,}"),
)
#: What a text must have for the pattern of the same place to have a hit; quickly looked for.
NEEDED = (r"\p{Nd}-\p{Nd}{2}-\p{Nd}", r"\p{Nd}{9}", r"\p{Nd}[-. )]", "@", r"\p{Nd}{5}", r"\p{Nd}\.\p{Nd}", r"\p{Nd}{4}[- ]", "gh[pousr]_", "dapi|lin_api_", "(?iu)token|secret|api|pass|pat|bearer")
#: The same for any of the patterns.
NEEDED_BY_ANY = r"(?iu)\p{Nd}|@|gh[pousr]_|dapi|lin_api_|token|secret|api|pass|\bpat\b|bearer"
DAY_DATE = r"\b(?:19|20)\d{2}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/(?:19|20)?\d{2}\b"
LABEL = "<REDACTED:{}>"
KINDS = tuple(dict.fromkeys(k for k, _ in PATTERNS))
# Patterns of e-mail bodies, which run before the others. Group 1 stays, group 2 is replaced.
_DATE = r"(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}|[A-Z][a-z]{2,8}\.?\s+\d{1,2},?\s+\d{4}|\d{1,2}\s+[A-Z][a-z]{2,8}\.?\s+\d{4})"
EMAIL_PATTERNS: tuple[tuple[str, str], ...] = (
    ("DATE_OF_BIRTH", r"(?i)(\b(?:dob|d\.o\.b\.?|date\s+of\s+birth|birth\s*date|born(?:\s+on)?)[^\w\n]{0,6})(" + _DATE + ")"),
    ("PERSON", r"((?i:\b(?:patient(?:\s+name)?|pt|name|dear|mr|mrs|ms|miss)\b)\.?[ \t]*[:,-]?[ \t]*(?:(?i:dr|mr|mrs|ms)\.?[ \t]+)?)([A-Z][a-z'-]+(?:,?[ \t]+[A-Z](?:[a-z'-]+|\.))*)"),
    ("ADDRESS", r"()(\b\d{1,6}[ \t]+(?:[A-Z0-9][\w.'-]*[ \t]+){1,4}(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Dr|Drive|Ln|Lane|Ct|Court|Way|Pl|Place|Pkwy|Parkway|Cir|Circle|Ter|Terrace|Hwy|Highway)\b\.?(?:,?[ \t]*(?:Apt|Unit|Suite|Ste|#)\.?[ \t]*\w+)?)"),
    ("ZIP_CODE", r"(\b[A-Z]{2}[ \t]+)(\d{5}(?:-\d{4})?)\b"),
)

def java(pattern: str) -> str:
    """The pattern with Python's meaning of \\w, \\d and \\b in Java."""
    return pattern.replace("(?i)", "(?iU)", 1) if pattern.startswith("(?i)") else f"(?U){pattern}"


_RE2_CLASS = {"d": "0-9", "w": "0-9A-Za-z_", "s": r"\t\n\f\r "}
_RE2_BOUNDARY = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
#: What RE2's (?i) takes for a letter besides its other case.
_RE2_FOLDS = {"s": "\u017f", "k": "\u212a"}


def re2(pattern: str) -> str:
    r"""The pattern with RE2's meaning in Java: \w, \d, \s and \b of ASCII alone, whole ends, folds of s and k.

    For the syntax that the patterns of this module use.
    """
    fold = pattern.startswith("(?i)")
    out, inside = ["(?i)" if fold else ""], False
    for part in re.findall(r"\\.|\(\?:|\[\^?|.", pattern.removeprefix("(?i)"), re.DOTALL):
        if part[0] == "\\" and part[1] in _RE2_CLASS:
            more = "".join(_RE2_FOLDS.values()) if fold and part[1] == "w" else ""
            out.append(_RE2_CLASS[part[1]] + more if inside else f"[{_RE2_CLASS[part[1]]}{more}]")
        elif part == r"\b":
            out.append(_RE2_BOUNDARY)
        elif inside:
            inside = part != "]"
            # the end of a range of letters
            out.append(part + "".join(_RE2_FOLDS.values()) if fold and part in "zZ" and out[-1] == "-" else part)
        elif part[0] == "[":
            inside = True
            out.append(part)
        elif part in "^$":
            out.append({"^": r"\A", "$": r"\z"}[part])
        else:
            out.append(f"[{part}{_RE2_FOLDS[part.lower()]}]" if fold and part.lower() in _RE2_FOLDS else part)
    return "".join(out)


def redact_steps(df: DataFrame, column: str, chain: Iterable[tuple[str, str, str]]) -> DataFrame:
    """``df`` with the column after a chain of patterns and replacements, both of Java; null stays null.

    A projection for each step, as in :func:`staged`; each step names first what a text must have for a hit.
    """
    for needed, pattern, replacement in chain:
        t = F.col(column)
        df = df.withColumn(column, F.when(t.rlike(needed), F.regexp_replace(t, F.lit(pattern), F.lit(replacement))).otherwise(t))
    return df


def redact(text: Column) -> Column:
    """The text with each hit replaced by its kind's label; null stays null."""
    for kind, pattern in PATTERNS:
        text = F.regexp_replace(text, F.lit(java(pattern)), F.lit(LABEL.format(kind)))
    return text


def hit_counts(text: Column) -> Column:
    """A struct with the number of hits of each pattern, in order (``p0``, ``p1``, ...), and ``text``, redacted.

    Each pattern is counted on the text as the earlier ones have left it.
    """
    fields = []
    for i, (kind, pattern) in enumerate(PATTERNS):
        fields.append(F.coalesce(F.regexp_count(text, F.lit(java(pattern))), F.lit(0)).alias(f"p{i}"))
        text = F.regexp_replace(text, F.lit(java(pattern)), F.lit(LABEL.format(kind)))
    return F.struct(*fields, text.alias("text"))


def staged(df: DataFrame, text: str, prefix: str = "_") -> DataFrame:
    """``df`` with ``_n0``, ``_n1``, ... hits of each pattern and ``_text``, redacted; for whole tables.

    The same as :func:`hit_counts`, a projection for each step of the chain, so that every pattern
    runs at most twice a row, and only where the row has what the pattern needs: each step is used
    more than once above, which keeps Catalyst from putting the steps into each other.
    """
    out = df.withColumn(f"{prefix}text", F.col(text))
    for i, (kind, pattern) in enumerate(PATTERNS):
        t, n = F.col(f"{prefix}text"), F.col(f"{prefix}n{i}")
        out = out.withColumn(f"{prefix}n{i}", F.when(t.rlike(NEEDED[i]), F.regexp_count(t, F.lit(java(pattern)))).otherwise(F.lit(0)))
        out = out.withColumn(f"{prefix}text", F.when(n > 0, F.regexp_replace(t, F.lit(java(pattern)), F.lit(LABEL.format(kind)))).otherwise(t))
    return out


def staged_kinds(prefix: str = "_") -> dict[str, Column]:
    """Hits of each kind from :func:`staged`."""
    out: dict[str, Column] = {}
    for i, (kind, _) in enumerate(PATTERNS):
        n = F.coalesce(F.col(f"{prefix}n{i}"), F.lit(0))
        out[kind] = out[kind] + n if kind in out else n
    return out


def kind_counts(hits: Column) -> dict[str, Column]:
    """Hits of each kind from :func:`hit_counts`."""
    out: dict[str, Column] = {}
    for i, (kind, _) in enumerate(PATTERNS):
        out[kind] = out[kind] + hits[f"p{i}"] if kind in out else hits[f"p{i}"]
    return out


def redact_kinds(text: Column) -> Column:
    """The kinds found, distinct and sorted."""
    hits = hit_counts(text)
    counts = kind_counts(hits)
    return F.array_compact(F.array(*[F.when(counts[k] > 0, F.lit(k)) for k in sorted(counts)]))


def day_dates(text: Column) -> Column:
    """Dates with a day in the redacted text. Advisory; never redacted."""
    return F.coalesce(F.regexp_count(redact(text), F.lit(java(DAY_DATE))), F.lit(0))


def redact_email_text(text: Column) -> Column:
    """E-mail patterns first (their anchors stay), then all others."""
    for kind, pattern in EMAIL_PATTERNS:
        text = F.regexp_replace(text, F.lit(java(pattern)), F.lit("$1" + LABEL.format(kind)))
    return redact(text)
