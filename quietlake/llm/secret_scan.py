"""Secret scans: fixed shapes, and sliding-window Shannon entropy by character class.

The base kinds are regular expressions. The method looks at candidate strings (long runs of
characters that keys are made of), slides a window over each with counts that are updated by
one character in and one out, and reports the stretch whose entropy passes the threshold of its
character class, unless an allow-list suppresses it. Candidates are judged whole and, so that a
name, path or other key glued to a key doesn't hide it, by their parts as well.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: Fixed patterns of the base kinds, in the order of their listing.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "entropy")

#: Long enough runs of hex digits; as runs are maximal, the same as HEX matches of that length.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

WINDOW = 20
#: Characters that candidates are made of, and the least entropy in bits a character of a window, by class.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
HEX_CLASS = re.compile(r"[0-9a-fA-F]+")
THRESHOLDS = {"hex": 3.0, "mixed": 3.7, "lower": 3.5, "upper": 3.5}
#: Candidates that aren't secrets: identifiers of digits only, repeated units, UUIDs, paths and dated names.
ALLOW = (re.compile(r"[0-9]+"), re.compile(r"(.{1,8}?)\1+.{0,8}", re.S), re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"), re.compile(r"(?:[A-Za-z]+[/_=-]+)+[A-Za-z]*[0-9]{0,4}"))

#: Parts of a candidate, and their parts: what stands between '=', '/' and '+', and unbroken letters and digits.
PART, UNBROKEN = re.compile(r"[A-Za-z0-9_-]{20,}"), re.compile(r"[A-Za-z0-9]{20,}")
#: Not looked at within a candidate.
UUID = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9])")
#: Parts that aren't secrets, besides: words and numbers, words with a number after or a number with an ending (mp3, 10th).
NAMES = re.compile(r"[_-]*(?:[A-Za-z]+[0-9]{0,4}|[0-9]+[A-Za-z]{0,2})(?:[_-]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]+[A-Za-z]{0,2}))*[_-]*")

_LOG = [0.0, *(i * math.log2(i) for i in range(1, WINDOW + 1))]


def dense(s: str, threshold: float, window: int = WINDOW) -> tuple[int, int] | None:
    """First and last index (exclusive) covered by windows whose entropy reaches the threshold."""
    counts: dict[str, int] = {}
    total, first, last = 0.0, None, None
    full = window * (math.log2(window) - threshold)  # sum of c log c may be that large
    for i, c in enumerate(s):
        if i >= window:
            out = s[i - window]
            n = counts[out]
            counts[out] = n - 1
            total += _LOG[n - 1] - _LOG[n]
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _LOG[n + 1] - _LOG[n]
        if i >= window - 1 and total <= full + 1e-9:
            first, last = (i - window + 1 if first is None else first), i + 1
    return None if first is None else (first, last)


def char_class(s: str) -> str | None:
    """hex: hex digits in one case with both letters and digits; mixed: lower, upper and 2 digits or more; lower, upper: letters of that case alone and 2 digits or more; else none."""
    if HEX_CLASS.fullmatch(s):
        letters = re.sub("[0-9]", "", s)
        if not letters or len(letters) == len(s):
            return None
        if letters.islower() or letters.isupper():
            return "hex"
    if len(re.findall("[0-9]", s)) < 2:
        return None
    lower, upper = re.search("[a-z]", s), re.search("[A-Z]", s)
    return "mixed" if lower and upper else "lower" if lower else "upper" if upper else None


def _parts(s: str) -> list[tuple[int, str]]:
    """Places and texts of what is judged besides the whole candidate."""
    out = []
    for m in PART.finditer(UUID.sub(lambda u: "=" * len(u[0]), s)):
        out.append((m.start(), m[0]))
        out += [(m.start() + x.start(), x[0]) for x in UNBROKEN.finditer(m[0]) if len(x[0]) < len(m[0])]
    return out


def entropy_spans(text: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if not re.search("[0-9]", s):
            continue
        found = []
        if (kind := char_class(s)) in ("hex", "mixed") and not any(a.fullmatch(s) for a in ALLOW) and (d := dense(s, THRESHOLDS[kind])):
            found.append((m.start() + d[0], m.start() + d[1]))
        for i, x in _parts(s):  # windows of the mixed class are the whole candidate's
            if (kind := char_class(x)) in ("hex", "lower", "upper") and not any(a.fullmatch(x) for a in (ALLOW if kind == "hex" else (*ALLOW, NAMES))) and (d := dense(x, THRESHOLDS[kind])):
                found.append((m.start() + i + d[0], m.start() + i + d[1]))
        first = len(out)
        for a, b in sorted(found):
            if len(out) > first and a < out[-1][1]:
                out[-1] = out[-1][0], max(out[-1][1], b)
            else:
                out.append((a, b))
    return out


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base kinds, in order."""
    raw = text.encode("utf-8", "replace") if raw is None else raw
    out = []
    if _keyword(raw):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(raw: bytes) -> tuple[int, int, int, str, str]:
    """n_assign, n_access, n_hex, base_sha256, spans of a text in UTF-8."""
    run = _RUN.search(raw)
    if not run and not _keyword(raw):
        return 0, 0, 0, _NONE, ""
    text = raw.decode("utf-8", "replace")
    base = base_spans(text, raw)
    taken = [(a, b) for a, _, b in base]
    more = [(a, 3, b) for a, b in entropy_spans(text) if not any(x <= a and b <= y for x, y in taken)] if run else []
    n = [sum(k == i for _, k, _ in base) for i in range(3)]
    digest = hashlib.sha256(joined(base).encode()).hexdigest() if base else _NONE
    return *n, digest, joined(sorted(base + more))


def _keyword(raw: bytes) -> bool:
    low = raw.translate(common.LOWER)
    return any(x in low for x in (b"passw", b"secret", b"token", b"api"))


_NONE = hashlib.sha256(b"").hexdigest()
#: A digit within or at the edge of a run of 16 or more: every access key, hex run and candidate of a class has one,
#: except access keys and hex runs of letters alone, which the other two branches find.
_RUN = re.compile(rb"[0-9][A-Za-z0-9+/_=-]{9}|[A-Za-z0-9+/_=-]{9}[0-9]|AKIA|[a-f]{16}")

NEW = [T.StructField("n_assign", T.LongType(), False), T.StructField("n_access", T.LongType(), False), T.StructField("n_hex", T.LongType(), False), T.StructField("base_sha256", T.StringType(), False), T.StructField("spans", T.StringType(), False)]


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with n_assign, n_access, n_hex, base_sha256 and spans.

    Offsets are code points of the whole text, end exclusive; a span of an assignment is its
    whole match. Null and empty texts have none. Spans of the method that lie within a base span
    are left out. Repeated rows give equal results; other columns aren't read; an empty table
    gives no rows.
    """

    def make():
        def work(_: pa.RecordBatch, texts: list[bytes]) -> list:
            return [list(x) for x in zip(*map(scan, texts), strict=True)]

        return work

    return common.map_text(docs.select("doc_id", "text"), "text", make, NEW).drop("text")
