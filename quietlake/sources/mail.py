"""E-mail messages: their text for scanning, and a copy with everything sensitive taken out."""

from __future__ import annotations

import email
import email.policy
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from email.message import EmailMessage
from email.utils import getaddresses

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.flatten import html_to_text
from ..functions.redact import EMAIL_PATTERNS, LABEL, PATTERNS
from ..shipping import ship

# Headers with addresses, which stay as domains alone; all headers that stay.
ADDRESSES = ("from", "to", "cc", "reply-to", "sender")
KEPT = (*ADDRESSES, "subject", "date")

#: A line without any of these has no hit of the general patterns.
_NEEDED = re.compile(r"\d|@|gh[pousr]_|dapi|lin_api_|token|secret|api|pass|\bpat\b|bearer", re.I)
_PLAIN = [(k, re.compile(p)) for k, p in PATTERNS]
_MAIL = [(k, re.compile(p)) for k, p in EMAIL_PATTERNS]


@dataclass
class MailReport:
    identifiers: Counter = field(default_factory=Counter)
    dropped_parts: list[str] = field(default_factory=list)
    dropped_headers: Counter = field(default_factory=Counter)

    @property
    def clean(self) -> bool:
        return not self.identifiers and not self.dropped_parts


def redact_text(text: str, report: MailReport) -> str:
    """The e-mail patterns, then the general ones line by line."""
    for kind, p in _MAIL:
        text, n = p.subn(lambda m, k=kind: m[1] + LABEL.format(k), text)
        report.identifiers[kind] += n
    return redact_lines(text, report)


def redact_lines(text: str, report: MailReport) -> str:
    """The general patterns, line by line."""
    out = []
    for line in text.splitlines(keepends=True):
        for kind, p in _PLAIN if _NEEDED.search(line) else ():
            line, n = p.subn(LABEL.format(kind), line)
            report.identifiers[kind] += n
        out.append(line)
    report.identifiers += Counter()
    return "".join(out)


def decoded(part: EmailMessage) -> str:
    """A text part's text, HTML flattened; an unknown charset is read as UTF-8."""
    try:
        text = part.get_content()
    except (LookupError, UnicodeError, AssertionError, KeyError):
        text = (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
    return html_to_text(text) if part.get_content_subtype() == "html" else text


def _parse(raw: bytes) -> EmailMessage:
    return email.message_from_bytes(raw, policy=email.policy.default)


def _parts(message: EmailMessage) -> list[EmailMessage]:
    if not message.is_multipart():
        return []
    got = message.get_payload()
    return [p for p in got if isinstance(p, EmailMessage)]


def scrub(raw: bytes) -> tuple[bytes, MailReport]:
    """The message with headers by allow-list, texts redacted, and all other parts replaced by a note."""
    report = MailReport()
    return _cleaned(_parse(raw), report, nested=False).as_bytes(), report


def _cleaned(part: EmailMessage, report: MailReport, nested: bool) -> EmailMessage:
    out = EmailMessage(policy=email.policy.default)
    own = not nested or part.get("from") is not None or part.get("subject") is not None
    for name, value in part.items() if own else []:
        low = name.lower()
        if low in ADDRESSES:
            found = [a for _, a in getaddresses([str(value)]) if a]
            report.identifiers["EMAIL_ADDRESS"] += sum("@" in a for a in found)
            domains = [a.rpartition("@")[2] for a in found] or [""]
            safe = ", ".join(f"REDACTED <redacted@{re.sub(r'[^A-Za-z0-9.-]', '', d) or 'invalid'}>" for d in domains)
            if low not in out:
                out[name] = safe
        elif low == "subject":
            if low not in out:
                out[name] = " ".join(redact_text(str(value), report).split())
        elif low == "date":
            if low not in out:
                out[name] = str(value)
        elif not low.startswith("content-") and low != "mime-version":
            report.dropped_headers[low] += 1
    kind = part.get_content_type()
    if kind == "message/rfc822":
        inner = _parts(part)
        out.add_attachment(_cleaned(inner[0], report, nested=True)) if inner else out.set_content("")
        return out
    if part.is_multipart():
        out.set_content("")
        out.clear_content()
        out.make_mixed()
        for p in _parts(part):
            out.attach(_cleaned(p, report, nested=True))
        if part.get_content_subtype() == "alternative":
            out.replace_header("content-type", "multipart/alternative")
        return out
    if part.get_content_maintype() == "text":
        out.set_content(redact_text(decoded(part), report))
        return out
    size = len(part.get_payload(decode=True) or b"")
    report.dropped_parts.append(f"{kind}, {size} bytes")
    out.set_content(f"[{kind} part removed ({size} bytes) - not scrubbable]\n")
    return out


def text_of(raw: bytes) -> str:
    """Decoded headers and texts of all parts, for scanning."""
    lines: list[str] = []

    def visit(part: EmailMessage) -> None:
        lines.extend(f"{k}: {v}" for k, v in part.items())
        if part.is_multipart():
            lines.append(part.preamble or "")
            for p in _parts(part):
                visit(p)
            lines.append(part.epilogue or "")
        elif part.get_content_maintype() == "text":
            lines.append(decoded(part))

    visit(_parse(raw))
    return "\n".join(lines)


SCRUBBED = T.StructType([T.StructField("message", T.BinaryType()), T.StructField("identifiers", T.MapType(T.StringType(), T.LongType())), T.StructField("dropped_parts", T.ArrayType(T.StringType())), T.StructField("dropped_headers", T.MapType(T.StringType(), T.LongType()))])


def scrub_mail(raw: Column | str) -> Column:
    """Column form of :func:`scrub`, for raw messages; null is an empty message."""
    ship()

    @F.pandas_udf(SCRUBBED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x in b:
                message, r = scrub(bytes(x or b""))
                rows.append({"message": message, "identifiers": dict(r.identifiers), "dropped_parts": r.dropped_parts, "dropped_headers": dict(r.dropped_headers)})
            yield pd.DataFrame(rows, columns=SCRUBBED.names)

    return run(raw)


def mail_text(raw: Column | str) -> Column:
    """Column form of :func:`text_of`."""
    ship()

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda x: None if x is None else text_of(bytes(x)))

    return run(raw)
