"""HTML as plain text, so that what tags split reads as one."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

# Elements at whose start and end a line ends (others vanish without a trace), elements that go whole, gaps.
LINE_TAGS = ("p", "div", "br", "tr", "li", "h1", "h2", "h3", "h4", "table", "blockquote")
DROPPED = ("script", "style", "head")

_DROP = re.compile(r"<(script|style|head)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>", re.S)
_LINE = re.compile(rf"</?(?:{'|'.join(LINE_TAGS)})(?=[\s/>])[^>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>")
_GAP = re.compile(r"\n[ \t]*\n(?:[ \t]*\n)+")


def html_to_text(markup: str) -> str:
    text = _DROP.sub("", _COMMENT.sub("", markup))
    text = _TAG.sub("", _LINE.sub("\n", text))
    return _GAP.sub("\n\n", html.unescape(text)).strip() + "\n"


def html_text(markup: Column | str) -> Column:
    """Column form; null stays null. Entities need a table of names that Spark hasn't, so this runs in Python, by Arrow batches."""
    ship()

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda x: None if x is None else html_to_text(x))

    return run(markup)
