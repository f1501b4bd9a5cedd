"""Files of any kind as text: plain, office, PDF, e-mail; what can't be read is named so."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import Globs
from ..functions.lines import LINE_END, lines
from ..functions.redact import NEEDED_BY_ANY, java, staged, staged_kinds
from ..shipping import ship
from .mail import text_of

MOST_BYTES = 20_000_000
SNIFF_BYTES = 8192
LEGACY = (".doc", ".xls", ".ppt")
#: Members of office archives that hold text.
OFFICE = {".docx": r"word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml", ".xlsx": r"xl/(?:sharedStrings|worksheets/sheet\d+|comments\d*)\.xml", ".pptx": r"ppt/(?:slides/slide\d+|notesSlides/notesSlide\d+)\.xml"}
# What ends a paragraph, cell or row in office files; any tag.
_LINE_END = re.compile(r"</(?:w:p|a:p|si|row|t)>")
_TAG = re.compile(r"<[^>]+>")
#: Markers that skip a line, or the file in whose first lines they stand.
ALLOW_LINE, ALLOW_FILE, ALLOW_FILE_LINES = "quietlake: allow", "quietlake: allow-file", 20
# Shapes of credentials.
SECRET = r"gh[pousr]_[A-Za-z0-9]{30,}|AKIA[0-9A-Z]{16}"


@dataclass(frozen=True)
class Extracted:
    text: str
    unscannable: str | None = None


def _suffix(name: str) -> str:
    return re.sub(r".*/", "", name).lower().rpartition(".")[1] + re.sub(r".*/", "", name).lower().rpartition(".")[2]


def office_text(raw: bytes, suffix: str) -> str:
    """Texts of an office archive's members, one paragraph, cell or row a line."""
    import html

    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for name in sorted(z.namelist()):
            if re.fullmatch(OFFICE[suffix], name):
                xml = z.read(name).decode("utf-8", "replace")
                out += [html.unescape(x) for x in _TAG.sub("", _LINE_END.sub("\n", xml)).splitlines()]
    return "\n".join(x for x in out if x.strip())


def extract(name: str, raw: bytes, most: int = MOST_BYTES) -> Extracted:
    """A file's text by its name and content."""
    if len(raw) > most:
        return Extracted("", f"over {most} bytes")
    suffix = _suffix(name)
    try:
        if suffix in OFFICE:
            return Extracted(office_text(raw, suffix))
        if suffix == ".pdf":
            try:
                from pypdf import PdfReader
            except ImportError:
                return Extracted("", "no PDF reader is installed")
            return Extracted("\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages))
        if suffix == ".eml":
            return Extracted(text_of(raw))
    except Exception as e:  # a broken file must be reported, never passed over
        return Extracted("", f"can't be read: {type(e).__name__}")
    if suffix in LEGACY:
        return Extracted("", f"{suffix} isn't readable")
    if b"\0" in raw[:SNIFF_BYTES]:
        return Extracted("")
    return Extracted(raw.decode("utf-8", "replace"))


def _extractor(most: int):
    ship()

    @F.pandas_udf("text string, unscannable string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, raws in batches:
            got = [extract(n, bytes(r or b""), most) for n, r in zip(names, raws, strict=True)]
            yield pd.DataFrame({"text": [x.text for x in got], "unscannable": [x.unscannable for x in got]})

    return run


def read_files(spark: SparkSession, path: str, ignore: tuple[str, ...] = (), most: int = MOST_BYTES) -> DataFrame:
    """``path, text, unscannable`` of all files below ``path`` that no glob ignores.

    Sizes are checked before contents are read; a file over the limit is listed as unscannable.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.filter(~ignored(F.col("path"), ignore))
    big = files.filter(F.col("length") > most).select("path", F.lit("").alias("text"), F.format_string("over %d bytes", F.lit(most)).alias("unscannable"))
    rest = files.filter(F.col("length") <= most).select("path", _extractor(most)("path", "content").alias("x")).select("path", "x.text", "x.unscannable")
    return rest.unionByName(big)


def ignored(path: Column, globs: tuple[str, ...]) -> Column:
    """Whether a path, or its last part, matches one of the globs; lines that begin with # are comments."""
    g = Globs([x.strip() for x in globs if x.strip() and not x.strip().startswith("#")])
    return g.matches(path) | g.matches(F.element_at(F.split(path, "/"), -1))


def scan_lines(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """``key, line_no, kinds`` of lines with identifiers. Values are never returned.

    A marker on a line skips it; the file marker in the first lines skips the file. Lines without
    anything that any pattern needs are put aside by one test; only the others run through the chain.
    """
    first = F.slice(F.split(F.col(text), LINE_END), 1, ALLOW_FILE_LINES)
    marked = F.when(F.contains(text, F.lit(ALLOW_FILE)), F.exists(first, lambda x: F.contains(x, F.lit(ALLOW_FILE)))).otherwise(F.lit(False))
    rows = lines(texts.filter(~marked), text, key).filter(~F.contains("line", F.lit(ALLOW_LINE)) & F.col("line").rlike(NEEDED_BY_ANY))
    rows = staged(rows, "line")
    n = staged_kinds()
    kinds = F.array_compact(F.array(*[F.when(n[k] > 0, F.lit(k)) for k in sorted(n)]))
    # a column that isn't deterministic keeps the last filter from being pushed into, and repeating, the chain
    found = rows.select(key, "line_no", kinds.alias("kinds"), F.monotonically_increasing_id().alias("_stop"))
    return found.filter((F.size("kinds") > 0) & (F.col("_stop") >= 0)).drop("_stop")


def scan_summary(texts: DataFrame, hits: DataFrame, key: str = "path") -> DataFrame:
    """One row: files, files_with_hits, lines_with_hits, unscannable, blocked."""
    n = texts.agg(F.count(F.lit(1)).alias("files"), F.count("unscannable").alias("unscannable"))
    h = hits.agg(F.count_distinct(key).alias("files_with_hits"), F.count(F.lit(1)).alias("lines_with_hits"))
    return n.crossJoin(h).withColumn("blocked", (F.col("files_with_hits") > 0) | (F.col("unscannable") > 0))


def blocked(files_with_hits: int, unscannable: int, allow_unscannable: bool = False, strict: bool = False) -> bool:
    """Whether a scan's result stops what it was made for. Hits always do; what can't be read does, unless it is allowed and the scan isn't strict."""
    return files_with_hits > 0 or unscannable > 0 and (strict or not allow_unscannable)


def find_secrets(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """``key, line_no, prefix`` of credential shapes; the first four characters only."""
    rows = lines(texts, text, key).filter(F.col("line").rlike(SECRET))
    return rows.select(key, "line_no", F.explode(F.regexp_extract_all("line", F.lit(java(f"({SECRET})")), F.lit(1))).alias("s")).select(key, "line_no", F.left("s", F.lit(4)).alias("prefix"))
