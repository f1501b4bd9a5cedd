"""A tamper-evident log: each line holds the digest of the line before."""

from __future__ import annotations

import getpass
import hashlib
import json
import os
import socket
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How far back :func:`last_event` looks.
LOOKBACK = 500


def sha256(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


class AuditLog:
    """Append-only JSON lines at ``path``, with copies of each line at ``mirrors``. One writer at a time."""

    def __init__(self, path: str | Path, mirrors: tuple[str | Path, ...] = ()) -> None:
        self.paths = [Path(path), *map(Path, mirrors)]

    def append(self, event: str, **values) -> dict:
        entry = {"ts": time.strftime("%Y-%m-%dT%H:%M:%S%z"), "event": event, "user": getpass.getuser(), "host": socket.gethostname(), **values}
        for path in self.paths:
            last = _last_line(path)
            line = json.dumps({**entry, "prev": sha256(last) if last else ""}, default=str)
            path.parent.mkdir(parents=True, exist_ok=True)
            fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_APPEND, 0o600)
            with os.fdopen(fd, "w") as f:
                f.write(line + "\n")
        return entry

    def verify(self, spark: SparkSession) -> tuple[bool, int | None]:
        """Whether the chain holds, and the first line (from 1) where it doesn't."""
        p = self.paths[0]
        if not p.exists():
            return True, None
        bad = verify_chain(log_lines(spark, str(p))).filter("NOT ok").agg(F.min("line_no")).first()[0]
        return bad is None, bad

    def mirrors_agree(self) -> bool:
        """Whether the last lines of all copies are equal but for their ``prev``."""
        last = []
        for p in self.paths:
            line = _last_line(p)
            last.append({k: v for k, v in json.loads(line).items() if k != "prev"} if line else None)
        return all(x == last[0] for x in last)

    def last_event(self, event: str) -> dict | None:
        p = self.paths[0]
        if not p.exists():
            return None
        for line in reversed(p.read_text().splitlines()[-LOOKBACK:]):
            try:
                entry = json.loads(line)
            except ValueError:
                continue
            if entry.get("event") == event:
                return entry
        return None

    def changed(self, event: str, **digests: str) -> list[str]:
        """Names of control files whose digest differs from the last such event's."""
        before = self.last_event(event)
        return [] if before is None else sorted(k for k, v in digests.items() if k in before and before[k] != v)


def _last_line(path: Path) -> str:
    """The last line without reading the whole file."""
    if not path.exists():
        return ""
    with path.open("rb") as f:
        end, got = f.seek(0, 2), b""
        while end and got.rstrip(b"\n").count(b"\n") < 1:
            step = min(end, 4096)
            end = f.seek(end - step)
            got = f.read(step) + got
            f.seek(end)
    return got.rstrip(b"\n").rsplit(b"\n", 1)[-1].decode()


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, raw, before`` of a log: numbers follow the file, ``before`` is the line before.

    The file is read in splits. Lines are numbered within each, and only a row for each split, its
    number of lines and its last line, is brought together to number them through.
    """
    at = F.col("_metadata.file_block_start")
    rows = spark.read.option("lineSep", "\n").text(path).select(at.alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("raw"))
    own = Window.partitionBy("block").orderBy("id")
    rows = rows.select("block", F.row_number().over(own).alias("n"), "raw", F.lag("raw").over(own).alias("prior"))
    through = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("block").agg(F.max("n").alias("lines"), F.max_by("raw", "n").alias("last"))
    splits = splits.select("block", F.coalesce(F.sum("lines").over(through), F.lit(0)).alias("first"), F.last("last").over(through).alias("carried"))
    return rows.join(F.broadcast(splits), "block").select((F.col("first") + F.col("n")).cast("int").alias("line_no"), "raw", F.when(F.col("n") == 1, F.col("carried")).otherwise(F.col("prior")).alias("before"))


def chained(lines: DataFrame, partition: str | None = None) -> DataFrame:
    """``lines`` with the digest that each must hold: of ``before`` where :func:`log_lines` gave it, else of the line before within ``partition``."""
    if partition is None:
        return lines.withColumn("expected", F.coalesce(F.sha2("before", 256), F.lit("")))
    w = Window.partitionBy(partition).orderBy("line_no")
    return lines.withColumn("expected", F.coalesce(F.sha2(F.lag("raw").over(w), 256), F.lit("")))


def verify_chain(lines: DataFrame, partition: str | None = None) -> DataFrame:
    """``lines`` with ``ok``: the line is JSON and its ``prev`` is the digest of the line before.

    ``partition`` names a column that keeps several logs apart; each is one ordered chain.
    """
    prev = F.get_json_object("raw", "$.prev")
    return chained(lines, partition).withColumn("ok", F.coalesce(prev == F.col("expected"), F.lit(False))).drop("expected")


def log_view(lines: DataFrame, most: int = 40) -> DataFrame:
    """The last lines as columns."""
    get = lambda k: F.get_json_object("raw", f"$.{k}").alias(k)
    return lines.orderBy(F.desc("line_no")).limit(most).select("line_no", *[get(k) for k in ("ts", "event", "verdict", "user", "host", "sql_sha256")])
