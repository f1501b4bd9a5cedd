"""Adapters by name: where a broker's relations come from."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_adapters: dict[str, Callable[..., None]] = {}

#: What a URL has that was never filled in: "<host>", "your-host", or a host of the documentation domains alone.
PLACEHOLDER = re.compile(r"<[^>]*>|\{[^}]*\}|://(?:your|my)[-_]|://(?:[^/@]*@)?(?:[\w-]+\.)?example(?:\.(?:com|org|net))?(?=[:/]|$)", re.I)
FORMATS = ("parquet", "orc", "csv", "json", "text", "avro")


def register(name: str, adapter: Callable[..., None]) -> None:
    """``adapter(spark, **options)`` makes relations visible in the session's catalog."""
    _adapters[name] = adapter


def adapter(name: str) -> Callable[..., None]:
    if name not in _adapters:
        raise KeyError(f"no adapter {name!r}; there are {sorted(_adapters)}")
    return _adapters[name]


def files(spark: SparkSession, path: str, tables: tuple[str, ...], format: str = "parquet", suffix: str = ".parquet", **options: str) -> None:
    """Temporary views over files ``path/table + suffix``."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}")
    for t in tables:
        read(spark, f"{path}/{t}{suffix}", format, **options).createOrReplaceTempView(t)


def read(spark: SparkSession, path: str, format: str = "parquet", **options: str) -> DataFrame:
    return spark.read.format(format).options(**options).load(path)


def jdbc(spark: SparkSession, url: str, tables: dict[str, str], **options: str) -> None:
    """Views over tables of a database; Spark pushes filters and columns down to it."""
    if PLACEHOLDER.search(url):
        raise ValueError("the URL is a placeholder")
    for view, table in tables.items():
        spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().createOrReplaceTempView(view)


register("files", files)
register("jdbc", jdbc)
