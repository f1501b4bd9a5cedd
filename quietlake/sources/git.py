"""Blobs of a git repository as texts: what is staged, what a range of commits brings, or all that is tracked.

The driver asks git for names and sizes; contents are read blob by blob and never more than the size
limit at once, so a history of any length needs little memory beyond the texts themselves.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import MOST_BYTES, extract, ignored


def _git(repo: str | Path, *args: str) -> bytes:
    return subprocess.run(["git", "-C", str(repo), *args], check=True, capture_output=True).stdout


def names(repo: str | Path, what: str) -> Iterator[tuple[str, str]]:
    """Path and object of each blob: ``staged``, ``all`` (tracked in the index), or a range like ``a..b``.

    A range gives each version of a file that one of its commits added or changed, so that what a later
    commit takes out again is seen as well.
    """
    if what in ("staged", "all"):
        listed = _git(repo, "ls-files", "--stage", "-z").decode("utf-8", "replace")
        at = {path: head.split()[1] for head, _, path in (x.partition("\t") for x in listed.split("\0") if x)}
        some = at if what == "all" else [p for p in _git(repo, "diff", "--cached", "--name-only", "--diff-filter=ACMRT", "-z").decode("utf-8", "replace").split("\0") if p]
        yield from ((p, at[p]) for p in some if p in at)
        return
    seen = set()
    for commit in _git(repo, "rev-list", what).decode().split():
        parts = _git(repo, "diff-tree", "-r", "-m", "--root", "--no-commit-id", "--diff-filter=ACMRT", "--no-renames", "-z", commit).decode("utf-8", "replace").split("\0")
        for head, path in zip(parts[::2], parts[1::2], strict=False):
            found = (path, head.split()[3])
            if found not in seen:
                seen.add(found)
                yield found


def read_git(spark: SparkSession, repo: str | Path, what: str, ignore: tuple[str, ...] = (), most: int = MOST_BYTES) -> DataFrame:
    """``path, text, unscannable`` of blobs, as :func:`.blobs.read_files` has of files; a path is followed by its object for a range."""
    rows = []
    for path, blob in names(repo, what):
        size = int(_git(repo, "cat-file", "-s", blob))
        x = extract(path, b"" if size > most else _git(repo, "cat-file", "blob", blob), most)
        why = f"over {most} bytes" if size > most else x.unscannable
        rows.append((path, path if what in ("staged", "all") else f"{path}@{blob[:12]}", x.text, why))
    df = spark.createDataFrame(rows, "name string, path string, text string, unscannable string")
    return df.filter(~ignored(F.col("name"), ignore)).drop("name")
