"""Exact deduplication against a persistent digest index, with DataFrame functions only.

The index is a Parquet table bucketed and sorted by digest. New data is reduced to one row a
digest before anything is joined (so a text that a third of the rows share costs one row for
each task), compared with the index by a sort-merge anti-join that needs no shuffle of the
index, and what is new is appended. Rows then find their group among the batch's own groups: the
few largest groups are sent to all executors, all others are joined by sort-merge.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: White space that doesn't count: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
#: Groups of more than a HOT_GROUPS-th of the rows, and more than HOT_LEAST, are sent to all executors: HOT_GROUPS of about 50 bytes at most.
HOT_GROUPS, HOT_LEAST = 20_000, 50


def normal(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def digest(text: Column) -> Column:
    """SHA-256 of the text without white space, as 32 bytes."""
    return F.unhex(F.sha2(normal(text), 256))


class DigestIndex:
    """Digests seen so far, at ``path``: one row each with the row that stays and the group's size in the batch that brought it."""

    COLUMNS = "digest binary, keep_id long, group_size long"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        """Open the index at ``path``, or create an empty one. ``buckets`` must be the same each time."""
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:24]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({self.COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def new_rows(self, groups: DataFrame) -> DataFrame:
        """Of ``groups`` (one row a digest) those that the index hasn't."""
        return groups.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")

    def known_rows(self, groups: DataFrame) -> DataFrame:
        """Of ``groups`` those that the index has, with the id that it recorded."""
        return groups.drop("keep_id").hint("merge").join(self.rows().select("digest", "keep_id"), "digest").select(*groups.columns)

    def append(self, groups: DataFrame) -> DataFrame:
        """Append the groups whose digest is new; returns all of ``groups`` with the ids that stay, stored before the index is written, so a retry can't read its own output."""
        flagged = self.new_rows(groups).withColumn("new", F.lit(True)).unionByName(self.known_rows(groups).withColumn("new", F.lit(False)))
        judged = common.stored(flagged, "digests")
        new = judged.filter("new").select("digest", "keep_id", "group_size")
        new.repartition(self.buckets, "digest").write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").saveAsTable(self.name)
        return judged.drop("new")

    def close(self, delete: bool = False) -> None:
        """Take the index out of the session's catalog; its files stay unless they are to be deleted."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if delete:
            common.delete(self.spark, self.path)


def groups_of(rows: DataFrame) -> DataFrame:
    """One row a digest of ``rows(doc_id, digest, n_points)``: most code points, then smallest id, stays.

    A null id loses against any other.
    """
    best = F.min(F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select("digest", F.col("best.c").alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, index_path: str | None = None) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts are one group. Of repeated rows with one doc_id and
    equal text all show ``kept`` if that id stays. Other columns are not read. An empty table
    gives no rows. With ``index_path`` the digests are appended to that index, and groups that it
    already had keep the id that it recorded; ``group_size`` counts the rows of ``docs``. Without,
    an empty index is made and taken away again.
    """
    spark = docs.sparkSession
    index = DigestIndex(spark, index_path or common.fresh_path(spark, "digest-index"))
    text = F.coalesce("text", F.lit(""))
    rows = common.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"), F.char_length(text).cast("long").alias("n_points")), "digest-rows")
    groups = index.append(common.stored(groups_of(rows), "digest-groups"))
    index.close(delete=index_path is None)
    # no more than HOT_GROUPS groups can have more rows than this
    large = F.col("group_size") > max(HOT_LEAST, rows.count() // HOT_GROUPS)
    hot, rest = groups.filter(large), groups.filter(~large)
    each = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest.hint("merge"), "digest").unionByName(rows.join(F.broadcast(hot), "digest"))
    return each.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS txt,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(txt) DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id) AS kept, text_sha256 FROM k
"""
