"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: No document is used more often.
MOST_REPEATS = 3
#: Hash buckets of one histogram; the second refines the boundary bucket of the first.
BUCKETS = 1024
#: Words are runs of anything but \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
#: The plan, one row a source, is sent to all executors up to so many rows; beyond, a join shuffles both sides and splits hot sources at run time.
BROADCAST_ROWS = 200_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_bits(doc_id: Column, text: Column) -> Column:
    """20 bits of a digest of the id; a null id uses the text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit(""))), 1, 5), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Water-filling in closed form:
    with sources ordered by cap / weight, a source is capped if its share of what the sources
    before it leave exceeds its cap. Works on one row a source.
    """
    k = F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last()))
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), (((k - 1) % len(WEIGHTS)) + 1).cast("int")))
    w = w.withColumn("cap", F.lit(float(MOST_REPEATS)) * F.col("source_size"))
    total = F.sum("source_size").over(Window.partitionBy())
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    w = w.withColumn("level", left / weights).withColumn("capped", F.col("level") * F.col("weight") > F.col("cap"))
    # the first source that isn't capped sets the level of all after it
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(Window.partitionBy())["level"]
    w = w.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight"))))
    return w.select("source", "source_size", "weight", "target")


def sizes_of(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, hi, lo`` of each row, stored."""
    bits = hash_bits(F.col("doc_id"), F.col("text"))
    return common.stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.floor(bits / BUCKETS).alias("hi"), (bits % BUCKETS).alias("lo")), "mix-sizes")


def cuts(rows: DataFrame) -> DataFrame:
    """One row a source of :func:`sizes_of`, stored: ``s, source_size, target, q, edge, cut``.

    A source's documents are taken q times, and those before bucket ``edge``, or in it and before
    ``cut`` of its refinement, once more.
    """
    hist = rows.groupBy("source", "hi").agg(F.sum("size").alias("words"))
    goal = targets(hist.groupBy("source").agg(F.sum("words").alias("source_size")))
    goal = goal.withColumn("q", F.least(F.lit(MOST_REPEATS), F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("q") * F.col("source_size")))
    goal = common.stored(goal.withColumn("q", F.when(F.col("source_size") == 0, 0).otherwise(F.col("q"))), "mix-targets")
    # the boundary bucket: the first whose running total passes the rest
    step = Window.partitionBy("source")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    run = F.sum("words").over(step.orderBy("hi").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = hist.withColumn("run", run)
    edge = goal.join(first, same(goal, first) & (first["run"] > goal["rest"]), "left")
    edge = edge.groupBy(goal["source"], "source_size", "target", "q", "rest").agg(F.min(F.struct("hi", (F.col("run") - F.col("words")).alias("under"))).alias("e")).select(F.col("source").alias("s"), "source_size", "target", "q", "rest", F.coalesce("e.hi", F.lit(BUCKETS)).alias("edge"), F.coalesce("e.under", F.lit(0)).alias("under"))
    edge = common.stored(edge, "mix-edge")
    inner = rows.join(common.bounded(edge, BROADCAST_ROWS), rows["source"].eqNullSafe(edge["s"]) & (rows["hi"] == edge["edge"])).groupBy("s", "lo", "under", "rest").agg(F.sum("size").alias("words"))
    inner = inner.withColumn("run", F.col("under") + F.sum("words").over(Window.partitionBy("s").orderBy("lo").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    near = (F.col("run") <= F.col("rest")) | (F.col("run") - F.col("rest") < F.col("rest") - (F.col("run") - F.col("words")))
    cut = inner.filter(near).groupBy("s").agg((F.max("lo") + 1).alias("cut")).withColumnRenamed("s", "c")
    plan = edge.join(cut, edge["s"].eqNullSafe(cut["c"]), "left").select("s", "source_size", "target", "q", "edge", F.coalesce("cut", F.lit(0)).alias("cut"))
    return common.stored(plan, "mix-plan")


def copies(some: Column) -> Column:
    """How often a row with ``hi`` and ``lo`` is taken by the plan joined to it; ``some``: whether it has words."""
    more = (F.col("hi") < F.col("edge")) | ((F.col("hi") == F.col("edge")) & (F.col("lo") < F.col("cut")))
    n = F.least(F.lit(MOST_REPEATS), F.col("q") + F.when(more, 1).otherwise(0))
    return F.when(some, n).otherwise(0).cast("int")


def mix_plan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, source, text)``: doc_id, source, size, source_size, target, copies, taken.

    A source whose target is q whole sizes and a rest takes every document q times, and once
    more those whose hash lies under a threshold. The threshold comes from a histogram of words
    by source and hash bucket; only the bucket where the rest is reached is refined, by a second
    histogram over the next bits, and its last step is taken if that ends nearer the target. No
    rows are sorted and nothing is sampled, so reruns agree. Null text has size 0 and is taken 0
    times; equal rows are treated alike; null sources are one source. Other columns aren't read.
    An empty table gives no rows.
    """
    rows = sizes_of(docs)
    plan = cuts(rows)
    out = rows.join(common.bounded(plan, BROADCAST_ROWS), rows["source"].eqNullSafe(plan["s"]))
    return out.withColumn("copies", copies(F.col("size") > 0)).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, all columns. Nulls and empty tables as in :func:`mix_plan`."""
    plan = cuts(sizes_of(docs)).select("s", "edge", "cut", "q")
    bits = hash_bits(F.col("doc_id"), F.col("text"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("of"), F.floor(bits / BUCKETS).alias("hi"), (bits % BUCKETS).alias("lo"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("some"))
    held = held.join(common.bounded(plan, BROADCAST_ROWS), held["of"].eqNullSafe(plan["s"])).select("row", copies(F.col("some")).alias("copies")).filter("copies > 0")
    return held.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 5))::BIGINT AS bits
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS sz, row_number() OVER (ORDER BY source::BLOB NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, ((k - 1) % 3 + 1)::DOUBLE AS wt, 3.0 * sz AS cap, sum(sz) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / wt, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(wt) OVER (ORDER BY cap / wt, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, sz, CASE WHEN lev * wt > cap THEN cap ELSE least(cap, wt * (SELECT arg_min(lev, cap / wt) FROM l WHERE NOT lev * wt > cap)) END AS target FROM l),
q AS (SELECT *, CASE WHEN sz = 0 THEN 0 ELSE least(3, floor(target / greatest(sz, 1))) END AS q FROM t),
r AS (SELECT *, greatest(0, target - q * sz) AS rest FROM q),
g AS (SELECT source, bits, sum(size) AS n FROM d GROUP BY ALL),
-- the running total of words by hash; the last step is taken if it ends nearer the rest
c AS (SELECT g.source, g.bits, sum(g.n) OVER (PARTITION BY g.source ORDER BY g.bits) AS run, g.n, rest FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source),
b AS (SELECT source, max(bits) AS last FROM c WHERE run <= rest OR run - rest < rest - (run - n) GROUP BY source)
SELECT d.doc_id, d.size, r.sz::BIGINT AS source_size, r.target,
       (d.size * least(3, r.q + CASE WHEN b.last IS NOT NULL AND d.bits <= b.last THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN b ON b.source IS NOT DISTINCT FROM d.source
"""
