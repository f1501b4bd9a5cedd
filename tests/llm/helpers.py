"""Small tables with every awkward case."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])

#: Columns whose names clash with those that operators use inside.
CLASHING = ("row", "text_", "part", "n", "node", "keys", "size", "score", "spans", "n_hit", "lang_pred", "bits_per_byte", "comp", "digest", "copies", "_row", "_copies")


def awkward(extra=()):
    """Nulls, empty and blank texts, one very long text, ties and repeated rows."""
    long = " ".join(f"word{i % 9001}" for i in range(60_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n\x0b", "en", "a"), (4, long, "en", "b"), (5, "one two", "en", "b"), (6, "one two", "en", None), (5, "one two", "en", "b"), (None, "a row without an id and some words", "fr", "a"), (7, "été à la plage, l'été dernier encore une fois", "fr", "c")]
    return rows + [(i, t, "en", "a") for i, t in extra]


def frame(spark, rows, clash=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    if clash:
        df = df.withColumns({c: F.lit(c) for c in CLASHING})
    return df
