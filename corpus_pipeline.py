"""Documents to training tokens: language, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each result as
Parquet into the shared folder and reads it again for the next. All stages take an empty table
and give one, read texts of any length whole, and, but for the last, return all columns of their
input, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quietlake.llm import common, decontam, langid, mixing, near_dup, token_output


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts that no learned language codes shorter than they are.

    Learns from the rows with a text and a lang. Null, empty and blank texts are dropped; a null id,
    lang or source is no reason to drop a row; rows of equal text are judged alike; of languages
    that code a text equally short the first by name counts. Where no row has a lang, all are dropped.
    """
    return langid.accepted(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays.

    Rows without an id stay, and link no others. Texts without words are like no other. Repeated rows
    of the id that stays all stay: an id, not a row, is what a group keeps. Other columns may be null.
    """
    return near_dup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark.

    Null and empty texts have none and stay; null and empty items, and an empty benchmark, drop
    nothing; an item without an id counts like any other. Rows of equal text go together. Other
    columns may be null.
    """
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null, empty and blank texts have no words and are taken 0 times. Null sources are one source, the
    last in order. Rows without an id are dealt by their text. Rows of one id share a hash, and are
    taken equally often. The only document of a source may be taken up to three times.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and per document its place in them.

    Rows without an id come first; rows of one id are ordered by text, and repeated rows are written
    as often as they come. A null or empty text is the end id alone.
    """
    return token_output.token_output(docs)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mix), ("token_output", tokens)]

#: Language, similarity components and token ids aren't expressible in SQL together; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage made on its way goes when its result is stored, its input when the next one is."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with common.Scratch(spark) as scratch:
            docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        scratch.clear()
        common.drop(before)
        before = docs
    return docs
