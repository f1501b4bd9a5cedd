"""The queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontam, exact_dedup, html_text, langid, mixing, near_dup, secret_scan, token_output, toxicity, url_filter


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(common.table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(common.table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = F.coalesce(langid.crc_class(4) == 2, F.lit(False))
    known = F.col("doc_id").isNotNull()
    found = langid.identify(docs, langid.train(docs.filter(known & ~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(common.table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = common.table(spark, sf_dir, "documents"), F.coalesce(langid.crc_class(5) == 0, F.lit(False))
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels").filter(~held))
    return toxicity.score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(common.table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(common.table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(common.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_output, op2_html_text, op3_decontamination, op4_language_id, op5_url_filter, op6_mixing, op7_toxicity, op8_ngram_jaccard, op9_exact_dedup, op10_secret_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": decontam.SQL, "op5_url_filter": url_filter.sql(), "op6_mixing": mixing.SQL, "op8_ngram_jaccard": near_dup.SQL, "op9_exact_dedup": exact_dedup.SQL}
