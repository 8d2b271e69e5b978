"""One registered query per training-data operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscope.llm import alignment, contamination, language, main_text, packing, passages, phrases, quality, repeats, secret_scan, simhash, token_files, topk
from wardscope.llm.common import documents, held_out


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality.classify(documents(spark, folder), _table(spark, folder, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.tokenize_to_files(documents(spark, folder))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder))


def op5_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_table(spark, folder, "embeddings"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.contaminated(documents(spark, folder), _table(spark, folder, "benchmark"))


def op7_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, folder))


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.find_secrets(documents(spark, folder))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.without_repeats(documents(spark, folder)).drop("kept")


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    found = language.identify(documents(spark, folder))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_tokenizers(documents(spark, folder), digest=True)


def op12_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = main_text.extract_main_text(_table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(documents(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_files": op2_token_files,
    "op3_simhash": op3_simhash,
    "op4_packing": op4_packing,
    "op5_topk": op5_topk,
    "op6_decontamination": op6_decontamination,
    "op7_passages": op7_passages,
    "op8_secrets": op8_secrets,
    "op9_repeats": op9_repeats,
    "op10_language": op10_language,
    "op11_alignment": op11_alignment,
    "op12_main_text": op12_main_text,
    "op13_phrases": op13_phrases,
}

#: The other contracts are not plain SQL: tokens, XXH64, reachability, models and decoding are not in DuckDB.
ORACLES: dict[str, str] = {"op5_topk": topk.ORACLE, "op13_phrases": phrases.ORACLE}
