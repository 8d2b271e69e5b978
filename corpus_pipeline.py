"""Corpus preparation in stages, each one of the training-data operators.

Every stage takes what its predecessor kept.  The first four return the columns of documents; the
last returns packed pieces.  A stage carries every column of its input that it is given, whatever
its name; repeated rows stay repeated unless a stage's decision is about copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscope.llm import contamination, language, packing, secret_scan, simhash
from wardscope.llm.common import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document whose most likely language gets less than this (four languages at par have 0.25) is rejected.
LEAST_LANGUAGE_SCORE = 0.3


def keep_known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a letter and a language that the network stands by.  Null texts go."""
    found = language.identify(docs, keep=docs.columns, prefix="_op10_")
    kept = found.filter((F.col("_op10_lang_pred") != language.UNDETERMINED) & (F.col("_op10_score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*docs.columns)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document of smallest id of each group of near copies; of equal rows, one."""
    mark = F.xxhash64("text").alias("_op3_mark")
    groups = simhash.near_duplicates(docs.select("doc_id", "text", mark), keep=["doc_id", "_op3_mark"])
    # the mark tells rows of one id apart; how many equal rows there are is counted with it
    rows = groups.groupBy("root", "doc_id", "_op3_mark").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.struct("doc_id", "_op3_mark", "n")).alias("k")
    one = cut_lineage(rows.groupBy("root").agg(least).select(F.col("k.doc_id").alias("_op3_id"), F.col("k._op3_mark").alias("_op3_first"), "k.n"))
    same = F.col("doc_id").eqNullSafe(F.col("_op3_id")) & (F.xxhash64("text") == F.col("_op3_first"))
    kept = docs.join(one, same, "left_semi")
    return kept if one.filter("n > 1").isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in which no benchmark passage was found."""
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("_op6_mark"))
    found = contamination.contaminated(marked, spark.read.parquet(f"{folder}/benchmark.parquet"), keep=["doc_id", "_op6_mark"])
    hit = cut_lineage(found.select(F.col("doc_id").alias("_op6_id"), "_op6_mark").distinct())
    same = F.col("doc_id").eqNullSafe(F.col("_op6_id")) & (F.xxhash64("text") == F.col("_op6_mark"))
    return docs.join(hit, same, "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents; secrets in texts, encoded ones too, are replaced, and n_chars follows."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", keep_known_language),
    ("near_duplicates", keep_one_of_group),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Trained models, XXH64, reachability and tokens are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over documents; each is written once and read again by the next."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
