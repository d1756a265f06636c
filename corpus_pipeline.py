"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``docs``.
"""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from tessel.llm.staging import scope, stage


def _keyed(docs: DataFrame) -> DataFrame:
    """Add ``__key``, the id and a hash of the text: rows that share it are repeats of one row."""
    return docs.withColumn("__key", F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents whose toxicity score is 0.5 or more."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.annotate(docs, model, score="__score", spans="__spans")
    return scored.where(F.col("__score") < 0.5).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines out that ten or more documents have; the documents stay."""
    out = line_dedup.drop_frequent_lines(docs, min_docs=10).withColumn("text", F.col("kept"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, repeated rows included, one document stays: the one with the least id."""
    keyed = _keyed(docs)
    kept = near_dedup.link_near_copies(keyed.select("__key", "text"), percent=80, row_id="__key").where("kept").select("__key").distinct()
    kept = kept.select(F.col("__key.doc_id").alias("__id"), F.col("__key.hash").alias("__hash"))
    same = F.col("__key.doc_id").eqNullSafe(F.col("__id")) & (F.col("__key.hash") == F.col("__hash"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["__key"]).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that hold a benchmark item."""
    items = decontaminate.split_item(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    keyed = _keyed(docs)
    leaks = stage(decontaminate.find_leaks(keyed.select("__key", "text"), items, row_id="__key"), "leaks")
    leaks = leaks.select(F.col("__key.doc_id").alias("__id"), F.col("__key.hash").alias("__hash")).distinct()
    same = F.col("__key.doc_id").eqNullSafe(F.col("__id")) & (F.col("__key.hash") == F.col("__hash"))
    return keyed.join(leaks, same, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack(packing.token_pieces(docs, path("byte_bpe_50k.json"), most=1024), tokens=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Training, similarity and packing are beyond SQL; the tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what a stage wrote for itself or the next one is deleted when that is done."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, step in STAGES:
        with scope() as made:
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
            made.remove(docs)
            made += old
            old = [docs]
    return docs
