"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

1. language_id: documents without a determined language go, and those of which no language has half; lang becomes the one found.
2. near_duplicates: of each group of documents linked by five-word shingles (Jaccard 0.8 or more), the smallest doc_id stays,
   or one row if all ids are null.
3. decontamination: documents that contain a benchmark item go.
4. secrets: secrets in texts are masked.
5. mixing: sources get copies to target weights.

All stages but the last return the columns of documents. Tables may be empty, and further columns go along to stage 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.decontaminate import decontaminated
from wordloom.llm.language_id import UNDETERMINED, identify_languages, in_training
from wordloom.llm.mixing import mixed
from wordloom.llm.ngram_join import rooted, text_hash
from wordloom.llm.secrets import redacted
from wordloom.llm.shared import columns_of, kept, looked_up

LEAST_SHARE = 0.5
_FOUND = "language found by stage 1"  # column names that tables won't have
_HASH = "hash of the text in stage 2"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs of a determined language that has LEAST_SHARE of the text or more; lang is that language."""
    packed = docs.select(F.struct("*").alias("row"), "text")
    found = identify_languages(packed, docs.where(in_training(F.col("doc_id"))), keep=("row",))
    found = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SHARE))
    return found.select("row.*", F.col("lang_pred").alias(_FOUND)).withColumn("lang", F.col(_FOUND)).select(columns_of(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group linked by five-word shingles at 0.8: of the smallest doc_id, or of a null one if all are null.

    Rows are decided by doc_id and text, so a row never goes for another one that shares its doc_id.
    """
    rows = kept(rooted(docs, shingle=5, threshold=80), "rooted")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("first")
    groups = rows.where("n_shingles > 0").groupBy("root").agg(first, F.count("*").alias("members"))
    groups = groups.where("members > 1").select(F.col("root").alias("of"), F.col("first.doc_id").alias("first_id"), F.col("first.h").alias("first_h"))
    joined = rows.join(looked_up(groups, "groups"), (F.col("root") == F.col("of")) & (F.col("n_shingles") > 0), "left")
    goes = F.col("of").isNotNull() & ~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")))
    # null ids without words are no copies of each other; any other row given twice is
    fates = joined.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(
        F.max(goes).alias("goes"), F.count_if(F.col("doc_id").isNotNull() | (F.col("n_shingles") > 0)).alias("copies")
    )
    fates = kept(fates.where("goes or copies > 1"), "fates")

    def this(of: DataFrame):
        return docs["doc_id"].cast("long").eqNullSafe(of["_id"]) & (text_hash(docs["text"]) == of["_h"])

    gone = looked_up(fates.where("goes").select("_id", "_h"), "gone")
    again = looked_up(fates.where("not goes").select("_id", "_h"), "again")
    left = docs.join(gone, this(gone), "left_anti")
    if again.isEmpty():
        return left.select(columns_of(docs))
    once = left.join(again, this(again), "left_semi").withColumn(_HASH, text_hash(F.col("text"))).dropDuplicates(["doc_id", _HASH])
    return left.join(again, this(again), "left_anti").select(columns_of(docs)).unionByName(once.select(columns_of(docs)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that contain no item of benchmark."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(columns_of(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with secrets masked; n_chars follows the text."""
    out = redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(columns_of(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies): how often the mix takes each document."""
    return mixed(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: Language inference, components of near duplicates and rounding aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
