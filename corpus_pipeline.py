"""From raw documents to packed sequences: toxicity, quality rules, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and its result is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Extra columns of docs stay until packing. Nulls are as in the
operators: a null text is empty; a row with a null doc_id is kept by the stages that keep its text. Of near duplicates exactly
one row stays, so that a row with a null doc_id stays only where the whole group has none, and rows whose texts differ stay even
if they repeat a doc_id.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm import packing, pii, quality_rules, simhash, toxicity
from vicinal.llm.common import crc_mod, shared_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; learned from the labels of rows whose crc32(doc_id as text) mod 3 is not 1."""
    terms, weights = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod(3) != 1)
    return toxicity.toxicity(docs, terms, weights).where("predicted = 0").select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_rules(docs).where("kept").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: that with the smallest doc_id, a null one last, and then by a hash of the row."""
    row = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    keyed = docs.withColumn("_row", row)
    found = simhash.near_duplicates(keyed.select("doc_id", "text", "_row"), key="_row")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("least"))
    # Rows that share the hash have the same id and text.
    return keyed.join(first.select(F.col("least._row").alias("_row")), "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the new text."""
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("quality_rules", drop_poor), ("simhash", drop_copies), ("pii", redact_personal), ("packing", pack)]

#: Learned scores and library tokenizers have no SQL; tests compare run() with the operators and with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What stages hand on lies in the shared checkpoint folder; a stage's folder goes when the next one's is written."""
    root, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{root}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            folder = spark._jvm.org.apache.hadoop.fs.Path(before)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        before = path
    return docs
