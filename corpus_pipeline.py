"""A training-corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept. The
output is written as Parquet and read again as the next stage's input, so a lost executor costs
one stage at most. All stages but the last return the columns of documents.

Null texts count as empty and are rejected by the quality rules; repeated rows survive until the
near-dedup stage keeps one of each group; an empty table gives an empty result; extra columns are
carried along until the packing stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from awardlens.llm import cnn, mixing, packing, quality_rules, simhash
from awardlens.llm.text import row_of, shared_folder

#: A document stays if the classifier gives it at least this probability.
KEEP_SCORE = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the latest policy."""
    judged = quality_rules.with_verdict(quality_rules.ledger(docs.select(row_of(docs).alias("row"), F.col("text"))))
    return judged.where("kept").select("row.*")


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network, fitted on labelled rows, takes for good ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    everything = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = cnn.train(everything, labels)
    return cnn.kept(docs, net, KEEP_SCORE)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by id, of each group of verified near copies."""
    return simhash.keep_one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents laid out so that sources interleave by their target weights."""
    return mixing.in_mixed_order(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their ids, in mixed order: that of the written files."""
    return packing.pieces(docs, place=("_metadata.file_path", "_metadata.file_block_start"))


STAGES = [
    ("quality_rules", quality_stage),
    ("quality_classifier", classifier_stage),
    ("simhash_near_dedup", dedup_stage),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier and the fingerprints are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written under the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
