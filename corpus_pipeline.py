"""Corpus pipeline: toxic documents go, repeated passages go, one of near copies stays, the rest is packed.

Every stage works on all that the stage before kept. ``run`` writes each
stage's result to a table in the shared folder, so a lost executor costs the
stage at hand at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editforge.llm.common import fresh
from editforge.llm.line_dedup import remove_repeats
from editforge.llm.ngram_join import similar_documents
from editforge.llm.packing import pack
from editforge.llm.toxicity import fit, score
from editforge.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject. Labels of held-out rows are not learnt from."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return score(docs, fit(docs, labels)).where("predicted = 0").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier; a document that consists of such passages goes whole."""
    done = remove_repeats(docs)
    cut = F.size("removed") > 0
    done = done.where(~(cut & (F.col("text") == ""))).withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id; of rows that repeat id and text one."""
    key = fresh(docs, "_kept")
    kept = materialize(similar_documents(docs).where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct(), "kept")
    named = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col(key), "left_semi").dropDuplicates(["doc_id", "text"])
    return named.union(docs.where("doc_id is null"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    return pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeats), ("ngram_join", drop_near_copies), ("packing", pack_sequences)]

#: Nearest neighbours and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
