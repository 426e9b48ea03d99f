"""The training-data pipeline: stages over ``documents``, each written as Parquet and read again for the next one.

toxicity and quality reject documents, near duplicates leave one document of each class (five-word shingles, similarity 0.8), decontamination
drops documents that hold a benchmark passage, and packing returns doc_id, n_tokens, bucket, padded_to, batch and place of what is left. All but packing
return the columns of their input, whatever their names.

Empty tables pass through all stages. Null and empty texts are neither toxic nor leaks nor copies; as to quality they have log weight 0. Rows without an id pass toxicity, quality and decontamination by
their text, and near duplicates as they are. Rows that share an id are documents of their own: of (4, A), (5, A), (5, B) near duplicates leave (4, A), (5, B); of equal rows one stays.
Texts of any length are taken whole. Ties: a score at a threshold rejects; of a class the smallest doc_id stays, then the smallest text hash; rows that tie at the quality cut all stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyfold.llm import decontamination, importance, jaccard_join, packing, toxicity
from keyfold.llm.queries import table
from keyfold.llm.store import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return importance.without_poor(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, 5, 80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("importance_resampling", drop_poor),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

ORACLE_SQL = None  # a trained classifier and hashed models decide


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
