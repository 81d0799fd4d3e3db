"""The corpus pipeline: five stages over documents, each an operator of geotally.llm applied to all that the last one kept.

Quality classifier: rejected documents go. Exact dedup: of equal texts the largest doc_id stays. Near-dedup: of each group of
near-duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays. Secret scans: secrets in the texts are
replaced by a mark and n_chars follows; no document goes. Packing: pieces of at most 2048 tokens in sequences.
All but the last return the columns of documents. Null and empty texts, repeated rows and empty tables have the results that
the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotally.llm import op2_exact_dedup, op3_quality_classifier, op4_packing, op7_secret_scans, op8_minhash
from geotally.llm.common import passing, read, saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_quality_classifier.accepted(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_minhash.one_of_each(docs, 80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = op7_secret_scans.redacted(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("secret scans", secrets), ("packing", packing)]
#: The classifier is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with passing(spark):  # a stage's own intermediate tables go when its result is written
            docs = saved(stage(spark, docs, sf_dir), lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
