"""A training-data pipeline: raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.  The
first four return the columns of documents, the last the tokens.  ``run`` writes every
stage's result as Parquet in the shared folder and reads it again, so a lost executor
costs the tasks of one stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skriva.llm import bpe, decontaminate, passages, resample, simhash
from skriva.llm.support import shared_dir, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier by importance resampling: documents that it rejects go."""
    return resample.draw(docs, resample.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: the document with the least id of each group stays."""
    return simhash.one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: passages that a smaller id holds are cut; a document of nothing else goes."""
    kept = passages.cut_passages(docs, passages.repeated_passages(docs))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: token ids, with the digests of the ids and of what they decode to."""
    return bpe.encode(docs, RANKS, keep=tuple(c for c in ("lang", "source") if c in docs.columns))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]
#: No SQL: fingerprints, windows and tokens have none; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
