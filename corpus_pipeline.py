"""The document pipeline: quality rules, toxicity, near-duplicates, source mixing, encoding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the rows that it keeps, with the columns
of documents, and the last one the encoded documents. run() writes each stage as Parquet in the shared folder of
spark.checkpoint.dir and reads it again as the next one's input, so a lost executor costs part of a stage at most. A stage's input
is removed when its output is written; the last output goes with the session.

Cases: documents without a word, null texts among them, fail the base rules of the first stage; null ids, languages and sources
are allowed; of rows that are equal in every column one stays in the third stage; very long texts are read whole in every stage;
an empty table gives no rows; columns besides those of documents pass through the first four stages as they are, whatever their
names, and the last one leaves them out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import adaptive_rules, cube_mixing, dart_minhash, kn_toxicity, spm_bpe
from quern.llm.common import remove, scratch, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return adaptive_rules.keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kn_toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dart_minhash.keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cube_mixing.take(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    coded = spm_bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select("doc_id", "lang", "source", F.octet_length("decoded").cast("long").alias("n_bytes"), "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity),
    ("near-duplicates", near_duplicates),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: The thresholds' sketches, the language models and the sampling are no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    folder = scratch(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
