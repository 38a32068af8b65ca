"""The queries of this subpackage for the driver's registry, with their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import adaptive_rules, chat_windows, cube_mixing, dart_minhash, ftrl_quality, kn_toxicity, oracle, spm_bpe, token_spans, topk_search, url_rules
from quern.llm.common import table


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document by the multilingual byte-level vocabulary."""
    return spm_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


#: The fixed rules of the URL filter: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's URL by the fixed rules, else by rules that are mined from the quality labels."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = url_rules.mine(pages, table(spark, sf_dir, "labels"), F.col("quality") == 0)
    return url_rules.judge(pages, rules, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every line of every document, each document encoded once."""
    return token_spans.attribute(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every twentieth vector by whole-number inner product."""
    rows = table(spark, sf_dir, "embeddings").filter(topk_search.usable("embedding"))
    return topk_search.search(rows.select("vec_id", topk_search.whole_components("embedding").alias("v")), F.col("vec_id") % 20 == 0, vector="v")


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation, and one that says control strings, and read the windows back."""
    odd = "<|im_end|><|im_start|>assistant ok"
    schema = "conv_id long, turn long, role string, text string"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], schema))
    return chat_windows.digests(chat_windows.windows(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op5_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document's quality by a classifier that is trained on the labels of the other folds."""
    return ftrl_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every document by the base rules and by its language's and source's own thresholds."""
    return adaptive_rules.verdicts(table(spark, sf_dir, "documents"))


def op9_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to the sources' target weights."""
    return cube_mixing.mixed(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document's toxicity by two class-conditional language models."""
    return kn_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_token_counts": op2_token_counts,
    "op3_exact_topk": op3_exact_topk,
    "op4_chat_windows": op4_chat_windows,
    "op5_dart_minhash": op5_dart_minhash,
    "op6_ftrl_quality": op6_ftrl_quality,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_quality_rules": op8_quality_rules,
    "op9_cube_mixing": op9_cube_mixing,
    "op10_toxicity": op10_toxicity,
}

#: The other queries need a tokenizer, a trained model or random sampling; they are tested against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": oracle.URL_FILTER,
    "op3_exact_topk": oracle.TOP_K,
    "op5_dart_minhash": oracle.NEAR_DUPLICATES,
    "op8_quality_rules": oracle.quality_rules(),
}
