"""Quality rules whose thresholds follow the data: mergeable quantile sketches per language and source.

``document_stats`` measures every whole text. ``sketches`` keeps, for each language, source and rate, a histogram over
logarithmic buckets (relative error ``ALPHA``): sketches of parts merge by adding counts, so one ``groupBy`` with partial
sums builds them, however many rows a source has. ``thresholds`` reads the buckets of the quartiles off the merged sketches and
puts a fence ``fence`` interquartile ranges (of buckets, so of logarithms) outside them. The rates of things that most texts
lack are (count + 1) / (words + 1): a text without any stands at what its length can tell, so the quartiles of these rates
spread as the lengths and counts of the group do, and no constant has to. Groups of fewer than ``min_docs`` documents use the
sketch of their language, and small languages that of the whole table. ``judge`` joins documents with the thresholds of their
group. Documents that fail the base rules stay out of the sketches.

Cases: a null or empty text has no words and fails the base rules; null languages and sources are groups of their own;
repeated rows count and are judged one by one; very long texts are measured whole; an empty table gives no rows; input
columns that have the names of output columns are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import ASCII_SPACE, aliased, cut, map_arrow, named, parts, without

#: Relative error of a sketch's quantiles.
ALPHA = 0.01
#: Documents that a group's own sketch needs.
MIN_DOCS = 50
#: Interquartile ranges between a quartile and its fence: those of Tukey's outer fences.
FENCE = 3
#: Thresholds that may be broadcast, in rows; larger tables are joined by shuffling.
BROADCAST_ROWS = 50_000
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: For each rate: numerator, denominator, what is added to both, and whether small values fail too.
RATES = {
    "symbol_rate": ("n_symbols", "n_words", 1, False),
    "dup_line_rate": ("n_dup_lines", "n_words", 1, False),
    "repeat_rate": ("n_repeat_words", "n_words", 1, False),
    "word_length": ("word_chars", "n_words", 0, True),
}


def measure(text: str) -> tuple[int, int, int, int, int]:
    """The five counts of COUNTS of a text. Words are runs of characters other than ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0
    chars = len(text) - sum(map(text.count, ASCII_SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    repeated = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        k = len(ids)
        if k <= 2_000_000:
            keys = (a[:-2] * k + a[1:-1]) * k + a[2:]
        else:  # three ids don't fit a number
            _, pairs = np.unique(a[:-1] * k + a[1:], return_inverse=True)
            keys = pairs[:-1].astype(np.int64) * k + a[2:]
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for shift in range(3):
                covered[shift : n - 2 + shift] |= twice
            repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def document_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the counts (long) of each whole text."""
    df = without(df, *COUNTS)
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [measure(x or "") for x in batch.column(text).to_pylist()]
            columns = zip(*found, strict=True) if found else [[] for _ in COUNTS]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], names=[*batch.schema.names, *COUNTS])

    return map_arrow(df, run, schema)


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _group_key(name: str):
    """A text that tells null from every value."""
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("null"))


_LOG_GAMMA = math.log((1 + ALPHA) / (1 - ALPHA))


def _bucket(name: str):
    """The bucket of a rate that is above 0; null elsewhere."""
    over, under, more, _ = RATES[name]
    rate = F.try_divide((F.col(over) + more).cast("double"), (F.col(under) + more).cast("double"))
    return F.when(rate > 0, F.ceil(F.log(rate) / F.lit(_LOG_GAMMA))).cast("int")


def sketches(stats: DataFrame) -> DataFrame:
    """(lang_key, source_key, rate, bucket, n): the merged histograms of the documents that pass the base rules."""
    values = F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), _bucket(r).alias("bucket")) for r in RATES))).alias("x")
    rows = stats.filter(~base_failed()).select(_group_key("lang").alias("lang_key"), _group_key("source").alias("source_key"), values)
    return rows.groupBy("lang_key", "source_key", F.col("x.rate").alias("rate"), F.col("x.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def _quartiles(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, docs, q1, q3) of sketches merged by keys; quartiles are buckets."""
    merged = parts.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    own = W.partitionBy(*keys, "rate")
    merged = merged.withColumn("upto", F.sum("n").over(own.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))).withColumn("docs", F.sum("n").over(own))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("docs") * q), F.col("bucket")))
    return merged.groupBy(*keys, "rate").agg(F.max("docs").alias("docs"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def thresholds(parts: DataFrame, fence: float = FENCE, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang_key, source_key, low_<rate>, high_<rate>): the fences of each language and source, as buckets."""
    levels = [_quartiles(parts, ["lang_key", "source_key"]), _quartiles(parts, ["lang_key"]), _quartiles(parts, [])]
    out = levels[0]
    for i, (level, keys) in enumerate(zip(levels[1:], (["lang_key", "rate"], ["rate"]), strict=True)):
        out = out.join(level.select(*keys, *(F.col(c).alias(f"{c}_{i}") for c in ("docs", "q1", "q3"))), keys, "left")
    enough, more = F.col("docs") >= min_docs, F.col("docs_0") >= min_docs
    pick = lambda c: F.when(enough, F.col(c)).when(more, F.col(f"{c}_0")).otherwise(F.col(f"{c}_1"))
    reach = fence * (pick("q3") - pick("q1"))
    out = out.select("lang_key", "source_key", "rate", (pick("q1") - reach).alias("low"), (pick("q3") + reach).alias("high"))
    one = lambda r, c: F.max(F.when(F.col("rate") == r, F.col(c))).alias(f"{c}_{r}")
    return out.groupBy("lang_key", "source_key").agg(*(one(r, c) for r in RATES for c in ("low", "high")))


def judge(stats: DataFrame, fences: DataFrame) -> DataFrame:
    """stats with base_failed and kept. fences: what thresholds() found, materialised."""
    stats = without(stats, "base_failed", "kept", "lang_key", "source_key")
    columns = stats.columns
    small = fences.count() <= BROADCAST_ROWS
    joined = stats.withColumns({"lang_key": _group_key("lang"), "source_key": _group_key("source")})
    joined = joined.join(F.broadcast(fences) if small else fences, ["lang_key", "source_key"], "left")
    fails = [_bucket(r) > F.col(f"high_{r}") for r in RATES] + [_bucket(r) < F.col(f"low_{r}") for r, x in RATES.items() if x[3]]
    outside = F.lit(False)
    for x in fails:
        outside = outside | F.coalesce(x, F.lit(False))
    return joined.select(*columns, base_failed().alias("base_failed"), (~base_failed() & ~outside).alias("kept"))


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: its counts, base_failed and kept. The texts are read once."""
    stats = cut(document_stats(docs.select("doc_id", "lang", "source", "text")).drop("text"))
    return judge(stats, cut(thresholds(sketches(stats)))).drop("lang", "source")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with the columns of docs. Counts are made again rather than carried with the texts."""
    fences = cut(thresholds(sketches(document_stats(docs.select("lang", "source", "text")).drop("text"))))
    own = {c: aliased(docs, c) for c in ("lang", "source", "text")}
    rows = aliased(docs).select("*", *(own[c].alias(c) for c in ("lang", "source")))
    return named(judge(document_stats(rows, f"__{docs.columns.index('text')}"), fences).filter("kept"), docs)
