"""URL filtering by fixed rules and by association rules that FP-growth mines from labelled URLs.

A URL's tokens are its host and every parent domain, its path's segments and the names of its query's parameters, digits
made alike. Only tokens that come with the label of a bad page often enough can be in a rule, and tokens that the same labelled
URLs hold (parents of a host, segments of one path) tell the same, so they are one item, which any of them stands for: a rule has
one of them at most, and n equal URLs of n segments make one item instead of 2^n sets. FP-growth finds the item sets that
are frequent among labelled URLs together with the bad label; rules that reach the least support and confidence remain, and of
those a rule that has a part of its items as a rule of no less confidence is pruned. Rules match by an inverted index: each is
listed under the tokens of its rarest item, the tokens of each different URL meet the list by an equi-join, and a candidate
holds if no item of the rule is missing. Only built-in functions and Spark's own FP-growth run here.

A fixed rule (host, path, verdict) fits a URL if the URL's host is the rule's or below it, and the URL's path starts with the
rule's; the longest fitting rule decides. Elsewhere the mined rules do: block if one fits, else allow.

Cases: URLs that are null or lack :// have an empty host and path and no tokens, and are allowed; very long URLs are used
whole; repeated URLs are matched once and answered on each row; null labels and labels without a page don't train; without
rules or labels all is allowed; an empty table gives no rows; input columns that have the names of output columns are
replaced.
"""

from __future__ import annotations

import math
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, without

#: Part of the labelled URLs that a rule's tokens share with the bad label, and part of the tokens' URLs that are bad, at least.
SUPPORT, CONFIDENCE = 0.002, 0.6
#: Labelled URLs that a rule rests on, at least.
LEAST_ROWS = 20
#: Rows of labels or rules that may be broadcast; more are joined by shuffling.
BROADCAST_ROWS = 200_000
_BAD = "label=bad"
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def host(url: str) -> Column:
    """What is between the first :// and the next /, ? or #, A-Z in lower case; empty without ://."""
    rest = F.expr(f"CASE WHEN locate('://', `{url}`) > 0 THEN substring(`{url}`, locate('://', `{url}`) + 3) ELSE '' END")
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: str) -> Column:
    """What is between the host and the next ? or #."""
    rest = F.expr(f"CASE WHEN locate('://', `{url}`) > 0 THEN substring(`{url}`, locate('://', `{url}`) + 3) ELSE '' END")
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def tokens(url: str) -> Column:
    """The different tokens of a URL (array<string>)."""
    plain = lambda c: F.regexp_replace(c, r"[0-9]+", "0")
    labels = F.split(host(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segments = F.transform(F.filter(F.split(path(url), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), plain(x)))
    query = F.regexp_extract(F.col(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), plain(F.regexp_extract(x, r"(?s)^([^=]*)", 1))))
    return F.when(F.coalesce(host(url), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, segments, names)))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def mine(pages: DataFrame, labels: DataFrame, bad: Column, page_key: str = "page_id", label_key: str = "doc_id", support: float = SUPPORT, confidence: float = CONFIDENCE, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(rule_id, items, confidence, support) of the item sets that tell bad pages; an item is an array of tokens, any of which is meant."""
    known = _small(labels.filter(F.col(label_key).isNotNull() & bad.isNotNull()).select(F.col(label_key).alias("of"), bad.alias("bad")))
    rows = pages.select(F.col(page_key).alias("of"), tokens("url").alias("items")).join(known, "of").filter(F.size("items") > 0)
    rows = cut(rows.select("items", "bad", F.monotonically_increasing_id().alias("id")))
    n = rows.count()
    least = max(least_rows, math.ceil(support * n), 1)
    held = rows.select("id", "bad", F.explode("items").alias("token"))
    # tokens of the same rows, told by the rows' number and two sums of their hashes
    same = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 31))).alias("y")]
    often = held.groupBy("token").agg(F.sum(F.col("bad").cast("long")).alias("b"), *same).filter(F.col("b") >= least)
    items = cut(often.groupBy("n", "x", "y").agg(F.min("token").alias("item"), F.sort_array(F.collect_list("token")).alias("tokens")))
    members = _small(items.select("item", F.explode("tokens").alias("token")))
    baskets = held.join(members, "token").groupBy("id", "bad").agg(F.collect_set("item").alias("items"))
    baskets = cut(baskets.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(_BAD)))).otherwise(F.col("items")).alias("items")))
    many = max(1, baskets.count())
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / many), minConfidence=confidence, numPartitions=parts).fit(baskets)
    rules = model.associationRules.filter(F.array_contains("consequent", _BAD)).select(F.array_sort("antecedent").alias("set"), "confidence", (F.col("support") * (many / max(1, n))).alias("support"))
    rules = cut(rules.withColumn("rule_id", F.xxhash64(F.array_join("set", "\n"))))
    # a rule is pruned if some shorter rule, met under the item that fewest rules have, is part of it and no less sure
    listed = rules.select("rule_id", "set", "confidence", F.explode("set").alias("item"))
    rare = listed.join(listed.groupBy("item").agg(F.count("*").alias("n")), "item").groupBy("rule_id").agg(F.min_by("item", F.struct("n", "item")).alias("item"))
    shorter = rules.select("rule_id", F.col("set").alias("less"), F.col("confidence").alias("sure")).join(rare, "rule_id").drop("rule_id")
    part = (F.size("less") < F.size("set")) & (F.size(F.array_except("less", "set")) == 0) & (F.col("sure") >= F.col("confidence"))
    pruned = listed.join(shorter, "item").filter(part).select("rule_id").distinct()
    kept = rules.join(pruned, "rule_id", "left_anti").select("rule_id", "confidence", "support", F.explode("set").alias("item"))
    return cut(kept.join(items.select("item", "tokens"), "item").groupBy("rule_id", "confidence", "support").agg(F.sort_array(F.collect_list("tokens")).alias("items")))


def matches(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined): the different URLs that mined rules fit, and the highest confidence."""
    urls = pages.filter(F.col("url").isNotNull()).select("url").distinct().withColumn("own", tokens("url"))
    listed = rules.select("rule_id", "items", "confidence", F.posexplode("items").alias("place", "tokens")).select("*", F.explode("tokens").alias("token"))
    some = _small(listed.select("token").distinct())
    counts = urls.select(F.explode("own").alias("token")).join(some, "token").groupBy("token").agg(F.count("*").alias("n"))
    found = listed.join(counts, "token", "left").groupBy("rule_id", "place").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    rare = found.groupBy("rule_id").agg(F.min_by("place", F.struct("n", "place")).alias("place"))
    index = _small(cut(listed.join(rare, ["rule_id", "place"]).select("token", "items", "confidence")))
    met = urls.select("url", "own", F.explode("own").alias("token")).join(index, "token")
    return met.filter(F.forall("items", lambda x: F.arrays_overlap(x, "own"))).groupBy("url").agg(F.max("confidence").alias("mined"))


def judge(pages: DataFrame, rules: DataFrame, fixed: list[tuple[str, str, str]]) -> DataFrame:
    """pages with host, path, rule, verdict and the confidence of the mined rule. fixed: (host, path, verdict) each."""
    pages = without(pages, "host", "path", "rule", "verdict", "mined")
    rows = pages.join(matches(pages, rules), "url", "left").select(*(F.col(f"`{c}`") for c in pages.columns), "mined")
    rows = rows.withColumns({"host": F.coalesce(host("url"), F.lit("")), "path": F.coalesce(path("url"), F.lit(""))})
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
    best = F.array_max(F.array(*(F.when(fits(h, p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in fixed)))
    rows = rows.withColumn("__best", best) if fixed else rows.withColumn("__best", F.lit(None).cast("struct<length:int,rule:string,verdict:string>"))
    method = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return rows.withColumns({"rule": F.col("__best.rule"), "verdict": F.coalesce(F.col("__best.verdict"), method)}).drop("__best")
