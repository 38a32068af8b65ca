"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation in blocks.

Vectors are rows of weighted terms: component d of a vector is the weight of term d, and a zero is no posting. Queries and
candidates are dealt into groups of bounded size (rows and components); each group of queries meets each group of candidates
once. There the candidates are an inverted index: the list of a term has the places and weights of the candidates that hold it,
or, if it has more than ``FULL`` of them, a weight for every place. Of a tile of query rows, one term after the other scatters
weight times list into the dense arrays of scores. All sums are of whole numbers and exact. A partition selection leaves each
query's best of the group, ties to the smaller id, and a window merges the groups.

Cases: vectors that are null or hold null, NaN or infinite components, and rows with a null id, take no part; vectors may
have different lengths (missing terms weigh nothing), and very long ones cost what they hold; an empty vector scores 0
everywhere; components or scores beyond 64 bits raise an error; rows that repeat an id are separate candidates, but none is a
candidate of the query with its own id; queries that repeat an id are one query if their vectors are equal, else the smallest
vector is taken; fewer candidates than k are all returned; ties go to the smaller id; an empty table gives no rows; other
columns, whatever their names, don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import cut

#: Rows and components of a group of queries or candidates, and query rows of a tile.
QUERIES, CANDIDATES, CELLS, TILE = 131_072, 65_536, 1 << 23, 64
#: Part of a group's candidates from which on a term's list has a weight for every place.
FULL = 0.25


def whole_components(vector: str, scale: float = 64.0) -> Column:
    """The components as whole numbers: floor of scale times each, as doubles."""
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vector: str) -> Column:
    good = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(good, F.lit(False))


def postings(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the components that aren't 0."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    if not len(lists) or offsets[-1] == offsets[0]:
        return (np.empty(0, np.int64),) * 3
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    at = np.flatnonzero(values)
    row = np.searchsorted(offsets[1:] - offsets[0], at, "right")
    return row, at - (offsets[row] - offsets[0]), values[at]


class Index:
    """The lists of a group of candidates, term by term."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int):
        order = np.argsort(terms, kind="stable")
        self.n, self.terms = n, np.unique(terms)
        ends = np.searchsorted(terms[order], self.terms)
        self.rows, self.weights, self.ends = rows[order], weights[order], np.append(ends, len(terms))
        self.largest = np.maximum.reduceat(np.abs(self.weights.astype(float)), ends) if len(ends) else np.empty(0)
        self.lists: dict[tuple[int, type], tuple[np.ndarray | None, np.ndarray]] = {}

    def list_of(self, i: int, kind: type) -> tuple[np.ndarray | None, np.ndarray]:
        """(places or None for all, weights) of the term at i."""
        if (i, kind) not in self.lists:
            own = slice(self.ends[i], self.ends[i + 1])
            places, weights = self.rows[own], self.weights[own].astype(kind)
            if len(places) > FULL * self.n:
                every = np.zeros(self.n, kind)
                every[places] = weights
                places, weights = None, every
            self.lists[i, kind] = places, weights
        return self.lists[i, kind]


def accumulate(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, index: Index) -> np.ndarray:
    """Scores (n query rows x candidates) of the query rows' postings, term at a time."""
    order = np.argsort(terms, kind="stable")
    rows, terms, weights = rows[order], terms[order], weights[order]
    held, first = np.unique(terms, return_index=True)
    ends = np.append(first, len(terms))
    _, mine, theirs = np.intersect1d(held, index.terms, assume_unique=True, return_indices=True)
    largest = np.maximum.reduceat(np.abs(weights.astype(float)), first) if len(first) else np.empty(0)
    bound = float((largest[mine] * index.largest[theirs]).sum())
    # the smallest numbers that hold every sum exactly; sums modulo 2^64 are exact if the totals fit, which sums of doubles tell
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    found = _scattered(rows, weights, ends, mine, theirs, n, index, kind)
    if bound >= 2.0**63 and (np.abs(_scattered(rows, weights, ends, mine, theirs, n, index, np.float64)) >= 2.0**63 - bound * 2.0**-40).any():
        raise OverflowError("scores beyond 64 bits")
    return found


def _scattered(rows: np.ndarray, weights: np.ndarray, ends: np.ndarray, mine: np.ndarray, theirs: np.ndarray, n: int, index: Index, kind: type) -> np.ndarray:
    scores, product = np.zeros((n, index.n), kind), np.empty((n, index.n), kind)
    for i, j in zip(mine.tolist(), theirs.tolist(), strict=True):
        own = slice(ends[i], ends[i + 1])
        at, weight = rows[own], weights[own].astype(kind)
        places, list_ = index.list_of(j, kind)
        if places is not None:
            scores[np.ix_(at, places)] += weight[:, None] * list_
        elif len(at) == n:
            scores += np.multiply(weight[np.argsort(at)][:, None], list_, out=product)
        else:
            scores[at] += np.multiply(weight[:, None], list_, out=product[: len(at)])
    return scores


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, best first, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, equal = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        need = k - len(above)
        if len(equal) > need:
            equal = equal[np.argpartition(ids[equal], need - 1)[:need]] if need < len(equal) else equal
        at = np.concatenate([above, equal])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))]


def search(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, <key>, score): each query's k best other rows. vector: arrays of whole numbers."""
    whole = F.transform(F.col(vector), lambda x: F.when(F.abs(x.cast("double")) >= 2.0**63, F.raise_error(F.lit("a component beyond 64 bits"))).otherwise(x.cast("long")))
    rows = cut(df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")))
    n = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1)), F.coalesce(F.sum(F.size("v")), F.lit(0)), F.coalesce(F.sum(F.when(F.col("q"), F.size("v"))), F.lit(0))).first()
    many_q, many_c = max(1, math.ceil(n[1] / QUERIES), math.ceil(n[3] / CELLS)), max(1, math.ceil(n[0] / CANDIDATES), math.ceil(n[2] / CELLS))
    # small inputs still spread over tasks
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many_c = max(many_c, min(spread, math.ceil(n[0] / 1024)))
    group = lambda many, seed: F.pmod(F.xxhash64("id", "v", F.lit(seed)), F.lit(many)).cast("int")
    asked = rows.filter("q").groupBy("id").agg(F.min("v").alias("v")).withColumn("qg", group(many_q, 1))
    asked = asked.withColumn("cg", F.explode(F.sequence(F.lit(0), F.lit(many_c - 1))))
    there = rows.select("id", "v").withColumn("cg", group(many_c, 2)).withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(many_q - 1))))

    def meet(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        qid, cid = queries.column("id").to_numpy(), candidates.column("id").to_numpy()
        out: list[tuple] = []
        if len(qid) and len(cid):
            index = Index(*postings(candidates.column("v")), len(cid))
            row, term, weight = postings(queries.column("v"))
            for a in range(0, len(qid), TILE):
                own = slice(*np.searchsorted(row, [a, a + TILE]))
                scores = accumulate(row[own] - a, term[own], weight[own], min(TILE, len(qid) - a), index)
                for i, found in enumerate(scores):
                    at = select(found, cid, k + 1)
                    at = at[cid[at] != qid[a + i]]
                    if len(at) < k and len(cid) > k:  # rows that repeat the query's id took places
                        others = np.flatnonzero(cid != qid[a + i])
                        at = others[select(found[others], cid[others], k)]
                    at = at[:k]
                    out.append((np.full(len(at), qid[a + i]), cid[at], found[at].astype(np.int64)))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "id", "score"), map(pa.array, columns), strict=True)))

    best = asked.groupBy("qg", "cg").cogroup(there.groupBy("qg", "cg")).applyInArrow(meet, "query_id long, id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
