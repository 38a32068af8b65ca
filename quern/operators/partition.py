"""Cost-balanced partitions of rows: largest differencing, least-loaded, micro-batches."""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Merges of states of one spread that are made at once: so many at most, and below so many one by one.
_AT_ONCE, _FEW = 1 << 16, 8


def workload(length: Column) -> Column:
    """Cost of a sequence: linear and quadratic in its length."""
    return 24576 * length + length * length


def differencing(costs: Sequence[float], k: int, equal: bool = False) -> list[int]:
    """The part of each cost by k-way largest differencing. equal: parts have the same number of costs, which k must divide.

    The two states with the largest spread are merged, largest part on smallest, until one is left. A state has its parts' sums only; a
    merge keeps which parts came together, and the parts' members are told from the last merge backwards. States of one spread wait in
    the order in which they were made, and many of them are merged at once.
    """
    if len(costs) < k:
        raise ValueError(f"{len(costs)} costs for {k} parts")
    if equal and len(costs) % k:
        raise ValueError(f"{k} doesn't divide {len(costs)}")
    cost = np.asarray(costs, float)
    order = np.argsort(cost, kind="stable")
    if equal:
        members = order.reshape(-1, k)
        members = np.take_along_axis(members, np.argsort(-cost[members], axis=1, kind="stable"), 1)
        places = np.broadcast_to(np.arange(k), members.shape)
    else:
        members, places = order[:, None], np.where(cost[order] < 0, k - 1, 0)[:, None]
    n = len(members)
    states = max(0, 2 * n - 1)
    sums = np.zeros((states, k))
    sums[np.arange(n)[:, None], places] = cost[members]
    ends, ranks = np.zeros((states, 2), np.int32), np.zeros((states, k), np.int32)
    heap: list[tuple[float, int, deque[int]]] = []
    waiting: dict[float, deque[int]] = {}

    def wait(first: int, spreads: list[float]) -> None:
        for state, spread in enumerate(spreads, first):
            if spread not in waiting:
                waiting[spread] = deque()
                heapq.heappush(heap, (-spread, state, waiting[spread]))
            waiting[spread].append(state)

    def leave() -> None:
        if not heap[0][2]:
            waiting.pop(-heapq.heappop(heap)[0], None)

    wait(0, (sums[:n].max(1) - sums[:n].min(1)).tolist())
    made, rounds, most = n, [n], _AT_ONCE
    while made < states:
        first, _, queue = heap[0]
        m = min(len(queue) // 2, most)
        if m < _FEW:
            a = queue.popleft()
            leave()
            b = heap[0][2].popleft()
            leave()
            both = [x + y for x, y in zip(sums[a].tolist(), sums[b, ::-1].tolist(), strict=True)]
            rank = sorted(range(k), key=[-x for x in both].__getitem__)
            both = [both[i] for i in rank]
            ends[made], ranks[made], sums[made], spreads, m = (a, b), rank, both, [both[0] - both[-1]], 1
            most = min(2 * most, _AT_ONCE)
        else:
            pairs = np.array([queue.popleft() for _ in range(2 * m)]).reshape(m, 2)
            both = sums[pairs[:, 0]] + sums[pairs[:, 1], ::-1]
            rank = np.argsort(-both, axis=1, kind="stable")
            both = np.take_along_axis(both, rank, 1)
            spread = both[:, 0] - both[:, -1]
            ahead = np.flatnonzero(spread > -first)[:1]  # by rounding; it goes before the pairs behind it
            most = min(2 * most, _AT_ONCE)
            if len(ahead):
                m = most = int(ahead[0]) + 1
                queue.extendleft(pairs[m:].ravel()[::-1].tolist())
            leave()
            here = slice(made, made + m)
            ends[here], ranks[here], sums[here], spreads = pairs[:m], rank[:m], both[:m], spread[:m].tolist()
        wait(made, spreads)
        made += m
        rounds.append(made)
    del sums
    part = np.zeros((states, k), np.int32)
    part[-1:] = np.arange(k)
    for end, start in zip(rounds[:0:-1], rounds[-2::-1], strict=True):
        if end - start == 1:
            a, b = ends[start]
            part[a, ranks[start]] = part[start]
            part[b, k - 1 - ranks[start]] = part[start]
        else:
            (a, b), rank, own = ends[start:end].T, ranks[start:end], part[start:end]
            part[a[:, None], rank] = own
            part[b[:, None], k - 1 - rank] = own
    out = np.zeros(len(cost), np.int64)
    out[members] = part[np.arange(n)[:, None], places]
    return out.tolist()


def least_loaded(costs: list[float], k: int) -> list[int]:
    """The part of each cost, in the order given: the one with the least sum so far."""
    heap = [(0.0, p) for p in range(k)]
    out = []
    for c in costs:
        total, p = heapq.heappop(heap)
        out.append(p)
        heapq.heappush(heap, (total + c, p))
    return out


def balanced(df: DataFrame, cost: str, k: int | Callable[[int, list[float]], int], key: str, keys: list[str] | None = None, equal: bool = False, greedy: bool = False) -> DataFrame:
    """df with ``part``: rows of each batch (given by keys; all of df without) in k parts of nearly the same cost, where k may be a function
    of a batch's number of rows and its costs.

    A batch is what one optimiser step reads, so its keys and costs fit a task; batches are partitioned in parallel.
    """
    keys = keys or []

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, ignore_index=True)
        costs = rows[cost].astype(float).tolist()
        parts = k(len(costs), costs) if callable(k) else k
        return rows[[*keys, key]].assign(part=least_loaded(costs, parts) if greedy else differencing(costs, parts, equal))

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, key]) + ", part long"
    own = df.select(*keys, key, cost).groupBy(*(keys or [F.lit(1).alias("__all")])).applyInPandas(run, schema)
    return df.join(own, [*keys, key])


def micro_batch_count(rows: int, tokens: int, most_tokens: int, least: int = 1, divisor: int = 1) -> int:
    """How many micro-batches: enough for the token budget, no more than rows, at least ``least``, a multiple of divisor."""
    n = max(least, min(rows, math.ceil(tokens / most_tokens)))
    return math.ceil(n / divisor) * divisor


def micro_batches(df: DataFrame, length: str, key: str, most_tokens: int, least: int = 1, divisor: int = 1, keys: list[str] | None = None) -> DataFrame:
    """df with ``part`` (micro-batch), each batch balanced by workload. The budget sets their number; single ones may exceed it."""
    # workload(n) = 24576 n + n^2 grows with n, so a cost tells the length
    tokens = lambda cost: round((math.sqrt(24576.0**2 + 4 * cost) - 24576) / 2)
    count = lambda n, costs: min(n, micro_batch_count(n, sum(map(tokens, costs)), most_tokens, least, divisor))
    return balanced(df.withColumn("__cost", workload(F.col(length).cast("double"))), "__cost", count, key, keys).drop("__cost")


def check(df: DataFrame, k: int) -> DataFrame:
    """(parts, ok): whether all k parts have rows."""
    return df.agg(F.countDistinct("part").alias("parts")).withColumn("ok", F.col("parts") == k)
