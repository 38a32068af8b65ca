"""Mixing sources to target weights by the cube method's balanced sampling.

A document's size is its number of words. The sources' targets share a budget by weight, none above ``MOST`` times its size
(the excess goes to the others by weight, until none is above). A source is taken at the rate target / size. Rows that are equal
in every column are a unit: of m rows at the rate r, the whole part of m x r is taken surely, and one copy more with the rest as
its inclusion probability. The vector of these probabilities is moved at random inside the null space of two constraints, the
number of documents and the number of words, until nearly all are 0 or 1: of three fractional units at a time, a step along the
constraints' cross product keeps both totals exactly and settles at least one unit. Sources are cut into blocks by a hash; each
block leaves two units at most, which meet in further blocks, level by level, until a source has one block. The ``LANDING``
smallest units of a source's first block stay out of all flights, and land together with the two that the last one leaves, on the
sides that miss fewest words and then fewest documents. Every random number follows from a hash of the block, so reruns agree.

Cases: null texts have size 0; a null source is a source of its own, ranked last; a unit's copies are dealt to its rows as
evenly as they can be; columns of map type don't tell rows apart; sources without words have the target 0 and are taken no
times; null ids are allowed; very long texts are counted whole; an empty table gives no rows; other columns, whatever their
names, don't matter to the mix, and take returns them as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import aliased, cut, map_arrow, named, parts
from quern.operators.batch import positions

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: The budget and a source's largest target, as parts of all sizes and of its own.
BUDGET, MOST = 1.5, 2.0
#: Units of a block, and those of a source's last block that only land.
BLOCK, LANDING = 4096, 10
#: Rows (of about 60 bytes) of a side that may be broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 200_000
#: Copies of a row that one task makes at a time.
PIECE = 1024


def _row_hash(docs: DataFrame):
    """A hash of all columns (but maps) of aliased(docs)."""
    return F.xxhash64(*(f"__{i}" for i, (_, kind) in enumerate(docs.dtypes) if "map<" not in kind))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, h, size) of each row; h is a hash of the row."""
    rows = aliased(docs).select(*(aliased(docs, c).alias(c) for c in ("doc_id", "source")), _row_hash(docs).alias("h"), aliased(docs, "text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sizes = [len((x or "").encode("utf-8", "surrogatepass").split()) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "h")), pa.array(sizes, pa.int64())], names=["doc_id", "source", "h", "size"])

    kinds = dict(rows.dtypes)
    return map_arrow(rows, run, f"doc_id {kinds['doc_id']}, source string, h long, size long")


def targets(units: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, place, units, source_size, target) of each source of units (source, size, m). Sources are numbered by ranges, and the
    level of the water is found by sums over all sources, so no task holds them all."""
    sources = units.groupBy("source").agg(F.count("*").alias("units"), F.sum(F.col("size") * F.col("m")).alias("source_size"))
    placed = positions(sources, F.col("source").isNull(), "source", pos="place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    s = placed.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    total, rest = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    level, capped = budget * total / rest if rest else 0.0, -1
    while True:  # sources whose even share is above their cap are capped, and the others share the rest
        over = F.col("cap") < level * F.col("w")
        n, held, rest = s.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
        if n == capped or not rest:
            break
        level, capped = (budget * total - held) / rest, n
    return s.select("source", "place", "units", "source_size", F.least(F.col("cap"), level * F.col("w")).alias("target"))


def fly(p: np.ndarray, m: np.ndarray, s: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move the probabilities p until at most two are fractional, keeping the sums of m * p and s * p."""
    uniform = iter(rng.random(len(p) + 8).tolist())
    pl, ml, sl = p.tolist(), m.astype(float).tolist(), s.astype(float).tolist()
    waiting = iter(range(len(pl)))
    held: list[int] = []
    while True:
        while len(held) < 3 and (i := next(waiting, None)) is not None:
            held.append(i)
        if len(held) < 3:
            break
        i, j, k = held
        u = [ml[j] * sl[k] - ml[k] * sl[j], ml[k] * sl[i] - ml[i] * sl[k], ml[i] * sl[j] - ml[j] * sl[i]]
        scale = max(abs(u[0]), abs(u[1]), abs(u[2]))
        if scale == 0:  # all alike but for a factor
            u, scale = [ml[j], -ml[i], 0.0], max(ml[i], ml[j])
        up = down = math.inf
        for at, d in zip(held, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - pl[at]) / d), min(down, pl[at] / d)
            elif d < 0:
                up, down = min(up, pl[at] / -d), min(down, (1 - pl[at]) / -d)
        step = up if next(uniform, 0.5) * (up + down) < down else -down
        held = []
        for at, d in zip((i, j, k), u, strict=True):
            x = pl[at] + step * d
            x = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
            pl[at] = x
            if 0.0 < x < 1.0:
                held.append(at)
        if len(held) == 3:  # rounding left all inside: settle the one that is nearest to a side
            at = min(held, key=lambda x: min(pl[x], 1 - pl[x]))
            pl[at] = float(round(pl[at]))
            held.remove(at)
    return np.array(pl)


def land(p: np.ndarray, m: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Round the few fractional p so that the sum of s * p, and then of m * p, changes least."""
    at = np.flatnonzero((p > 0) & (p < 1))
    sides = (np.arange(1 << len(at))[:, None] >> np.arange(len(at)) & 1) - p[at]
    words, documents = np.abs(sides @ s[at]).round(6), np.abs(sides @ m[at]).round(6)
    best = int(np.lexsort((documents, words))[0])
    p = p.copy()
    p[at] = best >> np.arange(len(at)) & 1
    return p


_UNIT = "source string, doc_id {kind}, h long, size long, m long, place long, block long, blocks long, sure long, p double"


def _level(units: DataFrame, level: int) -> DataFrame:
    """units (of _UNIT) after a flight in each block, and after landing where a source has one block."""
    names = [x.split()[0] for x in _UNIT.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").combine_chunks()
        size, h = (table.column(c).to_numpy() for c in ("size", "h"))
        order = np.lexsort((h, ids.fill_null(-1).to_numpy(zero_copy_only=False), -size))
        p, s = table.column("p").to_numpy()[order], size[order].astype(float)
        m, last, block = np.ones(len(p)), table.column("blocks")[0].as_py() == 1, table.column("block")[0].as_py()
        rng = np.random.default_rng([level, table.column("place")[0].as_py(), block])
        flying = len(p) - LANDING if block == 0 else len(p)  # a source's last block is its block 0
        if flying > 2:
            p = np.concatenate([fly(p[:flying], m[:flying], s[:flying], rng), p[flying:]])
        if last:
            p = land(p, m, s)
        table = table.take(pa.array(order)).select(names[:-1])
        return table.append_column("p", pa.array(p, pa.float64()))

    kind = dict(units.dtypes)["doc_id"]
    return units.select(*names).groupBy("place", "block").applyInArrow(run, _UNIT.format(kind=kind))


def decisions(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, doc_id, h, size, m, copies, source_size, target): how many copies of each unit of m equal rows are taken."""
    units = cut(sized(docs).groupBy("source", "doc_id", "h").agg(F.first("size").alias("size"), F.count("*").alias("m")))
    goals = cut(targets(units, weights, budget, most).withColumnRenamed("source", "of"))
    facts = goals.agg(F.count("*"), F.max("units")).first()
    side = F.broadcast(goals) if facts[0] <= BROADCAST_ROWS else goals
    rate = F.round(F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)), 12)
    rows = units.join(side, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate)
    wanted = F.round(F.col("m") * F.col("rate"), 9)
    blocks = F.ceil(F.col("units") / BLOCK)
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc_id", "h", F.lit(9)), F.col("blocks")))
    names = [x.split()[0] for x in _UNIT.split(", ")]
    rows = rows.withColumn("sure", F.floor(wanted)).withColumn("p", wanted - F.floor(wanted)).select(*names)
    settled = rows.filter("p <= 0")
    moving, level, most_blocks = rows.filter("p > 0"), 0, math.ceil((facts[1] or 0) / BLOCK)
    while True:
        moved = cut(_level(moving, level))
        settled = settled.unionByName(moved.filter("p <= 0 or p >= 1"))
        if most_blocks <= 1:
            break
        # two units of each block are left at most, so that BLOCK / 2 blocks make one
        moving = moved.filter("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / (BLOCK // 2))).withColumn("blocks", F.ceil(F.col("blocks") / (BLOCK // 2)))
        level, most_blocks = level + 1, math.ceil(most_blocks / (BLOCK // 2))
    found = settled.select("source", "doc_id", "h", "size", "m", (F.col("sure") + F.col("p").cast("long")).alias("copies"))
    return found.join(side.select("of", "source_size", "target"), F.col("source").eqNullSafe(F.col("of"))).drop("of")


def _repeated(rows: DataFrame, times: str, number: str) -> DataFrame:
    """Every row times times, numbered from 0; many copies of one row are dealt to many tasks in pieces."""
    few = rows.filter(F.col(times) <= PIECE).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1)))
    many = rows.filter(F.col(times) > PIECE).withColumn("__first", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(PIECE).cast("long"))))
    many = many.repartition("__first").withColumn(number, F.explode(F.sequence(F.col("__first"), F.least(F.col("__first") + (PIECE - 1), F.col(times) - 1))))
    return few.unionByName(many.drop("__first"))


def mixed(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    rows = cut(decisions(docs))
    own = F.floor(F.col("copies") / F.col("m")) + (F.col("row") < F.col("copies") % F.col("m")).cast("long")
    out = rows.filter("m = 1").withColumn("row", F.lit(0).cast("long")).unionByName(_repeated(rows.filter("m > 1"), "m", "row"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * own).alias("taken"))


def take(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs."""
    chosen = cut(decisions(docs).filter("copies > 0").select(F.col("source").alias("of"), F.col("doc_id").alias("id"), "h", "m", "copies"))
    side = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    rows = aliased(docs)
    same = aliased(docs, "doc_id").eqNullSafe(F.col("id")) & aliased(docs, "source").eqNullSafe(F.col("of")) & (F.col("own_hash") == F.col("h"))
    found = rows.withColumn("own_hash", _row_hash(docs)).join(side, same)
    # a row that has no equal is taken MOST times at most
    out = found.filter("m = 1").select(*rows.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("n")).drop("n")
    if not chosen.filter("m > 1").isEmpty():  # rows that are equal in every column: one of them, as often as all are taken
        units = found.filter("m > 1").groupBy("of", "id", "h").agg(F.first(F.struct(*rows.columns)).alias("row"), F.first("copies").alias("copies"))
        out = out.unionByName(_repeated(units, "copies", "n").select("row.*"))
    return named(out, docs)
