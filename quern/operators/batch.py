"""Batch algebra on frames with an explicit position column.

Rows of a frame have no order; every operator here takes the column that holds a row's position (0, 1, ...) and gives a frame
with the same column. Where positions must be made, they are counted per range of the order and not in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.lineage import cut

POS = "pos"


def positions(df: DataFrame, *order: str | Column, pos: str = POS) -> DataFrame:
    """df with positions in a total order. Ranges of the order are sorted in parallel; each range's offset is the rows before it.

    The sorted ranges are materialised: offsets and rows must come from the same ranges, and those depend on samples."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__mid", F.monotonically_increasing_id()))
    part, within = F.shiftright("__mid", 33), F.col("__mid").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    offsets = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))  # one row a part
    return dealt.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(pos, F.col("__before") + within).drop("__part", "__mid", "__before")


def count(df: DataFrame) -> int:
    return df.count()


def pop(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(the columns, the rest); a missing column raises."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no columns {missing}")
    return df.select(*columns), df.drop(*columns)


def rename(df: DataFrame, old: list[str] | str, new: list[str] | str) -> DataFrame:
    old, new = ([x] if isinstance(x, str) else list(x) for x in (old, new))
    if len(old) != len(new):
        raise ValueError(f"{len(old)} old and {len(new)} new names")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def select_mask(df: DataFrame, mask: Column, pos: str = POS) -> DataFrame:
    """Rows where the mask holds, in order, with new positions."""
    return positions(df.filter(mask), pos, pos="__new").drop(pos).withColumnRenamed("__new", pos)


def select_idxs(df: DataFrame, index: DataFrame, pos: str = POS) -> DataFrame:
    """index (idx, out_pos): the rows at idx, in the order of out_pos; an idx may come repeatedly."""
    return index.join(df, index["idx"] == df[pos]).drop("idx", pos).withColumnRenamed("out_pos", pos)


def reorder(df: DataFrame, permutation: DataFrame, pos: str = POS) -> DataFrame:
    """permutation (idx, out_pos) of all rows."""
    return select_idxs(df, permutation, pos)


def restore(df: DataFrame, permutation: DataFrame, pos: str = POS) -> DataFrame:
    """Undo reorder."""
    return permutation.join(df, permutation["out_pos"] == df[pos]).drop("out_pos", pos).withColumnRenamed("idx", pos)


def take_slice(df: DataFrame, start: int = 0, end: int | None = None, step: int = 1, pos: str = POS) -> DataFrame:
    inside = (F.col(pos) >= start) & ((F.col(pos) - start) % step == 0)
    inside = inside if end is None else inside & (F.col(pos) < end)
    return df.filter(inside).withColumn(pos, F.floor((F.col(pos) - start) / step))


def repeat(df: DataFrame, n: int, interleave: bool = True, pos: str = POS) -> DataFrame:
    """Each row n times: a row's copies together, or the whole frame n times over."""
    rows = df.withColumn("__rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if interleave:
        return rows.withColumn(pos, F.col(pos) * n + F.col("__rep")).drop("__rep")
    total = F.broadcast(df.agg(F.count("*").alias("__n")))  # one row
    return rows.join(total).withColumn(pos, F.col("__rep") * F.col("__n") + F.col(pos)).drop("__rep", "__n")


def repeat_by(df: DataFrame, times: str, pos: str = POS) -> DataFrame:
    """Each row as often as its own count says; 0 drops it. Copies are numbered by ``rep``."""
    return df.filter(F.col(times) > 0).withColumn("rep", F.explode(F.sequence(F.lit(0), (F.col(times) - 1).cast("int"))))


def unfold_chunks(df: DataFrame, n: int, arrays: list[str], pos: str = POS) -> DataFrame:
    """Each row becomes n rows with the n equal slices of its arrays; other columns are repeated."""
    rows = df.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    width = F.floor(F.size(arrays[0]) / n).cast("int")
    cut = {a: F.slice(a, F.col("__i") * width + 1, width) for a in arrays}
    return rows.withColumns(cut).withColumn(pos, F.col(pos) * n + F.col("__i")).drop("__i")


def fold(df: DataFrame, k: int, columns: list[str], pos: str = POS) -> DataFrame:
    """k rows in a row become one with arrays of the columns."""
    rows = df.groupBy(F.floor(F.col(pos) / k).alias(pos)).agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("__p"), *columns))).alias("__a"))
    return rows.select(pos, *(F.col(f"__a.{c}").alias(c) for c in columns))


def unfold(df: DataFrame, k: int, columns: list[str], pos: str = POS) -> DataFrame:
    """Undo fold; the last row may be short."""
    rows = df.select(pos, F.posexplode(F.arrays_zip(*columns)).alias("__i", "__z"))
    return rows.select((F.col(pos) * k + F.col("__i")).alias(pos), "__z.*")


def chunk(df: DataFrame, k: int, pos: str = POS, even: bool = True) -> DataFrame:
    """df with ``chunk``, one of k equal ones; a number of rows that k doesn't divide raises. Without ``even`` the rows that are left
    over come after the k chunks, in chunks of the same size or less; fewer than k rows have a null chunk."""
    total = F.broadcast(df.agg(F.count("*").alias("__n")))  # one row
    size = F.floor(F.col("__n") / k)
    if even:
        size = F.when(F.col("__n") % k == 0, size).otherwise(F.raise_error(F.lit(f"the rows are no multiple of {k}")).cast("long"))
    return df.join(total).withColumn("chunk", F.floor(F.try_divide(F.col(pos), size))).drop("__n")


def split(df: DataFrame, size: int, pos: str = POS) -> DataFrame:
    """df with ``part`` of size rows each; the last may be short."""
    return df.withColumn("part", F.floor(F.col(pos) / size))


def batches(df: DataFrame, size: int, drop_last: bool = True, pos: str = POS) -> DataFrame:
    """df with ``batch``; the short last one is dropped if asked."""
    rows = split(df, size, pos).withColumnRenamed("part", "batch")
    if not drop_last:
        return rows
    total = F.broadcast(df.agg(F.count("*").alias("__n")))  # one row
    return rows.join(total).filter(F.col("batch") < F.floor(F.col("__n") / size)).drop("__n")


def mini_batches(df: DataFrame, size: int, epochs: int, seed: int = 0, pos: str = POS) -> DataFrame:
    """(epoch, batch, ...): every row once an epoch, each epoch in its own seeded order."""
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    numbered = positions(rows, "epoch", F.xxhash64(pos, "epoch", F.lit(seed)), F.col(pos), pos="__at")
    total = F.broadcast(df.agg(F.count("*").alias("__n")))  # one row
    return numbered.join(total).withColumn("batch", F.floor((F.col("__at") - F.col("epoch") * F.col("__n")) / size)).drop("__at", "__n")


def pad_to_divisor(df: DataFrame, d: int, pos: str = POS) -> DataFrame:
    """df with leading rows repeated behind it until d divides the rows; ``padding`` marks them."""
    n = df.count()
    pad = -n % d if n else 0
    rows = df.withColumn("padding", F.lit(False))
    if not pad:
        return rows
    extra = df.filter(F.col(pos) < min(pad, n)).withColumn("__k", F.explode(F.sequence(F.col(pos).cast("int"), F.lit(pad - 1), F.lit(n))))
    return rows.unionByName(extra.withColumn(pos, F.lit(n) + F.col("__k")).drop("__k").withColumn("padding", F.lit(True)))


def unpad(df: DataFrame, padding: str = "padding") -> DataFrame:
    return df.filter(~F.col(padding)).drop(padding)


def pad_boundary(df: DataFrame, size: int, first: bool, pos: str = POS) -> DataFrame:
    """size more rows behind df, copies of its first or last row."""
    n = df.count()
    edge = df.filter(F.col(pos) == (0 if first else n - 1)).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return df.unionByName(edge.withColumn(pos, F.lit(n) + F.col("__k")).drop("__k")) if size else df


def concat(frames: list[DataFrame], pos: str = POS) -> DataFrame:
    """The frames behind each other; all must have the same columns."""
    first, *others = frames
    for x in others:
        if sorted(x.columns) != sorted(first.columns):
            raise ValueError(f"columns differ: {sorted(x.columns)} and {sorted(first.columns)}")
    out, n = first, first.count()
    for x in others:
        out = out.unionByName(x.withColumn(pos, F.col(pos) + n))
        n += x.count()
    return out


def union_columns(left: DataFrame, right: DataFrame, pos: str = POS) -> DataFrame:
    """Columns of both, row by row. Where both have a column its values must be equal (NaN equals NaN, null equals null)."""
    shared = [c for c in right.columns if c in left.columns and c != pos]
    other = right.withColumnsRenamed({c: f"__{c}" for c in shared})
    rows = left.withColumn("__l", F.lit(1)).join(other.withColumn("__r", F.lit(1)), pos, "full")
    same = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    for c in shared:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    checked = F.when(same, F.col(pos)).otherwise(F.raise_error(F.lit("the frames don't agree")).cast(dict(left.dtypes)[pos]))
    return rows.withColumn(pos, checked).drop("__l", "__r", *(f"__{c}" for c in shared))


def zip_rows(left: DataFrame, right: DataFrame, pos: str = POS) -> DataFrame:
    """Rows of right beside those of left at the same position; null where right is shorter."""
    return left.join(right, pos, "left")


def position_ids(df: DataFrame, seq: str, mask: str = "mask", pos: str = POS) -> DataFrame:
    """df with ``position_id``: the valid places up to here, less one, at least 0."""
    upto = W.partitionBy(seq).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("position_id", F.greatest(F.sum(mask).over(upto) - 1, F.lit(0)))


def interleave_ends(df: DataFrame, cost: str, key: str) -> DataFrame:
    """df with ``place``: ascending in cost, every other row from the front, the rest behind them in reverse."""
    rows = positions(df, cost, key, pos="__r")
    total = F.broadcast(df.agg(F.count("*").alias("__n")))  # one row
    half = F.floor((F.col("__n") + 1) / 2)
    place = F.when(F.col("__r") % 2 == 0, F.floor(F.col("__r") / 2)).otherwise(half + F.floor(F.col("__n") / 2) - 1 - F.floor(F.col("__r") / 2))
    return rows.join(total).withColumn("place", place).drop("__r", "__n")


def run_groups(df: DataFrame, seq: str, kind: str, pos: str = POS) -> DataFrame:
    """df with ``run``: consecutive rows of the same kind share a number, from 0."""
    order = W.partitionBy(seq).orderBy(pos)
    change = F.coalesce((~F.lag(kind).over(order).eqNullSafe(F.col(kind))).cast("int"), F.lit(0))
    rows = df.withColumn("__c", F.when(F.row_number().over(order) == 1, 0).otherwise(change))
    return rows.withColumn("run", F.sum("__c").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("__c")
