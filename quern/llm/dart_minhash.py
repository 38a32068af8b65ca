"""Near-duplicate classes of documents by DartMinHash signatures over five-word shingles.

A text is a weighted set of shingles (``width`` words in a row; a shorter text is one shingle of all its words): each weighs as
often as it comes, or 1 if ``weighted`` is False. Onto the plane of weight and rank over each shingle, darts fall at random but fixed places, one on average per unit of
area; the darts below an element's weight and with a rank below a bound hit the text. Each dart belongs to one of ``K``
coordinates, and a text's signature keeps the earliest dart of every coordinate. The bound on the rank falls with the text's
total weight, so that a text of any length is hit by about K ln K darts, and grows for texts that left a coordinate empty.
Two texts agree in a coordinate with the probability of their (weighted) Jaccard similarity.

Texts that are equal are contracted first. ``BANDS`` bands of ``ROWS`` coordinates each name a bucket. In a bucket each text is
compared to two centres, the text that shares most buckets with others and the smallest one, and small buckets are compared
fully. Links become classes by alternating star steps (large star, small star) on distributed tables. Then every two texts of a
larger bucket that are still of different classes are compared, in blocks of bounded size, so that of all texts that meet
in a bucket no two are left uncompared unless they are of one class already; only these comparisons grow with the square of a
bucket's unlinked rest, their results don't: a block tells which of its texts have a near one of another class, and with their sets
the links that join such classes. A comparison counts equal bytes of the signatures: what lies clearly below the threshold (``BELOW`` standard
deviations) is no link, and everything else is decided by the exact (weighted) Jaccard similarity of both shingle sets, so every
link is exact. Texts with many comparisons are dealt to several tasks for them.

Cases: null texts and texts without a word link to nothing and are classes of their own; equal texts are always one class;
null and repeated ids are allowed (rows with the same text share a class whatever their ids; a class id is the smallest id in
the class, null if it has none); very long texts are read whole; an empty table gives no rows; other columns, whatever their
names, don't matter to the classes, and keep_one returns them as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import aliased, cut, map_arrow, named, owned, parts

WIDTH = 5
THRESHOLD = 0.8
#: Bands and the coordinates of each: a pair at 0.8 meets in no bucket with a probability below 2e-5.
BANDS, ROWS = 36, 6
K = BANDS * ROWS
#: Buckets of up to so many texts are compared pair by pair.
SMALL_BUCKET = 5
#: Texts of a block, about, when the unlinked rest of a larger bucket is compared.
BLOCK = 512
#: Distance below the threshold, in standard deviations of the estimate, from which on the estimate decides.
BELOW = 4.0
#: Comparisons of one text that meet in one task.
TOGETHER = 4096
#: Rows (of 40 bytes at most) of a side that may be broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 200_000

_M1, _M2, _GOLD = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
#: Rank cells: [0, 2^-12), then doubling ones up to 1, then unit ones. Ranks are numbers of 2^-28.
_DOUBLING, _UNIT = 12, 28


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def _cells(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length in ranks of the first n cells, and for each the chances (as 32 bits) of at most 0, 1, ... darts."""
    start = [0, *(1 << (_UNIT - _DOUBLING + i) for i in range(_DOUBLING))]
    length = [1 << (_UNIT - _DOUBLING), *start[1:]]
    start += [c << _UNIT for c in range(1, max(1, n - _DOUBLING))]
    length += [1 << _UNIT] * (len(start) - len(length))
    start, length = np.array(start[:n], np.uint64), np.array(length[:n], np.uint64)
    area = length.astype(float) / (1 << _UNIT)
    chance = np.exp(-area)[:, None] * np.cumprod(np.concatenate([np.ones((len(area), 1)), area[:, None] / np.arange(1, 13)], 1), 1)
    return start, length, np.minimum(np.cumsum(chance, 1) * 2.0**32, 2.0**32).astype(np.uint64)


_CELLS: dict[int, tuple] = {}


def _throw(elements: np.ndarray, limits: np.ndarray | None, owner: np.ndarray, cells: int, k: int) -> np.ndarray:
    """Of all darts that hit: owner * k + coordinate in the upper 24 bits, the rank in the lower 40."""
    if cells not in _CELLS:
        _CELLS[cells] = _cells(cells)
    start, length, chance = _CELLS[cells]
    names = _mix(np.arange(1, cells + 1, dtype=np.uint64) * _GOLD)
    found = []
    step = max(1, (1 << 20) // cells)
    for a in range(0, len(elements), step):
        h = _mix(elements[a : a + step, None] ^ names[None, :])
        u = h >> np.uint64(32)
        row, cell = np.nonzero(u >= chance[None, :, 0])
        h, u = h[row, cell], u[row, cell]
        n = np.ones(len(h), np.int64)
        for j in range(1, 12):
            more = u >= chance[cell, j]
            if not more.any():
                break
            n += more
        at = np.repeat(np.arange(len(h)), n)
        number = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        dart = _mix(h[at] + (number + 1).astype(np.uint64) * _GOLD)
        rank = start[cell[at]] + (((dart >> np.uint64(36)) * length[cell[at]]) >> np.uint64(28))
        other = _mix(dart + _M1)
        own = a + row[at]
        packed = ((owner[own].astype(np.uint64) * np.uint64(k) + (other >> np.uint64(40)) % np.uint64(k)) << np.uint64(40)) | rank
        if limits is not None:
            packed = packed[(other & np.uint64(0xFFFFFF)).astype(float) / 2**24 < limits[own]]
        found.append(packed)
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def signatures(sets: list[tuple[np.ndarray, np.ndarray | None]], k: int = K) -> np.ndarray:
    """The signatures (one row of k ranks each) of non-empty sets (elements, weights or None for ones)."""
    out = np.zeros((len(sets), k), np.uint64)
    darts = k * (math.log(k) + 4)
    bound: dict[int, list[int]] = {}
    for i, (elements, weights) in enumerate(sets):
        reach = darts / (len(elements) if weights is None else float(weights.sum()))
        bound.setdefault(max(-_DOUBLING, math.ceil(math.log2(reach))), []).append(i)
    while bound:
        again: dict[int, list[int]] = {}
        for power, members in bound.items():
            cells = _DOUBLING + 1 + power if power <= 0 else _DOUBLING + (1 << power)
            for first in range(0, len(members), 4096):
                own = members[first : first + 4096]
                parts, limits, owner = [], [], []
                for j, i in enumerate(own):
                    elements, weights = sets[i]
                    if weights is not None:  # slices of weight one, the last one partly
                        slices = np.ceil(weights).astype(np.int64)
                        which = np.repeat(np.arange(len(elements)), slices)
                        number = np.arange(len(which)) - np.repeat(np.cumsum(slices) - slices, slices)
                        limits.append(weights[which] - number)
                        elements = np.where(number == 0, elements[which], _mix(elements[which] + number.astype(np.uint64) * _M2))
                    else:
                        limits.append(np.ones(len(elements)))
                    parts.append(elements)
                    owner.append(np.full(len(elements), j))
                limit = np.concatenate(limits)
                packed = np.sort(_throw(np.concatenate(parts), None if (limit >= 1).all() else limit, np.concatenate(owner), cells, k))
                key = (packed >> np.uint64(40)).astype(np.int64)
                head = np.ones(len(key), bool)
                head[1:] = key[1:] != key[:-1]
                key, rank = key[head], packed[head] & np.uint64((1 << 40) - 1)
                out[np.array(own)[key // k], key % k] = rank + np.uint64(1)
                full = np.bincount(key // k, minlength=len(own)) == k
                if not full.all():
                    again.setdefault(power + 1, []).extend(np.array(own)[~full].tolist())
        bound = again
    return out


# --- shingles -----------------------------------------------------------------------------------------------------


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """The hashes of a text's shingles in order, with repetitions."""
    words = text.encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(owned("shingles", _Hashes).__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    if not width:
        return h
    out = np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):
        out = _mix(out + h[j : len(h) - width + 1 + j] + np.uint64(j + 1))
    return out


def _sign(texts: list[str], width: int, weighted: bool) -> list[tuple[bytes, bytes] | None]:
    """Band hashes and signature bytes of each text, or None without words."""
    sets, at = [], []
    for i, text in enumerate(texts):
        elements = shingle_hashes(text, width)
        if len(elements):
            elements, n = np.unique(elements, return_counts=True)
            sets.append((elements, n.astype(float) if weighted and n.max() > 1 else None))
            at.append(i)
    out: list[tuple[bytes, bytes] | None] = [None] * len(texts)
    if sets:
        found = signatures(sets)
        bands = np.zeros((len(sets), BANDS), np.uint64)
        for j in range(ROWS):
            bands = _mix(bands * _GOLD + found[:, j::ROWS])
        bands = _mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD)
        short = (_mix(found) & np.uint64(0xFF)).astype(np.uint8)
        for i, b, s in zip(at, bands, short, strict=True):
            out[i] = b.tobytes(), s.tobytes()
    return out


_HAS_WORD = r"[^ \t\n\x0B\f\r]"


def _key(text: str):
    return F.unhex(F.md5(F.col(text)))


def _vertices(docs: DataFrame, width: int, weighted: bool) -> DataFrame:
    """(h, doc_id, bands, sig): one row for each different text with words; doc_id is the smallest."""
    rows = docs.filter(F.col("text").rlike(_HAS_WORD)).select(_key("text").alias("h"), "doc_id", "text")
    schema = T.StructType([*rows.drop("text").schema.fields, T.StructField("bands", T.BinaryType()), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            bands, sig = zip(*_sign(part.column("text").to_pylist(), width, weighted), strict=True)
            yield pa.RecordBatch.from_arrays([part.column("h"), part.column("doc_id"), pa.array(bands, pa.binary()), pa.array(sig, pa.binary())], names=schema.names)

    signed = map_arrow(rows, run, schema)
    return signed.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))


def _buckets(vertices: DataFrame) -> DataFrame:
    """(h, key): the buckets of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 4096):
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("h").take(np.repeat(np.arange(batch.num_rows), BANDS)), pa.array(keys)], names=["h", "key"])

    return map_arrow(vertices.select("h", "bands"), run, "h binary, key long")


def _shared(vertices: DataFrame) -> DataFrame:
    """(key, h, n) of the buckets of n > 1 texts, materialised."""
    rows = _buckets(vertices)
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return cut(rows.join(sizes, "key"))


def _candidates(shared: DataFrame) -> DataFrame:
    """Different pairs (a, b), a < b, of texts to compare first."""
    popular = shared.groupBy("h").agg(F.sum("n").alias("popularity"))
    centres = shared.join(popular, "h").groupBy("key").agg(F.max_by("h", F.struct("popularity", "h")).alias("c"), F.min("h").alias("d"))
    stars = shared.join(centres, "key").select("h", F.explode(F.array("c", "d")).alias("other"))
    few = shared.filter(F.col("n") <= SMALL_BUCKET)
    pairs = few.join(few.select("key", F.col("h").alias("other")), "key").filter("h < other").select("h", "other")
    edges = stars.unionByName(pairs).filter("h != other")
    return edges.select(F.least("h", "other").alias("a"), F.greatest("h", "other").alias("b")).distinct()


def _near(table: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of one bucket's blocks i and j: places (x, y) of texts of different classes with at least this estimate, and the estimates."""
    i, j, own = table.column("i")[0].as_py(), table.column("j")[0].as_py(), table.column("own").to_numpy()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, K)
    number: dict[bytes, int] = {}
    cls = np.array([number.setdefault(r, len(number)) for r in table.column("root").to_pylist()])
    for c in np.unique(cls[own == i]):
        x, y = np.flatnonzero((own == i) & (cls == c)), np.flatnonzero((own == j) & (cls > c if i == j else cls != c))
        step = max(1, (1 << 24) // (K * max(1, len(y))))
        for first in range(0, len(x) if len(y) else 0, step):
            some = x[first : first + step]
            found = (np.count_nonzero(sig[some, None, :] == sig[None, y, :], axis=2) / K - 1 / 256) / (1 - 1 / 256)
            p, q = np.nonzero(found >= least)
            yield some[p], y[q], found[p, q]


def _met(table: pa.Table, least: float) -> pa.Table:
    """The texts of one bucket's blocks that have a near one of another class there."""
    found = [np.concatenate([x, y]) for x, y, _ in _near(table, least)]
    at = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return table.select(["key", "i", "j", "own", "h"]).take(pa.array(at, pa.int64()))


def _joined(table: pa.Table, least: float, threshold: float) -> pa.Table:
    """Of such texts with their sets: links that join their classes, each confirmed by the sets; none between classes joined already."""
    h, sets = table.column("h").to_pylist(), [np.frombuffer(s, np.uint64) for s in table.column("s").to_pylist()]
    parent = {r: r for r in table.column("root").to_pylist()}
    root, a, b = table.column("root").to_pylist(), [], []

    def find(r: bytes) -> bytes:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    near = [np.concatenate(x) for x in zip(*_near(table, least), strict=True)] or [np.empty(0, np.int64)] * 3
    for k in np.argsort(-near[2], kind="stable").tolist():
        x, y = int(near[0][k]), int(near[1][k])
        p, q = find(root[x]), find(root[y])
        if p != q and _alike(sets[x], sets[y], threshold):
            parent[max(p, q)] = min(p, q)
            a.append(min(h[x], h[y]))
            b.append(max(h[x], h[y]))
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _alike(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= threshold * (len(x) + len(y) - both)


def _unlinked(shared: DataFrame, vertices: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(key, i, j, own, h, root, sig) of all texts in larger buckets of several classes, dealt into pairs of blocks."""
    large = shared.filter(F.col("n") > SMALL_BUCKET).join(roots, "h")
    mixed = large.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("key")
    rows = large.join(mixed, "key").join(vertices.select("h", "sig"), "h").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("h"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "h", "root", "sig")


def _estimate(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """pairs with the similarity that the signatures' bytes tell."""
    sig = vertices.select("h", "sig")
    rows = pairs.join(sig.select(F.col("h").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("h").alias("b"), F.col("sig").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 4096):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, K) for c in ("sa", "sb"))
            near = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near)], names=["a", "b", "near"])

    return map_arrow(rows.select("a", "b", "sa", "sb"), run, "a binary, b binary, near double")


def _sets(wanted: DataFrame, vertices: DataFrame, docs: DataFrame, width: int, weighted: bool) -> DataFrame:
    """(h, s) of the wanted texts (h): their different shingles, and if weighted their second, third, ... occurrences as elements of their
    own, materialised. Of equal texts only the one with the smallest id is read."""
    wanted = cut(wanted.distinct().join(vertices, "h").select(F.col("h").alias("k"), F.col("doc_id").alias("id")))
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    own = docs.filter(F.col("text").rlike(_HAS_WORD)).select(_key("text").alias("h"), "doc_id", "text")
    texts = own.join(side, (F.col("h") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [_elements(x, width, weighted).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(found, pa.binary())], names=["h", "s"])

    return cut(map_arrow(texts.select("h", "text"), sets, "h binary, s binary").groupBy("h").agg(F.first("s").alias("s")))


def _elements(text: str, width: int, weighted: bool) -> np.ndarray:
    """The set whose Jaccard similarities are those of the text's (weighted) shingles."""
    keys, n = np.unique(shingle_hashes(text, width), return_counts=True)
    if not weighted or n.max() == 1:
        return keys
    number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    keys = np.repeat(keys, n)
    return np.unique(np.where(number == 0, keys, _mix(keys + number.astype(np.uint64) * _M2)))


def _verified(pairs: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose shingle sets (of own) have the threshold's similarity. A centre's comparisons meet in many tasks, each with a copy
    of its set."""
    rows = pairs.select("a", "b")
    hot = cut(rows.select(F.explode(F.array("a", "b")).alias("of")).groupBy("of").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("tasks")).filter("tasks > 1"))
    many = hot.count()
    hot = F.broadcast(hot) if many <= BROADCAST_ROWS else hot
    dealt = lambda df, key: df.join(hot, F.col(key) == F.col("of"), "left").drop("of").withColumn("tasks", F.coalesce("tasks", F.lit(1))) if many else df.withColumn("tasks", F.lit(1))
    for c, other in (("a", "b"), ("b", "a")):
        left = dealt(rows, c).withColumn("task", F.pmod(F.xxhash64(other), F.col("tasks")).cast("int")).drop("tasks")
        right = dealt(own, "h").select(F.col("h").alias(c), F.col("s").alias(f"s{c}"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
        rows = left.join(right, [c, "task"]).drop("task")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = zip(*(batch.column(c).to_pylist() for c in ("sa", "sb")), strict=True)
            keep = [_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) for x, y in sets]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(rows.select("a", "b", "sa", "sb"), compare, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): the smallest node that it is connected to."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    seen = None
    while True:
        state = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = cut(small.select("e.u", "e.v").filter("u != v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (h, root) after the classes of further links (a, b) have become one, materialised."""
    ends = links.select("a", "b").join(roots.toDF("a", "ra"), "a").join(roots.toDF("b", "rb"), "b")
    joined = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    return cut(roots.join(joined.toDF("root", "least"), "root", "left").select("h", F.coalesce("least", "root").alias("root")))


def _classes(docs: DataFrame, threshold: float, width: int, weighted: bool) -> DataFrame:
    """(h, doc_id, root) of each different text with words, materialised."""
    vertices = cut(_vertices(docs, width, weighted))
    shared, least = _shared(vertices), threshold - BELOW * math.sqrt(threshold * (1 - threshold) / K)
    near = cut(_estimate(_candidates(shared), vertices).filter(F.col("near") >= least).select("a", "b"))
    sets = _sets(near.select(F.explode(F.array("a", "b")).alias("h")), vertices, docs, width, weighted)
    roots = components(_verified(near, sets, threshold))
    roots = cut(vertices.select("h").join(roots.withColumnRenamed("node", "h"), "h", "left").select("h", F.coalesce("root", "h").alias("root")))
    met = _unlinked(shared, vertices, roots, least).groupBy("key", "i", "j").applyInArrow(lambda table: _met(table, least), "key long, i long, j long, own long, h binary")
    met = cut(met)
    if not met.isEmpty():
        sets = _sets(met.select("h"), vertices, docs, width, weighted)
        rows = met.join(sets, "h").join(roots, "h").join(vertices.select("h", "sig"), "h")
        links = cut(rows.groupBy("key", "i", "j").applyInArrow(lambda table: _joined(table, least, threshold), "a binary, b binary").distinct())
        if not links.isEmpty():
            roots = _merged(roots, links)
    return cut(vertices.select("h", "doc_id").join(roots, "h"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, weighted: bool = True) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id of its class), and class_size."""
    docs = docs.select("doc_id", "text")
    found = _classes(docs, threshold, width, weighted)
    rows = docs.select("doc_id", F.when(F.col("text").rlike(_HAS_WORD), _key("text")).alias("h"))
    copies = rows.filter("h is not null").groupBy("h").agg(F.count("*").alias("n"))
    sized = found.join(copies, "h")
    totals = sized.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"))
    classes = found.select("h", "root").join(totals, "root").drop("root")
    linked = rows.filter("h is not null").join(classes, "h").select("doc_id", "class_id", "class_size")
    return linked.unionByName(rows.filter("h is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, weighted: bool = True) -> DataFrame:
    """The rows of docs without a word, and of each class the one with the smallest id; the columns are those of docs."""
    rows = aliased(docs)
    doc_id, text = aliased(docs, "doc_id"), aliased(docs, "text")
    found = _classes(rows.select(doc_id.alias("doc_id"), text.alias("text")), threshold, width, weighted)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("k"))
    kept = cut(first.select(F.col("k.h").alias("h"), F.col("k.doc_id").alias("id")))
    worded, key = text.rlike(_HAS_WORD), F.unhex(F.md5(text))
    side = F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept
    one = rows.filter(worded).withColumn("key", key).join(side, (F.col("key") == F.col("h")) & doc_id.eqNullSafe(F.col("id")))
    # rows that repeat both id and text are rare; only where there are any is one of them picked: the least in its other columns
    light = rows.filter(worded).select(key.alias("key"), doc_id.alias("id")).groupBy("key", "id").agg(F.count("*").alias("n")).filter("n > 1")
    if not light.isEmpty():
        plain = [f"__{i}" for i, (_, kind) in enumerate(docs.dtypes) if "map<" not in kind]
        order = F.struct(*(c for c in plain if c not in (f"__{docs.columns.index('text')}", f"__{docs.columns.index('doc_id')}")), F.lit(1))
        one = one.groupBy("key", "id").agg(F.min_by(F.struct(*rows.columns), order).alias("row")).select("row.*")
    return named(one.select(*rows.columns).unionByName(rows.filter(~F.coalesce(worded, F.lit(False)))), docs)
