"""Toxicity by two class-conditional Kneser-Ney models with shared backoff counts.

Expressions are words and pairs of neighbouring words (lower-cased, whole, told apart by 32-bit hashes). Both are counted by
their occurrences in either class; the lower order keeps them, since Kneser-Ney's continuation counts (of different words before)
lost a quarter of the toxic documents here. Every expression of every labelled training document stays in the model. For an order
(words or pairs) with counts n_0, n_1 in the classes and n in both, and sums N_0, N_1, N

    S(x)   = (n(x) - d) / N                                              shared; the rest is for the unseen
    K_c(x) = max(n_c(x) - DISCOUNT, 0) / N_c + R_c S(x)                  of class c; R_c is the mass of its discounts
    P_c(x) = SHARED S(x) + (1 - SHARED) K_c(x)

with d = ones / (ones + 2 twos), at most 0.95, of the numbers of expressions seen once and twice in both classes. A rare expression's
discounted counts vanish in both classes, so it backs off to the counts that they share and says little. A text's value is

    (sum of log P_1(w) / P_0(w) over its words + PAIRS x sum of log P_1(vw) / P_0(vw) over its seen pairs) / (words + PRIOR)

an unseen word has the unseen mass in both classes, an unseen pair backs off to its words alone. An ascending curve fitted to
the values of a further fold of labelled documents (isotonic regression on a histogram of fixed size) turns a value into a
score from 0 to 1.

The model is a table of expressions, dealt into chunks by a hash; the number of chunks follows the bytes of text. Scorers get
a part of fixed size: of each slot of a hash table the most frequent expression, and a bit filter of all. What a text has of
that part is summed where the text is read; the rest that passes the filter is dealt by chunk and joined with the whole
table, and the sums return to the text's segment (at most ``SEGMENT`` rows of a partition). So frequent expressions are never
shuffled, and rare ones never broadcast; the parts' sizes change the ways, not the scores.

Cases: null and empty texts and texts without a word count as surely ordinary; labels that are null, and rows without a label,
don't train; a repeated row counts as often as it is there, a document with several labels once for each; without any
trainable label every score is 0; very long texts are read whole; an empty table gives no rows; other columns, whatever their
names, don't matter to the scores, and keep_ordinary returns them as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import aliased, cut, fold, map_arrow, named, owned, parts, scratch, tidy

#: Part of the shared counts in both classes, and the discount of a class's own counts.
SHARED, DISCOUNT = 0.98, 4.0
#: Weight of pairs beside words, and words without evidence that every text is taken to have besides its own.
PAIRS, PRIOR = 0.3, 30
#: Bytes of text for a chunk of the model, and chunks at least.
CHUNK_BYTES, LEAST_CHUNKS = 128 << 20, 64
#: Bits of the numbers of slots and of filter bits that scorers get: (words, pairs).
SLOT_BITS, FILTER_BITS = (18, 20), (24, 26)
#: Rows of a segment, and pairs that a counting task holds, about.
SEGMENT, HELD = 16_384, 4_000_000
#: Folds that labels are split by: fold 0 is held out, fold 1 fits the curve, the others are counted.
FOLDS = 5
#: Labelled rows (20 bytes each) and keys of rejected texts that may be broadcast; more are joined by shuffling.
BROADCAST_ROWS = 1_000_000
#: Bins on either side of 0 of the histogram that the curve is fitted to: steps of the inverse hyperbolic sine of value / _UNIT.
BINS, _STEP, _UNIT = 4096, 1 / 256, 1e-4
_WORDS_OF = {"words": 0, "pairs": 1}
#: Contexts that no word has: that of a word alone, and a text's start.
_ALONE, _START, _LAST_WORD = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFF0
_FIND = re.compile(r"\w+").findall
_U = np.uint64


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) % _LAST_WORD
        return found


def word_ids(text: str) -> np.ndarray:
    words = _FIND(text.lower())
    return np.fromiter(map(owned("toxic words", _Hashes).__getitem__, words), np.uint64, len(words))


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts in order, the pairs that end in them, and the number of words of each text."""
    each = [word_ids(x or "") for x in texts]
    n = np.array([len(x) for x in each], np.int64)
    ids = np.concatenate(each) if each else np.empty(0, np.uint64)
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = _START
    return ids | _U(_ALONE << 32), before << _U(32) | ids, n


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def _chunk(mixed: np.ndarray, chunks: int) -> np.ndarray:
    """Chunks are ranges of mixed keys, as slots and filter bits are."""
    return ((mixed >> _U(32)) * _U(chunks) >> _U(32)).astype(np.int64)


# --- tables of expressions as blobs ---------------------------------------------------------------------------------

#: A blob row: ascending keys, the upper half as differences (they repeat), and the counts of each; of pairs n is the sum of the others.
_TABLE = "chunk int, kind string, upper binary, lower binary, n0 binary, n1 binary, n binary"
_NAMES = [x.split()[0] for x in _TABLE.split(", ")]


_ZSTD = pa.Codec("zstd", compression_level=3)


def _bytes(x: np.ndarray) -> bytes:
    """Compressed, behind the number of bytes."""
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def _array(x: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(x[:8], "little")
    return np.frombuffer(_ZSTD.decompress(x[8:], size, asbytes=True) if size else b"", kind)


def _packed(keys: np.ndarray) -> tuple[bytes, bytes]:
    return _bytes(np.diff((keys >> _U(32)).astype("<i8"), prepend=0).astype("<u4")), _bytes((keys & _U(0xFFFFFFFF)).astype("<u4"))


def _keys(upper: bytes, lower: bytes) -> np.ndarray:
    return np.cumsum(_array(upper, "<u4").astype(np.uint64)).astype(np.uint64) << _U(32) | _array(lower, "<u4").astype(np.uint64)


def _blobs(kind: str, keys: np.ndarray, counts: tuple[np.ndarray, ...], chunks: int) -> Iterator[pa.RecordBatch]:
    """The table as one row for each chunk that it has keys of."""
    chunk = _chunk(_mix(keys), chunks)
    order = np.lexsort((keys, chunk))
    keys, chunk, counts = keys[order], chunk[order], [x[order].astype("<i8") for x in counts]
    ends = [*np.flatnonzero(np.diff(chunk, prepend=-1)), len(keys)]
    rows = [(int(chunk[a]), kind, *_packed(keys[a:b]), *(_bytes(x[a:b]) for x in counts), *[None] * (3 - len(counts))) for a, b in zip(ends, ends[1:], strict=False)]
    if rows:
        types = [pa.int32(), pa.string(), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_NAMES)


def _summed(keys: np.ndarray, counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ascending different keys, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ _U(1)) != 0) if len(keys) else np.empty(0, np.int64)
    return keys[first], [np.add.reduceat(x[order], first) if len(first) else x for x in counts]


def _count(batches: Iterator[pa.RecordBatch], chunks: int) -> Iterator[pa.RecordBatch]:
    """The pairs of a partition with their numbers in both classes; again and again in a large partition."""
    held: list[tuple[np.ndarray, list[np.ndarray]]] = []
    size = 0

    def merged() -> tuple[np.ndarray, list[np.ndarray]]:
        return _summed(np.concatenate([k for k, _ in held]), [np.concatenate([c[i] for _, c in held]) for i in (0, 1)])

    for batch in parts(batches, 1024):
        _, pairs, n = _joined(batch.column("text").to_pylist())
        toxic = np.repeat(np.array(batch.column("cls").to_pylist(), np.int64), n)
        held.append(_summed(pairs, [1 - toxic, toxic]))
        size += len(held[-1][0])
        if size > HELD:
            held[:] = [merged()]
            size = len(held[0][0])
            if size > HELD // 2:
                yield from _blobs("pairs", held[0][0], tuple(held[0][1]), chunks)
                held, size = [], 0
    if held:
        keys, counts = merged()
        yield from _blobs("pairs", keys, tuple(counts), chunks)


def _read(table: pa.Table, kind: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The keys of this kind of all rows, and their three counts; ascending if there is one row."""
    rows = [r for r in table.to_pylist() if r["kind"] == kind]
    if not rows:
        return np.empty(0, np.uint64), [np.empty(0, np.int64)] * 3
    counts = [np.concatenate([_array(r[c], "<i8") for r in rows]) for c in (("n0", "n1", "n") if kind == "words" else ("n0", "n1"))]
    return np.concatenate([_keys(r["upper"], r["lower"]) for r in rows]), counts if kind == "words" else [*counts, sum(counts)]


def _merge(kind: str, chunks: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        keys, counts = _summed(*_read(table, kind))
        return pa.Table.from_batches(list(_blobs(kind, keys, tuple(counts if kind == "words" else counts[:2]), chunks)))

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of tables of pairs: how often each word ends one, in either class and in both."""
    for batch in parts(batches, 1):
        keys, (n0, n1, n) = _read(pa.Table.from_batches([batch]), "pairs")
        words, counts = _summed(keys & _U(0xFFFFFFFF), [n0, n1, n])
        yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), *map(pa.array, counts)], names=["w", "n0", "n1", "n"])


def _word_blobs(batches: Iterator[pa.RecordBatch], chunks: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            words = batch.column("w").to_numpy().astype(np.uint64) | _U(_ALONE << 32)
            yield from _blobs("words", words, tuple(batch.column(c).to_numpy() for c in ("n0", "n1", "n")), chunks)


# --- the model ------------------------------------------------------------------------------------------------------

_SUMS = ("types", "ones", "twos", "N0", "N1", "N", "over0", "over1")
_PART = "kind string, " + ", ".join(f"{x} double" for x in _SUMS) + ", keys binary, n0 binary, n1 binary, n binary, first long, bits binary"


def _part(batches: Iterator[pa.RecordBatch], slots: tuple[int, int], bits: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Of each table: its sums, the most frequent key of each slot, and its piece of the filter."""
    for batch in parts(batches, 1):
        kind = batch.column("kind")[0].as_py()
        keys, (n0, n1, n) = _read(pa.Table.from_batches([batch]), kind)
        slot_bits, filter_bits = slots[_WORDS_OF[kind]], bits[_WORDS_OF[kind]]
        mixed = _mix(keys)
        slot = mixed >> _U(64 - slot_bits)
        order = np.lexsort((keys, -n, slot))
        best = order[np.flatnonzero(np.diff(slot[order].astype(np.int64), prepend=-1))]
        at = (mixed >> _U(64 - filter_bits)).astype(np.int64)
        first = int(at.min()) // 8
        piece = np.zeros((int(at.max()) // 8 - first + 1) * 8, np.uint8)
        piece[at - first * 8] = 1
        sums = [len(n), (n == 1).sum(), (n == 2).sum(), n0.sum(), n1.sum(), n.sum(), np.maximum(n0 - DISCOUNT, 0).sum(), np.maximum(n1 - DISCOUNT, 0).sum()]
        row = [kind, *map(float, sums), _bytes(keys[best]), *(_bytes(x[best]) for x in (n0, n1, n)), first, _bytes(np.packbits(piece, bitorder="little"))]
        types = [pa.string(), *[pa.float64()] * len(_SUMS), *[pa.binary()] * 4, pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[x.split()[0] for x in _PART.split(", ")])


class Order:
    """The sums of one order and what follows from them."""

    def __init__(self, types: float, ones: float, twos: float, N0: float, N1: float, N: float, over0: float, over1: float):
        self.total, self.own = max(N, 1.0), (max(N0, 1.0), max(N1, 1.0))
        self.d = min(0.95, ones / (ones + 2 * twos)) if ones else 0.5
        self.rest = 1 - over0 / self.own[0], 1 - over1 / self.own[1]
        mass = [SHARED + (1 - SHARED) * r for r in self.rest]
        #: The ratio's logarithm of an unseen expression.
        self.unseen = math.log(mass[1] / mass[0])

    def ratio(self, n0: np.ndarray, n1: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log P_1 / P_0 of expressions with these counts."""
        shared = (n - self.d) / self.total
        p = [SHARED * shared + (1 - SHARED) * (np.maximum(own - DISCOUNT, 0) / total + rest * shared) for own, total, rest in zip((n0, n1), self.own, self.rest, strict=True)]
        return np.log(p[1] / p[0])


class Known:
    """The part of one order that scorers get: the key of each slot and what it weighs, and the filter of all keys."""

    def __init__(self, bits: int, filter_bits: int):
        self.bits, self.filter_bits = bits, filter_bits
        self.keys, self.weight, self.filter = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits), np.zeros(1 << filter_bits - 3, np.uint8)

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What known keys weigh (0 for others), and which others may be in the model."""
        mixed = _mix(keys)
        slot = mixed >> _U(64 - self.bits)
        here = self.keys[slot] == keys
        at = mixed >> _U(64 - self.filter_bits)
        there = ~here & (self.filter[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)
        return np.where(here, self.weight[slot], 0.0), there


class Model:
    """The sums, the scorers' part, and the whole table (chunk rows of _TABLE, in the shared folder)."""

    def __init__(self, tables: DataFrame, chunks: int, slots: tuple[int, int], bits: tuple[int, int]):
        self.tables, self.chunks = tables, chunks
        tidy(tables.sparkSession)
        rows = map_arrow(tables, lambda batches: _part(batches, slots, bits), _PART).collect()  # together of a fixed size: slots and filter bits
        sums = {k: np.sum([[r[c] for c in _SUMS] for r in rows if r["kind"] == k] or np.zeros((1, len(_SUMS))), axis=0) for k in _WORDS_OF}
        self.orders = {k: Order(*x) for k, x in sums.items()}
        scorers = {k: Known(slots[i], bits[i]) for k, i in _WORDS_OF.items()}
        best = {k: np.zeros(1 << slots[i], np.int64) for k, i in _WORDS_OF.items()}
        while rows:
            r = rows.pop(0)
            known, most = scorers[r["kind"]], best[r["kind"]]
            keys, (n0, n1, n) = _array(bytes(r["keys"]), np.uint64), (_array(bytes(r[c]), np.int64) for c in ("n0", "n1", "n"))
            slot = _mix(keys) >> _U(64 - known.bits)
            more = n > most[slot]  # ranges of two chunks may meet in a slot
            most[slot[more]] = n[more]
            known.keys[slot[more]], known.weight[slot[more]] = keys[more], self.weigh(r["kind"], n0, n1, n)[more]
            piece = _array(bytes(r["bits"]), np.uint8)
            known.filter[r["first"] : r["first"] + len(piece)] |= piece
        self.shared = tables.sparkSession.sparkContext.broadcast(scorers)  # of a fixed size: slots and filter bits

    def weigh(self, kind: str, n0: np.ndarray, n1: np.ndarray, n: np.ndarray) -> np.ndarray:
        return _weigh(self.orders[kind], kind, n0, n1, n)


def _weigh(order: Order, kind: str, n0: np.ndarray, n1: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What an expression adds to a text's sum; a word beyond what an unseen one adds."""
    ratio = order.ratio(n0, n1, n)
    return ratio - order.unseen if kind == "words" else PAIRS * ratio


def _with_labels(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(text, cls, fold) of the labelled documents outside fold 0."""
    own = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("cls"))
    own = own.withColumn("fold", fold("doc_id", FOLDS)).filter("fold > 0")
    side = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own
    return docs.select("doc_id", "text").join(side, "doc_id").select("text", "cls", "fold")


def count_model(labelled: DataFrame, size: int, slots: tuple[int, int] = SLOT_BITS, bits: tuple[int, int] = FILTER_BITS) -> Model:
    """The model of all rows (text, cls) of labelled. size: bytes of text to be scored, about."""
    spark = labelled.sparkSession
    chunks, folder = max(LEAST_CHUNKS, math.ceil(size / CHUNK_BYTES)), scratch(spark, "toxicity")
    pairs = map_arrow(labelled.select("text", "cls"), lambda batches: _count(batches, chunks), _TABLE)
    pairs.groupBy("chunk").applyInArrow(_merge("pairs", chunks), _TABLE).write.option("compression", "zstd").parquet(f"{folder}/kind=pairs")
    pairs = spark.read.schema(_TABLE).parquet(f"{folder}/kind=pairs")
    words = map_arrow(pairs, _ends, "w long, n0 long, n1 long, n long").groupBy("w").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "n")))
    words = map_arrow(words, lambda batches: _word_blobs(batches, chunks), _TABLE)
    words.groupBy("chunk").applyInArrow(_merge("words", chunks), _TABLE).write.option("compression", "zstd").parquet(f"{folder}/kind=words")
    return Model(pairs.unionByName(spark.read.schema(_TABLE).parquet(f"{folder}/kind=words")), chunks, slots, bits)


# --- scoring --------------------------------------------------------------------------------------------------------


def values(df: DataFrame, model: Model, key: str, text: str = "text", curve: tuple[np.ndarray, np.ndarray] | None = None, most: int = SEGMENT) -> DataFrame:
    """(key, value): one row for each row of df; value is null without words. With a curve's knots, its height at the value.

    most: rows of a segment, up to 65536.
    """
    shared, chunks, orders = model.shared, model.chunks, model.orders
    own = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    keys = T.ArrayType(own.schema["key"].dataType)
    # a segment's own row (its keys, numbers of words, sums), or the rest of its expressions in one chunk
    asked = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("segment", T.StringType()), T.StructField("rows", keys), *(T.StructField(c, T.BinaryType()) for c in ("n", "sums", "upper", "lower", "at"))])
    answer = T.StructType([T.StructField("segment", T.StringType()), T.StructField("chunk", T.IntegerType()), T.StructField("rows", keys), *(T.StructField(c, T.BinaryType()) for c in ("n", "sums", "at"))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        task, number, kind = TaskContext.get().partitionId(), 0, None
        held: dict[str, list] = {}
        digest, rows = xxhash.xxh64(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, rows
            segment = f"{task}-{number}-{digest.hexdigest()}"
            n, sums = np.concatenate(held["n"]), np.concatenate(held["sums"])
            out = [(xxhash.xxh32_intdigest(segment) % chunks, segment, pa.concat_arrays(held["rows"]).to_pylist(), _bytes(n.astype("<i8")), _bytes(sums), None, None, None)]
            cold, at = np.concatenate(held["cold"]), np.concatenate(held["at"])
            chunk = _chunk(_mix(cold), chunks)
            order = np.lexsort((cold, chunk))
            cold, at, chunk = cold[order], at[order], chunk[order]
            ends = [*np.flatnonzero(np.diff(chunk, prepend=-1)), len(cold)]
            for a, b in zip(ends, ends[1:], strict=False):
                found, count = np.unique(cold[a:b], return_counts=True)
                out.append((int(chunk[a]), segment, None, _bytes(count.astype("<u4")), None, *_packed(found), _bytes(at[a:b].astype("<u2"))))
            held.clear()
            digest.reset()
            number, rows = number + 1, 0
            types = [pa.int32(), pa.string(), pa.list_(kind), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=asked.names)

        for batch in parts(batches, 256):
            texts, kind = batch.column("text").to_pylist(), batch.column("key").type
            words, pairs, n = _joined(texts)
            owner, sums = np.repeat(np.arange(len(n)), n), np.zeros(len(n))
            for order, expressions in (("words", words), ("pairs", pairs)):
                weight, rest = known[order].look(expressions)
                sums += np.bincount(owner, weight, len(n))
                held.setdefault("cold", []).append(expressions[rest])
                held.setdefault("at", []).append(owner[rest] + rows)
            for name, x in (("n", n), ("sums", sums), ("rows", batch.column("key"))):
                held.setdefault(name, []).append(x)
            digest.update(words.tobytes() + n.tobytes())
            rows += len(n)
            if rows > most - 256 or sum(map(len, held["cold"])) > HELD:
                yield from flush()
        if rows:
            yield from flush()

    def meet(rows: pa.Table, tables: pa.Table) -> pa.Table:
        found = [(_read(tables, k), k) for k in _WORDS_OF]
        keys = np.concatenate([k for (k, _), _ in found])
        weight = np.concatenate([_weigh(orders[kind], kind, *counts) for (_, counts), kind in found])
        order = np.argsort(keys)
        keys, weight, out = np.append(keys[order], _U(0)), np.append(weight[order], 0.0), []
        for r in rows.to_pylist():
            if r["rows"] is not None:
                out.append((r["segment"], -1, r["rows"], r["n"], r["sums"], None))
                continue
            asked = _keys(r["upper"], r["lower"])
            place = np.searchsorted(keys[:-1], asked)
            each = np.repeat(np.where(keys[place] == asked, weight[place], 0.0), _array(r["n"], "<u4"))
            at, which = np.unique(_array(r["at"], "<u2"), return_inverse=True)
            out.append((r["segment"], r["chunk"], None, None, _bytes(np.bincount(which, each, len(at))), _bytes(at)))
        types = [pa.string(), pa.int32(), rows.schema.field("rows").type, *[pa.binary()] * 3]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names=answer.names)

    def gather(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["chunk", "rows", "n", "sums", "at"]).to_pylist(), key=lambda r: r["chunk"])
        if [r["chunk"] for r in rows[:2]].count(-1) != 1:
            raise RuntimeError(f"segment {table.column('segment')[0]} came in another order when it was read again")
        n, sums = _array(rows[0]["n"], "<i8"), _array(rows[0]["sums"], "<f8").copy()
        for r in rows[1:]:
            sums[_array(r["at"], "<u2")] += _array(r["sums"], "<f8")
        value = np.where(n > 0, (sums + orders["words"].unseen * n) / (n + PRIOR), 0.0)
        value = value if curve is None else np.interp(value, *curve)
        return pa.table({"key": pa.array(rows[0]["rows"], table.schema.field("rows").type.value_type), "value": pa.array(value, mask=n == 0)})

    here = map_arrow(own, read, asked).groupBy("chunk")
    met = here.cogroup(model.tables.groupBy("chunk")).applyInArrow(meet, answer)
    return met.groupBy("segment").applyInArrow(gather, T.StructType([own.schema["key"], T.StructField("value", T.DoubleType())]))


def fit_curve(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the ascending curve that fits labels y of ascending values x, n times each: isotonic regression by pooling adjacent
    values, each pool with one more observation at the mean label."""
    pools: list[list[float]] = []
    for at, label, times in zip(x.tolist(), y.tolist(), n.tolist(), strict=True):
        pools.append([at, at, times, times * label])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    if not pools:
        return np.zeros(1), np.zeros(1)
    mean = sum(p[3] for p in pools) / sum(p[2] for p in pools)
    level = np.maximum.accumulate([(p[3] + mean) / (p[2] + 1) for p in pools])
    return np.array([edge for p in pools for edge in p[:2]]), np.repeat(level, 2)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[Model, np.ndarray, np.ndarray]:
    """The model and the curve's knots, from documents outside fold 0."""
    labelled = _with_labels(docs, labels, label)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    model = count_model(labelled.filter("fold > 1"), size)
    tidy(docs.sparkSession)
    found = values(labelled.filter("fold = 1"), model, "cls").filter("value is not null")
    at = F.greatest(F.least(F.round(F.asinh(F.col("value") / _UNIT) / _STEP), F.lit(BINS)), F.lit(-BINS))
    bins = found.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum("key").alias("toxic")).orderBy("bin").toPandas()  # 2 * BINS + 1 rows at most
    return model, *fit_curve(np.sinh(bins["bin"].to_numpy(float) * _STEP) * _UNIT, (bins["toxic"] / bins["n"]).to_numpy(float), bins["n"].to_numpy(float))


def score(df: DataFrame, fitted: tuple[Model, np.ndarray, np.ndarray], key: str, text: str = "text") -> DataFrame:
    """(key, score): the score (double) of each row's text, on straight lines between the curve's knots; 0 without words."""
    return values(df, fitted[0], key, text, fitted[1:]).select("key", F.coalesce("value", F.lit(0.0)).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: held_out, score, predicted."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels), "doc_id").withColumnRenamed("key", "doc_id")
    return out.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with the columns of docs."""
    text = F.col("text")
    own = docs.select(F.unhex(F.md5(text)).alias("h"), text.alias("text"))
    bad = cut(score(own, fit(docs, labels), "h").filter("score >= 0.5").select(F.col("key").alias("bad")).distinct())
    side = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return named(aliased(docs).join(side, F.unhex(F.md5(aliased(docs, "text"))) == F.col("bad"), "left_anti"), docs)
