"""Byte-level BPE encoding and decoding through a sentencepiece model that is serialised from a rank file.

The vocabulary of a rank file (one base64 byte string and its rank a line) becomes a sentencepiece ``ModelProto``: every
byte b of a piece is written as the character U+0100 + b, a piece's score is its negative rank, the model type is BPE and
normalisation is the identity (no dummy prefix, no white-space changes). The highest score among neighbouring pairs is then
the lowest rank, and equal scores go to the left pair, so sentencepiece applies exactly the merges of the rank file.

Text is cut into pre-tokens by the vocabulary's pattern, each pre-token is encoded alone, and decoding maps ids back to
bytes by the inverse table. Because no pre-token crosses the front of "a space before a character that is not white space",
texts are first cut there, and the ids of such a chunk are kept in a bounded table of each worker.

Cases: a null text counts as empty and has no ids; very long texts and pre-tokens are encoded whole; bytes that the
vocabulary cannot spell raise ValueError when the model is built; input columns that have the names of output columns are
replaced; repeated rows are each encoded; an empty table gives an empty table with the same columns.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import map_arrow, owned, parts, without

#: Chunks and pre-tokens that a worker remembers before it starts afresh.
CACHE_ENTRIES = 250_000

_NORMAL, _UNKNOWN = 1, 2
_BPE = 2
_TO_CHARS = {b: 0x100 + b for b in range(256)}


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, filter(None, data.splitlines()))}


# --- serialisation of the model -----------------------------------------------------------------------------------


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _float(field: int, x: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", x)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece i is the byte string of the i-th smallest rank, and an unknown piece at the end."""
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary has no piece for {len(missing)} single bytes, such as {missing[0]}")
    out = bytearray()
    for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
        chars = piece.decode("latin-1").translate(_TO_CHARS).encode()
        out += _bytes(1, _bytes(1, chars) + _float(2, -float(rank)) + _number(3, _NORMAL))
    out += _bytes(1, _bytes(1, b"<unk>") + _float(2, -float(len(ranks)) - 1) + _number(3, _UNKNOWN))
    n = len(ranks)
    trainer = _number(3, _BPE) + _number(4, n + 1) + _number(40, n)
    # Ids of begin, end and padding are -1: the model has none. Negative numbers take ten bytes.
    trainer += b"".join(_number(field, 2**64 - 1) for field in (41, 42, 43))
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return bytes(out) + _bytes(2, trainer) + _bytes(3, normaliser)


# --- encoding in a worker -----------------------------------------------------------------------------------------


class Codec:
    """Encodes texts to packed little-endian unsigned 32-bit ids, and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        self.ids = [struct.pack("<I", rank) for _, rank in by_rank]
        self.pieces = {rank: piece for piece, rank in by_rank}
        self.pattern = regex.compile(pattern)
        self.cuts = regex.compile(r" (?=\S)")
        self.known: dict[str, bytes] = {}

    def _fill(self, chunks: set[str]) -> None:
        """Encode the chunks, each behind its space."""
        cut = [self.pattern.findall(" " + c) for c in chunks]
        flat = [x.encode("utf-8", "surrogatepass").decode("latin-1").translate(_TO_CHARS) for found in cut for x in found]
        encoded = iter(self.processor.encode(flat, num_threads=1))
        pack = self.ids
        for chunk, found in zip(chunks, cut, strict=True):
            self.known[chunk] = b"".join([pack[i] for _ in found for i in next(encoded)])

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.cuts.split(t) for t in texts]
        wanted = set()
        for chunks in cut:
            wanted.update(chunks[1:])
        known = self.known
        if missing := wanted.difference(known):
            if len(missing) + len(known) > CACHE_ENTRIES:
                missing, self.known = wanted, {}
            self._fill(missing)
            known = self.known
        heads = [self.pattern.findall(chunks[0]) for chunks in cut]
        flat = [x.encode("utf-8", "surrogatepass").decode("latin-1").translate(_TO_CHARS) for found in heads for x in found]
        encoded = iter(self.processor.encode(flat, num_threads=1))
        out = []
        for chunks, found in zip(cut, heads, strict=True):
            head = b"".join([self.ids[i] for _ in found for i in next(encoded)])
            out.append(head + b"".join(map(known.__getitem__, chunks[1:])))
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def codec(vocabulary: bytes, pattern: str) -> Codec:
    """The codec of a rank file's content; each worker builds it once."""
    return owned(f"codec {hashlib.sha256(vocabulary).hexdigest()} {pattern}", lambda: Codec(read_ranks(vocabulary), pattern))


def _groups(values: list, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about so many characters."""
    start = total = 0
    for i, x in enumerate(values):
        total += len(x)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(values):
        yield start, len(values)


def _with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", count: str = "n_tokens", decoded: str | None = None) -> DataFrame:
    """df with the packed ids (binary) and their number (long) of each whole text. vocabulary: the path of a rank file. decoded: a
    column for the bytes that the packed ids decode to again, made in the same pass."""
    with open(vocabulary, "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())  # bounded by the vocabulary file
    df = without(df, ids, count, *([decoded] if decoded else []))
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType())])
    if decoded:
        schema = schema.add(decoded, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(content.value, pattern)
        for batch in parts(batches):
            texts = [x or "" for x in batch.column(text).to_pylist()]
            for a, b in _groups(texts):
                packed = own.encode(texts[a:b])
                found = {ids: pa.array(packed, pa.binary()), count: pa.array([len(x) // 4 for x in packed], pa.int64())}
                if decoded:
                    found[decoded] = pa.array([own.decode(x) for x in packed], pa.binary())
                yield _with_columns(batch.slice(a, b - a), found)

    return map_arrow(df, run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes that the packed ids stand for."""
    with open(vocabulary, "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())
    df = without(df, decoded)
    schema = T.StructType([*df.schema.fields, T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {rank: piece for piece, rank in read_ranks(content.value).items()}
        for batch in parts(batches):
            packed = [x or b"" for x in batch.column(ids).to_pylist()]
            for a, b in _groups(packed, 4 << 20):
                out = [b"".join(map(pieces.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in packed[a:b]]
                yield _with_columns(batch.slice(a, b - a), {decoded: pa.array(out, pa.binary())})

    return map_arrow(df, run, schema)


def digests(df: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """One row per document: number of ids, and the digests of the packed ids and of what they decode to."""
    there = encode(df.select("doc_id", "text"), vocabulary, pattern, decoded="decoded")
    return there.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
