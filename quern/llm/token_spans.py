"""Token counts of parts of documents from one encoding of the whole text.

Each text is encoded once, whole. The lengths of the tokens' byte strings give every token's span of characters (a token
that holds only some bytes of a character spans that character), and the sections of a text are half-open intervals of
characters that cover it. Both lists are ordered, so their interval join is a merge by binary search. A token that lies in
one section counts there; one that crosses a boundary is given by the rule to

    start   the section of its first character
    end     the section of its last character
    most    the section with most of its characters, the first of equal ones

so that a document's sections always sum to its tokens. Sections are lines with their line ends, or come as an array column
of starts.

Cases: null and empty texts have one section, 0, without characters or tokens; a text that ends in a line end has no empty
last line; very long texts are encoded whole; repeated rows and null ids are allowed, each row gives its own sections; an empty
table gives no rows; columns besides the key, the text and the starts, whatever their names, don't matter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from quern.llm.common import map_arrow, owned, parts

RULES = ("start", "end", "most")


class Encoder:
    def __init__(self, ranks: bytes, pattern: str):
        pieces = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, ranks.splitlines()))}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=pieces, special_tokens={})
        self.lengths = np.zeros(max(pieces.values()) + 1, np.int64)
        for piece, rank in pieces.items():
            self.lengths[rank] = len(piece)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the tokens, and the first and last-plus-one character of each."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        raw = text.encode("utf-8")
        if len(raw) != len(text) and len(ids):
            # the character of each byte: the number of first bytes up to it, less one
            char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
            return ids, char[starts], char[ends - 1] + 1
        return ids, starts, ends


def encoder(ranks: bytes, pattern: str) -> Encoder:
    return owned(f"encoder {hash(ranks)} {pattern}", lambda: Encoder(ranks, pattern))


def line_starts(text: str) -> np.ndarray:
    """The first character of every line; a line has its line end."""
    if not text:
        return np.zeros(1, np.int64)
    lengths = [len(x) + 1 for x in text.split("\n")]
    if text[-1] == "\n":
        lengths.pop()
    return np.concatenate([[0], np.cumsum(lengths[:-1])]).astype(np.int64)


def allocate(start: np.ndarray, end: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether it crosses a boundary."""
    first = np.searchsorted(sections, start, "right") - 1
    last = np.searchsorted(sections, end - 1, "right") - 1
    crosses = first != last
    if rule == "start":
        return first, crosses
    if rule == "end":
        return last, crosses
    given = first.copy()
    for i in np.flatnonzero(crosses):
        edges = np.array([start[i], *sections[first[i] + 1 : last[i] + 1], end[i]])
        given[i] = first[i] + int(np.argmax(np.diff(edges)))
    return given, crosses


def attribute(df: DataFrame, vocabulary: str, pattern: str, rule: str = "start", key: str = "doc_id", text: str = "text", starts: str | None = None) -> DataFrame:
    """(key, section, start_char, n_chars, n_tokens, n_crossing) of each section of each row.

    vocabulary: the path of a rank file. starts: an array column of the sections' first characters (ascending, the first 0);
    lines if None. n_crossing counts the section's tokens that reach into another section.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    with open(vocabulary, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())  # bounded by the vocabulary file
    names = [key, "section", "start_char", "n_chars", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks.value, pattern)
        for batch in parts(batches):
            texts = batch.column(text).to_pylist()
            cuts = batch.column(starts).to_pylist() if starts else [None] * len(texts)
            rows, columns = [], [[] for _ in names[1:]]
            for value, at in zip(texts, cuts, strict=True):
                value = value or ""
                sections = line_starts(value) if at is None else np.array(at or [0], np.int64)
                _, a, b = own.spans(value)
                given, crosses = allocate(a, b, sections, rule)
                n = len(sections)
                rows.append(n)
                found = np.arange(n), sections, np.diff(sections, append=len(value)), np.bincount(given, minlength=n), np.bincount(given, crosses, n)
                for column, x in zip(columns, found, strict=True):
                    column.append(x.astype(np.int64))
            keys = batch.column(key).take(np.repeat(np.arange(len(texts)), rows))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(np.concatenate(x) if x else [], pa.int64()) for x in columns)], names=names)

    wanted = [key, text, *([starts] if starts else [])]
    kind = dict(df.dtypes)[key]
    return map_arrow(df.select(*wanted), run, f"`{key}` {kind}, " + ", ".join(f"{x} long" for x in names[1:]))
