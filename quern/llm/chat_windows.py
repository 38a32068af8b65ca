"""Chat formatting in budgeted windows.

A turn is written as ``<|im_start|>role``, a line feed, its text, ``<|im_end|>`` and a line feed. In roles and texts every ``<``
that is followed by any number of backslashes and a ``|`` gets one backslash more, so no text can write a mark, and removing
one restores it; in roles backslashes and line feeds are escaped as well.

A conversation is cut into windows of at most ``budget`` tokens along turns, counted in the escaped turns as they are written,
each mark one token. A first turn of the role ``system`` opens each of its windows; then come turns of the window before, up to
``history`` tokens, and then new turns while they fit: prefix sums of the turns' tokens are searched for the last one. A turn
that alone is too long has a window of its own and exceeds the budget. The loss mask covers the texts of new assistant turns;
repeated ones are masked, so each is trained once.

All turns are sorted by ranges, and a turn's place and the tokens before it are sums within its range and over the ranges before
it. Conversations are split into chunks where these tokens pass a multiple of ``CHUNK``, and the turns of the last ``history``
tokens go to the next chunk too, so a task holds some ``CHUNK`` tokens and a turn, however long a conversation is and
whatever its turns' numbers are. A window never crosses the end of a chunk.

Cases: null roles and texts are empty; turns are ordered by number (null last), then role, then text, so ties and repeated
rows have a fixed place and each is written; rows with a null conversation id are one conversation; empty conversations
don't exist; very long texts are written whole; an empty table gives no rows; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import cut, map_arrow, parts

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Tokens of a window and of repeated history in it, and those of a chunk.
BUDGET, HISTORY, CHUNK = 2048, 256, 65_536
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_LAST = 2**63 - 1


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def cut_windows(tokens: list[int], prior: int, system: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """(first repeated, first new, end) of each window over turns of which the first ``prior`` are history already."""
    upto = np.concatenate([[0], np.cumsum(tokens)])
    out, start = [], prior
    while start < len(tokens):
        room = budget - system
        back = int(np.searchsorted(upto, upto[start] - min(history, max(0, room - tokens[start])), "left"))
        end = int(np.searchsorted(upto, upto[back] + room, "right")) - 1
        out.append((back, start, max(end, start + 1)))
        start = out[-1][2]
    return out


def write(turns: list[tuple[str, str, bool]]) -> tuple[str, list[dict]]:
    """The formatted text of turns (role, text, repeated) and the spans of characters under the loss."""
    written, spans, at = [], [], 0
    for role, text, repeated in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        if role == "assistant" and not repeated:
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        written += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(written), spans


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted text."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE, line)
        out.append((unescape_role(formatted[at + len(OPEN) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(CLOSE)
    return out


def placed(conversations: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(conv_id, place, before, tokens, role, text) of each turn, materialised: its number in its conversation, the tokens before it, and its own."""
    spark, kind = conversations.sparkSession, dict(conversations.dtypes)["conv_id"]
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # bounded by the vocabulary file
    rows = conversations.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(_LAST)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, ranks.value.splitlines()))}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=pieces, special_tokens={})
        marks = 2 + len(encoding.encode_ordinary("\n"))
        for batch in parts(batches):
            turns = zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)
            n = [marks + len(encoding.encode_ordinary(f"{escape_role(role)}\n{escape(text)}")) for role, text in turns]
            yield batch.append_column("tokens", pa.array(n, pa.int64()))

    counted = map_arrow(rows, count, f"conv_id {kind}, turn long, role string, text string, tokens long").withColumn("tie", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "text", "tie"]
    dealt = counted.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, place, before = TaskContext.get().partitionId(), (), 0, 0
        for batch in parts(batches):
            found = []
            for of, n in zip(batch.column("conv_id").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if now != (of,):
                    now, place, before = (of,), 0, 0
                found.append((part, place, before))
                place, before = place + 1, before + n
            columns = zip(*found, strict=True) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "role", "text", "tokens")), *(pa.array(c, pa.int64()) for c in columns)], names=["conv_id", "role", "text", "tokens", "part", "place", "before"])

    dealt = cut(map_arrow(dealt.drop("turn", "tie"), sums, f"conv_id {kind}, role string, text string, tokens long, part long, place long, before long"))
    # of conversations that go on in another range: what the ranges before hold of them; a range goes on with one at most
    own = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    rest = own.select(F.col("conv_id").alias("of"), F.col("part").alias("in"), F.sum("n").over(earlier).alias("n"), F.sum("t").over(earlier).alias("t")).filter("n is not null")
    whole = dealt.join(F.broadcast(rest), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")), "left")
    return whole.select("conv_id", (F.col("place") + F.coalesce("n", F.lit(0))).alias("place"), (F.col("before") + F.coalesce("t", F.lit(0))).alias("before"), "tokens", "role", "text")


_WINDOW = "conv_id {kind}, chunk long, window int, formatted string, loss array<struct<start:long,end:long>>, n_repeated int, n_new int, n_tokens long"


def windows(conversations: DataFrame, vocabulary: str, pattern: str, budget: int = BUDGET, history: int = HISTORY, chunk: int = CHUNK) -> DataFrame:
    """One row per window: its text, the loss spans, and how many of its turns are repeated and new.

    vocabulary: the path of a rank file, by which tokens are counted. chunk: above history.
    """
    kind = dict(conversations.dtypes)["conv_id"]
    rows = placed(conversations, vocabulary, pattern)
    first = rows.filter("place = 0 and role = 'system'").select(F.col("conv_id").alias("of"), F.col("text").alias("system"), F.col("tokens").alias("system_tokens"))
    own = F.floor(F.col("before") / chunk)
    # the next chunk starts at a multiple of chunk or behind it
    both = F.when(F.col("before") >= (own + 1) * chunk - history, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = rows.filter("place > 0 or role != 'system'").withColumn("own", own).withColumn("chunk", F.explode(both))
    alone = rows.filter("place = 0 and role = 'system'").select("conv_id", F.lit(0).cast("long").alias("chunk"))
    turns = F.collect_list(F.struct("place", "role", "text", "tokens", (F.col("own") == F.col("chunk")).alias("new")))
    grouped = dealt.groupBy("conv_id", "chunk").agg(turns.alias("turns")).filter(F.exists("turns", lambda t: t["new"]))
    # a system turn opens its conversation's first chunk, also where no other turn is in it
    grouped = grouped.unionByName(alone.withColumn("turns", F.lit(None).cast(grouped.schema["turns"].dataType))).groupBy("conv_id", "chunk").agg(F.first("turns", ignorenulls=True).alias("turns"))
    grouped = grouped.join(first, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    names = [x.split()[0] for x in _WINDOW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            out = []
            for row in batch.to_pylist():
                turns = sorted(((t["place"], t["role"], t["text"], t["tokens"], t["new"]) for t in row["turns"] or []), key=lambda t: t[0])
                prior, tokens = sum(not t[4] for t in turns), [t[3] for t in turns]
                head, opens = row["system"] is not None, row["system"] is not None and row["chunk"] == 0
                for w, (back, start, end) in enumerate(cut_windows(tokens, prior, row["system_tokens"] or 0, budget, history) or [(0, 0, 0)]):
                    new_head = opens and w == 0
                    body = [(t[1], t[2], i < start - back) for i, t in enumerate(turns[back:end])]
                    text, spans = write(([("system", row["system"], not new_head)] if head else []) + body)
                    repeated = start - back + (head and not new_head)
                    out.append((row["conv_id"], row["chunk"], w, text, spans, repeated, head + len(body) - repeated, (row["system_tokens"] or 0) + sum(tokens[back:end])))
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return map_arrow(grouped.select("conv_id", "chunk", "turns", "system", "system_tokens"), run, _WINDOW.format(kind=kind))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows in order: the digests of its turns and of the text under the loss.

    A digest is sequential, so a conversation's windows stream through one task; no more than a batch of them is held.
    """
    kind = dict(formatted.dtypes)["conv_id"]
    rows = formatted.select("conv_id", "chunk", "window", "formatted", "loss", "n_repeated").repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "window")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []

        def end() -> tuple:
            key, n, turns, chars, loss, total, count = state
            return key, n, turns.hexdigest(), chars, loss.hexdigest(), total, count

        kind_of = None
        for batch in parts(batches):
            kind_of, out = batch.schema.field("conv_id").type, []
            for row in batch.to_pylist():
                if not state or state[0] != row["conv_id"]:
                    if state:
                        out.append(end())
                    state[:] = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                text = row["formatted"]
                for role, said in read(text)[row["n_repeated"] :]:
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in row["loss"]:
                    said = unescape(text[span["start"] : span["end"]])
                    state[3] += len(said)
                    state[4].update(said.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
                state[6] += 1
            if out:
                yield _rows(out, names, kind_of)
        if state:
            yield _rows([end()], names, kind_of)

    return map_arrow(rows, run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def _rows(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
