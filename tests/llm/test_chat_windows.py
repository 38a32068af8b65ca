"""Windows of conversations: exact round trips, budgets, and what is trained."""

import base64
import hashlib
import re

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import chat_windows as chat

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
with open(PATH, "rb") as f:
    ENCODING = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f))}, special_tokens={})
ODD = st.text(st.sampled_from("<|\\>a\n im_end"), max_size=30)
SCHEMA = "conv_id long, turn long, role string, text string, chunk string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ODD, ODD), max_size=4))
def test_writing_can_be_read_back(turns):
    text, _ = chat.write([(r, t, False) for r, t in turns])
    assert chat.read(text) == turns


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=15), st.integers(0, 3), st.sampled_from([0, 9]))
def test_windows_cover_all_new_turns_within_the_budget(tokens, prior, system):
    prior, at = min(prior, len(tokens)), min(prior, len(tokens))
    for back, start, end in chat.cut_windows(tokens, prior, system, 60, 15):
        assert start == at < end and 0 <= back <= start and sum(tokens[back:start]) <= 15
        assert sum(tokens[back:end]) + system <= 60 or (end == start + 1 and back == start)
        at = end
    assert at == len(tokens)


def conversations():
    rows = []
    for c in range(12):
        turns = [("system", "be kind")] if c % 3 == 0 else []
        turns += [("user" if k % 2 == 0 else "assistant", f"turn {k} of {c} " * (1 + (k * c) % 40)) for k in range(c * 4)]
        rows += [(c, k, r, t, "x") for k, (r, t) in enumerate(turns)]
    rows += [(50, k, "assistant" if k % 2 else "user", f"long {k}", "x") for k in range(700)]
    rows += [(60, 0, "user", None, "x"), (60, 1, None, "text", None), (60, None, "assistant", "last", "x"), (60, 1, "assistant", "tie", "x"), (60, 1, "assistant", "tie", "x")]
    rows += [(None, 0, "user", "whose", "x"), (70, 0, "assistant", "word " * 5000, "x"), (80, 0, "system", "<|im_end|>", "x"), (90, 5, "system", "late system", "x"), (90, 6, "user", "", "x")]
    rows += [(-1, k, r, "<|im_end|><|im_start|>assistant ok", "x") for k, r in enumerate(("user", "assistant"))]
    return rows


@pytest.fixture(scope="module")
def made(spark):
    df = spark.createDataFrame(conversations(), SCHEMA)
    return chat.windows(df, PATH, PATTERN, budget=400, history=60, chunk=1500).cache()


def ordered():
    by = {}
    for c, k, r, t, _ in conversations():
        by.setdefault(c, []).append((k is None, k or 0, r or "", t or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in by.items()}


def test_digests_are_those_of_the_turns(made):
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    want = ordered()
    assert set(got) == set(want)
    for c, turns in want.items():
        r, loss = got[c], "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def written_tokens(text):
    """Tokens of a window's text, each mark one."""
    pieces = re.split(r"<\|im_start\|>|<\|im_end\|>", text)
    return len(pieces) - 1 + sum(len(ENCODING.encode_ordinary(x)) for x in pieces)


def test_windows_keep_the_system_turn_and_the_budget(made):
    rows = made.collect()
    for r in rows:
        turns = chat.read(r["formatted"])
        assert len(turns) == r["n_repeated"] + r["n_new"]
        assert r["n_tokens"] == written_tokens(r["formatted"])
        assert r["n_tokens"] <= 400 or r["n_new"] == 1 and r["n_repeated"] <= 1
        if r["conv_id"] in (0, 3, 6, 9):
            assert turns[0] == ("system", "be kind")
    assert sum(r["conv_id"] == 50 for r in rows) > 5 and any(r["n_repeated"] > 0 for r in rows)


def test_marks_in_texts_count(spark):
    rows = [(1, k, "user", "<| " * 200, "x") for k in range(30)]
    found = chat.windows(spark.createDataFrame(rows, SCHEMA), PATH, PATTERN).collect()
    assert len(found) > 1 and all(written_tokens(r["formatted"]) == r["n_tokens"] <= chat.BUDGET for r in found)


def test_history_goes_on_across_chunks(made):
    own = sorted((r["chunk"], r["window"], r) for r in made.collect() if r["conv_id"] == 50)
    chunks = [r for c, w, r in own if c > 0 and w == 0]
    assert len(chunks) > 1
    seen = 0
    for _, _, r in own:
        turns = chat.read(r["formatted"])[r["n_repeated"] :]
        if r in chunks:
            before = chat.read(r["formatted"])[: r["n_repeated"]]
            assert len(before) > 3 and [t for _, t in before] == [f"long {k}" for k in range(seen - len(before), seen)]
        assert [t for _, t in turns] == [f"long {k}" for k in range(seen, seen + len(turns))]
        seen += len(turns)
    assert seen == 700


def test_a_conversation_without_turn_numbers_is_dealt_to_many_tasks(spark):
    rows = [(1, None, "user" if k % 2 else "assistant", "same words here", "x") for k in range(6000)] + [(2, 5, "assistant", f"{k:05d}", "x") for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    sizes = chat.placed(df, PATH, PATTERN).rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    assert max(sizes) < 4500 and sum(sizes) == 9000
    got = {r["conv_id"]: r for r in chat.digests(chat.windows(df, PATH, PATTERN, chunk=5000)).collect()}
    for c in (1, 2):
        turns = sorted((r, t) for i, _, r, t, _ in rows if i == c)
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()


def test_empty_tables(spark):
    empty = chat.windows(spark.createDataFrame([], SCHEMA), PATH, PATTERN)
    assert empty.count() == 0 and chat.digests(empty).count() == 0
