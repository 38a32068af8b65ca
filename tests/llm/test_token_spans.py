"""Token attribution against the offsets of another library, and its rules."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import ODD
from tokenizers import Tokenizer

from quern.llm import token_spans as spans

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        own = spans.Encoder(f.read(), PATTERN)
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    return own, other


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n.aé")), max_size=50))
def test_spans_are_those_of_the_other_library(both, text):
    own, other = both
    ids, start, end = own.spans(text)
    found = other.encode(text, add_special_tokens=False)
    assert ids.tolist() == found.ids
    assert all(text[a:b].encode().find(own.encoding.decode_single_token_bytes(i)) >= 0 for i, a, b in zip(ids.tolist(), start, end, strict=True))
    assert (start[1:] >= start[:-1]).all() and (not len(ids) or (start[0] == 0 and end[-1] == len(text)))


def test_rules_for_crossing_tokens():
    start, end, sections = np.array([0, 3, 6, 9]), np.array([3, 6, 9, 12]), np.array([0, 4, 5, 10])
    want = {"start": [0, 0, 2, 2], "end": [0, 2, 2, 3], "most": [0, 0, 2, 3]}
    for rule, given_ in want.items():
        got, crosses = spans.allocate(start, end, sections, rule)
        assert got.tolist() == given_ and crosses.tolist() == [False, True, False, True], rule


@pytest.mark.parametrize("rule", spans.RULES)
def test_sections_sum_to_the_document(docs_of, both, rule):
    rows = [(1, "a line\n\n\nanother  line\nlast", "en", "s"), (2, "x\n", "en", "s"), *[(10 + i, t, None, None) for i, (_, t, *_) in enumerate(ODD)]]
    got = {}
    for r in spans.attribute(docs_of(rows, clash=["section", "n_tokens"]), PATH, PATTERN, rule).collect():
        x = got.setdefault(r["doc_id"], [0, 0, 0])
        x[0] += 1
        x[1] += r["n_tokens"]
        x[2] += r["n_chars"]
    for i, text, *_ in rows:
        text = text or ""
        lines = max(1, text.count("\n") + (not text.endswith("\n")))
        assert got[i] == [lines, len(both[0].encoding.encode_ordinary(text)), len(text)]


def test_given_sections_and_errors(docs_of, both):
    docs = docs_of([(1, "hello there world", "en", "s"), (2, None, "en", "s")]).selectExpr("doc_id", "text", "CASE WHEN doc_id = 1 THEN array(0, 8, 12) END AS cuts")
    got = {(r["doc_id"], r["section"]): (r["n_tokens"], r["n_crossing"]) for r in spans.attribute(docs, PATH, PATTERN, starts="cuts").collect()}
    assert got == {(1, 0): (2, 1), (1, 1): (1, 1), (1, 2): (0, 0), (2, 0): (0, 0)}
    with pytest.raises(ValueError):
        spans.attribute(docs, PATH, PATTERN, "none")
    assert spans.attribute(docs_of([]), PATH, PATTERN).count() == 0


def test_other_columns_dont_matter(docs_of):
    rows = [(1, "one\ntwo", "en", "s"), (1, "one\ntwo", "en", "s"), (2, None, None, None)]
    plain = spans.attribute(docs_of(rows), PATH, PATTERN)
    odd = spans.attribute(docs_of(rows, clash=["section", "n_tokens", "start_char"]).selectExpr("*", "1 AS `a.b`"), PATH, PATTERN)
    assert odd.columns == plain.columns and sorted(map(tuple, odd.collect())) == sorted(map(tuple, plain.collect()))
