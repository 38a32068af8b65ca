"""Byte-level BPE against the tiktoken library, and exact round trips."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import ODD

from quern.llm import spm_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def pair():
    with open(PATH, "rb") as f:
        data = f.read()
    ranks = spm_bpe.read_ranks(data)
    return spm_bpe.Codec(ranks, PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'’s.,1aé\x85　")), max_size=60))
def test_any_text_is_encoded_as_by_tiktoken_and_comes_back(pair, text):
    own, other = pair
    packed = own.encode([text])[0]
    assert np.frombuffer(packed, "<u4").tolist() == other.encode_ordinary(text)
    assert own.decode(packed) == text.encode()


def test_the_table_of_known_chunks_may_overflow(pair, monkeypatch):
    own, other = pair
    monkeypatch.setattr(spm_bpe, "CACHE_ENTRIES", 5)
    texts = [f"a b{i} c{i} d{i} e{i}" for i in range(20)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts) + own.encode(texts)] == [other.encode_ordinary(t) for t in texts * 2]


def test_a_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        spm_bpe.serialise_model({b"a": 0})


def test_odd_rows(docs_of, pair):
    docs = docs_of(ODD, clash=["ids", "n_tokens", "decoded"])
    got = spm_bpe.encode(docs, PATH, PATTERN, decoded="decoded").collect()
    assert len(got) == len(ODD) and set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens", "decoded"}
    for r in got:
        ids = pair[1].encode_ordinary(r["text"] or "")
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]).decode() == (r["text"] or "")
    again = spm_bpe.decode(spm_bpe.encode(docs.drop("decoded"), PATH, PATTERN), PATH).collect()
    assert sorted(bytes(r["decoded"]) for r in again) == sorted((r[1] or "").encode() for r in ODD)


def test_digests_and_empty_tables(docs_of):
    r = spm_bpe.digests(docs_of([(1, None, "en", "s")]), PATH, PATTERN).first()
    none = hashlib.sha256(b"").hexdigest()
    assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (0, none, none)
    assert spm_bpe.digests(docs_of([]), PATH, PATTERN).count() == 0
