"""Byte-level BPE against the tiktoken library, and the round trip."""

import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
CODEC = bpe.Codec.of(PATH, P.PATTERN)
EXACT = tiktoken.Encoding("exact", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def ids(text):
    return list(memoryview(CODEC.encode([text])[0]).cast("I"))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n\t\r 'sé9.\x1c", max_size=60), st.text(alphabet="aab -=_", max_size=80)))
def test_ids_are_those_of_the_rank_file(text):
    assert ids(text) == EXACT.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode([text])[0]) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "  ", "a  b", "a \n\n b  ", "hahaha hahahaha", "x" * 3000, " " * 500 + "y", "日本語 😀é", "it's we'll\tgo"])
def test_given_texts(text):
    assert ids(text) == EXACT.encode_ordinary(text)


def test_offsets_cover_split_characters():
    spans = CODEC.offsets("a😀b")
    assert spans[0] == (0, 1) and spans[-1] == (2, 3)
    assert all(s == (1, 2) for s in spans[1:-1])


def test_table(spark):
    rows = [(1, "Hello world", "x"), (2, None, None), (None, "", "y"), (3, "é" * 2000, "z"), (3, "é" * 2000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_decode_digest(docs, PATH, P.PATTERN).collect()
    assert len(got) == 5
    by = {(r.doc_id, r.n_tokens): r for r in got}
    assert by[2, 0].ids_sha256 == hashlib.sha256(b"").hexdigest() == by[None, 0].decoded_sha256
    assert by[1, len(EXACT.encode_ordinary("Hello world"))].decoded_sha256 == hashlib.sha256(b"Hello world").hexdigest()
    assert bpe.encode_decode_digest(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_one_pass_is_encode_then_decode(spark):
    docs = spark.createDataFrame([(1, "some text  here"), (2, None), (3, "é\n")], "doc_id long, text string")
    two = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted(two) == sorted(bpe.encode_decode(docs, PATH, P.PATTERN).collect())
    spans = bpe.encode(docs, PATH, P.PATTERN, offsets=True).where("doc_id = 3").first().offsets
    assert [(s.start, s.end) for s in spans] == CODEC.offsets("é\n")
