"""Coded token files: exact round trips, corruption, tokenization by pieces."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import rangecoder, token_io
from lectern.session import scratch_path

PATH = P.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65533), max_size=80), max_size=6), st.integers(1, 50))
def test_blocks_come_back(rows, repeat):
    blocks = [np.array(r * (repeat if len(r) < 9 else 1), dtype="<u4") for r in rows]
    back = rangecoder.decode_blocks(rangecoder.encode_blocks(blocks), [len(b) for b in blocks])
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))


def test_repeats_are_coded_in_few_bits():
    x = np.tile(np.arange(50, dtype="<u4") * 900, 80)
    assert len(rangecoder.encode_blocks([x])[0]) * 8 < 2 * len(x)


def test_too_long_a_block():
    with pytest.raises(ValueError):
        rangecoder.encode_blocks([np.zeros(rangecoder.BLOCK + 1, dtype="<u4")])


def test_wide_ids_and_strands_come_back():
    rng = np.random.default_rng(2)
    blocks = [rng.integers(0, 1 << 32, 3000, dtype=np.uint64).astype("<u4"), rng.zipf(1.3, 9000).clip(max=60000).astype("<u4"), np.full(700, (1 << 32) - 1, "<u4")]
    back = rangecoder.decode_blocks(rangecoder.encode_blocks(blocks), [len(b) for b in blocks])
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))


def test_a_block_does_not_hang_on_its_neighbours():
    rng = np.random.default_rng(4)
    blocks = [rng.zipf(1.5, n).clip(max=300).astype("<u4") for n in (5000, 700, 90, 3000, 1)]
    assert rangecoder.encode_blocks(blocks) == [rangecoder.encode_blocks([b])[0] for b in blocks]


def test_blocks_are_smaller_than_by_zlib():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    ids = np.frombuffer(b"".join(token_io.tokenize(PATH, texts, 1)), "<u4")
    blocks = [ids[a : a + rangecoder.BLOCK] for a in range(0, len(ids), rangecoder.BLOCK)]
    coded = rangecoder.encode_blocks(blocks)
    for b, c in zip(blocks, coded, strict=True):
        assert len(c) < 0.9 * len(zlib.compress(b.astype("<u2").tobytes(), 9))
    assert sum(map(len, coded)) * 8 < 8 * len(ids)


@settings(max_examples=300, deadline=None)
@given(
    st.one_of(
        st.text(max_size=60),
        st.text(alphabet="aBe\u0301\u00e9 \n\x85\xa0\x1c.'s9\u03a3\u00c0\u0130\u00df\u00aa\u01c6\u00bd<|>", max_size=60),
        st.lists(st.sampled_from(["<|endoftext|>", "x", " ", "\u00c9", "don't", "12a"])).map("".join),
    )
)
def test_pieces_give_the_ids_of_the_whole(text):
    got = np.frombuffer(token_io.tokenize(PATH, [text], 1)[0], "<u4").tolist()
    assert got == [*WHOLE.encode(text, add_special_tokens=False).ids, 1]


def test_corruption_is_found():
    data = bytearray(token_io.pack_frames([1], [np.arange(500, dtype="<u4").tobytes()])[0][2])
    data[-300] ^= 1
    with pytest.raises(token_io.CorruptBlock):
        list(token_io.unpack_frames([bytes(data)]))


def test_table(spark):
    rows = [(7, "hello world"), (None, "first"), (3, None), (5, ""), (5, "tie " * 9000), (5, ""), (-2, "é \n x")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, ids int")
    path = scratch_path(spark, "test-ids")
    token_io.write(docs, path, PATH, frame_ids=20, block=64)
    got = sorted(token_io.digest(token_io.read(spark, path)).collect(), key=lambda r: r.start)
    at = 0
    for r, (d, t) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0], x[1] or "")), strict=True):
        ids = np.array([*WHOLE.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    path = scratch_path(spark, "test-ids")
    token_io.write(docs.limit(0), path, PATH)
    assert token_io.digest(token_io.read(spark, path)).count() == 0


def test_small_files_come_in_order(spark):
    docs, path = scratch_path(spark, "test-docs"), scratch_path(spark, "test-ids")
    spark.range(3000).selectExpr("id * 7919 % 3000 AS doc_id", "repeat('word ', int(id % 5)) AS text").write.parquet(docs)
    token_io.write(spark.read.parquet(docs), path, PATH, frame_ids=500)
    at = 0
    for k, r in enumerate(token_io.digest(token_io.read(spark, path)).orderBy("doc_id").collect()):
        assert (r.doc_id, r.start) == (k, at)
        at += r.n_tokens
    for r in spark.read.parquet(path).collect():
        ids = [d for own, _ in token_io.unpack_frames([bytes(r.data)]) for d in own]
        assert ids == list(range(ids[0], ids[0] + r.n_docs))


def test_a_repeated_word_is_looked_up_once():
    class Table(dict):
        looked = 0

        def get(self, *key):
            Table.looked += 1
            return dict.get(self, *key)

        def __getitem__(self, key):
            Table.looked += 1
            return dict.__getitem__(self, key)

    words = token_io.Words(PATH)
    words.words = Table()
    texts = ["One two\x0bone  ", None, "", "\tTWO one"] * 50
    got = words.encode(texts)
    assert Table.looked < 10
    assert [list(np.frombuffer(x, "<u4")) for x in got] == [words.whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_open_frames_wait():
    assert token_io.closed([bytes(4 * n) for n in (3, 0, 1, 9, 2, 1)], 4) == [3, 4]
