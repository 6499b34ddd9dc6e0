"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file gives each token's bytes and rank. Every split of a token into two
other tokens becomes a merge, in order of the token's rank, so that the library
merges the pair whose joined bytes rank lowest, as the rank files mean it. The
library breaks ties between two splits of one token by the split, the rank
files by position. That matters only for three tokens x, y and z in a row with
xy = yz a token (aaa, etete); the vocabulary tells all such strings, and a
piece that holds one is encoded by the tiktoken library.

Texts are cut before spaces that a character other than white space follows.
No match of the pattern crosses such a cut and none looks beyond it, so each
distinct unit is encoded once and its ids are reused.
"""

from __future__ import annotations

import base64
import bisect
import os
import re
import struct
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bounded, extended, sliced, tidy

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Units kept in a worker's table before it is emptied.
UNIT_TABLE = 100_000

_CUT = re.compile(r" (?=\S)")
_codecs: dict[tuple[str, str], Codec] = {}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = {b: 0x100 + n for n, b in enumerate(b for b in range(256) if b not in set(kept))}
    return [chr(moved.get(b, b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def cut(text: str) -> list[str]:
    """The text's parts at those single spaces before which the pattern never looks ahead; joined by spaces they are the text."""
    parts = text.split(" ")
    rest = parts[1:]
    if "" in rest or any(map(str.isspace, {p[0] for p in rest})):
        return _CUT.split(text)
    return parts


def ties(ranks: dict[bytes, int]) -> list[bytes]:
    """Strings xyz of tokens x, y and z with xy = yz a token."""
    found = set()
    for t in ranks:
        for k in range(1, len(t)):
            if t[:k] == t[-k:] and t[:k] in ranks and t[k:] in ranks and t[:-k] in ranks:
                found.add(t[:-k] + t)
    return sorted(found)


class Codec:
    """Encoder and decoder of one rank file; a process keeps one for each file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        chars = byte_characters()
        name = {t: "".join(chars[b] for b in t) for t in ranks}
        merges = [(name[t[:k]], name[t[k:]]) for t in sorted(ranks, key=ranks.__getitem__) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        model = models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0)
        self.library = Tokenizer(model)
        self.library.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.by_rank = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ties = ahocorasick.Automaton()
        for t in ties(ranks):
            self.ties.add_word(t.decode("latin-1"), None)
        if self.ties:
            self.ties.make_automaton()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, r in self.library.get_vocab().items():
            self.bytes_of[r] = bytes(byte_of[c] for c in token)
        self.units: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in _codecs:
            _codecs[path, pattern] = cls(path, pattern)
        return _codecs[path, pattern]

    def _encode_new(self, pieces: list[str]) -> list[bytes]:
        """Ids of texts that are met for the first time."""
        joined, ends = b"\xff".join(p.encode() for p in pieces), []
        at = -1
        for p in pieces:
            at += len(p.encode()) + 1
            ends.append(at)
        odd = {bisect.bisect_left(ends, at) for at, _ in self.ties.iter(joined.decode("latin-1"))} if self.ties else set()
        out = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        for k in odd:
            ids = self.by_rank.encode_ordinary(pieces[k])
            out[k] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.units) > UNIT_TABLE:
            self.units.clear()
        parts = [cut(t) if t else [""] for t in texts]
        known = self.units
        fresh = list({p for c in parts for p in c[1:] if p not in known})
        known.update(zip(fresh, self._encode_new([" " + p for p in fresh]), strict=True))
        heads = self._encode_new([c[0] for c in parts])
        return [head + b"".join(map(known.__getitem__, c[1:])) for head, c in zip(heads, parts, strict=True)]

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Start and end, in code points, of the characters that each id touches."""
        out, at = [], 0
        raw = text.encode()
        char_at = [i for i, c in enumerate(text) for _ in c.encode()] + [len(text)]
        ids = memoryview(self.encode([text])[0]).cast("I") if text else []
        for i in ids:
            end = at + len(self.bytes_of[i])
            out.append((char_at[at], char_at[end - 1] + 1))
            at = end
        assert at == len(raw)
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes that the ids stand for; a character split between ids is whole again."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I").tolist()))


def _drop() -> None:
    for codec in _codecs.values():
        codec.units.clear()


def encode(docs: DataFrame, ranks_path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """Token ids of docs (doc_id, text; other columns are ignored): doc_id, ids [, offsets].

    ids is binary, little-endian unsigned 32-bit; offsets, if asked for, are
    (start, end) pairs in code points. A null or empty text has no ids. A row is
    returned for each input row, whatever its doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks_path, pattern)
        for part, texts in sliced(batches):
            new = {"ids": pa.array(codec.encode(texts), pa.binary())}
            if offsets:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                new["offsets"] = pa.array([[{"start": s, "end": e} for s, e in codec.offsets(t or "")] for t in texts], kind)
            yield extended(part, ["doc_id"], **new)

    more = ", offsets array<struct<start:int,end:int>>" if offsets else ""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return bounded(docs).mapInArrow(tidy(run, _drop), "doc_id long, ids binary" + more)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded (binary: the bytes of the text) of what encode() returns; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks_path, pattern)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            out = pa.array([codec.decode(x or b"") for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), out], ["doc_id", "ids", "decoded"])

    return bounded(encoded.select("doc_id", "ids")).mapInArrow(tidy(run, _drop), "doc_id long, ids binary, decoded binary")


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """What decode(encode(docs)) returns, by one pass of one Python worker for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks_path, pattern)
        for part, texts in sliced(batches):
            ids = codec.encode(texts)
            yield extended(part, ["doc_id"], ids=pa.array(ids, pa.binary()), decoded=pa.array(map(codec.decode, ids), pa.binary()))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return bounded(docs).mapInArrow(tidy(run, _drop), "doc_id long, ids binary, decoded binary")


def encode_decode_digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, from encode_decode()."""
    return encode_decode(docs, ranks_path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
