"""Token ids in coded binary files, and their reading.

A dataset is a folder of Parquet files, whose writer commits each task's output
whole or not at all. A row is a frame: some documents in ascending doc_id
order, with every document whole. Its bytes stand alone:

    magic, documents, blocks, index bytes          4s 3I
    index: zlib of doc_ids (int64), null flags (uint8), id counts (uint32)
    for each block: coded bytes, ids, crc32 of the ids as uint32    3I
    the coded blocks

All numbers are little-endian. Each block is coded by `rangecoder` from a fresh
state; its checksum is compared at every reading.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import rangecoder
from lectern.llm.bpe import byte_characters
from lectern.llm.common import input_bytes, slices, small_batches, tidy, utf8

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters below are their own composed form, and so are all words of them.
LATIN = 0x250

MAGIC = b"LTF2"
#: Ids from which a frame is closed: a little less than a block, so that most frames are one.
FRAME_IDS = rangecoder.BLOCK - (1 << 14)
#: Ids that a worker holds before it codes them: as many strands of full blocks as advance together.
HELD_IDS = FRAME_IDS * (rangecoder.LANES // rangecoder.STRANDS)
#: Words and pre-tokens in a worker's tables, which outlive its tasks, before they are emptied.
WORD_TABLE, PIECE_TABLE = 1_000_000, 600_000
#: Pre-tokens in a string that goes to the library; longer strings take it longer for each.
LINE = 64
#: Characters whose words are looked up together: more share more of their words.
TEXT_CHARS = 8_000_000
#: Bytes of input files for each partition of ids, and the number of partitions from which they grow instead. Memory
#: is bounded by HELD_IDS and the sort's spilling, not by a partition's size.
PARTITION_BYTES, MOST_PARTITIONS = 16 << 20, 100_000
#: Bytes of a row group of frames, the least that a reading task takes on.
GROUP_BYTES = 2 << 20

_tokenizers: dict[str, Words] = {}


class Words:
    """Ids of words by a tokenizer file.

    The file's normaliser and pre-tokenizer must not look beyond ASCII white
    space: each distinct word is encoded once. Where the file's pre-tokenizer is
    a pattern whose matches are encoded on their own, words of Latin letters are
    cut by that pattern, and each distinct match goes to the library once. All
    other words go to it whole.
    """

    SEPARATOR = b"\xff\xff\xff\xff"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        normalizer = self.whole.normalizer
        self.lower = normalizer is not None and normalizer.normalize_str("A") == "a"
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.cut = self._cutter(config)
        if self.cut:
            self._by_piece(config["model"])

    @staticmethod
    def _cutter(config: dict):
        """All matches of the file's pattern in Latin text, and spaces; None for files of another make."""
        kinds = [n["type"] for n in (config.get("normalizer") or {}).get("normalizers", [])]
        steps = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
        model = config["model"]
        known = (
            kinds == ["NFC", "Replace", "Lowercase"]
            and [p["type"] for p in steps] == ["Split", "ByteLevel"]
            and "Regex" in steps[0]["pattern"]
            and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
            and not (steps[1]["add_prefix_space"] or steps[1]["use_regex"])
            and model["type"] == "BPE"
            and bool(model.get("end_of_word_suffix"))
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and len(model["vocab"]) < 1 << 24  # no id has a byte of the separator in its last place
        )
        if not known:
            return None
        pattern = steps[0]["pattern"]["Regex"]
        for name, category in (("L", "L"), ("N", "N")):
            own = "".join(re.escape(chr(c)) for c in range(LATIN) if unicodedata.category(chr(c))[0] == category)
            pattern = pattern.replace(f"[\\p{{{name}}}]", f"[{own}]").replace(f"\\p{{{name}}}", own)
        return None if "\\p" in pattern else re.compile(f"{pattern}| ").findall

    def _by_piece(self, model: dict) -> None:
        from tokenizers import Tokenizer, models, pre_tokenizers

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        suffix = model["end_of_word_suffix"]
        self.bare = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=suffix, cache_capacity=0))
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
        self.letters = {b: c for b, c in enumerate(byte_characters())}
        # control characters and odd spaces, and strings that the library takes for tokens of their own
        special = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(["[\\x00-\\x1f\\x7f-\\xa0]", *special])).search

    @classmethod
    def of(cls, path: str) -> Words:
        if path not in _tokenizers:
            _tokenizers[path] = cls(path)
        return _tokenizers[path]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids (uint32, little-endian) of each text."""
        if not texts:
            return []
        whole = pa.array([utf8(t) for t in texts], pa.large_binary()).view(pa.large_string())
        cut = pc.ascii_split_whitespace(pc.ascii_lower(whole) if self.lower else whole)
        # only distinct words become Python's; white space at a text's ends leaves empty ones
        words = cut.flatten().dictionary_encode()
        distinct = words.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        if len(self.words) > WORD_TABLE:
            self.words.clear()
        self.words[b""] = b""
        ids = list(map(self.words.get, distinct))
        new = [k for k, x in enumerate(ids) if x is None]
        if new:
            self._learn({distinct[k] for k in new})
            for k in new:
                ids[k] = self.words[distinct[k]]
        each = pa.array(ids, pa.large_binary()).take(words.indices)
        raw = memoryview(each.buffers()[2] or b"")
        ends = np.frombuffer(each.buffers()[1], "<i8", len(each) + 1)[cut.offsets.to_numpy()].tolist()
        return [bytes(raw[a:z]) for a, z in zip(ends, ends[1:], strict=False)]

    def _learn(self, fresh: set[bytes]) -> None:
        """Put words into the table."""
        odd: list[bytes] = []
        if self.cut:
            plain = [w for w in fresh if w.isascii()]
            if self.special(b" ".join(plain).decode()):
                plain = [w for w in plain if not self.special(w.decode())]
            self.words.update(zip(plain, self._cut(b" ".join(plain).decode()), strict=True) if plain else ())
            latin = list(fresh.difference(plain))
            spelt = b" ".join(latin).decode().lower()
            if latin and (max(spelt) >= chr(LATIN) or self.special(spelt)):
                known = [max(t) < chr(LATIN) and not self.special(t) for t in spelt.split(" ")]
                odd = [w for w, k in zip(latin, known, strict=True) if not k]
                spelt = " ".join(t for t, k in zip(spelt.split(" "), known, strict=True) if k)
                latin = [w for w, k in zip(latin, known, strict=True) if k]
            self.words.update(zip(latin, self._cut(spelt), strict=True) if latin else ())
        else:
            odd = list(fresh)
        for w, e in zip(odd, self.whole.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False), strict=True):
            self.words[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def _cut(self, words: str) -> list[bytes]:
        """Ids of each of some words of Latin letters with spaces between them."""
        pieces = self.cut(words)
        if len(self.pieces) > PIECE_TABLE:
            self.pieces.clear()
        table = self.pieces
        table[" "] = self.SEPARATOR
        fresh = list(set(pieces).difference(table))
        if fresh:
            spelt = [p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode())) for p in fresh]
            lines = [" ".join(spelt[k : k + LINE]) for k in range(0, len(spelt), LINE)]
            ids = np.array([i for e in self.bare.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], "<u4")
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            raw = ids.tobytes()
            table.update(zip(fresh, [raw[a:z] for a, z in zip([0, *ends], ends, strict=False)], strict=True))
        return b"".join(map(table.__getitem__, pieces)).split(self.SEPARATOR)


class CorruptBlock(ValueError):
    """A block's ids don't match its checksum."""


def tokenize(path: str, texts: list[str | None], end: int | None = None) -> list[bytes]:
    """Ids (uint32, little-endian) of each text by the tokenizer file, without special tokens, then `end`."""
    last = b"" if end is None else struct.pack("<I", end)
    return [ids + last for ids in Words.of(path).encode(texts)]


def closed(ids: list[bytes], frame_ids: int) -> list[int]:
    """Places after the last document of each frame that these documents fill."""
    bounds, size = [], 0
    for k, x in enumerate(ids):
        size += len(x) // 4
        if size >= frame_ids:
            bounds.append(k + 1)
            size = 0
    return bounds


def pack_frames(doc_ids: list[int | None], ids: list[bytes], frame_ids: int = FRAME_IDS, block: int = rangecoder.BLOCK) -> list[tuple[int, int, bytes]]:
    """(documents, ids, bytes) of each frame."""
    bounds = [0, *closed(ids, frame_ids)]
    if bounds[-1] < len(ids):
        bounds.append(len(ids))
    frames, blocks = [], []
    for a, z in zip(bounds, bounds[1:], strict=False):
        flat = np.frombuffer(b"".join(ids[a:z]), "<u4")
        cut = np.array_split(flat, -(-len(flat) // block)) if len(flat) else []
        frames.append((a, z, len(flat), len(cut)))
        blocks += cut
    coded = rangecoder.encode_blocks(blocks)
    out, at = [], 0
    for a, z, n, k in frames:
        keys = np.array([0 if d is None else d for d in doc_ids[a:z]], "<i8").tobytes()
        nulls = np.array([d is None for d in doc_ids[a:z]], "u1").tobytes()
        index = zlib.compress(keys + nulls + np.array([len(x) // 4 for x in ids[a:z]], "<u4").tobytes())
        head = struct.pack("<4s3I", MAGIC, z - a, k, len(index)) + index
        own = range(at, at + k)
        head += b"".join(struct.pack("<3I", len(coded[i]), len(blocks[i]), zlib.crc32(blocks[i].tobytes())) for i in own)
        out.append((z - a, n, head + b"".join(coded[i] for i in own)))
        at += k
    return out


def unpack_frames(frames: list[bytes]) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """doc_ids and ids (uint32, little-endian) of each frame."""
    parsed, blocks, sizes, sums = [], [], [], []
    for f in frames:
        magic, n, k, length = struct.unpack_from("<4s3I", f)
        if magic != MAGIC:
            raise CorruptBlock("not a frame of token ids")
        index = zlib.decompress(f[16 : 16 + length])
        keys, nulls = np.frombuffer(index, "<i8", n), np.frombuffer(index, "u1", n, 8 * n)
        counts = np.frombuffer(index[9 * n :], "<u4").astype(np.int64)
        table = np.frombuffer(f, "<u4", 3 * k, 16 + length).reshape(-1, 3)
        at = 16 + length + 12 * k
        for size, ids, crc in table.tolist():
            blocks.append(f[at : at + size])
            sizes.append(ids)
            sums.append(crc)
            at += size
        parsed.append(([None if x else d for d, x in zip(keys.tolist(), nulls.tolist(), strict=True)], counts, k))
    decoded = rangecoder.decode_blocks(blocks, sizes)
    at = 0
    for doc_ids, counts, k in parsed:
        for x, crc in zip(decoded[at : at + k], sums[at : at + k], strict=True):
            if zlib.crc32(x.tobytes()) != crc:
                raise CorruptBlock("a block's ids don't match its checksum")
        raw = b"".join(x.tobytes() for x in decoded[at : at + k])
        at += k
        ends = (np.cumsum(counts) * 4).tolist()
        yield doc_ids, [raw[a:z] for a, z in zip([0, *ends], ends, strict=False)]


def write(docs: DataFrame, path: str, tokenizer_path: str, end: int | None = 1, frame_ids: int = FRAME_IDS, block: int = rangecoder.BLOCK) -> None:
    """Encode docs (doc_id, text; other columns are ignored) into frames below path.

    Rows come in ascending order of doc_id, null first, then of text. A null
    text counts as empty, so its document has the end id alone, or none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, frame, before = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        held: list[bytes] = []
        size = 0

        def flush(docs):
            nonlocal frame, before, size
            packed = pack_frames(keys[:docs], held[:docs], frame_ids, block)
            del keys[:docs], held[:docs]
            for n, ids, data in packed:
                size -= ids
                arrays = [pa.array([part], pa.int32()), pa.array([frame], pa.int32()), pa.array([n], pa.int64()), pa.array([ids], pa.int64()), pa.array([before], pa.int64()), pa.array([data], pa.binary())]
                frame += 1
                before += ids
                yield pa.RecordBatch.from_arrays(arrays, ["part", "frame", "n_docs", "n_ids", "before", "data"])

        waiting: list[str | None] = []
        chars = 0

        def encode():
            nonlocal size, chars
            new = tokenize(tokenizer_path, waiting, end)
            waiting.clear()
            chars = 0
            held.extend(new)
            size += sum(map(len, new)) // 4
            # frames that advance together, and full ones alone: a call for a few of them takes nearly as many steps
            while size >= HELD_IDS:
                total = np.cumsum([len(x) // 4 for x in held])
                ready = [z for z in closed(held, frame_ids) if total[z - 1] >= HELD_IDS]
                if not ready:
                    break
                yield from flush(ready[0])

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, z in slices(texts):
                keys += ids[a:z]
                waiting += texts[a:z]
                chars += sum(len(t) for t in texts[a:z] if t)
                if chars >= TEXT_CHARS:
                    yield from encode()
        yield from encode()
        if keys:
            yield from flush(len(keys))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, min(MOST_PARTITIONS, -(-input_bytes(rows) // PARTITION_BYTES)))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    small_batches(rows.sparkSession)  # bounded() may deal the rows out anew, out of order
    frames = rows.mapInArrow(tidy(run), "part int, frame int, n_docs long, n_ids long, before long, data binary")
    # row groups of a few frames, so that readers share a file
    frames.write.option("parquet.block.size", GROUP_BYTES).option("parquet.page.size.row.check.min", 1).option("parquet.page.size.row.check.max", 1).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids of a dataset: start counts the ids of all documents before; ids is binary (uint32)."""
    frames = spark.read.parquet(path)
    parts = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row for each of at most MOST_PARTITIONS partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = frames.select("part", "n_ids", "before", "data").join(F.broadcast(parts), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column("n_ids").to_pylist()
            starts = batch.column("base").to_pylist()
            a = 0
            while a < len(counts):
                z = a + 1
                while z < len(counts) and sum(counts[a : z + 1]) <= HELD_IDS:
                    z += 1
                frames = batch.column("data").slice(a, z - a).to_pylist()
                for base, (doc_ids, ids) in zip(starts[a:z], unpack_frames(frames), strict=True):
                    at = base + np.cumsum([0, *[len(x) // 4 for x in ids[:-1]]])
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(at, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])
                a = z

    return rows.select("n_ids", (F.col("base") + F.col("before")).alias("base"), "data").mapInArrow(tidy(run), "doc_id long, start long, ids binary")


def digest(read_back: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read() returns."""
    return read_back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
