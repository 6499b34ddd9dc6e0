"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Words kept in a worker's word table before it is emptied.
WORD_TABLE = 200_000
#: Characters of text that a worker handles at a time; one longer text is handled alone.
SLICE_CHARS = 1_000_000

#: Rows of an Arrow batch of whole texts. Spark's own bound counts rows only, 10,000 of them, whatever their length.
BATCH_ROWS = 1_000

_words: dict[bytes, int] = {}

U = np.uint64


def small_batches(spark: SparkSession) -> None:
    """Bring the session's Arrow batches down to BATCH_ROWS rows if they are larger."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))


def bounded(texts: DataFrame) -> DataFrame:
    """The same rows in any order, in small_batches().

    Input of fewer bytes than make a file partition for each core is dealt out
    to all cores, for a text's work outweighs its move.
    """
    small_batches(texts.sparkSession)
    conf = texts.sparkSession.conf
    cores, part = texts.sparkSession.sparkContext.defaultParallelism, _bytes(conf.get("spark.sql.files.maxPartitionBytes"))
    return texts.repartition(cores) if input_bytes(texts) < (cores - 1) * part else texts


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads, by Spark's statistics."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))


def _bytes(setting: str) -> int:
    """134217728, 134217728b and 128m alike."""
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = setting.strip().lower().removesuffix("ib")
    text = text[:-1] if len(text) > 1 and text[-1] == "b" and text[-2] in "kmg" else text
    return int(text) if text.isdigit() else int(text[:-1]) * units[text[-1]]


def tidy(run: Callable, drop: Callable[[], None] = lambda: None) -> Callable:
    """A function over batches that, when its task ends, drops what it kept and gives the memory back.

    Python workers outlive tasks, and the next task may be another operator's.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            drop()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, a bijection."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def drop_words() -> None:
    _words.clear()


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word `[^\\x20\\x09-\\x0D]+` of the text, A-Z in lower case."""
    words = utf8(text).lower().split()
    if len(_words) > WORD_TABLE:
        _words.clear()
    get = _words.get
    out = [get(w) for w in words]
    if None in out:
        for i, h in enumerate(out):
            if h is None:
                w = words[i]
                out[i] = _words[w] = xxhash.xxh3_64_intdigest(w)
    return np.array(out, dtype=np.uint64)


def shingles(text: str | None, width: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles.

    A text of fewer words gives its whole sequence as one shingle; without
    words the set is empty.
    """
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(width, len(w))
    h = np.full(len(w) - n + 1, U(n))
    for k in range(n):
        h = mix(h * U(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
    return np.unique(h)


def slices(texts, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about so many characters."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n + 50
    if start < len(texts):
        yield start, len(texts)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of the batches that hold about SLICE_CHARS characters in `text`, and those texts."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, z in slices(texts):
            yield batch.slice(a, z - a), texts[a:z]


def extended(part: pa.RecordBatch, keep: list[str], **new: pa.Array) -> pa.RecordBatch:
    """The columns `keep` of a batch as they are, and new ones."""
    return pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *new.values()], [*keep, *new])
