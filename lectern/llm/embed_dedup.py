"""Near-duplicate vectors by binary codes of random rotations.

Rotations are random orthogonal matrices. A vector's code is the signs of its
rotated components, packed; slices of the code are the keys of hash tables, and
vectors that share a key are compared. Stored with the code are the factor
f = <code, rotated vector> under the first rotation and that rotated vector in
four bits a component, rounded at random so that its mean is right. The product
of one vector's code with the other's four bits, a few counts of bits, divided
by the factor is an unbiased estimate of the two vectors' inner product, whose
error is below SIGMAS * sqrt((1 - f^2) / f^2 / (d - 1) + (step / 2 f)^2) with
high probability (Gao and Long, 2024).

Only keys and codes are dealt out to the tables. A pair is taken up in the
first table that brings it together, and goes no further if its codes differ in
more bits than SIGMAS standard deviations above what the threshold's angle
gives. Vectors, factors and four bits are joined to the rows of a bucket that
are in a pair that is left; pairs whose estimate's upper bound reaches the
threshold are computed exactly.

Equal vectors become one with a weight. A bucket that is too large for one task
is cut into chunks and each pair of chunks is a task's share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.vectors import matrix, usable
from lectern.operators.graph import connected_components
from lectern.session import materialise

THRESHOLD = 0.95
MISS = 0.01
SIGMAS = 4.0
#: Vectors of a bucket that a chunk holds; buckets up to SMALL are compared pair by pair.
CHUNK = 1_024
SMALL = 48
MOST_BITS = 30
#: Bits of a component beside its sign.
PLANES = 4
CELL = ["t", "key", "ij"]


def rotations(dims: int, count: int, seed: int = 3) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(count)]


def table_shape(n: int, dims: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits of a key, tables): buckets of about eight unrelated vectors, and at the threshold a pair shares no key with probability `miss`."""
    bits = max(1, min(MOST_BITS, dims, math.ceil(math.log2(max(2, n))) - 3))
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - p))) if p < 1 else 1


@dataclass(frozen=True)
class Shape:
    """Of the codes of all vectors of one length."""

    dims: int
    bits: int
    tables: int
    threshold: float

    @property
    def turns(self) -> int:
        return -(-self.tables // (self.dims // self.bits))

    @property
    def most_different(self) -> float:
        """Bits of two codes that differ at the threshold, and SIGMAS standard deviations more."""
        n, p = self.turns * self.dims, math.acos(self.threshold) / math.pi
        return n * p + SIGMAS * math.sqrt(n * p * (1 - p))

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """Keys of all tables from the signs (rows, turns, dims)."""
        each, weights = self.dims // self.bits, 1 << np.arange(self.bits)
        out = np.empty((len(signs), self.tables), np.int32)
        for t in range(self.tables):
            r, k = divmod(t, each)
            out[:, t] = signs[:, r, k * self.bits : (k + 1) * self.bits] @ weights
        return out


def packed(bits: np.ndarray) -> list[bytes]:
    """Rows of bits as bytes, whole words of 64."""
    lacking = -bits.shape[1] % 64
    full = np.concatenate([bits, np.zeros((len(bits), lacking), bits.dtype)], axis=1) if lacking else bits
    return [r.tobytes() for r in np.packbits(full.astype(np.uint8), axis=1, bitorder="little")]


def words(rows: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<u8").reshape(len(rows), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def stored(x: np.ndarray, turns: list[np.ndarray], shape: Shape, seed: int) -> dict[str, list]:
    """Code, keys, factor and the four-bit components of unit vectors."""
    signs = np.stack([x @ turn.T > 0 for turn in turns], axis=1)
    turned = x @ turns[0].T
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / (2**PLANES - 1), 1e-12)
    level = (turned - low[:, None]) / step[:, None]
    level = np.clip(np.floor(level + np.random.default_rng(seed).random(level.shape)), 0, 2**PLANES - 1).astype(np.uint8)
    planes = np.concatenate([np.frombuffer(b"".join(packed(level >> j & 1)), np.uint8).reshape(len(x), -1) for j in range(PLANES)], axis=1)
    return {
        "bits": packed(signs.reshape(len(x), -1)),
        "keys": list(shape.keys(signs)),
        "factor": np.abs(turned).sum(axis=1) / math.sqrt(shape.dims),
        "planes": [r.tobytes() for r in planes],
        "low": low,
        "step": step,
    }


def estimate(code: np.ndarray, factor: np.ndarray, planes: np.ndarray, low: np.ndarray, step: np.ndarray, dims: int) -> np.ndarray:
    """Inner products of some vectors' codes (words of the first rotation) with others' four bits, row by row."""
    width = code.shape[1]
    level = np.zeros(len(code))
    for j in range(PLANES):
        plane = planes[:, j * width : (j + 1) * width]
        both, all_ = (np.bitwise_count(w).sum(axis=1, dtype=np.int64) for w in (code & plane, plane))
        level += (2.0 * both - all_) * 2**j
    ones = 2.0 * np.bitwise_count(code).sum(axis=1, dtype=np.int64) - dims
    return (level * step + ones * low) / math.sqrt(dims) / factor


class _Bucket:
    """Compares the rows of some buckets: first by codes alone, then with the vectors."""

    def __init__(self, shape: Shape, exact: bool):
        self.shape, self.exact = shape, exact

    def _pairs(self, pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows whose codes are close and whose first common table this is, each once."""
        s, n = self.shape, len(pdf)
        code, ids, table, side = words(pdf["bits"]), pdf["h"].to_numpy(), pdf["t"].to_numpy(), pdf["side"].to_numpy()
        signs = np.unpackbits(code.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")[:, : s.turns * s.dims]
        keys = s.keys(signs.reshape(n, s.turns, s.dims).astype(np.int32))
        here = keys[np.arange(n), table] == pdf["key"].to_numpy()  # else the row came by another vector of its hash
        cell = pdf[CELL].to_numpy()
        bucket = np.cumsum(np.concatenate([[0], np.any(cell[1:] != cell[:-1], axis=1)]))
        starts = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [n]])
        sizes = np.diff(starts)

        def first(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ok = ((side[a] == 0) | (side[a] != side[b])) & (ids[a] != ids[b]) & here[a] & here[b]
            a, b = a[ok], b[ok]
            before = (keys[a] == keys[b]) & (np.arange(s.tables)[None, :] < table[a][:, None])
            ok = ~before.any(axis=1)
            return a[ok], b[ok]

        small = np.repeat(sizes <= SMALL, sizes)
        for gap in range(1, int(min(SMALL, sizes.max(initial=0)))):
            a = np.flatnonzero(small[:-gap] & (bucket[:-gap] == bucket[gap:]))
            if len(a):
                ok = np.bitwise_count(code[a] ^ code[a + gap]).sum(axis=1, dtype=np.int64) <= s.most_different
                yield first(a[ok], a[ok] + gap)
        for at, size in zip(starts[:-1], sizes, strict=True):
            if size > SMALL:
                own = code[at : at + size]
                for a0 in range(0, size, 256):
                    different = sum(np.bitwise_count(own[a0 : a0 + 256, None, w] ^ own[None, :, w]).astype(np.int16) for w in range(own.shape[1]))
                    a, b = np.nonzero(different <= s.most_different)
                    a += a0
                    up = a < b
                    a, b = a[up] + at, b[up] + at
                    for c in range(0, len(a), 200_000):
                        yield first(a[c : c + 200_000], b[c : c + 200_000])

    def compare(self, pdf: pd.DataFrame) -> pd.DataFrame:
        if not self.exact:
            left = np.zeros(len(pdf), bool)
            for a, b in self._pairs(pdf):
                left[a] = left[b] = True
            return pdf.loc[left, ["h", *CELL, "side"]]
        return self._exact(pdf)

    def _exact(self, pdf: pd.DataFrame) -> pd.DataFrame:
        s = self.shape
        ids, weight, f = pdf["rep"].to_numpy(), pdf["weight"].to_numpy(), pdf["factor"].to_numpy()
        x, planes = unit(matrix(pdf["vector"])), words(pdf["planes"])
        lead = np.unpackbits(words(pdf["bits"]).view(np.uint8).reshape(len(pdf), -1), axis=1, bitorder="little")[:, : s.dims]
        code, low, step = words(pd.Series(packed(lead))), pdf["low"].to_numpy(), pdf["step"].to_numpy()
        turned = np.maximum(0.0, 1 - f * f) / (f * f) / max(1, s.dims - 1)
        links, edges = np.zeros(len(pdf), np.int64), []
        for a, b in self._pairs(pdf):
            error = SIGMAS * np.sqrt(turned[a] + (step[b] / f[a] / 2) ** 2)
            near = estimate(code[a], f[a], planes[b], low[b], step[b], s.dims) + error >= s.threshold
            a, b = a[near], b[near]
            near = np.einsum("ij,ij->i", x[a], x[b]) >= s.threshold
            a, b = a[near], b[near]
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            edges.append(np.stack([a, b], axis=1))
        return self._rows(ids, links, np.concatenate(edges) if edges else np.empty((0, 2), np.int64))

    def _rows(self, ids: np.ndarray, links: np.ndarray, edges: np.ndarray) -> pd.DataFrame:
        """Links of each vector here (a, a, n), and a spanning forest of them (a, b, 0)."""
        parent: dict[int, int] = {}

        def find(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        tree = []
        for a, b in ids[edges].tolist():
            p, q = find(a), find(b)
            if p != q:
                parent[q] = p
                tree.append((a, b, 0))
        at = np.flatnonzero(links)
        counts = pd.DataFrame({"a": ids[at], "b": ids[at], "n": links[at]}).groupby(["a", "b"], as_index=False).sum()
        return pd.concat([counts, pd.DataFrame(tree, columns=["a", "b", "n"], dtype="int64")])

    def run(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches come in order of bucket; a bucket that a batch's end cuts waits for the rest."""
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            open_ = (pdf[CELL] == pdf[CELL].iloc[-1]).all(axis=1).to_numpy()
            held.append(pdf)
            if not open_.all():
                whole = pd.concat(held, ignore_index=True) if len(held) > 1 else pdf.reset_index(drop=True)
                cut = len(whole) - int(open_[::-1].argmin())
                yield self.compare(whole.iloc[:cut].reset_index(drop=True))
                held = [whole.iloc[cut:]]
        if held:
            yield self.compare(pd.concat(held, ignore_index=True))


def _coded(shape: Shape):
    turns = rotations(shape.dims, shape.turns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                seed = int(pdf["h"].iloc[0]) % (1 << 32)
                yield pd.DataFrame({c: pdf[c] for c in ("h", "rep", "weight", "vector")} | stored(unit(matrix(pdf["vector"])), turns, shape, seed))

    return run


def _dealt(rows: DataFrame, label: str, shape: Shape, exact: bool, schema: str) -> DataFrame:
    buckets = rows.repartition(*CELL).sortWithinPartitions(*CELL)
    return materialise(buckets.mapInPandas(_Bucket(shape, exact).run, schema), label)


def _links(reps: DataFrame, shape: Shape, kind: str, chunk: int) -> DataFrame:
    """Links (a, a, n) and edges (a, b, 0) among the vectors of one length."""
    kept = f"h long, rep long, weight long, vector array<{kind}>, bits binary, keys array<int>, factor double, planes binary, low double, step double"
    coded = materialise(reps.mapInPandas(_coded(shape), kept), "codes")
    placed = coded.select("h", "bits", F.posexplode("keys").alias("t", "key"))
    large = coded.select(F.posexplode("keys").alias("t", "key")).groupBy("t", "key").count().where(F.col("count") > chunk)
    placed = placed.join(large.select("t", "key", F.ceil(F.col("count") / chunk).cast("int").alias("cuts")), ["t", "key"], "left")
    own = F.pmod(F.xxhash64("h", "t"), F.col("cuts"))

    def to(c):
        pair = F.shiftleft(F.least(own, c), 32) + F.greatest(own, c)
        return F.struct(pair.cast("long").alias("ij"), F.when(own == c, 0).when(own < c, 1).otherwise(2).alias("side"))

    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1), to)
    one = F.array(F.struct(F.lit(0).cast("long").alias("ij"), F.lit(0).alias("side")))
    placed = placed.withColumn("to", F.explode(F.coalesce(pairs, one))).select("h", "t", "key", "to.*", "bits")
    close = _dealt(placed, "close", shape, False, "h long, t int, key int, ij long, side int")
    return _dealt(close.join(coded.drop("keys"), "h"), "links", shape, True, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, chunk: int = CHUNK, vector: str = "embedding") -> DataFrame:
    """Links of each row of vectors (vec_id and the vector; other columns are ignored).

    Returns vec_id, n_links, component_id, kept. Two vectors are linked if their
    cosine, in double precision, is `threshold` or more; n_links counts the
    links found, all other rows with an equal vector among them. A pair at the
    threshold is not found with a probability of about `miss`, one of a higher
    cosine with a much smaller one. Vectors that are null, zero or hold null or
    non-finite components are linked with nothing, and vectors of another length
    aren't compared. A null vec_id gives n_links 0, a null component_id and
    kept = false. vec_id should be unique: rows of a repeated one share their
    component, and their links are added up. Empty input gives no rows.
    """
    v = F.when(usable(vector), F.col(vector).cast("array<double>"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    # equal vectors are told by 128 bits of hash, so that no key is a whole vector
    rows = rows.select("vec_id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))
    usable_row = F.col("v").isNotNull() & F.col("vec_id").isNotNull()
    kind = "float" if dict(vectors.dtypes)[vector] == "array<float>" else "double"
    reps = rows.where(usable_row).groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"))
    reps = materialise(reps.select("h", "g", "rep", "weight", F.col("v").cast(f"array<{kind}>").alias("vector"), F.size("v").alias("dims")), "vectors")
    links = vectors.sparkSession.createDataFrame([], "a long, b long, n long")
    for dims, n in sorted((r.dims, r["count"]) for r in reps.groupBy("dims").count().collect()):
        shape = Shape(dims, *table_shape(n, dims, threshold, miss), threshold)
        links = links.unionByName(_links(reps.where(F.col("dims") == dims), shape, kind, chunk))
    counts = links.where("n > 0").groupBy("a").agg(F.sum("n").alias("found")).withColumnRenamed("a", "rep")
    comp = connected_components(links.where("a <> b"), "a", "b").withColumnRenamed("id", "rep")
    # written, so that the last join is one of two tables and a common vector's rows can be dealt out
    labels = reps.select("h", "g", "rep", "weight").join(counts, "rep", "left").join(comp, "rep", "left")
    n_links = (F.coalesce("found", F.lit(0)) + F.col("weight") - 1).cast("long")
    labels = materialise(labels.select("h", "g", n_links.alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "labels")
    out = rows.where(usable_row).join(labels, ["h", "g"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable_row).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= {THRESHOLD} * a.n * b.n),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, coalesce(e.vec_id = c.component_id, FALSE) AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""
