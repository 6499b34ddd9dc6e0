"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has `bins` coordinates. In round i < bins each element of a set is
hashed to a random bin with value i + v; in round bins + j all elements go to
bin j, so that after 2 * bins rounds no coordinate is empty, and a set of n
elements needs about bins * ln(bins) / n rounds (Dahlgaard, Knudsen and Thorup,
2017). Two coordinates agree with the Jaccard similarity as probability, and
their sum concentrates as if they were independent.

The stages: documents of equal shingle sets become one class; bands of equal
coordinates tie each class to its bucket's leader; those whose sketches agree
too little with it are tied to a leader among themselves; ties connect into
candidate groups; within a group all pairs are compared on the full sets. A group larger than a task's bound is
cut by set size and hash into chunks, and every pair of chunks that can hold a
link has a task of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import U, bounded, drop_words, extended, mix, shingles, sliced, tidy
from lectern.operators.graph import connected_components
from lectern.session import materialise

BINS = 192
ROWS = 6
#: Share of equal coordinates below which a document isn't grouped with a bucket's leader. It then waits for
#: the next leader of those left in the bucket, LEADERS times at most, and is then grouped without this test.
LOOSE = 0.5
LEADERS = 3
#: Shingles that one verification task takes on from a group.
TASK_SHINGLES = 1_000_000


def sketch(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of 64-bit coordinates for each non-empty set."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.full((len(sets), bins), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = out.reshape(-1)
    active = np.arange(len(sets))
    elements = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    owner = np.repeat(active, sizes)
    for i in range(2 * bins):
        x = mix(elements + mix(np.array([i + 1], dtype=np.uint64)))
        b = ((x >> U(32)) * U(bins) >> U(32)).astype(np.int64) if i < bins else np.full(len(x), i - bins)
        np.minimum.at(flat, owner * bins + b, (x & U(0xFFFFFFFF)) | U(i << 32))
        full = (out != np.iinfo(np.uint64).max).all(axis=1)
        if full.all():
            break
        if i < 8 or not i % 8:
            keep = ~full[owner]
            elements, owner = elements[keep], owner[keep]
    return out


def _sketches(bins: int, rows: int, width: int):
    bands = bins // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sliced(batches):
            sets = [shingles(t, width) for t in texts]
            some = [k for k, s in enumerate(sets) if len(s)]
            s = sketch([sets[k] for k in some], bins)
            keys = np.tile(np.arange(bands, dtype=np.uint64) + U(1), (len(some), 1))
            for r in range(rows):
                keys = mix(keys * U(0x9E3779B97F4A7C15) + s[:, r::rows][:, :bands])
            low = (mix(s) & U(0xFF)).astype(np.uint8)
            sk, kk = [None] * len(sets), [None] * len(sets)
            for at, k in enumerate(some):
                sk[k], kk[k] = low[at].tobytes(), keys[at].view(np.int64)
            yield extended(
                part,
                ["doc_id"],
                n_shingles=pa.array([len(x) for x in sets], pa.int64()),
                fp=pa.array([hashlib.md5(x.tobytes()).digest() if len(x) else None for x in sets], pa.binary()),
                sketch=pa.array(sk, pa.binary()),
                bands=pa.array(kk, pa.list_(pa.int64())),
            )

    return run


def _agreement(bins: int):
    @F.pandas_udf("double")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x = np.frombuffer(b"".join(a), np.uint8).reshape(-1, bins)
        y = np.frombuffer(b"".join(b), np.uint8).reshape(-1, bins)
        return pd.Series((x == y).mean(axis=1))

    return agree


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sliced(batches):
            yield extended(part, ["doc_id", "grp", "tasks"], members=pa.array([shingles(t, width).tobytes() for t in texts], pa.binary()))

    return run


def linked_forest(ids: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among sets: den * intersection >= num * union."""
    sizes = np.array([len(s) for s in sets])
    values, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = df[inverse] > 1
    inverse, owner = inverse[shared], owner[shared]
    order = np.argsort(inverse, kind="stable")
    posting_owner, by_value = owner[order], inverse[order]
    starts = np.searchsorted(by_value, np.arange(len(values)))
    ends = starts + np.where(df > 1, df, 0)
    bounds = np.searchsorted(owner, np.arange(len(sets) + 1))
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for k in range(len(sets)):
        own = inverse[bounds[k] : bounds[k + 1]]
        if den * len(own) < num * sizes[k]:
            continue
        a, n = starts[own], ends[own] - starts[own]
        at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.bincount(posting_owner[at], minlength=len(sets))
        hit = np.flatnonzero(den * both >= num * (sizes[k] + sizes - both))
        for j in hit[hit > k].tolist():
            x, y = find(k), find(j)
            if x != y:
                parent[y] = x
                edges.append((ids[k], ids[j]))
    return edges


def _verify(num: int, den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(b, np.uint64) for b in pdf["members"]]
        edges = linked_forest(pdf["doc_id"].tolist(), sets, num, den) if len(sets) > 1 else []
        return pd.DataFrame(edges, columns=["src", "dst"], dtype="int64")

    return run


def _size_class(num: int, den: int) -> Column:
    """Sets whose classes differ by two or more are too unlike in size for a link."""
    return F.floor(F.log(F.col("n_shingles")) / F.log(F.lit(den / num * 1.001))).cast("int")


def near_duplicates(
    docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, bins: int = BINS, rows: int = ROWS, loose: float = LOOSE, task_shingles: int = TASK_SHINGLES
) -> DataFrame:
    """Near-duplicate component of each row of docs (doc_id, text; other columns are ignored).

    Returns doc_id, n_shingles, component_id, kept. Two documents are linked if
    the Jaccard similarity of their sets of distinct word shingles (64-bit
    hashes) is num/den or more. A text without words, or null, has an empty
    set, is linked with nothing and is its own component. Rows of a null doc_id
    give null component_id and kept = false. A repeated doc_id gives a row for
    each occurrence; the occurrences share a component. Empty input gives no
    rows. Links need one of bins // rows bands of equal coordinates: a pair of
    similarity 0.8 is missed with a probability of 0.00006, one of 0.85 of
    0.0000003, unless others link it.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = materialise(
        bounded(base).mapInArrow(tidy(_sketches(bins, rows, width), drop_words), "doc_id long, n_shingles long, fp binary, sketch binary, bands array<long>"), "sketches"
    )
    # one row for each distinct set, so that a group of copies is brought down to one row before the shuffle
    heads = table.where("fp is not null and doc_id is not null").groupBy("fp")
    heads = heads.agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n_shingles", "sketch", "bands"), "doc_id").alias("h"))
    heads = materialise(heads.select("fp", "rep", "h.*"), "heads")

    sk = heads.select("rep", "sketch")
    waiting, ties = heads.select("rep", F.explode("bands").alias("key")).distinct(), None
    for trial in range(LEADERS):
        star = materialise(_stars(waiting), f"stars-{trial}")
        pairs = star.select("rep", "leader").distinct()
        pairs = pairs.join(sk, "rep").join(sk.withColumnsRenamed({"rep": "leader", "sketch": "other"}), "leader")
        close = materialise(pairs.where(_agreement(bins)("sketch", "other") >= loose).select("rep", "leader").distinct(), f"ties-{trial}")
        ties = close if ties is None else ties.unionByName(close)
        waiting = star.join(close, ["rep", "leader"], "left_anti").select("rep", "key")
        if waiting.isEmpty():
            break
    # what agrees with no leader so far stays together, whatever its sketches say, and is left to the exact comparison
    star = ties.unionByName(_stars(waiting).select("rep", "leader")).select(F.col("rep").alias("a"), F.col("leader").alias("b"))
    groups = materialise(connected_components(star, "a", "b").withColumnsRenamed({"id": "rep", "component_id": "grp"}), "groups")

    sized = groups.join(heads.select("rep", "n_shingles").distinct(), "rep").withColumn("s", _size_class(num, den))
    cells = sized.groupBy("grp", "s").agg(F.sum("n_shingles").alias("total"))
    whole = cells.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("s", F.ceil(F.col("total") / task_shingles).cast("int")))).alias("cuts"), F.sum("total").alias("total"))
    placed = sized.join(whole, "grp")

    def cuts(shift: int) -> Column:
        return F.coalesce(F.try_element_at("cuts", F.col("s") + shift), F.lit(0))

    own = F.pmod(F.xxhash64("rep"), cuts(0)).cast("int")
    to = F.concat(
        F.transform(F.sequence(F.lit(0), cuts(0) - 1), lambda c: F.struct(F.col("s").alias("s"), F.lit(0).alias("up"), F.least(own, c).alias("i"), F.greatest(own, c).alias("j"))),
        F.when(cuts(1) > 0, F.transform(F.sequence(F.lit(0), cuts(1) - 1), lambda c: F.struct(F.col("s").alias("s"), F.lit(1).alias("up"), own.alias("i"), c.alias("j")))).otherwise(F.array()),
        F.when(cuts(-1) > 0, F.transform(F.sequence(F.lit(0), cuts(-1) - 1), lambda c: F.struct((F.col("s") - 1).alias("s"), F.lit(1).alias("up"), c.alias("i"), own.alias("j")))).otherwise(F.array()),
    )
    one = F.array(F.struct(F.lit(-1).alias("s"), F.lit(0).alias("up"), F.lit(0).alias("i"), F.lit(0).alias("j")))
    placed = placed.select(F.col("rep").alias("doc_id"), "grp", F.when(F.col("total") <= task_shingles, one).otherwise(to).alias("tasks"))
    members = bounded(base.join(placed, "doc_id")).mapInArrow(tidy(_sets(width), drop_words), "doc_id long, grp long, tasks array<struct<s:int,up:int,i:int,j:int>>, members binary")
    links = (
        members.select("doc_id", "members", "grp", F.explode("tasks").alias("t"))
        .groupBy("grp", "t")
        .applyInPandas(_verify(num, den), "src long, dst long")
    )
    comp = connected_components(materialise(links, "links"))

    # labels by set, written, so that the last join is one of two tables and its hot keys can be dealt out
    labels = heads.select("fp", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    labels = materialise(labels.select("fp", F.coalesce("component_id", "rep").alias("label")), "labels")
    rows = table.select("doc_id", "n_shingles", "fp")
    linked = F.col("fp").isNotNull() & F.col("doc_id").isNotNull()
    out = rows.where(linked).join(labels, "fp").select("doc_id", "n_shingles", F.col("label").alias("component_id"))
    out = out.unionByName(rows.where(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _stars(rows: DataFrame) -> DataFrame:
    """rep, leader and key of rows (rep, key): a key's leader is that of its reps with the smallest hash."""
    leaders = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", "key").alias("h"), "rep")).alias("m"), F.count("*").alias("n")).where("n > 1")
    return rows.join(leaders.select("key", F.col("m.rep").alias("leader")), "key").where("rep <> leader").select("rep", "leader", "key")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS sh
  FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 85 * (x.n_shingles + y.n_shingles - shared)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n_shingles, 0) AS n_shingles, c.component_id, coalesce(d.doc_id = c.component_id, FALSE) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
