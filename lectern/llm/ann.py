"""Nearest neighbours by collision counting over query-centred windows.

Every block of vectors is indexed by `projections` random directions, each a
sorted array of the vectors' projections. A search at radius R looks at the
windows of half-width WIDTH * R / 2 about the query's projections; larger radii
widen the windows and only what is new is counted (virtual rehashing). The
first radius is START of the distance at which a sample has k neighbours, for
smaller ones would seldom end the search. A vector
that lies in enough windows is verified by its exact distance. At its distance
a neighbour is in a share p of the windows, p = 2 * Phi(WIDTH / 2) - 1; the
threshold is SIGMAS standard deviations below. The search of a block ends when
k verified vectors lie within R (Huang et al., 2015, with the radius itself as
the bound, for recall). The first block is searched before the others; the
distance of its k-th neighbour bounds the radius in all of them, for the k
nearest of all can't lie further away.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.vectors import matrix, usable
from lectern.session import materialise

PROJECTIONS = 256
WIDTH = 2.719
SIGMAS = 1.25
GROWTH = 1.1
START = 0.87
SAMPLE = 256
#: Vectors of a block, and queries that one task searches it for.
BLOCK = 8_192
QUERIES = 2_000


class Index:
    """Sorted projections of a block's vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = 5):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], projections))
        self.sample = np.arange(0, len(ids), -(-len(ids) // SAMPLE))
        p = self.vectors @ self.directions
        self.order = np.argsort(p, axis=0, kind="stable").astype(np.int32).T.copy()
        self.sorted = np.take_along_axis(p, self.order.T, axis=0).T.copy()
        self.verified = 0
        share = math.erf(WIDTH / 2 / math.sqrt(2))
        self.threshold = max(1, math.floor(projections * share - SIGMAS * math.sqrt(projections * share * (1 - share))))

    def search(self, own: int, query: np.ndarray, k: int, most: float = math.inf) -> list[tuple[float, int]]:
        """(distance, id) of the k nearest found up to a radius `most`, without vectors of the id `own`.

        `verified` counts the vectors whose distances were computed.
        """
        n, m = len(self.ids), len(self.sorted)
        centre = query @ self.directions
        low = np.array([np.searchsorted(s, c) for s, c in zip(self.sorted, centre, strict=True)])
        high = low.copy()
        counts, pending = np.zeros(n, np.int32), np.ones(n, bool)
        pending[np.searchsorted(self.ids, own, "left") : np.searchsorted(self.ids, own, "right")] = False
        found_at, found = [np.empty(0, np.int64)], [np.empty(0)]
        near = np.sort(np.linalg.norm(self.vectors[self.sample[pending[self.sample]]] - query, axis=1))
        least = 1e-6 * float(np.linalg.norm(query))
        most += least
        radius = min(most, (START * float(near[min(k, len(near)) - 1]) if len(near) else 1.0) + least)
        while True:
            half = WIDTH * radius / 2
            parts = []
            for j in range(m):
                s = self.sorted[j]
                a, z = np.searchsorted(s, centre[j] - half, "left"), np.searchsorted(s, centre[j] + half, "right")
                if a < low[j]:
                    parts.append(self.order[j, a : low[j]])
                    low[j] = a
                if z > high[j]:
                    parts.append(self.order[j, high[j] : z])
                    high[j] = z
            if parts:
                counts += np.bincount(np.concatenate(parts), minlength=n).astype(np.int32)
            at = np.flatnonzero(pending & (counts >= self.threshold))
            if len(at):
                pending[at] = False
                self.verified += len(at)
                d = self.vectors[at] - query
                found.append(np.sqrt(np.einsum("ij,ij->i", d, d)))
                found_at.append(at)
            distances = np.concatenate(found)
            if (distances <= radius).sum() >= k or radius >= most or not pending.any():
                at = np.concatenate(found_at)
                close = at if len(at) <= k else at[distances <= np.partition(distances, k - 1)[k - 1] * (1 + 1e-9)]
                exact, ids = distance(self.vectors[close] - query), self.ids[close]
                best = np.lexsort((ids, exact))[:k]
                return list(zip(exact[best].tolist(), ids[best].tolist(), strict=True))
            radius = min(most, radius * GROWTH)


def distance(d: np.ndarray) -> np.ndarray:
    """Lengths of the rows, squares added from first to last, so that no library's order of summing matters."""
    total = np.zeros(len(d))
    for column in d.T:
        total += column * column
    return np.sqrt(total)


def _search(k: int, projections: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_query = pdf["query"].to_numpy()
        rows = []
        if is_query.any() and not is_query.all():
            c, q = pdf[~is_query], pdf[is_query].sort_values("vec_id")
            index = Index(c["vec_id"].to_numpy(), matrix(c["vector"]), projections)
            for own, vector, most in zip(q["vec_id"], matrix(q["vector"]), q["most"], strict=True):
                rows += [(own, i, d) for d, i in index.search(own, vector, k, math.inf if most is None or most != most else most)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, projections: int = PROJECTIONS, vector: str = "embedding") -> DataFrame:
    """The k nearest vectors found for each query: query_id, rank, vec_id, score.

    Both tables have vec_id and the vector; other columns are ignored. score is
    the Euclidean distance in double precision. Rows are nearest first, ties to
    the smaller vec_id, from rank 1; fewer than k if there are fewer. Rows of
    the query's own vec_id are no neighbours of it. Null vec_ids and vectors
    that are null, zero, or hold null or non-finite components take no part, and
    vectors of another length aren't compared. Of queries that share a vec_id
    the smallest vector counts; of neighbours that do, the nearest. Empty tables
    give no rows.
    """

    def rows(df: DataFrame) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        return df.where(usable(vector) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))

    own, asked = rows(vectors), rows(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = max(1, -(-own.count() // block))
    groups = max(1, -(-asked.count() // QUERIES))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    c = own.select("*", F.lit(None).cast("double").alias("most"), F.lit(False).alias("query"), F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int").alias("block"), every(groups).alias("part"))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("part")

    def searched(candidates: DataFrame, queries: DataFrame) -> DataFrame:
        return candidates.unionByName(queries).groupBy("block", "part", F.size("vector").alias("dims")).applyInPandas(_search(k, projections), "query_id long, vec_id long, score double")

    q = asked.select("*", F.lit(None).cast("double").alias("most"), F.lit(True).alias("query"), F.lit(0).alias("block"), part)
    found = searched(c.where("block = 0"), q)
    if blocks > 1:
        found = materialise(found, "first-block")
        bound = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("most")).where(F.col("n") >= k)
        asked = asked.join(bound.select(F.col("query_id").alias("vec_id"), "most"), "vec_id", "left")
        q = asked.select("vec_id", "vector", "most", F.lit(True).alias("query"), F.explode(F.sequence(F.lit(1), F.lit(blocks - 1))).alias("block"), part)
        found = found.unionByName(searched(c.where("block > 0"), q))
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.e, v.e) AS score FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d)
SELECT * FROM r WHERE rank <= 10
"""
