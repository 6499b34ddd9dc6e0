"""Connected components, reachability and cycles over edge tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import drop_scratch, materialise, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40) -> DataFrame:
    """Component of every vertex that has an edge: (id, component_id).

    component_id is the smallest id reachable. Alternating large-star and
    small-star rounds (Kiveris et al., 2014): each round is aggregations and
    equi-joins over the edge table only, a hub's neighbours are pre-aggregated
    to one minimum, and the edge table is written out after each round, when the
    one before goes.
    Null ends and self edges are ignored; repeated edges count once; an empty
    table gives an empty result.
    """
    e = (
        edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e, path = written(e, "edges")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = (
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        last, (e, path) = path, written(e, "edges")
        drop_scratch(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component_id"))
    ).groupBy("id").agg(F.min("component_id").alias("component_id"))


def reachable(edges: DataFrame, src: str = "src", dst: str = "dst", max_depth: int = 64) -> DataFrame:
    """All (src, dst, depth) with a path of one edge or more; depth is that of the shortest.

    Semi-naive: each round joins the pairs that the last one found with the
    edges, and keeps those not seen. Cycles end when nothing is new; beyond
    max_depth an error is raised. Null ends are ignored.
    """
    e = materialise(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct(), "edges")
    found = fresh = e.withColumn("depth", F.lit(1))
    step = e.withColumnsRenamed({"src": "mid", "dst": "to"})
    for depth in range(2, max_depth + 2):
        new = fresh.join(step, F.col("dst") == F.col("mid")).select("src", F.col("to").alias("dst")).distinct()
        fresh = materialise(new.join(found, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if fresh.isEmpty():
            return found
        found = found.unionByName(fresh)
    raise RuntimeError(f"paths longer than {max_depth}")


def on_cycle(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Vertices (id) that lie on a cycle of two vertices or more; self edges don't count."""
    return reachable(edges.where(F.col(src) != F.col(dst)), src, dst).where("src = dst").select(F.col("src").alias("id"))


def _closing_paths(edges: set[tuple[str, str]]) -> list[list[str]]:
    """One cycle for each edge that leads back into the path of a depth-first walk; vertices in ascending order."""
    ahead: dict[str, list[str]] = {}
    for a, b in sorted(edges, reverse=True):
        ahead.setdefault(a, []).append(b)
    found, seen = [], set()
    for root in sorted(ahead):
        todo = [(root, 0)]  # a vertex and its depth; what lies deeper than the next one has been left
        path: list[str] = []
        while todo:
            at, depth = todo.pop()
            if depth > 0 and at in path[:depth]:
                found.append([*path[path.index(at) : depth], at])
            elif at not in seen:
                seen.add(at)
                path[depth:] = [at]
                todo += [(b, depth + 1) for b in ahead.get(at, ())]
    return found


def cycles(edges: DataFrame, doc: str = "doc", src: str = "src", dst: str = "target") -> DataFrame:
    """doc, ordinal, cycle (array of vertices, the first again at the end): one for each back edge.

    Self edges and null ends don't count. A document's own edges are walked in
    one task; documents are dealt out by their key.
    """
    e = edges.select(F.col(doc).cast("string").alias("doc"), F.col(src).cast("string").alias("a"), F.col(dst).cast("string").alias("b"))
    per = e.where("a is not null and b is not null and a <> b").groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("e"))

    def run(batches):
        for pdf in batches:
            rows = [(d, k, c) for d, own in zip(pdf["doc"], pdf["e"], strict=True) for k, c in enumerate(_closing_paths({(x["a"], x["b"]) for x in own}), 1)]
            yield pd.DataFrame(rows, columns=["doc", "ordinal", "cycle"])

    return per.mapInPandas(run, "doc string, ordinal int, cycle array<string>")
