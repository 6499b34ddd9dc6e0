"""Citation-graph expansion: candidates with provenance, ranking and coupling clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import graph, joins, merge, scoring


def expand(seeds: DataFrame, edges: DataFrame, topical: DataFrame, cited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates around the seeds, and the seeds that found nothing.

    seeds: title; edges: src_title, direction, seq and a work's title, year,
    venue, doi, cited_by_count, referenced; topical: query, seq and a work.
    cited: title of what is cited already. A work's paths are direction:seed and
    search:query; two seeds in one direction count twice.
    """
    work = ["title", "year", "venue", "doi", "cited_by_count", "referenced"]
    s = seeds.select(X.norm_title("title").alias("seed_key"), F.col("title").alias("seed"))
    e = edges.withColumn("seed_key", X.norm_title("src_title"))
    hops = s.join(e, "seed_key").select("seed", F.struct(F.lit(0).alias("g"), "direction", "seed", "seq").alias("order"), F.concat_ws(":", "direction", "seed").alias("path"), *work)
    found = topical.select(F.lit(None).cast("string").alias("seed"), F.struct(F.lit(1).alias("g"), F.lit("search").alias("direction"), F.col("query").alias("seed"), "seq").alias("order"), F.concat(F.lit("search:"), "query").alias("path"), *work)
    hits = hops.unionByName(found).withColumn("key", X.norm_title("title"))
    excluded = cited.select(X.norm_title("title").alias("key"))
    out = merge.keyed_upsert(hits, "key", "order", ["title", "year", "venue", "doi"], "cited_by_count", "path", "referenced", excluded)
    empty = s.join(hops.select("seed").distinct(), "seed", "left_anti").select(F.col("seed").alias("title"))
    return out, empty


def ranked(candidates: DataFrame, angles: list[str], as_of: int) -> DataFrame:
    """Candidates with score and grade, graded first, then by score and title. An unknown count is the median of the known."""
    normal = F.array(*[X.norm_title(F.lit(a)) for a in angles]) if angles else F.array().cast("array<string>")
    c = merge.impute_median(candidates, "cited_by_count", "cites")
    shared = scoring.overlap(X.norm_title("title"), normal)
    score = F.round(scoring.score(shared, F.size("paths"), F.col("cites"), F.col("year"), as_of), 4)
    return scoring.ranked(c.withColumn("score", score).withColumn("grade", scoring.grade(shared, F.size("paths"))).drop("cites"))


def clusters(candidates: DataFrame, key: str = "key", least: int = 3) -> DataFrame:
    """key, cluster, median_year, size: candidates coupled by `least` common references or more; others are alone.

    A cluster is named by its smallest member. Candidates without known
    references, and clusters without a year, keep null for what isn't known.
    """
    ids = candidates.select(key, "year", "referenced", F.xxhash64(key).alias("id"))
    pairs = joins.coupling_pairs(ids.select("id", F.explode("referenced").alias("ref")), "id", "ref", least)
    comp = graph.connected_components(pairs, "a", "b")
    j = ids.join(comp, "id", "left").withColumn("c", F.coalesce("component_id", "id"))
    per = j.groupBy("c").agg(F.min(key).alias("cluster"), F.median("year").alias("median_year"), F.count("*").alias("size"))
    return j.join(per, "c").select(key, "cluster", "median_year", "size").orderBy(F.asc_nulls_last("median_year"), "cluster", key)
