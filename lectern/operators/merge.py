"""Keyed merging: first record wins, unknown is not zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by an explicit order; ties would be arbitrary, so the order should be total."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def union_first(sources: list[DataFrame], key: str, order: str) -> DataFrame:
    """Union of sources in order of priority, one row for each key: the first source's first row. Null keys are dropped."""
    ranked = None
    for k, s in enumerate(sources):
        s = s.withColumn("engine", F.lit(k))
        ranked = s if ranked is None else ranked.unionByName(s, allowMissingColumns=True)
    # an aggregation that combines before its shuffle; null keys go after it, for a filter would compute a key twice
    rest = [c for c in ranked.columns if c != key]
    first = ranked.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("engine", order)).alias("__first")).where(F.col(key).isNotNull())
    return first.select(*[key if c == key else F.col(f"__first.{c}").alias(c) for c in ranked.columns])


def keyed_upsert(
    hits: DataFrame, key: str, seq: str, attributes: list[str], count: str, path: str, references: str, excluded: DataFrame | None = None, excluding: Column | None = None
) -> DataFrame:
    """One row for each key: attributes of the first hit, greatest known count, union of references, distinct paths in order.

    Hits are first brought down to one row for each key and path, in an
    aggregation that combines before its shuffle: attributes by min_by on seq,
    references as a set. So a key's last row grows with its distinct paths and
    references alone, not with its hits. Keys that are null, empty or in
    `excluded` (a column named as the key), or of which a hit meets the
    condition `excluding`, are dropped. A count that no hit knows stays null;
    references that none has are an empty array.
    """
    if excluded is not None:
        hits = hits.join(excluded.select(key).distinct(), key, "left_anti")
    bad = F.coalesce(excluding, F.lit(False)) if excluding is not None else F.lit(False)
    none = F.array().cast(dict(hits.dtypes)[references])
    hits = hits.withColumn("__bad", bad).withColumn("__ref", F.explode_outer(F.when(F.size(references) > 0, F.col(references))))
    per = hits.groupBy(key, F.col(path).alias("__path")).agg(
        F.min_by(F.struct(F.col(seq).alias("__seq"), *attributes), F.col(seq)).alias("__first"),
        F.max(count).alias(count),
        F.collect_set("__ref").alias("__refs"),
        F.bool_or("__bad").alias("__bad"),
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.col("__first.__seq").alias("s"), F.col("__path").alias("p"))))
    merged = per.groupBy(key).agg(
        F.min_by("__first", F.col("__first.__seq")).alias("__first"),
        F.max(count).alias(count),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("__refs", none))))).alias(references),
        F.array_distinct(F.transform(ordered, lambda x: x["p"])).alias("paths"),
        # a flag, for a filter on the key itself would be put before the aggregations and compute each key twice
        F.bool_and((F.col(key) != "") & ~F.col("__bad")).alias("__kept"),
    )
    return merged.where("__kept").select(key, *[F.col(f"__first.{a}").alias(a) for a in attributes], count, references, "paths")


def impute_median(df: DataFrame, col: str, into: str, by: list[str] | None = None) -> DataFrame:
    """col with the median of the known values (of the group) for null, 0 if none is known."""
    w = Window.partitionBy(*by) if by else None
    if w is not None:
        known = F.median(col).over(w)
        return df.withColumn(into, F.coalesce(F.col(col).cast("double"), known, F.lit(0.0)))
    stand_in = df.agg(F.coalesce(F.median(col), F.lit(0.0)).alias("__m"))  # one row
    return df.crossJoin(F.broadcast(stand_in)).withColumn(into, F.coalesce(F.col(col).cast("double"), F.col("__m"))).drop("__m")


def ordered_distinct(*arrays: Column) -> Column:
    return F.array_distinct(F.concat(*arrays))


def set_difference(before: Column, after: Column) -> Column:
    """Members dropped as -x and members added as +x, sorted."""
    gone = F.transform(F.array_except(before, after), lambda x: F.concat(F.lit("-"), x.cast("string")))
    new = F.transform(F.array_except(after, before), lambda x: F.concat(F.lit("+"), x.cast("string")))
    return F.array_sort(F.concat(gone, new))


def first_definitions(defs: DataFrame, name: str, body: str, seq: str) -> DataFrame:
    """name, body of the first definition, and conflicts: how many later definitions differ."""
    first = defs.groupBy(name).agg(F.min_by(body, seq).alias("__body"))
    return defs.join(first, name).groupBy(name).agg(F.first("__body").alias(body), F.sum((~F.col(body).eqNullSafe(F.col("__body"))).cast("long")).alias("conflicts"))
