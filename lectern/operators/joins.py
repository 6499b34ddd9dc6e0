"""Joins with the semantics that reference data needs: as-of, interval, author differences, coupling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X


def asof_last_before(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: list[str], strict: bool = False) -> DataFrame:
    """left with, for each row, the columns `take` of the last right row of its group at or before its time.

    One shuffle: both sides are united, sorted by time in their group, and the
    last right row is carried forward by a window, so that a group's size
    squared never arises. strict: before, not at. Of right rows at one time the
    one with the greatest `take` wins. Rows without a match get nulls; null
    times or group values match nothing.
    """
    names = [f"l_{c}" for c in left.columns]
    l = left.select(*[F.col(c).alias(n) for c, n in zip(left.columns, names, strict=True)])
    keyed = l.select(*[F.col(f"l_{b}").alias(f"k_{b}") for b in by], F.col(f"l_{left_time}").alias("t"), F.lit(0 if strict else 1).alias("side"), F.struct(*names).alias("row"), F.lit(None).cast(_struct(right, take)).alias("hit"))
    r = right.where(F.col(right_time).isNotNull()).select(*[F.col(b).alias(f"k_{b}") for b in by], F.col(right_time).alias("t"), F.lit(1 if strict else 0).alias("side"), F.lit(None).cast(keyed.schema["row"].dataType).alias("row"), F.struct(*take).alias("hit"))
    w = Window.partitionBy(*[f"k_{b}" for b in by]).orderBy("t", "side", "hit").rowsBetween(Window.unboundedPreceding, 0)
    carried = keyed.unionByName(r).withColumn("last", F.last("hit", ignorenulls=True).over(w)).where("row is not null")
    known = F.col("t").isNotNull()
    for b in by:
        known &= F.col(f"k_{b}").isNotNull()
    return carried.select(*[F.col(f"row.{n}").alias(c) for n, c in zip(names, left.columns, strict=True)], *[F.when(known, F.col(f"last.{t}")).alias(t if t not in left.columns else f"right_{t}") for t in take])


def _struct(df: DataFrame, columns: list[str]):
    return df.select(F.struct(*columns).alias("s")).schema["s"].dataType


def interval_locate(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, width: float, by: list[str] | None = None) -> DataFrame:
    """points left-joined with the spans [start, end) that hold them, by bins of `width`.

    A span is put into every bin that it touches and a point into its own, so
    the join is an equi-join; choose a width near the usual span's length.
    A point in no span has nulls; a point in several has a row for each.
    Column names of the two must differ, but for those in `by`.
    """
    by = by or []
    bin_of = F.floor(F.col(point).cast("double") / width).cast("long")
    first, last = (F.floor(F.col(c).cast("double") / width).cast("long") for c in (start, end))
    s = spans.where(F.col(start) < F.col(end)).withColumn("__bin", F.explode(F.sequence(first, last)))
    p = points.withColumn("__bin", bin_of)
    s = s.withColumnsRenamed({b: f"__{b}" for b in by}).withColumnRenamed("__bin", "__sbin")
    on = (p["__bin"] == s["__sbin"]) & (F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))
    for b in by:
        on &= p[b] == s[f"__{b}"]
    return p.join(s, on, "left").drop("__bin", "__sbin", *[f"__{b}" for b in by])


def author_diff(bib: Column, record: Column) -> Column:
    """struct(only_bib, only_record) of two arrays of names, by family name.

    Et-al marks are no names and excuse authors missing from bib. Nothing is
    reported across scripts, nor if the record lists organisations only.
    """
    abbreviated = F.exists(bib, X.is_et_al)

    def people(names: Column) -> Column:
        return F.filter(names, lambda n: (n != "") & ~X.is_et_al(n))

    b, r = people(bib), people(record)

    def lacking(own: Column, other: Column) -> Column:
        keys = F.transform(other, X.family_key)
        return F.filter(own, lambda n: ~F.array_contains(keys, X.family_key(n)))

    scripts = (F.size(b) > 0) & (F.size(r) > 0) & (F.exists(b, X.is_latin) != F.exists(r, X.is_latin))
    bodies = (F.size(r) > 0) & F.forall(r, X.looks_like_organisation)
    none = F.array().cast("array<string>")
    silent = scripts | bodies
    return F.struct(
        F.when(silent, none).otherwise(lacking(b, r)).alias("only_bib"),
        F.when(silent | abbreviated, none).otherwise(lacking(r, b)).alias("only_record"),
    )


def name_form_mismatches(bib: Column, record: Column) -> Column:
    """Names in bib whose family the record has, but with other initials only; a record name without initial excuses."""

    def differs(n: Column) -> Column:
        group = F.filter(record, lambda r: X.family_key(r) == X.family_key(n))
        initials = F.transform(group, X.given_initial)
        return (F.size(group) > 0) & (X.given_initial(n) != "") & ~F.array_contains(initials, "") & ~F.array_contains(initials, X.given_initial(n))

    return F.filter(bib, differs)


def full_outer_agreement(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key, outcome_a, outcome_b, side (both, only_a, only_b) and agree (null on one side only)."""
    l, r = a.select(F.col(key), F.col(value).alias("outcome_a"), F.lit(1).alias("in_a")), b.select(F.col(key), F.col(value).alias("outcome_b"), F.lit(1).alias("in_b"))
    both = l.join(r, key, "full_outer")
    side = F.when(F.col("in_a").isNull(), "only_b").when(F.col("in_b").isNull(), "only_a").otherwise("both")
    return both.select(key, "outcome_a", "outcome_b", side.alias("side"), F.when(side == "both", F.col("outcome_a").eqNullSafe(F.col("outcome_b"))).alias("agree"))


def coupling_pairs(refs: DataFrame, owner: str, ref: str, least: int, most_owners: int | None = None) -> DataFrame:
    """Pairs (a, b, shared) of owners that share `least` references or more, a < b.

    An equi-join on the reference instead of a comparison of all pairs; owners
    with fewer than `least` references can't couple and go first. A reference
    with many owners makes their pairs: most_owners, if given, leaves out
    references that more owners share, as too common to tell anything.
    """
    own = refs.select(F.col(owner).alias("o"), F.col(ref).alias("r")).where("o is not null and r is not null").distinct()
    enough = own.groupBy("o").count().where(F.col("count") >= least).select("o")
    own = own.join(enough, "o", "left_semi")
    if most_owners is not None:
        own = own.join(own.groupBy("r").count().where(F.col("count") <= most_owners).select("r"), "r", "left_semi")
    a, b = own.withColumnRenamed("o", "a"), own.withColumnRenamed("o", "b")
    return a.join(b, "r").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
