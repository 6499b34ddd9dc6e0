"""Ordered rows: chains, look-ahead, numbering, running budgets, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chain_ids(df: DataFrame, by: list[str], order: list[str], value: str, into: str = "chain_id") -> DataFrame:
    """Number the runs in which `value` strictly increases; a null or a fall starts a new run."""
    w = Window.partitionBy(*by).orderBy(*order)
    goes_on = F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(False))
    return df.withColumn(into, F.sum((~goes_on).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def rows_after(by: list[str], order: list[str]) -> Column:
    """How many rows of the chain follow."""
    w = Window.partitionBy(*by)
    return F.count("*").over(w) - F.row_number().over(w.orderBy(*order))


def all_later(flag: Column, by: list[str], order: list[str]) -> Column:
    """Whether the chain goes on and the flag holds on every later row; null flags don't hold."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return F.coalesce(F.min(F.coalesce(flag, F.lit(False)).cast("int")).over(w) == 1, F.lit(False))


def supersede(df: DataFrame, by: list[str], order: list[str], severity: str = "severity", confirmed: str = "confirmed") -> DataFrame:
    """CRITICAL rows become LOCAL if their chain goes on and all its later rows are confirmed."""
    demoted = (F.col(severity) == "CRITICAL") & all_later(F.col(confirmed), by, order)
    return df.withColumn("demoted", F.coalesce(demoted, F.lit(False))).withColumn(severity, F.when(F.col("demoted"), "LOCAL").otherwise(F.col(severity)))


def licence_ahead(df: DataFrame, by: list[str], order: list[str], licence: str, continues: Column, into: str) -> DataFrame:
    """A row without licence takes that of the next row, if that one continues it."""
    w = Window.partitionBy(*by).orderBy(*order)
    ahead = F.when(F.lead(continues).over(w), F.lead(licence).over(w))
    return df.withColumn(into, F.coalesce(F.col(licence), ahead))


def number_within(df: DataFrame, by: list[str], order: list[str], counted: Column, into: str) -> DataFrame:
    """Counter values in document order; rows that aren't counted have null but keep their place."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.when(counted, F.sum(counted.cast("long")).over(w)))


def suffix_repeats(df: DataFrame, key: str, order: list[str], into: str) -> DataFrame:
    """Unique ids: the second and later rows of a key get #2, #3 and so on."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn(into, F.when(n == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("#"), n.cast("string"))))


def within_budget(df: DataFrame, by: list[str], order: list[str], cost: str, budget: float) -> DataFrame:
    """Rows run in order until the budget is spent: spent_before, and status run or unverified."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(cost).over(w), F.lit(0.0))
    return df.withColumn("spent_before", spent).withColumn("status", F.when(spent < budget, "run").otherwise("unverified"))


def covered_length(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Length of the union of intervals of each group. Intervals with a null end, or none, cover nothing."""
    df = df.where(F.col(start) < F.col(end))
    w = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(end).over(w), F.col(start))
    gain = F.greatest(F.lit(0).cast(dict(df.dtypes)[end]), F.col(end) - F.greatest(F.col(start), reached))
    return df.withColumn("__gain", gain).groupBy(*by).agg(F.sum("__gain").alias("covered"))


def breaker(attempts: DataFrame, by: str, order: list[str], failed: Column, limit: int = 3) -> DataFrame:
    """Attempts with `open`: whether `limit` failures in a row of the host came before; once open, a host stays so."""
    w = Window.partitionBy(by).orderBy(*order)
    runs = attempts.withColumn("__f", failed.cast("long")).withColumn("__run", F.sum(1 - F.col("__f")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum("__f").over(Window.partitionBy(by, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("__s", streak)
    tripped = F.max((F.col("__s") >= limit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("open", F.coalesce(tripped == 1, F.lit(False))).drop("__f", "__run", "__s")
