"""Scores, grades and verdict ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Grades and severities in order.
GRADES = ("THREAT", "RELATED", "BACKGROUND")
SEVERITIES = ("CRITICAL", "MAJOR", "LOCAL", "MINOR", "WEAK", "UNVERIFIED", "SKIP")


def rank_of(col: Column | str, ladder: tuple[str, ...]) -> Column:
    """Place on a ladder, from 0; null for what isn't on it."""
    return F.nullif(F.array_position(F.array(*map(F.lit, ladder)), F.col(col) if isinstance(col, str) else col), F.lit(0)) - 1


def worst(col: Column | str, ladder: tuple[str, ...] = SEVERITIES) -> Column:
    """Aggregate: the most severe value, SKIP if there is none."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.get(F.array(*map(F.lit, ladder)), F.min(rank_of(c, ladder)).cast("int")), F.lit(ladder[-1]))


def overlap(title: Column, angles: Column) -> Column:
    """How many angles occur in the title; both normalised. Parts of words count."""
    return F.when(F.coalesce(title, F.lit("")) == "", 0).otherwise(F.size(F.filter(angles, lambda a: (a != "") & F.contains(title, a))))


def score(shared: Column, paths: Column, cites: Column, year: Column, as_of: int) -> Column:
    """2 * shared + paths + 0.2 * log10(1 + cites a year) + 0.5 for the last three years."""
    age = F.greatest(F.lit(1), as_of - F.coalesce(year, F.lit(as_of)) + 1)
    fresh = F.when(F.coalesce(year, F.lit(0)) >= as_of - 3, 0.5).otherwise(0.0)
    return 2.0 * shared + paths + 0.2 * F.log10(1 + F.greatest(cites / age, F.lit(0.0))) + fresh


def grade(shared: Column, paths: Column) -> Column:
    """THREAT for overlap from two paths or more, RELATED for either, else BACKGROUND."""
    return F.when((shared > 0) & (paths >= 2), "THREAT").when((shared > 0) | (paths >= 2), "RELATED").otherwise("BACKGROUND")


def ranked(df: DataFrame, grade_col: str = "grade", score_col: str = "score", title: str = "title") -> DataFrame:
    return df.orderBy(rank_of(grade_col, GRADES), F.desc(score_col), title)


def verdict(structural: Column, refuted: Column, confirmed: Column, domains_known: Column, faithful: Column, not_refuted: Column) -> Column:
    """Severity of a step from its engines' outcomes; the first rung that holds counts.

    An unknown domain never refutes, a translation that isn't faithful caps at
    WEAK, and engines that disagree leave a step UNVERIFIED.
    """
    return (
        F.when(structural, "SKIP")
        .when(refuted & confirmed, "UNVERIFIED")
        .when(refuted & ~domains_known & ~faithful, "UNVERIFIED")
        .when(refuted & ~domains_known, "MAJOR")
        .when(refuted & ~faithful, "WEAK")
        .when(refuted, "CRITICAL")
        .when(confirmed & ~faithful, "WEAK")
        .when(confirmed, "SKIP")
        .when(not_refuted, "WEAK")
        .otherwise("UNVERIFIED")
    )


def compose_verdicts(steps: DataFrame, results: DataFrame, confirming: tuple[str, ...] = ("symbolic", "smt")) -> DataFrame:
    """step_id, severity, confirmed from steps (step_id, kind, domains_known) and results (step_id, engine, outcome, translation_confidence).

    Without a translation_confidence a result counts as faithful.
    """
    flags = results.groupBy("step_id").agg(
        F.bool_or(F.col("outcome") == "refuted").alias("refuted"),
        F.bool_or((F.col("outcome") == "confirmed") & F.col("engine").isin(*confirming)).alias("confirmed"),
        F.bool_or(F.col("outcome") == "not-refuted").alias("not_refuted"),
        F.bool_and(F.coalesce(F.col("translation_confidence"), F.lit("faithful")) == "faithful").alias("faithful"),
    )
    no, yes = F.lit(False), F.lit(True)
    j = steps.join(flags, "step_id", "left")
    refuted, confirmed, faithful = F.coalesce("refuted", no), F.coalesce("confirmed", no), F.coalesce("faithful", yes)
    severity = verdict(F.col("kind") == "structural", refuted, confirmed, F.coalesce("domains_known", no), faithful, F.coalesce("not_refuted", no))
    return j.select("step_id", severity.alias("severity"), (confirmed & ~refuted & faithful & (F.col("kind") != "structural")).alias("confirmed"))


def rollup_counts(df: DataFrame, by: str, severity: str = "severity", ladder: tuple[str, ...] = SEVERITIES) -> DataFrame:
    """Counts of each severity for each group, zeros kept, and a total row with a null group."""
    counts = [F.count(F.when(F.col(severity) == s, 1)).alias(s) for s in ladder]
    return df.rollup(by).agg(*counts)


def wilson(successes: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high) of Wilson's interval."""
    p, zz = successes / n, z * z
    centre, spread = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return F.struct(((centre - spread) / (1 + zz / n)).alias("low"), ((centre + spread) / (1 + zz / n)).alias("high"))


def rule_of_three(n: Column) -> Column:
    """Upper 95 % bound of a rate of which n trials showed no case."""
    return 3.0 / n


def no_failures(p: Column, n: Column) -> Column:
    return F.pow(1 - p, n)


def reachable_rate(percent: Column, n: Column) -> Column:
    """Whether some whole number out of n rounds to this whole percentage."""
    return F.exists(F.sequence(F.lit(0).cast("long"), n.cast("long")), lambda k: F.bround(100 * k / n) == percent)


def ratio_percent(a: Column, b: Column) -> Column:
    """a as a percentage of b, halves to even; null if b is 0 or unknown."""
    return F.when(b != 0, F.bround(100 * a / b).cast("long"))
