"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. Each source's budget is
filled from those counts: the same share of every length, rounded by a seed,
then a bounded knapsack over what the shares leave. Which documents of a length
are taken follows a seeded hash; its leading bits cut every (source, length) into bins, so that a source
or length with a third of all documents is ranked by many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST_COPIES = 2
REST_WORDS = 1 << 22


def _draw(*parts: object) -> float:
    """A number from 0 to 1, below 1, that follows from the parts."""
    return xxhash.xxh3_64_intdigest("\x1f".join(map(repr, parts))) / 2**64


def fit_counts(sizes: list[int], counts: list[int], budget: int, seed: object = 0) -> list[int]:
    """How many documents of each length to take so that their words come close to budget, never above.

    Every length gives budget / have of its documents, rounded up or down:
    along the ascending lengths the shares are added up from a seeded start, and
    each whole number that is passed takes one document more. So every stretch
    of lengths gives its share but for less than one document, and what is
    lacking or too much in all is less than the longest document. Documents too
    much go, and a bounded knapsack over all documents not taken, in seeded
    order, fills the rest; it ends as soon as the budget is met exactly. While it
    isn't, one document each of 16, 32, 64 and so on lengths that were rounded up,
    in seeded order, is given back and the knapsack fills the larger rest; the
    closest sum stays. The rounds end when all those lengths are rounded down, or
    when the rest would exceed both REST_WORDS and twice the longest document: the
    knapsack takes four bytes a word of the rest, however many lengths there are.
    """
    have = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if budget >= have:
        return list(counts)
    unit = math.gcd(*sizes)
    sizes, budget, have = [s // unit for s in sizes], budget // unit, have // unit
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    take = [0] * len(sizes)
    start = int(_draw(seed, "start") * have)
    passed, done = 0, 0
    for i in order:
        passed += counts[i] * budget
        take[i] = (passed + start) // have - done
        done += take[i]
    rest = budget - sum(sizes[i] * take[i] for i in order)
    up = [i for i in order if take[i] > counts[i] * budget // have]
    while rest < 0:
        # of the lengths that were rounded up the shortest that is long enough, or else the longest
        i = up.pop(next((k for k, i in enumerate(up) if sizes[i] >= -rest), -1))
        take[i] -= 1
        rest += sizes[i]
    best, lacking = _filled(sizes, counts, take, rest, seed)
    givers = sorted((i for i in order if take[i] > counts[i] * budget // have), key=lambda i: _draw(seed, "back", sizes[i])) if lacking else []
    most, given, n = max(REST_WORDS, 2 * sizes[order[-1]]), 0, 16
    while lacking and given < len(givers):
        for i in givers[given:n]:
            if rest + sizes[i] > most:
                return best
            take[i] -= 1
            rest += sizes[i]
        given, n = n, 2 * n
        filled, short = _filled(sizes, counts, take, rest, seed)
        if short < lacking:
            best, lacking = filled, short
    return best


def _filled(sizes: list[int], counts: list[int], take: list[int], rest: int, seed: object) -> tuple[list[int], int]:
    """take with others that make up `rest` words or the most below, and what is lacking."""
    # by[w]: the item by which w words were first reached; the items before it reach w less its own words
    by = np.full(rest + 1, -1, np.int32)
    by[0] = 0
    items: list[tuple[int, int]] = [(0, 0)]
    for i in sorted((i for i in range(len(sizes)) if 0 < sizes[i] <= rest and counts[i] > take[i]), key=lambda i: _draw(seed, sizes[i])):
        left, k = min(counts[i] - take[i], rest // sizes[i]), 1
        while left > 0 and by[rest] < 0:
            n = min(k, left)
            left, k = left - n, 2 * k
            words = n * sizes[i]
            new = np.flatnonzero((by[: rest + 1 - words] >= 0) & (by[words:] < 0)) + words
            by[new] = len(items)
            items.append((i, n))
        if by[rest] >= 0:
            break
    take = list(take)
    at = int(np.flatnonzero(by >= 0)[-1])
    lacking = rest - at
    while at:
        i, n = items[by[at]]
        take[i] += n
        at -= n * sizes[i]
    return take, lacking


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target for a table (source, source_size) of one row a source.

    Sources in code-point order, null last, weigh as `weights`, repeating. The
    targets share total * all sizes by weight, but none exceeds most times its
    source's size: sources are put in order of cap a weight unit, and the level
    up to which the others fill follows from running sums.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, onwards, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("share", F.sum("source_size").over(everything) * total)
    rows = rows.withColumn("level", (F.col("share") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onwards))
    rows = rows.withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    level = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("source").isNull().alias("z"), "source", "level"))).over(everything)["level"]
    return rows.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def _fit(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size").reset_index(drop=True)
        sizes, counts = pdf["size"].tolist(), pdf["n"].tolist()
        source = pdf["source"].iloc[0]
        take = fit_counts(sizes, [n * MOST_COPIES for n in counts], int(round(pdf["target"].iloc[0])), (seed, None if pd.isna(source) else source))
        base, more = zip(*[divmod(t, n) for t, n in zip(take, counts, strict=True)], strict=True)
        return pd.DataFrame({"source": pdf["source"], "size": sizes, "base": base, "more": more})

    return run


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, keep: tuple[str, ...] = ()) -> DataFrame:
    """How many words the mix takes of each row of docs (doc_id, text, source).

    Returns doc_id, size, source_size, target, taken, copies and the columns
    named in `keep`. size counts the words of the text, none if it is null or
    empty. taken is size times copies; the copies of a source's rows bring its
    words close to its target and never above it. A null source is a source of
    its own. Rows alike in source, length, doc_id and text are interchangeable.
    Empty input gives no rows. Columns of docs other than these are ignored.
    """
    extra = [c for c in keep if c not in ("doc_id", "source", "text")]
    rows = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("order"),
        *(["text"] if "text" in keep else []),
        *[F.col(c).alias(f"__{c}") for c in extra],
    ).withColumn("bin", F.shiftrightunsigned("order", 54).cast("int"))
    bins = rows.groupBy("source", "size", "bin").agg(F.count("*").alias("n"))
    counts = bins.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = source_targets(totals, weights, total)
    t = targets.withColumnRenamed("source", "s")
    plan = (
        counts.join(t, F.col("source").eqNullSafe(F.col("s")))
        .groupBy("source")
        .applyInPandas(_fit(seed), "source string, size long, base long, more long")
        .withColumnsRenamed({"source": "s", "size": "z"})
    )
    before = Window.partitionBy("source", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    quota = bins.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    quota = quota.withColumn("left", F.col("more") - F.coalesce(F.sum("n").over(before), F.lit(0)))
    quota = quota.join(t, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("bin").alias("b"), "base", "left", "source_size", "target"
    )
    place = F.row_number().over(Window.partitionBy("source", "size", "bin").orderBy("order", "doc_id"))
    out = rows.withColumn("place", place)
    out = out.join(quota, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("bin") == F.col("b")))
    out = out.withColumn("copies", (F.col("base") + (F.col("place") <= F.col("left")).cast("long")))
    return out.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies",
        *[c for c in ("source", "text") if c in keep], *[F.col(f"__{c}").alias(c) for c in extra],
    )
