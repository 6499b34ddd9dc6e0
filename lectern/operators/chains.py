"""Displays as chains of claims, blocked symbols, requests and display strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.parse.latex import EQUAL, GREATER, LESS


def compose(a: Column, b: Column) -> Column:
    """parse.latex.compose as a Column: the relation over two links, null where none holds. An empty one is neutral."""
    weak = F.when(a.isin(*LESS) & b.isin(*LESS), r"\le").when(a.isin(*GREATER) & b.isin(*GREATER), r"\ge")
    return F.when(a == "", b).when(b == "", a).when((a == b) | b.isin(*EQUAL), a).when(a.isin(*EQUAL), b).otherwise(weak)


def chain_claims(rows: DataFrame, by: list[str], order: str = "row") -> DataFrame:
    """Two claims for each row of a display: on the row before, and from the chain's first term.

    rows: lhs, rel, rhs; a continuation row has an empty lhs and goes on from
    the rhs before. Returns by, order, left, rel, right, scope (row or chain).
    The relation from the first term is the links' composition; where it is
    null no chain claim is made. Rows without relation or right side make none.
    """
    w = Window.partitionBy(*by).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    full = rows.where((F.coalesce("rel", F.lit("")) != "") & (F.coalesce("rhs", F.lit("")) != ""))
    given = F.nullif(F.trim("lhs"), F.lit(""))
    part = full.withColumn("lhs", given).withColumn("__seg", F.sum(F.col("lhs").isNotNull().cast("int")).over(upto))
    ws = Window.partitionBy(*by, "__seg").orderBy(order)
    us = ws.rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("__first", F.first("lhs", ignorenulls=True).over(us)).withColumn("__before", F.coalesce("lhs", F.lag("rhs").over(ws)))
    lost = F.lit("?")
    links = F.collect_list("rel").over(us)
    total = F.aggregate(links, F.lit(""), lambda acc, r: F.when(acc == "?", lost).otherwise(F.coalesce(compose(acc, r), lost)))
    part = part.withColumn("__total", F.nullif(total, lost)).withColumn("__n", F.row_number().over(ws))
    own = part.where("__before is not null").select(*by, order, F.col("__before").alias("left"), "rel", F.col("rhs").alias("right"), F.lit("row").alias("scope"))
    chain = part.where("__first is not null and __total is not null and __n > 1").select(*by, order, F.col("__first").alias("left"), F.col("__total").alias("rel"), F.col("rhs").alias("right"), F.lit("chain").alias("scope"))
    return own.unionByName(chain)


def domains_known(steps: DataFrame, inventory: DataFrame) -> DataFrame:
    """step_id, domains_known, unknown: whether every symbol of a step (doc, step_id, symbols_used) has a domain that may refute."""
    used = steps.select("doc", "step_id", F.explode_outer("symbols_used").alias("symbol"))
    known = inventory.where(F.col("provenance").isin("declared", "inferred", "user-supplied")).select("doc", "symbol", F.lit(True).alias("known"))
    j = used.join(known, ["doc", "symbol"], "left")
    lacking = F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("symbol"))))
    return j.groupBy("doc", "step_id").agg(lacking.alias("unknown")).select("doc", "step_id", (F.size("unknown") == 0).alias("domains_known"), "unknown")


def blocked_symbols(conditions: DataFrame, inventory: DataFrame) -> DataFrame:
    """doc, symbol, obligations, steps of symbols without a domain that undetermined conditions (doc, step_id, kind, expr, status) wait for."""
    open_ = conditions.where("status = 'undetermined'")
    unknown = inventory.where("provenance = 'unknown'").select("doc", F.col("symbol").alias("expr"))
    j = open_.join(unknown, ["doc", "expr"])
    return j.groupBy("doc", F.col("expr").alias("symbol")).agg(F.array_sort(F.collect_set("kind")).alias("obligations"), F.array_sort(F.collect_set("step_id")).alias("steps"))


def requests(plan: DataFrame, steps: DataFrame) -> DataFrame:
    """claim_id, request: JSON of a planned claim with its chosen steps, and the ids of those left out."""
    s = steps.select(F.col("proof_id"), "ordinal", F.struct("id", "kind", "prose", "math").alias("step"))
    j = plan.join(s, "proof_id", "left").withColumn("chosen", F.array_contains("step_ids", F.col("step.id")))
    own = F.transform(F.array_sort(F.collect_list(F.when(F.col("chosen"), F.struct("ordinal", "step")))), lambda x: x["step"])
    rest = F.transform(F.array_sort(F.collect_list(F.when(~F.col("chosen"), F.struct("ordinal", "step")))), lambda x: x["step"]["id"])
    g = j.groupBy("claim_id", "proof_id").agg(own.alias("steps"), rest.alias("skipped"))
    return g.select("claim_id", F.to_json(F.struct("claim_id", "proof_id", "steps", "skipped")).alias("request"))


def plan_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("claims"), F.coalesce(F.sum(F.size("step_ids")), F.lit(0)).alias("steps"))


def path_kinds(paths: Column, most: int = 3) -> Column:
    """The kinds of provenance paths, the first few, with how many paths there are."""
    kinds = F.array_distinct(F.transform(paths, lambda p: F.split_part(p, F.lit(":"), F.lit(1))))
    return F.concat(F.concat_ws(", ", F.slice(kinds, 1, most)), F.lit(" ("), F.size(paths).cast("string"), F.lit(")"))


def shown_count(count: Column) -> Column:
    return F.coalesce(count.cast("string"), F.lit("n/r"))


def year_span(low: Column, high: Column) -> Column:
    return F.when(low.isNull(), "undated").when(low == high, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("–"), high.cast("string")))
