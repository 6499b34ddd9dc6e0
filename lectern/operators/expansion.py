"""Expansion plans for proofs, and what comes back: fragments, gaps, agreement of two translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import scoring
from lectern.parse.latex import INFERENCES

# Claims that are expanded, licences of a row, severities of a gap, and commands that make a fragment a document.
EXPANDABLE = ("theorem", "lemma", "proposition", "corollary", "claim", "fact")
LICENCES = ("equation", "citation", "named-result", "local-result", "not-established")
GAPS = ("BLOCKING", "SUBSTANTIVE", "NOTATIONAL", "COSMETIC")
FORBIDDEN = (
    r"\documentclass \usepackage \begin{document} \end{document} \newcommand \renewcommand \providecommand \def "
    r"\DeclareMathOperator \input \include \bibliography"
).split()


def dependents(edges: DataFrame) -> DataFrame:
    """claim_id, dependents: references to a claim from other claims, of edges (src, target)."""
    return edges.where("target is not null and not (src <=> target)").groupBy(F.col("target").alias("claim_id")).agg(F.count("*").alias("dependents"))


def plan(claims: DataFrame, proofs: DataFrame, steps: DataFrame, edges: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """One row for each provable claim with a proof: claim_id, proof_id, counts, step_ids, dependents; in order of work.

    claims: id, kind, duplicate_of; proofs: id, claim_id, start; steps: id,
    proof_id, ordinal, kind, opaque; flagged: ids of steps that alone count, if
    given. A claim's last proof counts. A restatement is left out if what it
    restates has a proof itself.
    """
    last = proofs.where("claim_id is not null").groupBy("claim_id").agg(F.max_by("id", "start").alias("proof_id"))
    c = claims.where(F.col("kind").isin(*EXPANDABLE)).select(F.col("id").alias("claim_id"), "kind", "duplicate_of").join(last, "claim_id")
    proved = last.select(F.col("claim_id").alias("original"))
    c = c.join(proved, c["duplicate_of"] == proved["original"], "left_anti")
    chosen = F.col("kind").isin(*INFERENCES)
    s = steps.withColumn("inference", chosen).withColumn("chosen", chosen)
    if flagged is not None:
        marks = flagged.select(F.col("id"), F.lit(True).alias("flag")).distinct()
        s = s.join(marks, "id", "left").withColumn("chosen", chosen & F.coalesce("flag", F.lit(False)))
    per = s.groupBy("proof_id").agg(
        F.count("*").alias("steps"),
        F.count_if("inference").alias("inference_steps"),
        F.count_if("opaque").alias("opaque_steps"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("chosen"), F.struct("ordinal", "id")))), lambda x: x["id"]).alias("step_ids"),
    )
    out = c.join(per, "proof_id", "left").join(dependents(edges), "claim_id", "left")
    zero = {k: 0 for k in ("steps", "inference_steps", "opaque_steps", "dependents")}
    out = out.fillna(zero).withColumn("step_ids", F.coalesce("step_ids", F.array().cast("array<string>")))
    return out.select("claim_id", "proof_id", "kind", *zero, "step_ids").orderBy(F.desc("dependents"), F.desc("inference_steps"), "claim_id")


def flagged_steps(steps: DataFrame, verdicts: DataFrame) -> DataFrame:
    """ids of steps (id, hedges, statuses array, opaque) worth expanding: a real verdict, a hedge, an unstated condition, or opaque."""
    bad = verdicts.where(F.col("severity").isin("CRITICAL", "MAJOR", "WEAK", "UNVERIFIED")).select(F.col("step_id").alias("id"), F.lit(True).alias("bad")).distinct()
    j = steps.join(bad, "id", "left")
    no = F.lit(False)
    return j.where(F.coalesce("bad", no) | F.coalesce(F.size("hedges") > 0, no) | F.coalesce(F.array_contains("statuses", "unstated"), no) | F.coalesce("opaque", no)).select("id")


def validate_rows(rows: DataFrame, steps: DataFrame, verdicts: DataFrame, moves: tuple[str, ...] = ()) -> DataFrame:
    """Fragment rows (request_id, seq, step_id, content_hash, licence, deferred_to, checked, move, breaks_if) with problem and warnings.

    problem is the first of unknown-step, no-hash, stale-hash, bad-licence,
    unknown-deferral, verdict-contradicted; null for a row that may be used.
    `checked` becomes the actual verdict whatever the row claims.
    """
    s = steps.select(F.col("id").alias("step_id"), F.col("content_hash").alias("ledger_hash"), F.lit(True).alias("known"))
    d = steps.select(F.col("id").alias("deferred_to"), F.lit(True).alias("target_known"))
    v = verdicts.select("step_id", F.col("severity").alias("actual"))
    j = rows.join(s, "step_id", "left").join(d, "deferred_to", "left").join(v, "step_id", "left")
    empty = F.coalesce("content_hash", F.lit("")) == ""
    problem = (
        F.when(F.col("known").isNull(), "unknown-step").when(empty, "no-hash").when(~F.col("content_hash").eqNullSafe(F.col("ledger_hash")), "stale-hash")
        .when(~F.coalesce(F.col("licence").isin(*LICENCES), F.lit(False)), "bad-licence").when(F.col("deferred_to").isNotNull() & F.col("target_known").isNull(), "unknown-deferral")
        .when(F.col("actual").isNotNull() & F.col("checked").isNotNull() & (F.col("checked") != F.col("actual")), "verdict-contradicted")
    )
    warnings = [F.when(F.coalesce(F.trim("breaks_if"), F.lit("")) == "", F.lit("nothing-breaks-it"))]
    if moves:
        warnings.append(F.when(~F.coalesce(F.split_part("move", F.lit(":"), F.lit(1)).isin(*moves), F.lit(False)), F.lit("unlisted-move")))
    return j.select(*rows.drop("checked").columns, F.coalesce("actual", "checked").alias("checked"), problem.alias("problem"), F.array_compact(F.array(*warnings)).alias("warnings"))


def forbidden_commands(tex: Column) -> Column:
    """Commands of a fragment's text that belong to a document."""
    return F.array_compact(F.array(*[F.when(F.contains(tex, F.lit(c)), F.lit(c)) for c in FORBIDDEN]))


def validate_gaps(gaps: DataFrame, steps: DataFrame) -> DataFrame:
    """Gaps (request_id, seq, severity, step_ids, what_would_close_it) with problem: bad-severity, no-remedy, unknown-step or null."""
    each = gaps.select("request_id", "seq", F.explode("step_ids").alias("id")).join(steps.select("id"), "id", "left_anti").groupBy("request_id", "seq").agg(F.lit(True).alias("lost"))
    lacking = F.col("severity").isin("BLOCKING", "SUBSTANTIVE") & (F.coalesce(F.trim("what_would_close_it"), F.lit("")) == "")
    problem = F.when(~F.coalesce(F.col("severity").isin(*GAPS), F.lit(False)), "bad-severity").when(lacking, "no-remedy").when(F.col("lost").isNotNull(), "unknown-step")
    return gaps.join(each, ["request_id", "seq"], "left").withColumn("problem", problem).drop("lost")


def assemble(plan_rows: DataFrame, gaps: DataFrame, returned: DataFrame) -> DataFrame:
    """Gaps of planned claims; a claim without a returned fragment (request_id) is a BLOCKING gap itself."""
    missing = plan_rows.select(F.col("claim_id").alias("request_id")).join(returned.select("request_id").distinct(), "request_id", "left_anti")
    missing = missing.select("request_id", F.lit("BLOCKING").alias("severity"), F.lit("no fragment was returned").alias("what_is_missing"))
    return gaps.select("request_id", "severity", "what_is_missing").unionByName(missing)


def reportable(gaps: DataFrame, least: str = "SUBSTANTIVE", everything: bool = False) -> DataFrame:
    """Gaps at least as severe as `least`, in order of severity."""
    rank = scoring.rank_of("severity", GAPS)
    return (gaps if everything else gaps.where(rank <= GAPS.index(least))).orderBy(rank, "request_id")


def gaps_as_findings(gaps: DataFrame) -> DataFrame:
    severity = F.when(F.col("severity") == "BLOCKING", "MAJOR").when(F.col("severity") == "SUBSTANTIVE", "MINOR").otherwise("WEAK")
    return gaps.select(F.col("request_id").alias("claim"), F.lit("gap").alias("kind"), severity.alias("severity"), F.col("what_is_missing").alias("detail"))


def collisions(symbols: DataFrame, existing: DataFrame) -> DataFrame:
    """Symbols (symbol, meaning, seq) brought in with two meanings, or shadowing an existing one: symbol, why, first_meaning."""
    many = symbols.groupBy("symbol").agg(F.min_by("meaning", "seq").alias("first_meaning"), F.count_distinct("meaning").alias("n"))
    taken = existing.select("symbol", F.lit(True).alias("taken")).distinct()
    j = many.join(taken, "symbol", "left")
    why = F.when(F.col("n") > 1, "two-meanings").when(F.col("taken").isNotNull(), "shadows")
    return j.select("symbol", why.alias("why"), "first_meaning").where("why is not null")


def adjudicate(steps: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Severity of steps that two translations were checked for: step_id, outcome_a, outcome_b, agree, severity.

    steps: step_id, kind, domains_known; a and b: step_id, outcome. Both refuted
    is a refutation by both; only one refuted is UNVERIFIED; else a's verdict
    holds. Steps on one side only are left out.
    """
    j = steps.join(a.select("step_id", F.col("outcome").alias("outcome_a")), "step_id").join(b.select("step_id", F.col("outcome").alias("outcome_b")), "step_id")
    ra, rb = F.col("outcome_a") == "refuted", F.col("outcome_b") == "refuted"
    ladder = scoring.verdict(F.col("kind") == "structural", ra & rb, F.col("outcome_a") == "confirmed", F.col("domains_known"), F.lit(True), F.col("outcome_a") == "not-refuted")
    severity = F.when(ra != rb, "UNVERIFIED").otherwise(ladder)
    return j.select("step_id", "outcome_a", "outcome_b", (F.col("outcome_a") == F.col("outcome_b")).alias("agree"), severity.alias("severity"))


def agreement(rows: DataFrame, least: float = 80.0) -> DataFrame:
    """One row: n, agreement_pct, degraded."""
    pct = F.round(100.0 * F.count_if("agree") / F.greatest(F.count("*"), F.lit(1)), 1)
    return rows.agg(F.count("*").alias("n"), pct.alias("agreement_pct"), (pct < least).alias("degraded"))
