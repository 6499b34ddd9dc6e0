"""Notation a document uses, and rows that report on its steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Number words before "seeds", and the notes.
COUNT_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
SEVERAL = " training seed(s) reported"
SINGLE = "single training seed — confidence intervals cannot describe training variance"

_CALLS = r"\\([A-Za-z]+)"


def frozen_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols (doc, symbol, domain, occurrences) with place: most occurrences first, then by symbol. An unknown domain is `unknown`."""
    w = Window.partitionBy("doc").orderBy(F.desc("n"), F.asc_nulls_last("symbol"))
    s = symbols.withColumn("n", F.coalesce("occurrences", F.lit(0)))
    return s.select("doc", "symbol", F.coalesce("domain", F.lit("unknown")).alias("domain"), F.col("n").cast("long").alias("occurrences"), F.row_number().over(w).alias("place"))


def glossary(symbols: DataFrame, used: DataFrame) -> DataFrame:
    """Symbols (doc, symbol) that are in used (doc, symbol); documents without any used symbol keep all."""
    s = used.where("symbol is not null").select("doc", "symbol").distinct()
    silent = symbols.join(s.select("doc").distinct(), "doc", "left_anti")
    return symbols.join(s, ["doc", "symbol"], "left_semi").unionByName(silent)


def used_macros(macros: DataFrame, texts: DataFrame, rounds: int = 3) -> DataFrame:
    """Macros (doc, name, body) that the texts (doc, text) call, or the bodies of kept ones, `rounds` calls deep.

    A document whose texts are all null or blank keeps every macro: one missing
    breaks it, one too many doesn't. Each round is an equi-join of names.
    """
    names = macros.select("doc", "name").distinct()
    said = texts.where(F.trim(F.regexp_replace("text", r"\s", " ")) != "")
    kept = said.select("doc", F.explode(F.regexp_extract_all("text", F.lit(_CALLS), F.lit(1))).alias("name")).distinct().join(names, ["doc", "name"], "left_semi")
    calls = macros.select("doc", "name", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(_CALLS), F.lit(1)))).alias("callee"))
    for _ in range(rounds):
        more = kept.join(calls, ["doc", "name"]).select("doc", F.col("callee").alias("name")).join(names, ["doc", "name"], "left_semi")
        kept = kept.unionByName(more).distinct()
    silent = macros.join(said.select("doc").distinct(), "doc", "left_anti")
    return macros.join(kept, ["doc", "name"], "left_semi").unionByName(silent)


def seed_note(quote: Column | str) -> Column:
    """How many training runs a sentence states; empty if it states none."""
    q = F.lower(F.coalesce(F.col(quote) if isinstance(quote, str) else quote, F.lit("")))
    said = F.regexp_extract(q, r"\b(\d+|" + "|".join(COUNT_WORDS) + r")\s+seeds\b", 1)
    words = F.create_map(*[F.lit(x) for k, v in COUNT_WORDS.items() for x in (k, str(v))])
    several = F.coalesce(F.try_element_at(words, said), F.regexp_replace(said, r"^0+(?=\d)", ""))
    single = q.rlike(r"\b(?:training|random)\s+seed\s*\d+\b|\bseed\s*0\b|one training run")
    return F.when(said != "", F.concat(several, F.lit(SEVERAL))).when(single, SINGLE).otherwise("")


def report_rows(steps: DataFrame, proofs: DataFrame, verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    """A row for each step with its proof's claim and its verdict, and one for each finding.

    steps: id, proof_id, kind; proofs: id, claim_id; verdicts: one row a step
    with step, engines, severity, confirmed, detail, scripts; findings: claim,
    proof, step, kind, engine, severity, detail, script. What isn't known is empty.
    """

    def text(c: Column | str) -> Column:
        return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))

    def line(c: str) -> Column:
        return F.replace(text(c), F.lit("\n"), F.lit(" "))

    p = proofs.select(F.col("id").alias("proof_id"), F.col("claim_id").alias("claim"))
    v = verdicts.select(F.col("step").alias("id"), "engines", "severity", "confirmed", "detail", "scripts")
    own = steps.select("id", "proof_id", F.col("kind").alias("step_kind")).join(p, "proof_id", "left").join(v, "id", "left")
    own = own.select(
        text("claim").alias("claim"),
        text("proof_id").alias("proof"),
        F.col("id").alias("step"),
        text("step_kind").alias("kind"),
        F.array_join(F.coalesce("engines", F.array().cast("array<string>")), ",").alias("engine"),
        F.when(F.coalesce("confirmed", F.lit(False)), "confirmed").otherwise(text("severity")).alias("verdict"),
        text("severity").alias("severity"),
        line("detail").alias("detail"),
        F.array_join(F.coalesce("scripts", F.array().cast("array<string>")), ";").alias("script"),
    )
    found = findings.select(*[text(c).alias(c) for c in ("claim", "proof", "step", "kind", "engine")], F.lit("finding").alias("verdict"), text("severity").alias("severity"), line("detail").alias("detail"), text("script").alias("script"))
    return own.unionByName(found)
