"""Notation, cycles of claims, and rows that report on steps."""

from pyspark.sql import functions as F

from lectern.operators import graph, notation
from lectern.parse import latex


def test_cycles(spark):
    edges = [("d", "a", "b"), ("d", "b", "c"), ("d", "c", "a"), ("d", "c", "b"), ("d", "a", "a"), ("d", "a", "b"), ("d", "x", None), ("e", "b", "a"), ("e", "a", "c"), ("e", "b", "c"), ("f", "q", "p"), ("f", "p", "q"), (None, "u", "v"), (None, "v", "u")]
    df = spark.createDataFrame(edges, "doc string, src string, target string")
    assert {(r.doc, r.ordinal, "".join(r.cycle)) for r in graph.cycles(df).collect()} == {("d", 1, "abca"), ("d", 2, "bcb"), ("f", 1, "pqp"), (None, 1, "uvu")}
    assert graph.cycles(df.limit(0)).count() == 0


def test_a_long_chain_of_claims():
    n = 5000
    ring = {(f"{i:05}", f"{(i + 1) % n:05}") for i in range(n)}
    (found,) = graph._closing_paths(ring)
    assert len(found) == n + 1 and found[0] == found[-1] == "00000"
    assert graph._closing_paths(ring - {(f"{n - 1:05}", "00000")}) == []


def test_claims_that_rest_on_each_other(spark):
    one = r"\begin{lemma}\label{a} $x=1$ \end{lemma} \begin{proof} So $x=1$ by \ref{b}. \end{proof} "
    two = r"\begin{lemma}\label{b} $y=1$ \end{lemma} \begin{proof} So $y=1$ by \ref{a}. \end{proof}"
    rows = latex.ledger(spark.createDataFrame([("p", one + two), ("q", two), ("r", None)], "doc string, text string"))
    found = latex.structural_findings(rows).where("kind = 'claim-cycle'").collect()
    assert [(r.doc, r.severity, r.detail.count(" -> ")) for r in found] == [("p", "CRITICAL", 2)]


def test_symbols(spark):
    s = spark.createDataFrame([("d", "y", None, 2), ("d", "x", "real", 2), ("d", "z", None, 5), ("d", "w", "real", None), ("e", "y", None, 1)], "doc string, symbol string, domain string, occurrences int")
    assert [tuple(r) for r in notation.frozen_symbols(s).where("doc = 'd'").orderBy("place").collect()] == [("d", "z", "unknown", 5, 1), ("d", "x", "real", 2, 2), ("d", "y", "unknown", 2, 3), ("d", "w", "real", 0, 4)]
    used = spark.createDataFrame([("d", "x"), ("d", "x"), ("d", None)], "doc string, symbol string")
    assert {(r.doc, r.symbol) for r in notation.glossary(s, used).collect()} == {("d", "x"), ("e", "y")}


def test_used_macros(spark):
    m = spark.createDataFrame([("d", "a", r"\b"), ("d", "b", r"\a\c"), ("d", "c", None), ("d", "z", "1"), ("e", "a", ""), ("f", "a", "")], "doc string, name string, body string")
    t = spark.createDataFrame([("d", r"\a"), ("d", None), ("e", None), ("f", "plain")], "doc string, text string")
    assert {(r.doc, r.name) for r in notation.used_macros(m, t).collect()} == {("d", "a"), ("d", "b"), ("d", "c"), ("e", "a")}
    assert {r.name for r in notation.used_macros(m, t, rounds=1).where("doc = 'd'").collect()} == {"a", "b"}


def test_seed_note(spark):
    df = spark.createDataFrame([("Ten seeds and 4 seeds",), ("over 010 seeds",), ("Seed 0 only",), ("one training run",), ("12seeds",), ("",), (None,)], "q string")
    got = [r[0] for r in df.select(notation.seed_note("q")).collect()]
    assert got == ["10" + notation.SEVERAL, "10" + notation.SEVERAL, notation.SINGLE, notation.SINGLE, "", "", ""]


def test_report_rows(spark):
    steps = spark.createDataFrame([("s1", "p1", "display"), ("s2", None, None)], "id string, proof_id string, kind string")
    proofs = spark.createDataFrame([("p1", None)], "id string, claim_id string")
    verdicts = spark.createDataFrame([("s1", ["a", "b"], "MINOR", False, "x\ny", ["f", "g"])], "step string, engines array<string>, severity string, confirmed boolean, detail string, scripts array<string>")
    findings = spark.createDataFrame([], "claim string, proof string, step string, kind string, engine string, severity string, detail string, script string")
    out = notation.report_rows(steps, proofs, verdicts, findings)
    assert {tuple(r) for r in out.collect()} == {("", "p1", "s1", "display", "a,b", "MINOR", "MINOR", "x y", "f;g"), ("", "", "s2", "", "", "", "", "", "")}
    assert out.where(F.col("verdict") == "finding").count() == 0
