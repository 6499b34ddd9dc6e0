"""Axis evidence and LaTeX column functions."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import latex as L
from lectern.operators import compare as C

DRAFT = r"""Intro words. \section{Method} We propose a thing. \item We use datasets. Training runs for a total of 10^5 updates. We use a batch size of 64.
\section{Data} We evaluate on the large benchmark. We use 5 seeds."""
OTHER = "We pretrained on 60 million pairs of examples. This paper uses a corpus."


@pytest.fixture(scope="module")
def sections(spark):
    return C.split_sections(spark.createDataFrame([("draft", DRAFT), ("other", OTHER), ("none", "")], "doc string, text string")).cache()


def test_sections(sections):
    assert [(r.heading) for r in sections.where("doc = 'draft'").orderBy("ord").collect()] == ["(preamble)", "Method", "Data"]
    assert [(r.heading) for r in sections.where("doc = 'other'").collect()] == ["(body)"]


def test_evidence(sections):
    got = {(r.doc, r.axis): r for r in C.evidence(sections).collect()}
    assert got["draft", "data"].quote == "We evaluate on the large benchmark." and got["draft", "data"].section == "Data"
    assert got["draft", "problem"].quote == "We propose a thing." and got["other", "problem"].quote == "This paper uses a corpus."
    assert not got["other", "seeds"].found and got["draft", "seeds"].found
    wide = C.side_by_side(C.evidence(sections), ["draft", "other"])
    assert wide.columns == ["axis", "draft", "other"] and wide.count() == len(C.AXES)


def test_scale(sections):
    s = C.training_scale(sections)
    assert {(r.doc, r.examples, r.how) for r in s.collect()} == {("draft", 6400000, "updates x batch"), ("other", 60000000, "stated")}
    assert [r.note for r in C.scale_notes(s, "draft").collect()] == ["6.4M vs 60M: about 11% of the other's scale"]


def test_full_text(spark):
    rows = [("a", 2, "pdf", "text"), ("a", 1, "latex", " "), ("b", 4, "abstract", "short"), ("c", 1, "latex", None)]
    got = {r.doc: (r.source, r.degraded) for r in C.full_text(spark.createDataFrame(rows, "doc string, rung int, source string, text string")).collect()}
    assert got == {"a": ("pdf", False), "b": ("abstract", True), "c": ("none", True)}


@pytest.mark.parametrize(
    ("function", "text", "want"),
    [
        (L.contributions, "We know. Our contributions are: (i) a fast new method; (ii) proofs of its bounds. End.", ["a fast new method", "proofs of its bounds"]),
        (L.packages, "\\usepackage[x]{a, b}\n%\\usepackage{no}\n\\usepackage{a}", ["a", "b"]),
        (L.escape, "50% of $x_1$ & a_b\\", r"50\% of $x_1$ \& a\_b\textbackslash{}"),
        (L.named_conditions, "By Jensen, f grows", ["jensen:convexity-not-stated"]),
        (L.named_conditions, "By Jensen, f is convex", []),
    ],
)
def test_functions(spark, function, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(function("t").alias("x")).first().x == want


def test_quantifiers(spark):
    got = spark.createDataFrame([(r"\forall x \exists \alpha",)], "t string").select(L.quantifiers("t").alias("q")).first().q
    assert [(q.binder, q.variable) for q in got] == [("forall", "x"), ("exists", "\\alpha")]


def test_citations(spark):
    tex = spark.createDataFrame([(r"\cite{a,b} \citep{c}",)], "text string")
    entries = spark.createDataFrame([("a", {"title": "T"}), ("b", {}), ("d", {"title": "U"})], "key string, fields map<string,string>")
    assert {tuple(r) for r in L.citation_audit(tex, entries).collect()} == {("c", "undefined"), ("d", "uncited"), ("b", "untitled")}
    bbl = spark.createDataFrame([(r"\bibitem[x]{a} \bibitem{b}",)], "text string")
    assert {r.key for r in L.cited_entries(entries, bbl).collect()} == {"a", "b"} and L.cited_entries(entries, bbl.select(F.lit("").alias("text"))).count() == 3


def test_guard():
    assert L.guard("import math\nx = math.pi") == []
    assert L.guard("import os\neval('1')\n().__class__") == ["attribute: __class__", "import: os", "name: eval"]
    assert L.guard("(")[0].startswith("syntax")
