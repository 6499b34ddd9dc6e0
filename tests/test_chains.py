"""Chains of relations, requests, symbols that block, and gradients."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lectern.operators import chains as C
from lectern.operators import engines as E
from lectern.parse import latex


def test_compose_agrees_with_the_parser(spark):
    every = ["=", "<", r"\le", ">", r"\ge", r"\equiv"]
    df = spark.createDataFrame([(a, b) for a in every for b in every], "a string, b string").select("a", "b", C.compose(F.col("a"), F.col("b")).alias("c"))
    assert all(r.c == latex.compose(r.a, r.b) for r in df.collect())


def test_chain_claims(spark):
    rows = [("d", 1, "a", r"\le", "b"), ("d", 2, "", "=", "c"), ("d", 3, None, "<", "e"), ("d", 4, "", ">", "f"), ("d", 5, "x", "=", "y"), ("d", 6, "", "", "z")]
    got = C.chain_claims(spark.createDataFrame(rows, "display string, row int, lhs string, rel string, rhs string"), ["display"])
    out = {(r.row, r.scope): (r.left, r.rel, r.right) for r in got.collect()}
    assert out == {
        (1, "row"): ("a", r"\le", "b"), (2, "row"): ("b", "=", "c"), (3, "row"): ("c", "<", "e"), (4, "row"): ("e", ">", "f"), (5, "row"): ("x", "=", "y"),
        (2, "chain"): ("a", r"\le", "c"), (3, "chain"): ("a", r"\le", "e"),
    }


def test_symbols_and_requests(spark):
    inv = spark.createDataFrame([("d", "x", "declared"), ("d", "y", "unknown")], "doc string, symbol string, provenance string")
    steps = spark.createDataFrame([("d", "s1", ["x"]), ("d", "s2", ["x", "y", "q"]), ("d", "s3", None)], "doc string, step_id string, symbols_used array<string>")
    assert {r.step_id: (r.domains_known, r.unknown) for r in C.domains_known(steps, inv).collect()} == {"s1": (True, []), "s2": (False, ["q", "y"]), "s3": (True, [])}
    cond = spark.createDataFrame([("d", "s2", "positive", "y", "undetermined"), ("d", "s1", "non-zero", "y", "undetermined"), ("d", "s1", "non-zero", "x", "undetermined")], "doc string, step_id string, kind string, expr string, status string")
    assert [tuple(r) for r in C.blocked_symbols(cond, inv).collect()] == [("d", "y", ["non-zero", "positive"], ["s1", "s2"])]
    plan = spark.createDataFrame([("c", "p", ["a"])], "claim_id string, proof_id string, step_ids array<string>")
    s = spark.createDataFrame([("a", "p", 2, "display", "so", "x"), ("b", "p", 1, "narration", "We", "")], "id string, proof_id string, ordinal int, kind string, prose string, math string")
    request = json.loads(C.requests(plan, s).first().request)
    assert [x["id"] for x in request["steps"]] == ["a"] and request["skipped"] == ["b"]
    assert tuple(C.plan_totals(plan).first()) == (1, 1)


def test_strings(spark):
    df = spark.createDataFrame([(["forward:a", "forward:b", "back:c"], None, 2001, 2003)], "p array<string>, n int, a int, z int")
    row = df.select(C.path_kinds(F.col("p")), C.shown_count(F.col("n")), C.year_span(F.col("a"), F.col("z"))).first()
    assert tuple(row) == ("forward, back (3)", "n/r", "2001–2003")


@pytest.mark.parametrize(
    ("f", "claimed", "want"),
    [(lambda x: x**3, lambda x: 3 * x**2, "not-refuted"), (lambda x: x**3, lambda x: 2 * x**2, "refuted"), (lambda x: 1 / x, lambda x: -1 / x**2, "not-refuted"), (lambda x: 5 * x, lambda x: Decimal(5), "not-refuted"), (lambda x: x / 0, lambda x: x, "unverified"), (lambda x: abs(x - Decimal("1.70001")), lambda x: Decimal(-1), "unverified")],
)
def test_gradient(f, claimed, want):
    assert E.gradient("s", f, claimed, {"x": "1.7"}, "x")[0] == want
