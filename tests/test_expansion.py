"""Plans, fragments, surveys, symbols and macros."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import expansion as X
from lectern.operators import survey
from lectern.parse import symbols as S


def test_plan(spark):
    claims = spark.createDataFrame([("a", "lemma", None), ("b", "theorem", None), ("c", "theorem", "b"), ("d", "definition", None), ("e", "theorem", "d")], "id string, kind string, duplicate_of string")
    proofs = spark.createDataFrame([("pa", "a", 1), ("pb1", "b", 2), ("pb2", "b", 9), ("pc", "c", 3), ("pe", "e", 5), ("po", None, 4)], "id string, claim_id string, start int")
    steps = spark.createDataFrame([("s1", "pa", 1, "display", False), ("s2", "pa", 2, "narration", True), ("s3", "pb2", 1, "chain-row", False)], "id string, proof_id string, ordinal int, kind string, opaque boolean")
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("a", "a"), (None, "b")], "src string, target string")
    got = [(r.claim_id, r.proof_id, r.dependents, r.step_ids) for r in X.plan(claims, proofs, steps, edges).collect()]
    assert got == [("a", "pa", 2, ["s1"]), ("b", "pb2", 1, ["s3"]), ("e", "pe", 0, [])]
    assert [r.step_ids for r in X.plan(claims, proofs, steps, edges, steps.where("id = 's3'")).collect()] == [[], ["s3"], []]


def test_fragments(spark):
    steps = spark.createDataFrame([("s1", "h1"), ("s2", "h2")], "id string, content_hash string")
    verdicts = spark.createDataFrame([("s2", "MAJOR")], "step_id string, severity string")
    rows = [("r", 1, "s1", "h1", "citation", None, None, "factor", "x"), ("r", 2, "zz", "h", "citation", None, None, "m", ""), ("r", 3, "s1", None, "citation", None, None, "m", "x"), ("r", 4, "s1", "old", "citation", None, None, "m", "x"), ("r", 5, "s1", "h1", "because", None, None, "m", "x"), ("r", 6, "s1", "h1", "equation", "zz", None, "m", "x"), ("r", 7, "s2", "h2", "equation", None, "SKIP", "m", "x")]
    df = spark.createDataFrame(rows, "request_id string, seq int, step_id string, content_hash string, licence string, deferred_to string, checked string, move string, breaks_if string")
    got = {r.seq: r for r in X.validate_rows(df, steps, verdicts, ("factor",)).collect()}
    assert {k: r.problem for k, r in got.items()} == {1: None, 2: "unknown-step", 3: "no-hash", 4: "stale-hash", 5: "bad-licence", 6: "unknown-deferral", 7: "verdict-contradicted"}
    assert got[7].checked == "MAJOR" and got[1].warnings == [] and got[2].warnings == ["nothing-breaks-it", "unlisted-move"]
    gaps = spark.createDataFrame([("r", 1, "BLOCKING", ["s1"], "do"), ("r", 2, "BLOCKING", ["s1"], " "), ("r", 3, "BAD", [], "do"), ("r", 4, "COSMETIC", ["zz"], None)], "request_id string, seq int, severity string, step_ids array<string>, what_would_close_it string")
    assert {r.seq: r.problem for r in X.validate_gaps(gaps, steps).collect()} == {1: None, 2: "no-remedy", 3: "bad-severity", 4: "unknown-step"}
    forbidden = spark.createDataFrame([(r"a \input{x} \def\y",), ("fine",)], "t string").select(X.forbidden_commands(F.col("t")).alias("f"))
    assert [r.f for r in forbidden.collect()] == [["\\def", "\\input"], []]


def test_gaps_and_collisions(spark):
    plan = spark.createDataFrame([("a",), ("b",)], "claim_id string")
    gaps = spark.createDataFrame([("a", "COSMETIC", "x"), ("a", "SUBSTANTIVE", "y")], "request_id string, severity string, what_is_missing string")
    every = X.assemble(plan, gaps, gaps)
    assert [(r.request_id, r.severity) for r in X.reportable(every).collect()] == [("b", "BLOCKING"), ("a", "SUBSTANTIVE")]
    assert sorted(r.severity for r in X.gaps_as_findings(every).collect()) == ["MAJOR", "MINOR", "WEAK"]
    new = spark.createDataFrame([("u", "one", 1), ("u", "two", 2), ("x", "m", 3), ("v", "m", 4)], "symbol string, meaning string, seq int")
    got = {(r.symbol, r.why, r.first_meaning) for r in X.collisions(new, spark.createDataFrame([("x",)], "symbol string")).collect()}
    assert got == {("u", "two-meanings", "one"), ("x", "shadows", "m")}


def test_two_translations(spark):
    steps = spark.createDataFrame([(s, "display", True) for s in "abcd"], "step_id string, kind string, domains_known boolean")
    a = spark.createDataFrame([("a", "refuted"), ("b", "refuted"), ("c", "confirmed"), ("d", "confirmed")], "step_id string, outcome string")
    b = spark.createDataFrame([("a", "refuted"), ("b", "confirmed"), ("c", "confirmed")], "step_id string, outcome string")
    rows = X.adjudicate(steps, a, b)
    assert {r.step_id: r.severity for r in rows.collect()} == {"a": "CRITICAL", "b": "UNVERIFIED", "c": "SKIP"}
    assert tuple(X.agreement(rows).first()) == (3, 66.7, True)


def test_survey(spark):
    w = "title string, year int, venue string, doi string, cited_by_count int, referenced array<string>"
    seeds = spark.createDataFrame([("Seed One",), ("Seed Two",), ("Nothing",)], "title string")
    edges = spark.createDataFrame(
        [("seed one", "forward", 1, "Graph Nets", 2020, "V", None, None, ["r1", "r2", "r3"]), ("Seed Two", "forward", 1, "Graph nets!", 2020, "V", "d", 7, ["r4"]), ("Seed One", "back", 2, "Cited Work", 2000, "V", None, 1, None)],
        "src_title string, direction string, seq int, " + w,
    )
    topical = spark.createDataFrame([("graph nets", 1, "Other Paper", None, "", None, 3, ["r1", "r2", "r3", "r9"])], "query string, seq int, " + w)
    found, empty = survey.expand(seeds, edges, topical, spark.createDataFrame([("cited work",)], "title string"))
    rows = {r.key: r for r in found.collect()}
    assert set(rows) == {"graph nets", "other paper"} and rows["graph nets"].paths == ["forward:Seed One", "forward:Seed Two"] and rows["graph nets"].cited_by_count == 7
    assert [r.title for r in empty.collect()] == ["Nothing"]
    assert [r.grade for r in survey.ranked(found, ["graph nets"], 2025).collect()] == ["THREAT", "BACKGROUND"]
    assert {(r.key, r.cluster, r.size) for r in survey.clusters(found).collect()} == {("graph nets", "graph nets", 2), ("other paper", "graph nets", 2)}


TEXT = r"Let $\alpha > 0$ and $x \in \mathbb{R}^d$. Then $\sum_{t=1}^T \frac{\alpha}{t} \le A^{-1} y$. % $z > 0$"


def test_symbols(spark):
    got = {s[0]: (s[2], s[3], s[4]) for s in S.inventory(TEXT)}
    assert got[r"\alpha"] == (2, "positive", "declared") and got["x"][1:] == ("real-vector", "declared")
    assert got["t"][1:] == ("natural", "inferred") and got["A"][1:] == ("invertible", "inferred") and got["y"][1:] == (None, "unknown") and "z" not in got
    inv = S.symbols(spark.createDataFrame([("d", TEXT)], "doc string, text string"))
    inv = S.overlay(inv, spark.createDataFrame([("y", "negative"), ("_note", "why")], "symbol string, domain string"))
    conditions = [("d", "s", "non-zero", r"\alpha"), ("d", "s", "non-zero", "t"), ("d", "s", "invertible", "A"), ("d", "s", "positive", "y"), ("d", "s", "non-zero", "q"), ("d", "s", "limit-interchange", "")]
    df = spark.createDataFrame(conditions, "doc string, step_id string, kind string, expr string")
    assert {r.expr: r.status for r in S.condition_status(df, inv).collect()} == {r"\alpha": "established", "t": "established", "A": "undetermined", "y": "unstated", "q": "undetermined", "": "unstated"}
    with pytest.raises(Exception, match="not a domain"):
        S.overlay(inv, spark.createDataFrame([("y", "unit_interval")], "symbol string, domain string")).collect()


def test_domain_in_scope(spark):
    d = spark.createDataFrame([("d", "x", 10, "positive"), ("d", "x", 50, "negative")], "doc string, symbol string, end int, domain string")
    u = spark.createDataFrame([("d", "x", 5), ("d", "x", 10), ("d", "x", 99), ("d", "y", 3)], "doc string, symbol string, pos int")
    w = spark.createDataFrame([("d", "x", "real")], "doc string, symbol string, domain string")
    assert {(r.symbol, r.pos): r.domain for r in S.domain_at(d, u, w).collect()} == {("x", 5): "real", ("x", 10): "positive", ("x", 99): "negative", ("y", 3): None}


def test_macros():
    known = S.macros(r"\newcommand{\R}{\mathbb{R}} \newcommand{\norm}[1]{\|#1\|} \providecommand{\R}{no} \renewcommand\E{\mathbb{E}} \DeclareMathOperator{\tr}{tr}")
    assert known["R"] == (0, r"\mathbb{R}") and known["tr"] == (0, r"\operatorname{tr}")
    assert S.expand(r"\norm{\R x} \E\tr \Rest", known) == (r"\|\mathbb{R} x\| \mathbb{E}\operatorname{tr} \Rest", [])
    assert S.expand(r"\a", {"a": (0, r"\a")})[1] == ["a"]


def test_illegal_domains(spark):
    df = spark.createDataFrame([("x", "unit_interval"), ("y", "zzz"), ("z", "real"), ("_n", "bad"), ("w", "")], "symbol string, domain string")
    assert {(r.symbol, r.nearest) for r in S.illegal_domains(df).collect()} == {("x", "unit-interval"), ("y", None)}
