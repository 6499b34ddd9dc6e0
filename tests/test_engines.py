"""The rational engine and registered engines."""

import pandas as pd

from lectern.operators import engines as E


def test_outcomes(spark):
    claims, builds = E.demo_claims(spark)
    got = {r.step_id: r for r in E.run_checks(claims, builds).collect()}
    assert {k: r.outcome for k, r in got.items()} == {
        "square": "not-refuted", "amgm": "not-refuted", "expand": "not-refuted", "wrong": "refuted", "ends": "refuted", "divide": "refuted", "nobuild": "unverified",
    }
    assert got["ends"].counterexample == "x=0" and got["square"].trials > 24


def test_points_repeat_and_stay_in_domain():
    assert E.points("s", {"x": "unit"}, "=") == E.points("s", {"x": "unit"}, "=")
    assert all(0 < p["x"] < 1 for p in E.points("s", {"x": "unit"}, r"\le"))
    assert not set(E.domain_points("integer")) & {0, 1, -1}
    assert E.check("s", {"x": "other"}, "=", lambda x: (x, x))[0] == "unverified"
    assert E.check("s", {"x": "real"}, "?", lambda x: (x, x))[0] == "unverified"


def test_registered_engines(spark):
    E.register("yes", lambda pdf: pd.DataFrame({"step_id": pdf["step_id"], "engine": "yes", "outcome": "confirmed", "trials": 1, "counterexample": ""}))
    E.register("boom", lambda pdf: 1 / 0)
    claims, _ = E.demo_claims(spark)
    got = {(r.engine, r.outcome, r.counterexample) for r in E.run_engines(claims, ["yes", "boom"]).collect()}
    assert got == {("yes", "confirmed", ""), ("boom", "unverified", "ZeroDivisionError")}


def test_every_rational_domain_has_points():
    for domain in E.DOMAINS:
        assert len(E.domain_points(domain, 8)) == 8
    assert E.check("s", {"x": "open-unit-interval"}, "<", lambda x: (x * x, x))[0] == "not-refuted"
    assert E.check("s", {"x": "natural"}, ">", lambda x: (x, 2 * x))[0] == "refuted"
