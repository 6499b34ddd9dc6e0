"""Checks of claims at exact rational points, and callables as engines.

A claim is lhs rel rhs in some variables with known domains. Points are a table
of rationals for each domain; a step's own hash decides where it starts in
them, so a run can be repeated. User engines are registered functions of a
pandas frame, never generated source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Domains of symbols that have rational points; parse.symbols.DOMAINS has more, for which nothing can be tried.
DOMAINS = (
    "real", "positive", "nonnegative", "nonzero", "negative", "nonpositive", "integer", "integer-positive", "natural", "unit-interval", "unit-interval-half-open",
    "open-unit-interval", "unit",
)
_INSIDE = {
    "real": lambda q: True, "positive": lambda q: q > 0, "nonnegative": lambda q: q >= 0, "nonzero": lambda q: True, "negative": lambda q: q < 0, "nonpositive": lambda q: q <= 0,
    "integer": lambda q: q.denominator == 1, "integer-positive": lambda q: q.denominator == 1 and q > 0, "natural": lambda q: q.denominator == 1 and q > 0,
    "unit-interval": lambda q: 0 < q < 1, "unit-interval-half-open": lambda q: 0 < q < 1, "open-unit-interval": lambda q: 0 < q < 1, "unit": lambda q: 0 < q < 1,
}
#: Of 0, 1 and -1 those that belong to a domain; they are tried for inequalities only.
_ENDS = {
    "real": (0, 1, -1), "nonnegative": (0, 1), "positive": (1,), "integer": (0, 1), "nonzero": (1, -1), "negative": (-1,), "nonpositive": (0, -1), "integer-positive": (1,),
    "natural": (1,), "unit-interval": (0, 1), "unit-interval-half-open": (0,),
}
RELATIONS = {
    "=": lambda a, b: a == b, r"\le": lambda a, b: a <= b, r"\leq": lambda a, b: a <= b, r"\ge": lambda a, b: a >= b, r"\geq": lambda a, b: a >= b,
    "<": lambda a, b: a < b, ">": lambda a, b: a > b, r"\ne": lambda a, b: a != b,
}

Build = Callable[..., tuple[Fraction, Fraction]]
_engines: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}


def register(name: str, engine: Callable[[pd.DataFrame], pd.DataFrame]) -> None:
    """An engine takes the rows of one step and returns step_id, engine, outcome, trials, counterexample."""
    _engines[name] = engine


def domain_points(domain: str, count: int = 24) -> list[Fraction]:
    """Rationals of a domain by rising magnitude: halves, thirds and wholes, without 0 and ±1, which hide errors."""
    # between 0 and 1 halves, thirds and fifths are seven points, so sevenths and elevenths join them
    divisors = (1, 2, 3, 5, 7, 11) if "unit" in domain else (1, 2, 3, 5)
    grid = sorted({Fraction(n, d) for d in divisors for n in range(-60, 61)}, key=lambda q: (abs(q), q < 0))
    return [q for q in grid if q not in (0, 1, -1) and _INSIDE[domain](q)][:count]


def points(step_id: str, domains: dict[str, str], relation: str, trials: int = 24) -> list[dict[str, Fraction]]:
    """Points to try; the ends 0 and 1 of a domain belong to inequalities only."""
    start = int.from_bytes(hashlib.blake2b(step_id.encode(), digest_size=4).digest(), "big")
    pools = {v: domain_points(d) for v, d in domains.items()}
    out = [{v: p[(start + t * (2 * k + 1)) % len(p)] for k, (v, p) in enumerate(pools.items())} for t in range(trials)]
    if relation != "=":
        for e in (0, 1, -1):
            if all(e in _ENDS.get(d, ()) for d in domains.values()):
                out.append({v: Fraction(e) for v in domains})
    return out


def check(step_id: str, domains: dict[str, str], relation: str, build: Build, trials: int = 24) -> tuple[str, int, str]:
    """(outcome, trials, counterexample): refuted, not-refuted, or unverified where nothing could be evaluated.

    Points at which the claim can't be evaluated are passed over. The reported
    counterexample is the failing point of least magnitude among those tried.
    """
    holds, tried, failed = RELATIONS.get(relation), 0, []
    if holds is None or not set(domains.values()) <= set(DOMAINS):
        return "unverified", 0, ""
    for point in points(step_id, domains, relation, trials):
        try:
            a, b = build(**point)
        except (ArithmeticError, ValueError):
            continue
        tried += 1
        if not holds(a, b):
            failed.append(point)
    if not tried:
        return "unverified", 0, ""
    if not failed:
        return "not-refuted", tried, ""
    worst = min(failed, key=lambda p: (sum(map(abs, p.values())), str(p)))
    return "refuted", tried, ", ".join(f"{v}={q}" for v, q in worst.items())


def run_checks(claims: DataFrame, builds: dict[str, Build], trials: int = 24) -> DataFrame:
    """Results of the rational engine for claims (step_id, relation, domains map): step_id, engine, outcome, trials, counterexample.

    A step without a build is unverified.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for c in pdf.itertuples():
            domains = dict(c.domains) if c.domains is not None else {}
            build = builds.get(c.step_id)
            rows.append((c.step_id, "rational", *(check(c.step_id, domains, c.relation, build, trials) if build else ("unverified", 0, ""))))
        return pd.DataFrame(rows, columns=["step_id", "engine", "outcome", "trials", "counterexample"])

    schema = "step_id string, engine string, outcome string, trials int, counterexample string"
    return claims.select("step_id", "relation", "domains").mapInPandas(lambda batches: map(run, batches), schema)


def _guarded(name: str, engine: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return engine(pdf)
        except Exception as e:  # noqa: BLE001  a user's function may fail in any way
            return pd.DataFrame({"step_id": pdf["step_id"].iloc[:1], "engine": [name], "outcome": ["unverified"], "trials": [0], "counterexample": [type(e).__name__]})

    return run


def run_engines(claims: DataFrame, names: list[str]) -> DataFrame:
    """Union of registered engines' results, one group for each step; an engine that raises leaves its step unverified."""
    schema, out = "step_id string, engine string, outcome string, trials int, counterexample string", None
    for name in names:
        own = claims.groupBy("step_id").applyInPandas(_guarded(name, _engines[name]), schema)
        out = own if out is None else out.unionByName(own)
    return out


def demo_claims(spark: SparkSession) -> tuple[DataFrame, dict[str, Build]]:
    """A few claims, true and false, for the catalogue's query."""
    rows = [
        ("square", r"\ge", {"x": "real"}), ("amgm", r"\le", {"x": "positive", "y": "positive"}), ("expand", "=", {"x": "real", "y": "real"}),
        ("wrong", "=", {"x": "real", "y": "real"}), ("ends", "<", {"x": "nonnegative"}), ("divide", r"\ge", {"x": "nonzero"}), ("nobuild", "=", {"x": "real"}),
    ]
    builds: dict[str, Build] = {
        "square": lambda x: (x * x, Fraction(0)),
        "amgm": lambda x, y: (4 * x * y, (x + y) ** 2),
        "expand": lambda x, y: ((x + y) ** 2, x * x + 2 * x * y + y * y),
        "wrong": lambda x, y: ((x + y) ** 2, x * x + y * y),
        "ends": lambda x: (Fraction(0), x),
        "divide": lambda x: (1 / x, Fraction(0)),
    }
    return spark.createDataFrame(rows, "step_id string, relation string, domains map<string,string>"), builds


def gradient(step_id: str, f: Callable[..., object], claimed: Callable[..., object], at: dict[str, str], variable: str, digits: int = 50) -> tuple[str, int]:
    """(outcome, trials) of a claimed partial derivative, by central differences at three widths in `digits` digits.

    Each width is a quarter of the one before, and the error of a right
    derivative falls to about a sixteenth. No error, or one that falls at such a
    rate to nothing, speaks for it. An error that falls but stays, or that
    doesn't settle, is numerical and leaves it unverified; only one that no
    width changes refutes it.
    """
    from decimal import Decimal, InvalidOperation, localcontext

    with localcontext() as context:
        context.prec = digits
        point = {v: Decimal(x) for v, x in at.items()}
        try:
            value = Decimal(claimed(**point))
            errors = []
            for k in (6, 7, 8):
                h = Decimal(2) ** -(2 * k)
                up, down = point | {variable: point[variable] + h}, point | {variable: point[variable] - h}
                errors.append(abs((Decimal(f(**up)) - Decimal(f(**down))) / (2 * h) - value))
        except (ArithmeticError, InvalidOperation, TypeError, ValueError):
            return "unverified", 0
        tiny = Decimal(10) ** -(digits // 2)
        if all(e <= tiny for e in errors):
            return "not-refuted", 3
        ratios = [a / b if b else None for a, b in zip(errors, errors[1:], strict=False)]
        if errors[-1] <= Decimal(10) ** -6 * max(abs(value), Decimal(1)):
            return "not-refuted", 3
        settled = all(r is not None and Decimal("0.5") < r < 2 for r in ratios)
        return ("refuted" if settled else "unverified"), 3
