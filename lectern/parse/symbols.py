"""Symbols of a text's math, their domains, and macros."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.parse.bibtex import balanced
from lectern.parse.latex import _MATH, plain

# Names of domains, and which of them settle an obligation.
DOMAINS = (
    "real integer natural integer-positive complex positive negative nonnegative nonpositive unit-interval unit-interval-half-open "
    "open-unit-interval real-vector matrix invertible positive-definite positive-semidefinite probability-distribution convex"
).split()
SETTLES = {
    "non-zero": ("positive", "negative", "positive-definite", "probability-distribution", "natural", "open-unit-interval"),
    "positive": ("positive", "positive-definite", "probability-distribution", "open-unit-interval", "natural"),
    "non-negative": (
        "positive", "positive-definite", "probability-distribution", "open-unit-interval", "natural", "nonnegative", "unit-interval",
        "unit-interval-half-open", "positive-semidefinite",
    ),
    "invertible": ("positive-definite", "invertible"),
}
# Declarations, what follows a symbol, and the domain that it gives.
DECLARATIONS = (
    (r"\s*>\s*0(?![.\d])", "positive"), (r"\s*<\s*0(?![.\d])", "negative"), (r"\s*\\(?:ge|geq)\s*0(?![.\d])", "nonnegative"), (r"\s*\\(?:le|leq)\s*0(?![.\d])", "nonpositive"),
    (r"\s*\\in\s*\(\s*0\s*,\s*1\s*\)", "open-unit-interval"), (r"\s*\\in\s*\[\s*0\s*,\s*1\s*\)", "unit-interval-half-open"), (r"\s*\\in\s*\[\s*0\s*,\s*1\s*\]", "unit-interval"),
    (r"\s*\\in\s*\\mathbb\s*\{?R\}?\s*\^\s*\{?\w+\s*\\times", "matrix"), (r"\s*\\in\s*\\mathbb\s*\{?R\}?\s*\^", "real-vector"), (r"\s*\\in\s*\\mathbb\s*\{?R\}?", "real"),
    (r"\s*\\in\s*\\mathbb\s*\{?N\}?", "natural"), (r"\s*\\in\s*\\mathbb\s*\{?Z\}?", "integer"), (r"\s*\\in\s*\\mathbb\s*\{?C\}?", "complex"),
    (r"\s*\\succ\s*0", "positive-definite"), (r"\s*\\succeq\s*0", "positive-semidefinite"),
)
# Commands that are letters.
_GREEK = (
    "alpha", "beta", "gamma", "delta", "epsilon", "varepsilon", "zeta", "eta", "theta", "vartheta", "iota", "kappa", "lambda", "mu", "nu", "xi", "pi", "varpi", "rho", "varrho",
    "sigma", "varsigma", "tau", "upsilon", "phi", "varphi", "chi", "psi", "omega", "Gamma", "Delta", "Theta", "Lambda", "Xi", "Pi", "Sigma", "Upsilon", "Phi", "Psi", "Omega", "ell", "hbar", "imath", "jmath",
)
# Fixed value: code points from a symbol's first use within which a declaration of it counts.
WINDOW = 240
# What may stand between a symbol and its relation, indices, powers and primes, and up to four more symbols.
_MARKS = r"(?:_\{[^{}]*\}|_[A-Za-z0-9]|\^\{[^{}]*\}|\^[A-Za-z0-9]|')*"
_LIST = r"(?:\s*,\s*\$?\s*\\?[A-Za-z]+" + _MARKS + r"\$?){0,4}"
_SYMBOL = re.compile(r"\\(?:" + "|".join(_GREEK) + r")(?![A-Za-z])|(?<![A-Za-z\\])[A-Za-z](?![A-Za-z])")


def inventory(text: str | None) -> list[tuple[str, int, int, str | None, str, str]]:
    """(symbol, first offset, occurrences, domain, provenance, evidence) of the symbols in a text's math.

    A domain is declared by the first declaration that starts within WINDOW of
    the symbol's first use, in which the symbol is neither an index nor a part
    of a longer name; its own indices and a list of symbols may follow it. Else it is inferred
    from an index of a sum that starts at a whole number, or from a power of
    -1, which settles no obligation; else it is unknown.
    """
    text, seen = plain(text or ""), {}
    for m in _MATH.finditer(text):
        for s in _SYMBOL.finditer(re.sub(r"\\(?:text|mathrm|label|ref)\s*\{[^}]*\}|\\(?!%s)[A-Za-z]+" % "|".join(_GREEK), lambda x: " " * len(x[0]), m[0])):
            at = m.start() + s.start()
            first, n = seen.get(s[0], (at, 0))
            seen[s[0]] = first, n + 1
    out = []
    for symbol, (first, n) in sorted(seen.items(), key=lambda x: x[1]):
        name = re.escape(symbol) + r"(?![A-Za-z])"
        starts = r"(?<![A-Za-z0-9_^\\])" + re.escape(symbol) + (r"(?![A-Za-z])" if symbol[0] == "\\" else "") + _MARKS + _LIST
        hits = ((re.compile(starts + p).search(text, first, first + WINDOW), domain) for p, domain in DECLARATIONS)
        declared = min(((m.start(), -len(m[0]), domain, m[0]) for m, domain in hits if m), default=None)
        index = re.search(r"\\(?:sum|prod)\s*_\s*\{\s*" + name + r"\s*=\s*(\d+)", text)
        if declared:
            out.append((symbol, first, n, declared[2], "declared", declared[3]))
        elif index:
            out.append((symbol, first, n, "natural" if int(index[1]) else "nonnegative", "inferred", "summation-index"))
        elif re.search(name + r"\s*\^\s*\{\s*-\s*1\s*\}", text):
            out.append((symbol, first, n, "invertible", "inferred", "negative-exponent"))
        else:
            out.append((symbol, first, n, None, "unknown", ""))
    return out


def symbols(docs: DataFrame) -> DataFrame:
    """doc, symbol, first_use, occurrences, domain, provenance, evidence of documents (doc, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, *x) for d, t in zip(pdf["doc"], pdf["text"], strict=True) for x in inventory(t)]
            yield pd.DataFrame(rows, columns=["doc", "symbol", "first_use", "occurrences", "domain", "provenance", "evidence"])

    return docs.select("doc", "text").mapInPandas(run, "doc string, symbol string, first_use int, occurrences int, domain string, provenance string, evidence string")


def overlay(inventory: DataFrame, supplied: DataFrame) -> DataFrame:
    """The inventory with a reader's domains (symbol, domain), by symbol or its name; keys that start with _ are notes.

    A domain that isn't one of DOMAINS raises when the result is evaluated.
    """
    own = supplied.where(~F.col("symbol").startswith("_") & (F.coalesce("domain", F.lit("")) != ""))
    own = own.select(F.regexp_replace("symbol", r"^\\", "").alias("name"), F.col("domain").alias("given"))
    legal = F.col("given").isin(*DOMAINS)
    given = F.when(F.col("given").isNull() | legal, F.col("given")).otherwise(F.raise_error(F.concat(F.lit("not a domain: "), "given")))
    j = inventory.withColumn("name", F.regexp_replace("symbol", r"^\\", "")).join(own, "name", "left").withColumn("given", given)
    return j.withColumn("domain", F.coalesce("given", "domain")).withColumn("provenance", F.when(F.col("given").isNotNull(), "user-supplied").otherwise(F.col("provenance"))).drop("name", "given")


def illegal_domains(supplied: DataFrame) -> DataFrame:
    """symbol, domain, nearest of a reader's domains that are none; nearest by edits, null if more than two in five letters differ."""
    bad = supplied.where(~F.col("symbol").startswith("_") & (F.coalesce("domain", F.lit("")) != "") & ~F.col("domain").isin(*DOMAINS))
    near = F.array_min(F.array(*[F.struct(F.levenshtein("domain", F.lit(d)).alias("edits"), F.lit(d).alias("name")) for d in DOMAINS]))
    return bad.select("symbol", "domain", F.when(near["edits"] <= 0.4 * F.length("domain"), near["name"]).alias("nearest"))


def condition_status(conditions: DataFrame, inventory: DataFrame) -> DataFrame:
    """Conditions (doc, step_id, kind, expr) with status established, unstated or undetermined.

    Known domains are those declared, supplied, or inferred from a sum's index.
    A limit or derivative taken inside is always unstated.
    """
    known = F.col("provenance").isin("declared", "user-supplied") | (F.col("evidence") == "summation-index")
    s = inventory.select("doc", F.col("symbol").alias("expr"), F.when(known, F.col("domain")).alias("known_domain"))
    j = conditions.join(s, ["doc", "expr"], "left")
    settled: Column = F.lit(False)
    for kind, domains in SETTLES.items():
        settled |= (F.col("kind") == kind) & F.col("known_domain").isin(*domains)
    always = F.col("kind").isin("limit-interchange", "differentiation-under-integral")
    status = F.when(always, "unstated").when(F.coalesce(settled, F.lit(False)), "established").when(F.col("known_domain").isNotNull(), "unstated").otherwise("undetermined")
    return j.withColumn("status", status)


def domain_at(declarations: DataFrame, uses: DataFrame, document: DataFrame) -> DataFrame:
    """uses (doc, symbol, pos) with the domain of the last declaration (doc, symbol, end, domain) in scope before, else the document's."""
    w = Window.partitionBy("doc", "symbol").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    d = declarations.select("doc", "symbol", F.col("end").alias("at"), F.lit(0).alias("side"), "domain")
    u = uses.select("doc", "symbol", F.col("pos").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("domain"))
    carried = d.unionByName(u).withColumn("last", F.last("domain", ignorenulls=True).over(w)).where("side = 1")
    whole = document.select("doc", "symbol", F.col("domain").alias("whole"))
    return carried.join(whole, ["doc", "symbol"], "left").select("doc", "symbol", F.col("at").alias("pos"), F.coalesce("last", "whole").alias("domain"))


_DEFINE = re.compile(r"\\(newcommand|renewcommand|providecommand|DeclareMathOperator)\*?\s*\{?\s*\\([A-Za-z]+)\s*\}?\s*(?:\[(\d)\])?")


def macros(text: str | None) -> dict[str, tuple[int, str]]:
    """Arguments and body of each defined command; the last definition counts, but providecommand never replaces one."""
    text, out = plain(text or ""), {}
    for m in _DEFINE.finditer(text):
        at = re.compile(r"\s*").match(text, m.end()).end()
        if text[at : at + 1] != "{":
            continue
        body, _, closed = balanced(text, at)
        if closed and not (m[1] == "providecommand" and m[2] in out):
            out[m[2]] = int(m[3] or 0), rf"\operatorname{{{body}}}" if m[1] == "DeclareMathOperator" else body
    return out


def without_definitions(text: str) -> str:
    """The text with definitions of commands blanked, so that none is expanded in its own definition."""
    out, at = [], 0
    for m in _DEFINE.finditer(text):
        if m.start() < at:
            continue
        body = re.compile(r"\s*").match(text, m.end()).end()
        if text[body : body + 1] == "{":
            _, end, closed = balanced(text, body)
            if closed:
                out += [text[at : m.start()], re.sub(r"[^\n]", " ", text[m.start() : end])]
                at = end
    return "".join(out) + text[at:]


def expand(text: str, known: dict[str, tuple[int, str]], depth: int = 8) -> tuple[str, list[str]]:
    """The text with commands replaced, at most `depth` times over, and the commands that survive."""
    if not known:
        return text, []
    use = re.compile(r"\\(" + "|".join(sorted(map(re.escape, known), key=len, reverse=True)) + r")(?![A-Za-z])")
    for _ in range(depth):
        out, at, changed = [], 0, False
        for m in iter(lambda: use.search(text, at), None):
            out.append(text[at : m.start()])
            count, body = known[m[1]]
            end, arguments = m.end(), []
            for _k in range(count):
                start = re.compile(r"\s*").match(text, end).end()
                if text[start : start + 1] == "{":
                    value, end, _ = balanced(text, start)
                else:
                    value, end = text[start : start + 1], start + 1
                arguments.append(value)
            out.append(re.sub(r"##|#([1-9])", lambda x: "#" if x[0] == "##" else arguments[int(x[1]) - 1] if int(x[1]) <= len(arguments) else "", body))
            at, changed = end, True
        if not changed:
            break
        text = "".join(out) + text[at:]
    return text, sorted({m[1] for m in use.finditer(text)})
