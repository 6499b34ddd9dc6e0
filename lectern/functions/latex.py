"""Column functions on LaTeX: contributions, quantifiers, packages, escapes, citations."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X

# Phrases that announce contributions.
CUES = r"(?i)our contributions?|we present|we propose|we introduce|we contribute|this paper (?:presents|proposes|introduces)"
# Modules and names for code that users supply.
MODULES = ("math", "fractions", "decimal", "itertools", "functools", "operator", "random", "statistics", "cmath", "numbers", "collections", "typing", "dataclasses", "sympy")
REFUSED = ("eval", "exec", "compile", "open", "input", "__import__", "globals", "locals", "vars", "getattr", "setattr", "delattr", "breakpoint")


# Patterns of loaded packages and of a bibliography's items.
_PACKAGES = r"\\usepackage\s*(?:\[[^\]]*\])?\s*\{([^}]*)\}"
_ITEMS = r"\\bibitem\s*(?:\[[^\]]*\])?\s*\{([^}]*)\}"


def contributions(col: Column | str) -> Column:
    """Items of the sentences that announce contributions: what follows a colon, cut at semicolons and (i) marks; three words or more."""
    flat = F.regexp_replace(X.drop_markup(col), r"\s+", " ")
    own = F.filter(X.sentences(flat), lambda s: s.rlike(CUES))
    tails = F.transform(own, lambda s: F.regexp_replace(s, r"^[^:]*:", ""))
    items = F.flatten(F.transform(tails, lambda t: F.split(t, r"(?i);|\(\s*[0-9ivx]+\s*\)")))
    clean = F.transform(items, lambda p: F.btrim(F.regexp_replace(p, r"\s+", " "), F.lit(" .,;:")))
    return F.filter(clean, lambda p: F.size(F.split(p, " ")) >= 3)


def quantifiers(col: Column | str) -> Column:
    """(binder, variable) of for-all and exists."""
    c = F.col(col) if isinstance(col, str) else col
    pattern = r"\\(forall|exists)\s*(\\?[A-Za-z]+)"
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("binder"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("variable"))
    return pairs.cast("array<struct<binder:string,variable:string>>")


def packages(col: Column | str) -> Column:
    """Distinct packages that a text loads, in order."""
    c = F.col(col) if isinstance(col, str) else col
    lists = F.regexp_extract_all(X.strip_comments(c), F.lit(_PACKAGES), F.lit(1))
    names = F.flatten(F.transform(lists, lambda g: F.transform(F.split(g, ","), lambda p: F.trim(p))))
    return F.array_distinct(F.filter(names, lambda p: p != ""))


def escape(col: Column | str) -> Column:
    """Plain text for LaTeX; what stands in $...$ stays."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.split(c, r"(?<!\\)\$")

    def outside(p: Column) -> Column:
        p = F.regexp_replace(p, r"\\", "\u0001")
        p = F.regexp_replace(p, "([&%#_{}])", r"\\$1")
        p = F.replace(F.replace(p, F.lit("~"), F.lit(r"\textasciitilde{}")), F.lit("^"), F.lit(r"\textasciicircum{}"))
        return F.replace(p, F.lit("\u0001"), F.lit(r"\textbackslash{}"))

    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, outside(p)).otherwise(p)), "$")


def cited_entries(entries: DataFrame, bbl: DataFrame) -> DataFrame:
    """Entries (key) that a bibliography's items name; bbl: text. All of them if it names none."""
    keys = bbl.select(F.explode(F.regexp_extract_all("text", F.lit(_ITEMS), F.lit(1))).alias("key")).distinct()
    return entries.join(keys, "key", "left_semi") if not keys.isEmpty() else entries


def citation_audit(tex: DataFrame, entries: DataFrame) -> DataFrame:
    """key, problem: cited but undefined, defined but uncited, or cited without a title. tex: text; entries: key, fields."""
    cited = tex.select(F.explode(X.cited_keys("text")).alias("key")).distinct()
    title = F.coalesce(F.try_element_at("fields", F.lit("title")), F.lit(""))
    undefined = cited.join(entries, "key", "left_anti").select("key", F.lit("undefined").alias("problem"))
    uncited = entries.join(cited, "key", "left_anti").select("key", F.lit("uncited").alias("problem"))
    untitled = entries.where(title == "").join(cited, "key", "left_semi").select("key", F.lit("untitled").alias("problem"))
    return undefined.unionByName(uncited).unionByName(untitled)


def named_conditions(col: Column | str) -> Column:
    """Hypotheses that a step must meet for the results it names: array of codes.

    Jensen needs a convexity, and the mean of the function on the side that the
    convexity makes the larger: with a convex function E[f(X)] >= f(E[X]), with a
    concave one the other way round. Where the text doesn't compare the two, or
    speaks of both shapes, nothing is said of the direction. Markov, Chebyshev
    and the means need terms that aren't negative.
    """
    c = F.col(col) if isinstance(col, str) else col
    jensen = c.rlike("(?i)jensen")
    shaped = c.rlike("(?i)convex|concav")
    mean = r"(?:\\mathbb\s*\{?\s*E\s*\}?|\\operatorname\s*\{\s*E\s*\}|\\E(?![A-Za-z]))\s*(?:\\left)?\s*[\[({]\s*\\?[A-Za-z]+\s*(?:\\left)?\s*[\[(]"
    of_mean = r"\\?[A-Za-z]+\s*(?:\\left)?\s*[\[(]\s*(?:\\mathbb\s*\{?\s*E|\\operatorname\s*\{\s*E|\\E(?![A-Za-z]))"
    less, more = r"(?:\\leq?(?:slant)?(?![a-z])|<)", r"(?:\\geq?(?:slant)?(?![a-z])|>)"
    mean_is_less = c.rlike(f"{mean}[^<>]*?{less}[^<>]*?{of_mean}") | c.rlike(f"{of_mean}[^<>]*?{more}[^<>]*?{mean}")
    mean_is_more = c.rlike(f"{mean}[^<>]*?{more}[^<>]*?{of_mean}") | c.rlike(f"{of_mean}[^<>]*?{less}[^<>]*?{mean}")
    convex, concave = c.rlike(r"(?i)\bconvex"), c.rlike(r"(?i)\bconcav")
    wrong = (convex & ~concave & mean_is_less & ~mean_is_more) | (concave & ~convex & mean_is_more & ~mean_is_less)
    codes = [
        F.when(jensen & ~shaped, F.lit("jensen:convexity-not-stated")),
        F.when(jensen & wrong, F.lit("jensen:direction")),
        F.when(c.rlike("(?i)markov(?:'s)? inequality|chebyshev") & ~c.rlike("(?i)non-?negative|positive"), F.lit("markov:non-negative")),
        F.when(c.rlike("(?i)AM[-–]GM|arithmetic[-\\s]geometric") & ~c.rlike("(?i)non-?negative|positive"), F.lit("am-gm:non-negative")),
    ]
    return F.array_compact(F.array(*codes))


def guard(source: str) -> list[str]:
    """Why user code is refused: unlisted imports, refused names, dunder attributes. No security boundary."""
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        return [f"syntax: {e.msg}"]
    out = []
    for node in ast.walk(tree):
        names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
        out += [f"import: {n}" for n in names if n.split(".")[0] not in MODULES]
        if isinstance(node, ast.Name) and node.id in REFUSED:
            out.append(f"name: {node.id}")
        if isinstance(node, ast.Attribute) and node.attr.startswith("__"):
            out.append(f"attribute: {node.attr}")
    return sorted(out)
