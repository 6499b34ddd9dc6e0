"""Operators whose steps depend on their own earlier output, run as one small group each."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick_angles(angles: list[str], limit: int = 8, ideal: int = 3, overlap: float = 0.5) -> list[str]:
    """Up to `limit` phrases: distinct concepts near `ideal` words first, then two-word prefixes of them.

    Two thirds of the limit go to concepts; one whose words have a Jaccard
    similarity of `overlap` or more with a chosen one is passed over.
    """
    distinct = list(dict.fromkeys(a for a in angles if a.split()))
    chosen: list[str] = []
    for a in sorted(distinct, key=lambda a: abs(len(a.split()) - ideal)):
        if len(chosen) == max(1, 2 * limit // 3):
            break
        own = set(a.split())
        if all(len(own & (s := set(c.split()))) < overlap * len(own | s) for c in chosen):
            chosen.append(a)
    for a in list(chosen):
        broad = " ".join(a.split()[:2])
        if len(chosen) < limit and len(a.split()) >= 3 and broad not in chosen:
            chosen.append(broad)
    return chosen[:limit]


def greedy_angles(phrases: DataFrame, key: str, phrase: str, pos: str, limit: int = 8) -> DataFrame:
    """key, rank, angle: pick_angles() for each key's phrases in order of pos; null phrases don't count."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        picked = pick_angles(pdf.sort_values("p")["a"].dropna().tolist(), limit)
        return pd.DataFrame({"k": pdf["k"].iloc[0], "rank": range(1, len(picked) + 1), "angle": picked})

    kind = dict(phrases.dtypes)[key]
    source = phrases.select(F.col(key).alias("k"), F.col(phrase).alias("a"), F.col(pos).alias("p"))
    return source.groupBy("k").applyInPandas(run, f"k {kind}, rank int, angle string").withColumnRenamed("k", key)


def ratio(a: str, b: str) -> float:
    """Ratcliff and Obershelp's similarity, as difflib computes it."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def restatements(claims: DataFrame, statement: float = 0.70, conclusion: float = 0.90) -> DataFrame:
    """doc, id, duplicate_of, by, ratio for the claims of each document that restate an earlier one.

    claims: doc, ord, id, kind, label, statement, conclusion, explicit. A label
    that differs by a suffix such as _restated or _appendix from an earlier one
    decides; else the earlier claim of the same kind, itself no duplicate, that
    is most alike: with an explicit mark whatever the ratio, without if
    statement and conclusion reach the thresholds. One document is one group.
    """
    stem = F.regexp_replace("label", r"(?i)[_:-]?(restated|restate|appendix|app|copy|again)$", "")
    source = claims.withColumn("stem", stem)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, firsts = [], []
        for c in pdf.sort_values("ord").itertuples():
            found = next(((e.id, "label", 1.0) for e in firsts if c.label and c.stem != c.label and e.label == c.stem), None)
            if not found:
                alike = [(ratio(e.statement or "", c.statement or ""), e) for e in firsts if e.kind == c.kind]
                best = max(alike, key=lambda x: x[0], default=None)
                if best and (c.explicit or best[0] >= statement and ratio(best[1].conclusion or "", c.conclusion or "") >= conclusion):
                    found = best[1].id, "explicit" if c.explicit else "ratio", best[0]
            if found:
                rows.append((c.doc, c.id, *found))
            else:
                firsts.append(c)
        return pd.DataFrame(rows, columns=["doc", "id", "duplicate_of", "by", "ratio"])

    return source.groupBy("doc").applyInPandas(run, "doc string, id string, duplicate_of string, by string, ratio double")
