"""LaTeX proofs to tables."""

import pytest

from lectern.parse import latex as L

PAPER = r"""
\newtheorem{thm}{Theorem}
\begin{lemma}\label{lem:a} Let $x > 0$ be given. Then $\log x \le x - 1$. \end{lemma}
\begin{thm}[Main]\label{thm:m} If $n \ge 1$, then $a_n \le 2$ by Lemma~\ref{lem:a}. \end{thm}
% \begin{lemma} commented \end{lemma}
\begin{proof}
We set the scene, i.e. Section 2. By Jensen's inequality,
\begin{align}
a &\le b \\
  &= c + \frac{1}{y} \label{eq:c} \\
  &< d
\end{align}
Clearly, the rest is small. Hence $a < d$ by Lemma \ref{lem:a} and \eqref{eq:missing}. This completes the proof.
\end{proof}
\begin{proof}[Proof of Lemma~\ref{lem:a}]
We argue by induction on the depth $L$. When $L = 1$, the claim is $0 \le 0$. Thus it holds.
\end{proof}
"""


@pytest.fixture(scope="module")
def rows():
    out = {}
    for r in L.parse(PAPER):
        out.setdefault(r.entity, []).append(r)
    return out


def test_claims(rows):
    a, m = rows["claim"]
    assert (a.id, a.kind, a.extra["number"], a.extra["method"]) == ("claim/lem:a", "lemma", "1", "then")
    assert a.extra["hypotheses"] == "Let $x > 0$ be given" and a.extra["conclusion"].startswith(r"$\log x")
    assert (m.id, m.extra["title"], m.extra["method"]) == ("claim/thm:m", "Main", "if-then")


def test_proofs(rows):
    first, second = rows["proof"]
    assert (first.id, first.parent, first.extra["attachment"]) == ("proof/thm:m", "claim/thm:m", "adjacent")
    assert (second.id, second.parent, second.extra["attachment"]) == ("proof/lem:a", "claim/lem:a", "argument")
    assert first.extra["base_case"] == "n/a" and second.extra["base_case"] == "found"
    assert float(first.extra["captured"]) > 0.9


def test_steps(rows):
    own = [r for r in rows["step"] if r.parent == "proof/thm:m"]
    assert [r.kind for r in own] == ["narration", "chain-row", "chain-row", "chain-row", "prose-move", "qed"]
    lead = own[1]
    assert lead.extra["justification"] == "named-result" and lead.extra["by"] == "jensen" and lead.extra["relation"] == r"\le"
    assert [r.extra["row"] for r in own[1:4]] == ["1", "2", "3"]
    assert own[2].extra["side_conditions"] == "non-zero:y"
    assert own[4].extra["justification"] == "internal-ref" and "hedge" in own[4].extra["opacity"]
    assert own[0].id == "proof/thm:m/s1" and "i.e. Section 2." in own[0].extra["prose"]


def test_offsets(rows):
    for r in [*rows["claim"], *rows["proof"]]:
        assert PAPER[r.start : r.end].startswith("\\begin{") and PAPER[r.start : r.end].endswith("}")


@pytest.mark.parametrize(("a", "b", "want"), [(None, "<", "<"), ("=", "<", "<"), ("<", "=", "<"), (r"\le", "<", r"\le"), ("<", r"\le", r"\le"), ("<", ">", None), (">", r"\gg", r"\ge"), ("<", "<", "<")])
def test_relations(a, b, want):
    assert L.compose(a, b) == want


@pytest.mark.parametrize(("body", "want"), [("By induction.", "unknown"), ("By induction on $n$. Assume it holds.", "not-found"), ("By induction on $k$. For $k=0$ clear.", "found"), ("Base case. By induction.", "found"), ("Directly.", "n/a")])
def test_induction(body, want):
    assert L.induction(body) == want


def test_tables(spark):
    docs = spark.createDataFrame([("p", PAPER), ("n", None), ("e", "no latex"), ("o", r"\begin{proof} Obviously so. \end{proof}")], "doc string, text string")
    rows = L.ledger(docs).cache()
    assert {r.id for r in L.table(rows, "claim", "label").where("doc = 'p'").collect()} == {"claim/lem:a", "claim/thm:m"}
    g = L.reference_graph(rows)
    assert [(r.src, r.target) for r in g["edges"].collect()] == [("claim/thm:m", "claim/lem:a"), ("claim/thm:m", "claim/lem:a")]
    assert [r.label for r in g["dangling"].collect()] == ["eq:missing"]
    assert {r.label for r in g["unused"].collect()} == {"thm:m", "eq:c"}
    found = {(r.doc, r.kind, r.severity) for r in L.structural_findings(rows).collect()}
    assert {("p", "dangling-ref", "MINOR"), ("o", "orphan-proof", "MINOR"), ("o", "hedge", "MINOR"), ("p", "side-condition", "UNVERIFIED")} <= found
    assert not any(kind in ("low-text-capture", "induction-base-case") for _, kind, _ in found)


def test_odd_input():
    assert L.parse(None) == [] == L.parse("")
    assert [r.entity for r in L.parse(r"\begin{lemma} never closed")] == []
    assert L.parse(r"\end{proof}\begin{proof}\end{proof}")[0].extra["captured"] == "1.0000"


def test_declarations_count_near_the_first_use_and_for_whole_symbols():
    from lectern.parse import symbols

    def domains(text):
        return {x[0]: x[3] for x in symbols.inventory(text)}

    assert domains("$x$ " + "word " * 70 + "$x > 0$") == {"x": None}
    assert domains(r"$y_t \in [0,1]$") == {"y": "unit-interval", "t": None}
    assert domains(r"$a, b \ge 0$") == {"a": "nonnegative", "b": "nonnegative"}
    assert domains(r"$\ell > 0$ and $\varsigma$") == {r"\ell": "positive", r"\varsigma": None}


def test_own_commands_are_expanded_before_parsing():
    rows = L.parse(r"\newcommand{\bd}[1]{#1 \le 3}\begin{lemma}$x=1$.\end{lemma}\begin{proof}Hence $\bd{x}$. Suppose first that $x = 2$.\end{proof}")
    assert [(r.kind, r.extra["relation"]) for r in rows if r.entity == "step"] == [("prose-move", r"\le"), ("case-open", "=")]


def test_abbreviations_end_no_sentence():
    assert len(L.sentences("By Alg. 3 and Tab. X we go. See Defn. Y too.")) == 2


def test_direction_of_jensen(spark):
    from pyspark.sql import functions as F

    from lectern.functions.latex import named_conditions

    right, wrong = r"By Jensen for convex $f$, $f(\mathbb{E}[X]) \le \mathbb{E}[f(X)]$", r"By Jensen for convex $f$, $\mathbb{E}[f(X)] \leq f(\mathbb{E}[X])$"
    rows = [right, wrong, wrong.replace("convex", "concave"), right.replace("convex", "concave"), right.replace(r"\le", r"\ge"), "By Jensen for convex f."]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    got = {r.k: list(r.c) for r in df.select("k", named_conditions(F.col("t")).alias("c")).collect()}
    assert got == {0: [], 1: ["jensen:direction"], 2: [], 3: ["jensen:direction"], 4: ["jensen:direction"], 5: []}
