"""Queries that SQL can't express: parsers, greedy picks and engines, on the driver's tables or fixed texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import bibliography, engines, greedy
from lectern.parse import bibtex, latex
from lectern.plans.documents import read

BIB = r"""
@article{one, title = {A {Nested} Title}, author = "Lee, Ann and Ray, B{\"o}", year = 2020, journal = {J. of Nets}}
@inproceedings{two, title={Other Work}, author={New, Guy and others}, booktitle={Proc. Conf.}, year={2019}, volume={2019}}
@misc{web, title={A page}, url={http://x.y}}
"""
TEX = r"""
\begin{lemma}\label{lem:a} Let $x > 0$. Then $\log x \le x - 1$. \end{lemma}
\begin{proof} By concavity, \begin{align} \log x &\le x - 1 \\ &= y + \frac{1}{z} \end{align} Hence $\log x \le y$. \end{proof}
\begin{theorem}\label{thm:b} If $n \ge 1$, then $a_n \le 2$, see Lemma~\ref{lem:a}. \end{theorem}
\begin{proof}[Proof of Theorem~\ref{thm:b}] By induction on $n$. Clearly $a_n \le 2$ by \ref{lem:zz}. \end{proof}
"""
#: Words in a row that a document shares with a passage before the two are compared.
RUN = 4


def bib_parse(spark, sf_dir):
    """Entries and the findings of the rules without any record."""
    e = bibtex.entries(spark.createDataFrame([("refs.bib", BIB)], "path string, text string"))
    found = bibliography.check(e, spark.createDataFrame([], "entry_key string, " + bibliography.RECORD[7:-1]))
    return e.join(found, "key", "left").select("key", "etype", F.map_keys("fields").alias("names"), "field", "severity")


def ledger_steps(spark, sf_dir):
    return latex.table(latex.ledger(spark.createDataFrame([("paper", TEX)], "doc string, text string")), "step", "justification", "by", "relation", "opacity", "side_conditions")


def ledger_findings(spark, sf_dir):
    return latex.structural_findings(latex.ledger(spark.createDataFrame([("paper", TEX)], "doc string, text string")))


def greedy_angles(spark, sf_dir):
    """Diverse phrases of every document, picked from all of its phrases, the most frequent first."""
    each = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.phrases("text", (3, 2))).alias("pos", "phrase"))
    found = each.groupBy("doc_id", "phrase").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    return greedy.greedy_angles(found.withColumn("place", F.row_number().over(w)), "doc_id", "phrase", "place", 8)


def fuzzy_ratio(spark, sf_dir):
    """Benchmark passages that documents restate: for each pair the stretch of the document that is most alike.

    Blocked: a stretch of as many words as the passage is compared where it
    shares RUN words in a row with the passage, or a shorter passage as a whole.
    """
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    texts = read(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("fp"), "text")
    passages = read(spark, sf_dir, "benchmark").select("item_id", words.alias("p")).where("size(p) > 0").withColumn("n", F.least(F.size("p"), F.lit(RUN)))
    docs = texts.select("doc_id", "fp", words.alias("w"))
    sizes = F.broadcast(passages.agg(F.sort_array(F.collect_set("n")).alias("sizes")))  # one row of RUN sizes at most

    def runs(of, n):
        at = F.when(F.size(of) >= n, F.sequence(F.lit(0), F.size(of) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(F.array_join(F.slice(of, i + 1, n), " ")).alias("run")))

    ours = passages.select("item_id", "p", F.explode(runs(F.col("p"), F.col("n"))).alias("a"))
    theirs = docs.crossJoin(sizes).select("doc_id", "fp", F.explode(F.flatten(F.transform("sizes", lambda n: runs(F.col("w"), n)))).alias("b"))
    met = theirs.join(ours, F.col("a.run") == F.col("b.run")).select("doc_id", "fp", "item_id", "p", (F.col("b.at") - F.col("a.at")).alias("start")).distinct()
    # a start before the document's first word leaves the passage's first words without a counterpart
    first = F.greatest("start", F.lit(0))
    stretch = F.array_join(F.slice(words, first + 1, F.col("start") + F.size("p") - first), " ")
    pairs = met.join(texts, (met["doc_id"].eqNullSafe(texts["doc_id"])) & (met["fp"] == texts["fp"])).select(met["doc_id"], "item_id", first.alias("start"), F.array_join("p", " ").alias("passage"), stretch.alias("stretch"))
    pairs = pairs.distinct().withColumn("doc", F.to_json(F.struct("doc_id", "item_id", "start", F.xxhash64("passage", "stretch").alias("h"))))
    sides = F.array(F.struct(F.lit(0).alias("ord"), F.col("item_id").cast("string").alias("id"), F.col("passage").alias("text")), F.struct(F.lit(1).alias("ord"), F.col("start").cast("string").alias("id"), F.col("stretch").alias("text")))
    claims = pairs.select("doc", F.inline(sides)).select("doc", "ord", "id", F.lit("passage").alias("kind"), F.lit(None).cast("string").alias("label"), F.col("text").alias("statement"), F.col("text").alias("conclusion"), F.lit(False).alias("explicit"))
    found = greedy.restatements(claims).withColumn("doc", F.get_json_object("doc", "$.doc_id"))
    best = found.groupBy("doc", "duplicate_of").agg(F.max_by(F.struct("id", "by", "ratio"), F.struct("ratio", -F.col("id").cast("long"))).alias("best"))
    return best.select("doc", "best.id", "duplicate_of", "best.by", F.round("best.ratio", 6).alias("ratio"))


def rational_check(spark, sf_dir):
    claims, builds = engines.demo_claims(spark)
    return engines.run_checks(claims, builds)


QUERIES = {f.__name__: (f, None) for f in (bib_parse, ledger_steps, ledger_findings, greedy_angles, fuzzy_ratio, rational_check)}
