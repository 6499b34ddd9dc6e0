"""Evidence from documents, axis by axis, and what documents have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X

# Each axis's patterns, the most specific first.
AXES = {
    "problem": (r"\bwe (?:present|propose|introduce)\b", r"\bthis paper\b"),
    "data": (r"\b(?:evaluate|train|test)\w*\s+on\s+[^.]{0,40}\b(?:dataset|benchmark|corpus)", r"\bbenchmark[s]?\b", r"\bdataset[s]?\b", r"\bcorpus\b"),
    "checkpoint": (
        r"\brelease[sd]?\b.{0,60}\bcheckpoint\b", r"\bcheckpoint\b.{0,60}\b(?:public|available|release)",
        r"\bpre-?trained (?:model|weights)\b.{0,40}\bavailable\b",
    ),
    "seeds": (r"\b(?:training|random)\s+seed[s]?\s*\d", r"\bseed[s]?\s*\d", r"\b(?:three|five|ten|\d+)\s+seeds\b", r"\b(?:training|random) seed[s]?\b"),
    "metrics": (r"\b(?:we (?:report|measure)|evaluated? (?:with|using)|metric[s]?)\b",),
    "results": (r"\b(?:accuracy|percentile rank|F1|BLEU|R\^?2|score)\b.{0,40}\d",),
    "compute": (r"\bGPU[s]?\b", r"\bGPU-hours\b", r"\bA100\b|\bH100\b|\bV100\b"),
}
# Phrases that state a number of examples, of updates, and a batch size.
_UNITS = "k|thousand|m|million|b|billion"
STATED = rf"(?i)(?:pre-?train(?:ed|ing)?|train(?:ed|ing)?)\b[^.]*?\b(?:on|of)\s+(?:approximately|about|~)?\s*(\d[\d,.]*\s*(?:{_UNITS})\b)[^.]*?\b(?:examples|samples|pairs?|instances)"
UPDATES = r"(?i)total of\s+(\d[\d,.]*(?:\s*\^\s*\{?\d+\}?)?)\s+(?:updates|steps)"
BATCH = r"(?i)(?:global\s+)?batch(?:\s+size)?\s+of\s+(\d[\d,.]*)"
_HEADING = r"\\(?:sub)*section\*?\s*\{([^}]*)\}"


def split_sections(docs: DataFrame) -> DataFrame:
    """doc, ord, heading, body of documents (doc, text), cut at their section commands.

    Text before the first heading is (preamble); a text without headings is (body).
    """
    parts = docs.select("doc", F.posexplode(F.split("text", rf"(?={_HEADING})")).alias("ord", "part"), F.col("text").rlike(_HEADING).alias("any"))
    heading = F.regexp_extract("part", f"^{_HEADING}", 1)
    cut = F.col("part").rlike(f"^{_HEADING}")
    name = F.when(cut, F.trim(heading)).when(F.col("any"), "(preamble)").otherwise("(body)")
    body = F.regexp_replace("part", f"^{_HEADING}", "")
    return parts.select("doc", "ord", name.alias("heading"), body.alias("body")).where(cut | (F.trim("body") != ""))


def full_text(candidates: DataFrame) -> DataFrame:
    """doc, source, text, degraded: the first non-empty text of each document by rung; an abstract is degraded.

    candidates: doc, rung, source, text. Documents with no text are kept, as source none.
    """
    some = F.trim(F.coalesce("text", F.lit(""))) != ""
    best = candidates.groupBy("doc").agg(F.min_by(F.when(some, F.struct("source", "text")), F.when(some, F.col("rung"))).alias("b"))
    return best.select("doc", F.coalesce("b.source", F.lit("none")).alias("source"), "b.text", (F.coalesce("b.source", F.lit("none")).isin("abstract", "none")).alias("degraded"))


def _sentences(sections: DataFrame) -> DataFrame:
    own = sections.select("doc", F.col("ord").alias("section_ord"), "heading", F.posexplode(X.sentences("body")).alias("sentence_ord", "raw"))
    lead = r"^(?:\\(?:item|noindent|bigskip|medskip|smallskip|par|centering|small|footnotesize|normalsize)\b\s*|\\(?:vspace|hspace|vskip|hskip)\*?\s*\{[^}]*\}\s*)+"
    s = own.withColumn("sentence", F.trim(F.regexp_replace("raw", lead, "")))
    return s.where((F.col("sentence") != "") & ~F.col("sentence").rlike(r"^\\(?:ref|cref|autoref|eqref|figref|tabref)\b"))


def evidence(sections: DataFrame, axes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc, axis, found, value, quote, section for each document and axis.

    The first sentence that matches counts, by order of pattern, then of
    section and sentence; markup is no evidence. One aggregation for all axes:
    min_by on (pattern, section, sentence).
    """
    axes = axes or AXES
    s = _sentences(sections).where(~X.is_markup("sentence"))
    hits = None
    for axis, patterns in axes.items():
        rank = F.coalesce(*[F.when(F.col("sentence").rlike("(?i)" + p), k) for k, p in enumerate(patterns)])
        own = s.select("doc", F.lit(axis).alias("axis"), rank.alias("rank"), "section_ord", "sentence_ord", "heading", "sentence").where("rank is not null")
        hits = own if hits is None else hits.unionByName(own)
    best = hits.groupBy("doc", "axis").agg(F.min_by(F.struct("heading", "sentence"), F.struct("rank", "section_ord", "sentence_ord")).alias("b"))
    names = F.explode(F.array(*map(F.lit, axes)))
    every = sections.select("doc").distinct().withColumn("axis", names)
    j = every.join(best, ["doc", "axis"], "left")
    return j.select("doc", "axis", F.col("b").isNotNull().alias("found"), F.left("b.sentence", F.lit(160)).alias("value"), F.col("b.sentence").alias("quote"), F.col("b.heading").alias("section"))


def training_scale(sections: DataFrame) -> DataFrame:
    """doc, examples, how: a stated total, else updates times batch size, each by its first occurrence; null if neither is there."""
    s = _sentences(sections)

    def first(pattern: str) -> Column:
        n = X.parse_count(F.nullif(F.regexp_extract("sentence", pattern, 1), F.lit("")))
        return F.min_by(n, F.when(n.isNotNull() & (n > 0), F.struct("section_ord", "sentence_ord")))

    g = s.groupBy("doc").agg(first(STATED).alias("stated"), first(UPDATES).alias("updates"), first(BATCH).alias("batch"))
    how = F.when(F.col("stated").isNotNull(), "stated").when((F.col("updates") * F.col("batch")).isNotNull(), "updates x batch")
    return g.select("doc", F.coalesce("stated", F.col("updates") * F.col("batch")).alias("examples"), how.alias("how"))


def scale_notes(scales: DataFrame, draft: str) -> DataFrame:
    """doc, note: the draft's scale against each other document's; documents without a scale have no row."""
    d = scales.where((F.col("doc") == draft) & (F.col("examples") > 0)).select(F.col("examples").alias("own"))
    o = scales.where((F.col("doc") != draft) & (F.col("examples") > 0))
    j = o.crossJoin(F.broadcast(d))  # one row
    pct = F.bround(100 * F.col("own") / F.col("examples")).cast("long").cast("string")
    return j.select("doc", F.concat(X.format_count("own"), F.lit(" vs "), X.format_count("examples"), F.lit(": about "), pct, F.lit("% of the other's scale")).alias("note"))


def side_by_side(found: DataFrame, papers: list[str]) -> DataFrame:
    """axis and one column for each paper with its value; null where nothing was found."""
    return found.groupBy("axis").pivot("doc", papers).agg(F.first("value"))
