"""Cross-site boilerplate lines, by HyperLogLog spread; DataFrame functions only.

For every line, keyed by two hashes, a HyperLogLog sketch of the sites that it
occurs on is built in each task and merged by the aggregation. Estimates well
above or below the threshold decide; lines near it get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import materialise

MIN_SITES = 10
LG_K = 12
#: Six standard errors of a sketch with 2**12 bins.
MARGIN = 6 * 1.04 / 64


def _lines(text: str = "text") -> Column:
    return F.split(text, "\n", -1)


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", lg_k: int = LG_K, margin: float = MARGIN) -> tuple[DataFrame, DataFrame]:
    """(lines, boilerplate): every line with its place, and the keys of boilerplate with their first place."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col(site).alias("site"), F.posexplode(_lines()).alias("pos", "line"))
    lines = lines.where(F.trim(F.regexp_replace("line", "\\s", " ")) != "")
    lines = lines.select("doc_id", "th", "site", "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("g"))
    spread = lines.groupBy("h", "g").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"),
        F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "th", "pos")).alias("first"),
    )
    low, high = min_sites * (1 - margin) - 1, min_sites * (1 + margin) + 1
    spread = materialise(spread.where(F.col("sites") >= low).select("h", "g", "sites", "first"), "line-spread")
    near = spread.where(F.col("sites") <= high)
    exact = lines.join(near.select("h", "g"), ["h", "g"], "left_semi").where("site is not null").groupBy("h", "g", "site").agg(F.lit(1).alias("one"))
    exact = exact.groupBy("h", "g").agg(F.count("one").alias("n")).where(F.col("n") >= min_sites)
    sure = spread.where(F.col("sites") > high).select("h", "g", "first")
    return lines, sure.unionByName(near.join(exact, ["h", "g"]).select("h", "g", "first"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """docs with boilerplate lines taken out of `text`, plus n_lines and n_removed (long).

    A line that is not blank and occurs on min_sites distinct sites or more is
    boilerplate; its first occurrence, by doc_id (null first) and position,
    stays, so that nothing disappears from the corpus. A null site is no site.
    A null text stays null with no lines; an empty text has one blank line.
    Rows of one doc_id and text are treated alike. Other columns pass through;
    columns that docs has by the names n_lines or n_removed are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    lines, bad = boilerplate_lines(docs, min_sites, site)
    gone = (
        lines.join(bad, ["h", "g"])
        .where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")) & (F.col("pos") == F.col("first.pos"))))
        .groupBy("doc_id", "th")
        .agg(F.collect_set("pos").alias("__gone"))
        .withColumnsRenamed({"doc_id": "__id", "th": "__th"})
    )
    out = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__th"]), "left")
    n = F.coalesce(F.size(_lines()), F.lit(0))
    removed = F.coalesce(F.size("__gone"), F.lit(0))

    def joined(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    # a variable of a lambda holds the lines, so that the text is split once and not for every line
    left = F.transform(F.array(_lines()), joined)
    cleaned = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.get(left, F.lit(0)))
    out = out.withColumns({"n_lines": n.cast("long"), "n_removed": removed.cast("long")}).withColumn("text", cleaned)
    return out.drop("__gone", "__id", "__th")


SQL = f"""
WITH docs AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM docs),
spread AS (
  SELECT line, min(struct_pack(d := doc_id, p := pos)) AS f FROM lines
  WHERE trim(regexp_replace(line, '\\s', ' ', 'g')) <> ''
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (SELECT l.*, s.line IS NOT NULL AND NOT (s.f.d = l.doc_id AND s.f.p = l.pos) AS gone FROM lines l LEFT JOIN spread s USING (line))
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
  count(*) AS n_lines, count(*) FILTER (gone) AS n_removed
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, text, 0, 0 FROM documents WHERE text IS NULL
"""
