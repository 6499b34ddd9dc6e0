"""Source files: include closures, archives, discovery, candidate lists, reports."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import norm_title, strip_comments, table_cell
from lectern.operators.graph import reachable


def include_closure(files: DataFrame, root: str) -> DataFrame:
    """path, depth of the files that the root includes, itself at 0. files: path, text.

    An include without a suffix means path, or else path.tex; one that is in no
    row is left out. A file that several others include is listed once.
    """
    targets = F.regexp_extract_all(strip_comments("text"), F.lit(r"\\(?:input|include)\s*\{([^}]*)\}"), F.lit(1))
    edges = files.select(F.col("path").alias("src"), F.explode(targets).alias("target")).withColumn("target", F.trim("target"))
    tried = edges.select("src", "target", F.posexplode(F.array("target", F.concat("target", F.lit(".tex")))).alias("rank", "dst"))
    first = tried.join(files.select(F.col("path").alias("dst")), "dst").groupBy("src", "target").agg(F.min_by("dst", "rank").alias("dst"))
    below = reachable(first.select("src", "dst")).where(F.col("src") == root).select(F.col("dst").alias("path"), "depth")
    start = files.where(F.col("path") == root).select("path", F.lit(0).alias("depth"))
    return start.unionByName(below.where(F.col("path") != root))


def archive_text(blob: bytes | None) -> str | None:
    """The .tex members of a tar archive in order of name, or a gzip file's text; null for neither."""
    if not blob:
        return None
    try:
        with tarfile.open(fileobj=io.BytesIO(blob)) as tar:
            members = sorted((m for m in tar.getmembers() if m.isfile() and m.name.endswith(".tex")), key=lambda m: m.name)
            parts = [tar.extractfile(m).read().decode("utf-8", "replace") for m in members]
        return "\n".join(parts) if parts else None
    except tarfile.TarError:
        pass
    try:
        return gzip.decompress(blob).decode("utf-8", "replace")
    except (OSError, EOFError):
        return None


def archives(files: DataFrame) -> DataFrame:
    """path, text of rows (path, content) as the binaryFile source gives them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [archive_text(b) for b in pdf["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def discover(files: DataFrame, preferred: tuple[str, ...], suffix: str, excluded: str = "corrected") -> DataFrame:
    """One path for each folder (folder, path): a preferred name in order of preference, else the first by name."""
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.coalesce(*[F.when(name == p, k) for k, p in enumerate(preferred)], F.lit(len(preferred)))
    own = files.where(name.endswith(suffix) & ~F.contains(name, F.lit(excluded)))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return own.groupBy(folder.alias("folder")).agg(F.min_by("path", F.struct(rank, name)).alias("path"))


def from_candidates(candidates: DataFrame, grades: tuple[str, ...], by_doi: DataFrame, by_title: DataFrame) -> DataFrame:
    """Candidates of the given grades, resolved by DOI, else by title key, else as they are: title, resolved_id, how.

    Titles are compared by norm_title, and an empty key meets none; of several
    records of one DOI or title key that with the smallest id counts.
    """
    c = candidates.where(F.col("grade").isin(*grades)).withColumn("c_key", F.nullif(norm_title("title"), F.lit("")))
    d = by_doi.groupBy(F.col("doi").alias("d_doi")).agg(F.min("id").alias("d_id"))
    t = by_title.groupBy(norm_title("title").alias("t_key")).agg(F.min("id").alias("t_id"))
    j = c.join(d, F.col("doi") == F.col("d_doi"), "left").join(t, F.col("c_key") == F.col("t_key"), "left")
    how = F.when(F.col("d_id").isNotNull(), "doi").when(F.col("t_id").isNotNull(), "title").otherwise("retained")
    return j.select("title", F.coalesce("d_id", "t_id").alias("resolved_id"), how.alias("how"))


def report_rows(findings: DataFrame, group: str, ladder: tuple[str, ...], columns: list[str], most: int = 80) -> DataFrame:
    """Markdown table lines of findings, in order of the ladder: group, line_no, line. Empty groups don't appear."""
    cells = [table_cell(F.col(c).cast("string"), most) for c in columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rank = F.array_position(F.array(*map(F.lit, ladder)), F.col(group))
    rows = findings.where(rank > 0).select(rank.alias("rank"), F.col(group).alias("grp"), line.alias("line"))
    rows = rows.withColumn("line_no", F.row_number().over(Window.partitionBy("grp").orderBy("line")))
    return rows.orderBy("rank", "line_no").select(F.col("grp").alias(group), "line_no", "line")
