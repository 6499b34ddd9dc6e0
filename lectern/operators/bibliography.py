"""Bibliography entries against authoritative records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.joins import author_diff, name_form_mismatches

# Fixed value: the venue of a record that stands for a DOI that doesn't resolve.
UNRESOLVED = "__DOI_UNRESOLVED__"
# Venues of preprints.
PREPRINT = r"(?i)arxiv|corr\b|preprint|biorxiv|ssrn"
# findings' severities in the order of the report.
REPORT_ORDER = ("CRITICAL", "MAJOR", "MINOR", "WEAK", "UNVERIFIED", "SKIP")

RECORD = "struct<rung:int,title:string,authors:array<string>,venue:string,year:int,volume:string,issue:string,pages:string,doi:string,source:string,strong:boolean>"
RECORD_FIELDS = tuple(f.split(":")[0] for f in RECORD[7:-1].replace("array<string>", "x").split(","))


def is_preprint(venue: Column) -> Column:
    return F.coalesce(venue, F.lit("")).rlike(PREPRINT)


def _field(name: str) -> Column:
    return F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(""))


def has_arxiv_identity() -> Column:
    return (_field("eprint") != "") | (_field("archiveprefix") != "") | F.lower(_field("doi")).startswith("10.48550/") | _field("journal").rlike(PREPRINT)


def cites_preprint() -> Column:
    """Whether an entry rests on a preprint: by its venue, or by its identity if it names none."""
    venue = F.trim(F.when(_field("journal") != "", _field("journal")).otherwise(_field("booktitle")))
    alone = (_field("eprint") != "") | (_field("archiveprefix") != "") | F.lower(_field("doi")).startswith("10.48550/")
    return F.when(venue != "", venue.rlike(PREPRINT)).otherwise(alone)


def check(entries: DataFrame, records: DataFrame) -> DataFrame:
    """Findings (key, field, in_bib, in_record, source, severity) on entries (key, etype, fields).

    records: entry_key and the fields of RECORD, rung giving the order in which
    sources were asked. Records are grouped by entry, then findings() has the rules.
    """
    r = records.groupBy(F.col("entry_key").alias("key")).agg(F.array_sort(F.collect_list(F.struct(*RECORD_FIELDS))).alias("recs"))
    return findings(entries.join(r, "key", "left"))


def findings(entries: DataFrame) -> DataFrame:
    """What check() returns, on entries (key, etype, fields, recs) that have met their records.

    recs: structs of RECORD in the order of their rungs, or null. All rules are one
    array of conditional structs, exploded. Later rules are guarded by the
    conditions that stop the ladder. An entry without records is UNVERIFIED; a
    lookup by title alone never gives more than WEAK.
    """
    none = F.array().cast(f"array<{RECORD}>")
    e = entries.withColumn("recs", F.coalesce(F.col("recs").cast(f"array<{RECORD}>"), none))
    e = e.withColumn("usable", F.filter("recs", lambda x: ~F.coalesce(x["venue"] == UNRESOLVED, F.lit(False))))
    strong_ones = F.filter("usable", lambda x: F.coalesce(x["strong"], F.lit(False)))
    e = e.withColumn("rec", F.coalesce(F.try_element_at(strong_ones, F.lit(1)), F.try_element_at("usable", F.lit(1))))
    b_venue = F.when(_field("journal") != "", _field("journal")).otherwise(_field("booktitle"))
    e = e.withColumns({f"b_{name}": F.trim(_field(name)) for name in ("title", "author", "year", "volume", "number", "pages")} | {"b_venue": b_venue})
    strong = F.coalesce(F.col("rec.strong"), F.lit(False))
    source = F.coalesce(F.col("rec.source"), F.lit("-"))
    e = e.withColumn("names", F.when(F.col("b_author") != "", X.split_authors("b_author")).otherwise(F.array().cast("array<string>")))
    e = e.withColumn("people", F.coalesce("rec.authors", F.array().cast("array<string>")))
    e = e.withColumn("diff", author_diff(F.col("names"), F.col("people"))).withColumn("forms", name_form_mismatches(F.col("names"), F.col("people")))

    skip = F.col("etype").isin("misc", "online", "electronic", "unpublished") & ~has_arxiv_identity() & (_field("doi") == "")
    unresolved = F.exists("recs", lambda x: F.coalesce(x["venue"] == UNRESOLVED, F.lit(False)))
    found = F.size("usable") > 0
    # columns, for an expression would be worked out anew wherever a rule names it; folding is most of the work, so titles are folded
    # where they differ or a record of the same title is looked for, and null elsewhere: no rule reads them there. Where one
    # title goes on from the other, what it has beyond that is folded alone
    e = e.withColumn("same", F.coalesce(F.trim("rec.title") == F.col("b_title"), F.lit(False)))
    same = F.col("same")
    e = e.withColumn("rest", F.when(~same & found, X.beyond(F.trim("rec.title"), "b_title")))
    rest = F.col("rest")
    e = e.withColumn("bt", F.when(found & (~same | cites_preprint()), F.when(rest.isNull() | cites_preprint(), X.norm_title("b_title"))))
    e = e.withColumn("rt", F.when(found & ~same, F.when(rest.isNull(), X.norm_title(F.coalesce("rec.title", F.lit(""))))))
    bt, rt = F.col("bt"), F.col("rt")
    e = e.withColumn("other_title", F.when(rest.isNotNull(), X.norm_title(rest) != "").otherwise(~same & (bt != "") & (rt != "") & (bt != rt)))
    other_title = F.col("other_title")
    go = ~skip & found & ~(other_title & ~strong)
    official = F.filter("usable", lambda x: F.coalesce(x["strong"], F.lit(False)) & ~is_preprint(x["venue"]) & x["year"].isNotNull())
    years = F.transform(official, lambda x: x["year"])
    by = F.when(F.col("b_year").rlike("^[0-9]+$"), F.col("b_year").try_cast("int"))
    wrong_year = by.isNotNull() & (F.size(official) > 0) & ~F.exists(years, lambda y: F.abs(y - by) <= 1)
    volume = X.usable_volume("rec.volume")
    vb, vr = X.norm_title("b_venue"), X.norm_title(F.coalesce("rec.venue", F.lit("")))
    candidates = F.when(cites_preprint(), F.col("usable")).otherwise(none)
    published = F.filter(candidates, lambda x: ~is_preprint(x["venue"]) & (F.coalesce(x["venue"], F.lit("")) != "") & (F.coalesce(x["strong"], F.lit(False)) | (x["source"] == "dblp")) & (X.norm_title(x["title"]) == bt))
    year_as_volume = (F.col("etype") == "inproceedings") & F.col("b_volume").rlike("^[0-9]{4}$") & by.isNotNull() & (F.abs(F.col("b_volume").try_cast("int") - by) <= 1)
    year_as_volume &= ~F.exists("usable", lambda x: X.usable_volume(x["volume"]).isNotNull())

    def rule(when: Column, field: str, in_bib: Column, in_record: Column, severity: Column | str, src: Column = source) -> Column:
        s = severity if isinstance(severity, Column) else F.lit(severity)
        return F.when(when, F.struct(F.lit(field).alias("field"), in_bib.alias("in_bib"), in_record.alias("in_record"), src.alias("source"), s.alias("severity")))

    graded = F.when(strong, "CRITICAL").otherwise("WEAK")
    blank = F.lit("")
    only_bib, only_rec = F.col("diff.only_bib"), F.col("diff.only_record")
    has_author = F.col("b_author") != ""
    rules = [
        rule(skip, "entry", _field("url"), blank, "SKIP", F.lit("url")),
        rule(~skip & unresolved, "doi", _field("doi"), F.lit("does not resolve"), "CRITICAL", F.lit("crossref")),
        rule(~skip & ~found & ~unresolved, "entry", F.col("b_title"), F.lit("no record found"), "UNVERIFIED", F.lit("-")),
        rule(~skip & found & other_title, "title", F.col("b_title"), F.col("rec.title"), graded),
        rule(go & has_author & (F.size(only_bib) > 0), "author", F.array_join(only_bib, "; "), F.array_join(only_rec, "; "), graded),
        rule(go & has_author & (F.size(only_bib) == 0) & (F.size(only_rec) > 0), "author", F.lit("(missing)"), F.array_join(only_rec, "; "), F.when(strong, "MAJOR").otherwise("WEAK")),
        rule(go & has_author & (F.size("forms") > 0), "author-name-form", F.array_join("forms", "; "), F.array_join("people", "; "), "MINOR"),
        rule(go & wrong_year, "year", F.col("b_year"), F.array_join(F.array_sort(F.array_distinct(F.transform(years, lambda y: y.cast("string")))), "/"), F.when(F.col("etype") == "book", "MINOR").otherwise("MAJOR")),
        rule(go & strong & (F.col("b_volume") != "") & volume.isNotNull() & (X.fold("b_volume") != X.fold(volume)), "volume", F.col("b_volume"), volume, "MAJOR"),
        rule(go & strong & (F.col("b_number") != "") & (F.coalesce("rec.issue", blank) != "") & (X.fold("b_number") != X.fold("rec.issue")), "issue", F.col("b_number"), F.col("rec.issue"), "MAJOR"),
        rule(go & strong & (F.col("b_pages") != "") & (X.page_range("rec.pages") != "") & (X.page_range("b_pages") != X.page_range("rec.pages")), "pages", X.page_range("b_pages"), X.page_range("rec.pages"), "MAJOR"),
        rule(go & year_as_volume, "volume", F.col("b_volume"), F.lit("the year of publication, not a volume"), "MINOR"),
        rule(go & strong & ~is_preprint(F.col("rec.venue")) & (vb != "") & (vr != "") & ~F.contains(vr, vb) & ~F.contains(vb, vr), "venue", F.col("b_venue"), F.col("rec.venue"), "MAJOR"),
        rule(go & (F.size(published) > 0), "preprint", F.col("b_venue"), F.get(published, F.lit(0))["venue"], "MINOR", F.coalesce(F.get(published, F.lit(0))["source"], F.lit("-"))),
    ]
    e = e.withColumn("findings", F.array_compact(F.array(*rules)))
    last = rule(~skip & found & ~strong & (F.size("findings") == 0), "entry", blank, F.lit("title-search match only"), "WEAK")
    return e.select("key", F.explode(F.concat("findings", F.array_compact(F.array(last)))).alias("f")).select("key", "f.*")


def coverage(entries: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: entries, checked, unverified and skipped; what could not be checked is data."""
    state = findings.groupBy("key").agg(F.bool_or(F.col("severity") == "UNVERIFIED").alias("u"), F.bool_or(F.col("severity") == "SKIP").alias("s"))
    j = entries.select("key").distinct().join(state, "key", "left")
    return j.agg(F.count("*").alias("entries"), F.count_if(~F.coalesce("u", F.lit(False)) & ~F.coalesce("s", F.lit(False))).alias("checked"), F.count_if("u").alias("unverified"), F.count_if("s").alias("skipped"))
