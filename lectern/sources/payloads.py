"""Stored payloads of scholarly indexes as record tables, and the ladder over them.

Payloads are ingested beforehand (url_sha, url, body); here they are parsed by
from_json and from_xml with the fields that count. An empty or malformed body
gives no record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.bibliography import UNRESOLVED, is_preprint

_CROSSREF = "title array<string>, author array<struct<given:string,family:string>>, issued struct<`date-parts`:array<array<int>>>, `container-title` array<string>, volume string, issue string, page string, DOI string, `is-referenced-by-count` long"
_DBLP = "result struct<hits:struct<hit:array<struct<info:struct<title:string,venue:string,year:string,volume:string,number:string,pages:string,doi:string,authors:struct<author:string>>>>>>"
_OPENALEX = "results array<struct<id:string,title:string,display_name:string,publication_year:int,doi:string,cited_by_count:long,primary_location:struct<source:struct<display_name:string>>,authorships:array<struct<author:struct<display_name:string>>>,referenced_works:array<string>>>"
_S2 = "data array<struct<paperId:string,title:string,year:int,venue:string,citationCount:long,externalIds:struct<DOI:string>,authors:array<struct<name:string>>>>"
_ATOM = "entry array<struct<id:string,title:string,published:string,author:array<struct<name:string>>>>"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _record(title, authors, venue, year, source: str, strong: bool, volume=None, issue=None, pages=None, doi=None, cites=None) -> list[Column]:
    null = F.lit(None).cast("string")
    return [
        _text(title).alias("title"), authors.alias("authors"), _text(venue).alias("venue"), year.cast("int").alias("year"),
        *[(c if c is not None else null).alias(n) for c, n in ((volume, "volume"), (issue, "issue"), (pages, "pages"), (doi, "doi"))],
        F.lit(source).alias("source"), F.lit(strong).alias("strong"), (cites if cites is not None else F.lit(None)).cast("long").alias("cited_by_count"),
    ]


def crossref(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Works looked up by DOI: the DOIs of one publisher's anthology are labelled with it."""
    p = payloads.withColumn("m", F.from_json(body, f"message struct<{_fields(_CROSSREF)}>")["message"]).where("m is not null")
    names = F.transform(F.coalesce("m.author", F.array().cast("array<struct<given:string,family:string>>")), lambda a: F.concat_ws(" ", a["given"], a["family"]))
    m = F.col("m")
    year = F.get(F.get(m["issued"]["date-parts"], F.lit(0)), F.lit(0))
    out = p.select(*payloads.drop(body).columns, *_record(F.get(m["title"], F.lit(0)), names, F.get(m["container-title"], F.lit(0)), year, "crossref", True, m["volume"], m["issue"], m["page"], m["DOI"], m["is-referenced-by-count"]))
    return out.withColumn("source", F.when(F.col("doi").startswith("10.18653/"), "acl/crossref").otherwise(F.col("source")))


def _fields(ddl: str) -> str:
    """A column list as the fields of a struct type."""
    return ",".join(":".join(part.split(" ", 1)) for part in ddl.split(", "))


def arxiv(payloads: DataFrame, body: str = "body") -> DataFrame:
    p = payloads.withColumn("e", F.get(F.from_xml(body, _ATOM)["entry"], F.lit(0))).where("e is not null")
    e = F.col("e")
    title = F.trim(F.regexp_replace(e["title"], r"\s+", " "))
    return p.select(*payloads.drop(body).columns, *_record(title, F.transform(e["author"], lambda a: a["name"]), F.lit("arXiv"), F.left(e["published"], F.lit(4)).try_cast("int"), "arxiv", True))


def dblp(payloads: DataFrame, body: str = "body") -> DataFrame:
    """First hit of a title search; a single author comes as an object instead of a list."""
    p = payloads.withColumn("i", F.get(F.from_json(body, _DBLP)["result"]["hits"]["hit"], F.lit(0))["info"]).where("i is not null")
    i = F.col("i")
    raw = i["authors"]["author"]
    many = F.from_json(raw, "array<struct<text:string>>")
    one = F.array(F.from_json(raw, "struct<text:string>"))
    people = F.when(F.ltrim(raw).startswith("["), many).when(raw.isNotNull(), one).otherwise(F.array().cast("array<struct<text:string>>"))
    names = F.transform(people, lambda a: X.strip_homonym_number(a["text"]))
    return p.select(*payloads.drop(body).columns, *_record(F.regexp_replace(i["title"], r"\.+$", ""), names, i["venue"], i["year"].try_cast("int"), "dblp", False, i["volume"], i["number"], i["pages"], i["doi"]))


def openalex(payloads: DataFrame, body: str = "body", every: bool = False) -> DataFrame:
    """First result of a title search, or every result, with what it cites; an unknown count stays null."""
    results = F.from_json(body, _OPENALEX)["results"]
    p = payloads.withColumn("w", F.explode(results if every else F.slice(results, 1, 1)))
    w = F.col("w")
    names = F.filter(F.transform(w["authorships"], lambda a: a["author"]["display_name"]), lambda n: n.isNotNull())
    doi = F.nullif(F.replace(w["doi"], F.lit("https://doi.org/"), F.lit("")), F.lit(""))
    cols = _record(F.coalesce(w["title"], w["display_name"]), names, w["primary_location"]["source"]["display_name"], w["publication_year"], "openalex", False, doi=doi, cites=w["cited_by_count"])
    return p.select(*payloads.drop(body).columns, *cols, w["id"].alias("id"), w["referenced_works"].alias("referenced"))


def semantic_scholar(payloads: DataFrame, body: str = "body", every: bool = False) -> DataFrame:
    data = F.from_json(body, _S2)["data"]
    p = payloads.withColumn("w", F.explode(data if every else F.slice(data, 1, 1))).where(_text(F.col("w.title")) != "")
    w = F.col("w")
    return p.select(*payloads.drop(body).columns, *_record(w["title"], F.filter(F.transform(w["authors"], lambda a: a["name"]), lambda n: n.isNotNull()), w["venue"], w["year"], "s2", False, doi=w["externalIds"]["DOI"], cites=w["citationCount"]), w["paperId"].alias("id"))


def uncached(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """URLs that the stored payloads lack; a stored 404 or 410 counts as an answer."""
    return urls.withColumn("url_sha", F.sha2("url", 256)).join(cache.select("url_sha"), "url_sha", "left_anti")


def ladder(entries: DataFrame, by_doi: DataFrame, by_arxiv: DataFrame, by_title: DataFrame) -> DataFrame:
    """Records of each entry in the order in which they count: entry_key, rung, and the record.

    entries: key, doi, arxiv_id, title. by_doi and by_arxiv have doi or arxiv_id
    as their first column, named lookup; by_title has title_key and rung 3 and
    above. A DOI without record gives one that says so. Title searches count
    only where no published record was found by an identifier.
    """
    e = entries.withColumn("title_key", X.norm_title("title"))
    own = e.where((F.col("doi") != "") & X.arxiv_id_from_doi("doi").isNull())
    d = own.select("key", F.col("doi").alias("lookup")).join(by_doi, "lookup", "left")
    fields = ["title", "authors", "venue", "year", "volume", "issue", "pages", "source", "strong"]
    d = d.select(F.col("key").alias("entry_key"), F.lit(1).alias("rung"), "lookup", *fields)
    missing = F.col("source").isNull()
    d = d.withColumn("venue", F.when(missing, UNRESOLVED).otherwise(F.col("venue"))).withColumn("strong", F.coalesce("strong", F.lit(True))).withColumn("source", F.coalesce("source", F.lit("crossref")))
    ids = e.select("key", F.coalesce(X.arxiv_id_from_doi("doi"), F.col("arxiv_id")).alias("lookup")).where("lookup is not null")
    a = ids.join(by_arxiv, "lookup").select(F.col("key").alias("entry_key"), F.lit(2).alias("rung"), "lookup", *fields)
    found = d.unionByName(a)
    settled = found.where(F.col("strong") & (F.col("venue") != UNRESOLVED) & ~is_preprint(F.col("venue"))).select(F.col("entry_key").alias("key")).distinct()
    t = e.select("key", "title_key").join(settled, "key", "left_anti").join(by_title, "title_key").select(F.col("key").alias("entry_key"), "rung", F.lit(None).cast("string").alias("lookup"), *fields)
    return found.unionByName(t).withColumnRenamed("lookup", "doi")
