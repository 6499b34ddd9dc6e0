"""BibTeX parsing and the bibliography's rules."""

import re

import duckdb
import pytest

from lectern import catalogue
from lectern.operators import bibliography as B
from lectern.parse import bibtex
from lectern.plans import scholarly
from oracle import compare

TEXT = r"""
@string{x = "y"}
@Article{one, title = {A {Nested}
  Title}, author="Ba{\v{s}}i\'c, I. and Doe, J.", YEAR = 2020, year = 2021}
stray @ sign
@inproceedings{two, title = {Broken
"""


def test_parse():
    entries, problems = bibtex.parse(TEXT)
    assert [(k, t) for k, t, _ in entries] == [("one", "article"), ("two", "inproceedings")]
    assert entries[0][2] == {"title": "A Nested Title", "author": "Bašić, I. and Doe, J.", "year": "2021"}
    assert problems == ["two: value of title is not closed"]
    assert bibtex.parse(None) == ([], []) and bibtex.parse('@a{k, t = "never')[1]


def test_entries(spark):
    got = bibtex.entries(spark.createDataFrame([("a.bib", TEXT), ("b.bib", None)], "path string, text string")).collect()
    assert [(r.key, r.etype) for r in sorted(got, key=lambda r: r.seq)] == [("one", "article"), ("two", "inproceedings"), ("", "problem")]


BASE = {"title": "Deep Nets", "author": "Ann Lee and Bo Ray", "year": "2020", "journal": "J. Nets", "volume": "3", "pages": "1--9"}
REC = {"rung": 1, "title": "Deep nets", "authors": ["A. Lee", "Bo Ray"], "venue": "J. Nets", "year": 2020, "volume": "3", "issue": None, "pages": "1-9", "doi": "10.1/x", "source": "crossref", "strong": True}


@pytest.mark.parametrize(
    ("fields", "record", "want"),
    [
        ({}, {}, set()),
        ({"title": "Other"}, {}, {("title", "CRITICAL")}),
        ({"title": "Other", "year": "1999"}, {"strong": False}, {("title", "WEAK")}),
        ({"author": "Ann Lee and New Guy"}, {}, {("author", "CRITICAL")}),
        ({"author": "Ann Lee"}, {}, {("author", "MAJOR")}),
        ({"author": "Ann Lee and others"}, {}, set()),
        ({"author": "Zoe Lee and Bo Ray"}, {}, {("author-name-form", "MINOR")}),
        ({"year": "2015"}, {}, {("year", "MAJOR")}),
        ({"year": "2021"}, {}, set()),
        ({"volume": "4"}, {}, {("volume", "MAJOR")}),
        ({"volume": "4"}, {"volume": "abs/12"}, set()),
        ({"pages": "2-9"}, {}, {("pages", "MAJOR")}),
        ({"journal": "Other Place"}, {}, {("venue", "MAJOR")}),
        ({"journal": "arXiv"}, {}, {("venue", "MAJOR"), ("preprint", "MINOR")}),
        ({}, {"strong": False}, {("entry", "WEAK")}),
        ({}, {"venue": B.UNRESOLVED}, {("doi", "CRITICAL")}),
        ({}, None, {("entry", "UNVERIFIED")}),
    ],
)
def test_rules(spark, fields, record, want):
    entries = spark.createDataFrame([("k", "article", BASE | fields)], "key string, etype string, fields map<string,string>")
    columns = "entry_key string, " + B.RECORD[7:-1]
    records = spark.createDataFrame([("k", *(REC | record).values())] if record is not None else [], columns)
    assert {(r.field, r.severity) for r in B.check(entries, records).collect()} == want


def test_skip_and_coverage(spark):
    entries = spark.createDataFrame([("w", "misc", {"url": "u"}), ("n", "article", {"title": "T"})], "key string, etype string, fields map<string,string>")
    found = B.check(entries, spark.createDataFrame([], "entry_key string, " + B.RECORD[7:-1]))
    assert {(r.key, r.severity) for r in found.collect()} == {("w", "SKIP"), ("n", "UNVERIFIED")}
    assert tuple(B.coverage(entries, found).first()) == (2, 0, 1, 1)


def test_quotes_escapes_and_open_values():
    found, problems = bibtex.parse('@article{a, author = "Lee {"q"} and B{\\"o}", t={x \\{ y}, year = 2020 }\n@string{f = "b"} @book{k,title="open')
    assert [(k, kind, f) for k, kind, f in found] == [("a", "article", {"author": 'Lee "q" and Bö', "t": "x \\ y", "year": "2020"}), ("k", "book", {"title": "open"})]
    assert problems == ["k: value of title is not closed"]


def test_a_title_is_folded_once(spark):
    entries = spark.createDataFrame([("k", "article", BASE)], "key string, etype string, fields map<string,string>")
    records = spark.createDataFrame([("k", *REC.values())], "entry_key string, " + B.RECORD[7:-1])
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = B.check(entries, records)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    assert plan.count("translate(b_title#") == 1
    assert len(re.findall(r"translate\(coalesce\(rec#\d+\.title", plan)) == 1


def test_equal_titles_are_not_folded(spark):
    entries = spark.createDataFrame([("k", "article", BASE)], "key string, etype string, fields map<string,string>")
    records = spark.createDataFrame([("k", *REC.values())], "entry_key string, " + B.RECORD[7:-1])
    plan = B.check(entries, records)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"CASE WHEN \(\(size\(usable#\d+, \w+\) > 0\) AND \(?NOT same#", plan)) == 2, plan


@pytest.mark.parametrize("name", ["rule_engine", "worst_severity"])
def test_a_repeated_document_meets_its_own_record(spark, tmp_path, name):
    docs = [(1, "One", "src0"), (1, "Another", "src1"), (2, "Two", "src0"), (2, "Two", "src0"), (3, " 'Thrée ", None), (3, "!", "src3"), (4, "four", "src1"), (None, "five", "src2")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1, 1, 0), (2, 0, 0), (2, 0, 1), (3, 0, 1), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got, want = compare(catalogue.queries()[name](spark, str(tmp_path)), con, catalogue.oracle_sql()[name])
    assert got == want


def test_titles_that_go_on_from_one_another_fold_the_rest_alone(spark):
    titles = [("A study", "A study, more"), ("A study: more", "A study"), ("A study", "A study!"), ("!", "! more"), ("A study", "More")]
    entries = spark.createDataFrame([(str(i), "article", BASE | {"title": a}) for i, (a, _) in enumerate(titles)], "key string, etype string, fields map<string,string>")
    records = spark.createDataFrame([(str(i), *(REC | {"title": b}).values()) for i, (_, b) in enumerate(titles)], "entry_key string, " + B.RECORD[7:-1])
    found = B.check(entries, records)
    assert {r.key for r in found.collect() if r.field == "title"} == {"0", "1", "4"}
    assert re.search(r"CASE WHEN isnotnull\(rest#\d+\) THEN NOT \(trim\(regexp_replace\(CASE WHEN \(octet_length\(rest#", found._jdf.queryExecution().optimizedPlan().toString())


@pytest.mark.parametrize("bits", [1, 64, 1 << 23])
def test_marks_miss_no_document(spark, monkeypatch, bits):
    monkeypatch.setattr(scholarly, "_MARKS", bits)
    docs = spark.range(-500, 500).selectExpr("id * 12345678901 AS doc_id", "'t' AS text").union(spark.sql("SELECT CAST(NULL AS BIGINT), 't'"))
    ids = spark.range(-500, 500, 10).selectExpr("id * 12345678901 AS doc_id")
    got = scholarly._marked(docs, ids)
    assert got.columns == ["doc_id", "text", "marked"] and got.count() == 1001
    marked = {r.doc_id for r in got.where("marked").collect()}
    assert {r.doc_id for r in ids.collect()} <= marked
    assert bits < 1 << 23 or len(marked) < 110
    narrow = spark.range(0, 1000, 10).selectExpr("CAST(id AS INT) AS doc_id")
    assert scholarly._marked(spark.range(1000).toDF("doc_id"), narrow).where("marked AND doc_id % 10 = 0").count() == 100
    assert scholarly._marked(docs, ids.where("false")).where("marked").count() == 0


@pytest.mark.parametrize("name", ["rule_engine", "worst_severity", "bib_coverage"])
@pytest.mark.parametrize("bits", [1, 1 << 23])
def test_findings_are_the_same_whatever_is_marked(spark, tmp_path, monkeypatch, name, bits):
    monkeypatch.setattr(scholarly, "_MARKS", bits)
    texts = ["One", "", " ", "!", "One", "Ünï", "one more", " x ", "more"]
    docs = [(i, texts[i % 9], f"src{i % 3}") for i in range(49)] + [(50, None, "src1"), (51, "five", None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, q, t) for i in range(0, 40, 2) for q, t in ([(1, 0)], [(0, 1)], [(0, 0), (0, 1)], [(1, 1), (0, 0)])[i // 2 % 4]] + [(50, 0, 0), (None, 1, 1), (99, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got, want = compare(catalogue.queries()[name](spark, str(tmp_path)), con, catalogue.oracle_sql()[name])
    assert got == want
