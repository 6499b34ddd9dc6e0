"""Cross-site boilerplate lines against the SQL and given cases."""

import time

import duckdb
import pandas as pd

from lectern.llm import line_dedup

SCHEMA = "doc_id long, text string, source string, n_lines int, line string"


def rows():
    out = [(i, f"own {i}\nfooter\n\nfew", f"s{i}" if i < 12 else None, 0, "x") for i in range(40)]
    out += [(100 + i, "few\nrare" if i < 3 else "tail\n", f"s{i}", 0, "x") for i in range(9)]
    return [*out, (200, None, "s1", 0, "x"), (201, "", "s1", 0, "x"), (202, "footer\nfooter", None, 0, "x")]


def test_against_sql(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = line_dedup.remove_boilerplate(docs)
    assert got.columns.count("n_lines") == 1 and "line" in got.columns
    got = got.select("doc_id", "text", "n_lines", "n_removed").toPandas().sort_values("doc_id").reset_index(drop=True)
    documents = pd.DataFrame(rows(), columns=["doc_id", "text", "source", "a", "b"])  # noqa: F841
    want = duckdb.sql(line_dedup.SQL).df().sort_values("doc_id").reset_index(drop=True)
    want["text"] = want.text.astype(object).where(want.text.notna(), None)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    by = got.set_index("doc_id")
    assert by.loc[0, "text"] == "own 0\nfooter\n\nfew" and by.loc[1, "text"] == "own 1\n"
    assert by.loc[202, "n_removed"] == 2 and by.loc[200, "n_lines"] == 0 and by.loc[102, "text"] == "rare"


def test_exactly_at_the_threshold(spark):
    docs = spark.createDataFrame([(i, "a\nb" if i < 9 else "a", f"s{i}", 0, "") for i in range(10)], SCHEMA)
    got = {r.doc_id: r.text for r in line_dedup.remove_boilerplate(docs).collect()}
    assert got == {0: "a\nb"} | {i: "b" for i in range(1, 9)} | {9: ""}


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a", f"s{i}", 0, "") for i in range(11)] + [(5, "a", "s1", 0, "")] * 2, SCHEMA)
    got = line_dedup.remove_boilerplate(docs).collect()
    assert len(got) == 13 and sorted(r.text for r in got if r.doc_id is None) == ["a"] * 11
    assert [r.text for r in got if r.doc_id == 5] == ["", ""]
    assert line_dedup.remove_boilerplate(docs.limit(0)).count() == 0


def test_texts_of_many_lines(spark):
    long = "\n".join(f"line {k}" for k in range(8000))
    docs = spark.createDataFrame([(i, long, f"s{i}", 0, "") for i in range(11)], SCHEMA)
    line_dedup.remove_boilerplate(docs).count()
    began = time.perf_counter()
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.remove_boilerplate(docs).collect()}
    took = time.perf_counter() - began
    assert got == {0: (long, 0)} | {i: ("", 8000) for i in range(1, 11)}
    assert took < 12
