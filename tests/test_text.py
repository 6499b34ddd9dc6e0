"""Scalar functions on given cases."""

import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X


def one(spark, expression, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(expression.alias("x")).first()
    return row.x


@pytest.mark.parametrize(
    ("text", "want"),
    [("Ba{\\v{s}}i\\'c", "basic"), ("Stra\\ss{}e", "strasse"), ("O&apos;Reilly", "o'reilly"), ("Cesa\u2010Bianchi", "cesa-bianchi"), ("De~Vylder", "de vylder"), ("Ünïcode", "unicode"), ("\\'{\\i}", "i")],
)
def test_fold_exact(spark, text, want):
    assert X.fold_text(text) == want
    assert one(spark, X.fold_exact("c0"), text) == want


@pytest.mark.parametrize("text", ["Ünïcode ß Éa", "plain", " trim ", "Cesa\u2010Bianchi’s", "ño"])
def test_fold_agrees_on_latin(spark, text):
    assert one(spark, X.fold("c0"), text) == X.fold_text(text)


CASES = [
    (X.norm_title, "Über: the Title (2nd)", "uber the title 2nd"),
    (X.family_key, "Molina León, Gabriela", "leon"),
    (X.family_key, "Gabriela Molina León", "leon"),
    (X.family_key, "Wei Wang 0001", "wang"),
    (X.given_initial, "Vastl, Martin", "m"),
    (X.given_initial, "Martin Vastl", "m"),
    (X.given_initial, "Vastl", ""),
    (X.split_authors, "A and B,  and C", ["A", "B", "C"]),
    (X.is_et_al, "et al.", True),
    (X.is_et_al, "Alan", False),
    (X.looks_like_organisation, "ETH Zurich", True),
    (X.looks_like_organisation, "Ethan Z", False),
    (X.parse_count, "10^5", 100000),
    (X.parse_count, "1,000", 1000),
    (X.parse_count, "60 million", 60000000),
    (X.parse_count, "6.4M", 6400000),
    (X.parse_count, "10K", 10000),
    (X.parse_count, "several", None),
    (X.parse_count, None, None),
    (X.page_range, "1--9", "1-9"),
    (X.usable_volume, "abs/2604.08324", None),
    (X.usable_volume, "35", "35"),
    (X.arxiv_id_from_doi, "10.48550/arXiv.2101.00001", "2101.00001"),
    (X.arxiv_id_from_doi, "10.1/x", None),
    (X.strip_comments, "a % b\nc \\% d", "a \nc \\% d"),
    (X.cited_keys, "\\citep[see][]{a, b} \\autocite{b,c} \\ref{d}", ["a", "b", "c"]),
    (X.step_number, "proof/s12", 12),
    (X.slug, "lem: smooth const", "lem-smooth-const"),
    (X.table_cell, "a|b\nc", "a\\|b c"),
    (X.is_markup, "\\a{b}\\c{d}$x$", True),
    (X.is_markup, "A plain sentence of words.", False),
    (X.phrases, "Graph neural nets and fast search trees", ["graph neural nets", "fast search trees", "graph neural", "neural nets", "fast search", "search trees"]),
    (X.sentences, "One. Two! three", ["One.", "Two!", "three"]),
]


@pytest.mark.parametrize(("function", "text", "want"), CASES)
def test_functions(spark, function, text, want):
    assert one(spark, function("c0"), text) == want


@pytest.mark.parametrize(("n", "want"), [(6400000, "6.4M"), (1000, "1K"), (999, "999"), (60000000, "60M"), (1234567, "1.23457M"), (None, "")])
def test_format_count(spark, n, want):
    assert spark.createDataFrame([(n,)], "n long").select(X.format_count("n").alias("x")).first().x == want


def test_content_hash_ignores_layout(spark):
    a = one(spark, X.content_hash("c0", "c1"), "a  b\n", None)
    assert a == one(spark, X.content_hash("c0", "c1"), " a b", "") != one(spark, X.content_hash("c0", "c1"), "ab", "")
    assert one(spark, F.lit(len(a)), "") == 16


def test_key_keeps_letters_digits_and_spaces_alone(spark):
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    kept = spark.createDataFrame([(every,)], "t string").select(F.regexp_replace("t", X.NOT_KEY, "").alias("k")).first().k
    assert kept == " 0123456789abcdefghijklmnopqrstuvwxyz"


@pytest.mark.parametrize("raw", ["", " \n", "A~b`C", "\ta, (b) -  C\u00a0", "É\u0301tude: ß Ünï\u2019s K", "x\u20ac y", "Ƶ İ"])
def test_title_keys_in_ascii_and_beyond(spark, raw):
    assert one(spark, X.norm_title("c0"), raw) == " ".join(re.findall("[a-z0-9]+", X.fold_text(raw)))


@pytest.mark.parametrize("more", ["", " more", " Über", "!?", " ~`´", "\u0301", "ß", "\u212a", "Σ", " \u4e2d", "\u01307"])
@pytest.mark.parametrize("start", ["", "a", "Größe", "Πό", "!", "I", "x \u0301"])
def test_what_goes_beyond_a_title_decides_if_keys_differ(spark, start, more):
    df = spark.createDataFrame([(start, start + more)], "a string, b string")
    key, other = X.norm_title("a"), X.norm_title("b")
    for rest in (X.beyond("a", "b"), X.beyond("b", "a")):
        got, known, differs = df.select(rest, X.norm_title(rest) != "", key != other).first()
        assert got == (more if re.search("[A-Za-z0-9]", start) else None)
        assert got is None or known == differs
    assert df.select(X.beyond(F.concat(F.lit("b"), "a"), F.concat(F.lit("c"), "b"))).first()[0] is None
