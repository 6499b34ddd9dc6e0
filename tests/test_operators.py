"""Operators on given cases: joins, merging, sequences, sources, greedy picks, streaming."""

import gzip
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from lectern import catalogue
from lectern.operators import graph, greedy, joins, merge, scoring, sequences
from lectern.sources import files, payloads
from lectern.streaming.breaker import breaker_stream


@pytest.mark.parametrize(
    ("bib", "rec", "want"),
    [
        (["Lee, A", "Ray, B"], ["Ann Lee", "Bo Ray"], ([], [])),
        (["Lee, A", "Fake, X"], ["Ann Lee", "Bo Ray"], (["Fake, X"], ["Bo Ray"])),
        (["Lee, A", "others"], ["Ann Lee", "Bo Ray"], ([], [])),
        (["Lee, A"], ["李安"], ([], [])),
        (["Lee, A"], ["ETH Zurich"], ([], [])),
        ([], ["Ann Lee"], ([], ["Ann Lee"])),
    ],
)
def test_author_diff(spark, bib, rec, want):
    df = spark.createDataFrame([(bib, rec)], "b array<string>, r array<string>")
    d = df.select(joins.author_diff(F.col("b"), F.col("r")).alias("d")).first().d
    assert (d.only_bib, d.only_record) == want


def test_asof(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 5), (4, None, 5), (5, "a", None)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 9, "z"), (None, 1, "n")], "k string, t int, v string")
    got = {r.id: (r.v, r.right_t) for r in joins.asof_last_before(left, right, ["k"], "t", "t", ["t", "v"]).collect()}
    assert got == {1: ("y", 5), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None)}
    strict = {r.id: r.v for r in joins.asof_last_before(left, right, ["k"], "t", "t", ["v"], strict=True).collect()}
    assert strict[1] == "x"


def test_interval_edges(spark):
    p = spark.createDataFrame([(0,), (9,), (10,), (25,), (None,)], "x int")
    s = spark.createDataFrame([(1, 0, 10), (2, 5, 26), (3, 7, 7)], "id int, a int, z int")
    got = joins.interval_locate(p, s, "x", "a", "z", 4).collect()
    assert sorted((str(r.x), r.id) for r in got if r.id) == [("0", 1), ("10", 2), ("25", 2), ("9", 1), ("9", 2)]
    assert [r.x for r in got if r.id is None] == [None]


def test_components_and_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (None, 3), (7, 5), (3, 1)], "src long, dst long")
    assert {r.id: r.component_id for r in graph.connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 4}
    assert graph.connected_components(e.limit(0)).count() == 0
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    assert {r.component_id for r in graph.connected_components(path).collect()} == {0}
    assert {r.id for r in graph.on_cycle(e).collect()} == {1, 2, 3}
    with pytest.raises(RuntimeError):
        graph.reachable(path, max_depth=5)


def test_upsert_keeps_unknown(spark):
    rows = [("k", 2, "B", 5, "forward:s", ["r1"]), ("k", 1, "A", None, "back:s", ["r2", "r1"]), ("k", 3, "C", 3, "back:s", None), ("u", 4, "D", None, "x", None), ("", 5, "E", 1, "x", None), ("gone", 6, "F", 1, "x", None)]
    df = spark.createDataFrame(rows, "key string, seq int, title string, cites int, path string, refs array<string>")
    got = {r.key: r for r in merge.keyed_upsert(df, "key", "seq", ["title"], "cites", "path", "refs", spark.createDataFrame([("gone",)], "key string")).collect()}
    assert set(got) == {"k", "u"} and got["u"].cites is None
    assert (got["k"].title, got["k"].cites, got["k"].refs, got["k"].paths) == ("A", 5, ["r1", "r2"], ["back:s", "forward:s"])


def test_supersede(spark):
    rows = [(1, "CRITICAL", None), (2, "SKIP", True), (3, "CRITICAL", True)]
    df = spark.createDataFrame([("c", *r) for r in rows], "c string, n int, severity string, confirmed boolean")
    assert [r.severity for r in sequences.supersede(df, ["c"], ["n"]).orderBy("n").collect()] == ["LOCAL", "SKIP", "CRITICAL"]


def test_verdicts(spark):
    steps = spark.createDataFrame([("s", "structural", True), ("r", "display", True), ("u", "display", False), ("d", "display", True), ("c", "display", True), ("n", "display", True)], "step_id string, kind string, domains_known boolean")
    results = [("s", "rational", "refuted", None), ("r", "rational", "refuted", None), ("u", "rational", "refuted", None), ("d", "rational", "refuted", None), ("d", "smt", "confirmed", None), ("c", "smt", "confirmed", "partial")]
    got = scoring.compose_verdicts(steps, spark.createDataFrame(results, "step_id string, engine string, outcome string, translation_confidence string"))
    assert {r.step_id: r.severity for r in got.collect()} == {"s": "SKIP", "r": "CRITICAL", "u": "MAJOR", "d": "UNVERIFIED", "c": "WEAK", "n": "UNVERIFIED"}


def test_angles_and_restatements(spark):
    angles = ["graph neural network pruning", "graph neural network", "neural network pruning", "sparse attention maps", "tiny"]
    assert greedy.pick_angles(angles, 4) == ["graph neural network", "sparse attention maps", "graph neural", "sparse attention"]
    df = spark.createDataFrame([("d", a, i) for i, a in enumerate(angles)], "doc string, phrase string, pos int")
    assert [r.angle for r in greedy.greedy_angles(df, "doc", "phrase", "pos", 4).orderBy("rank").collect()] == greedy.pick_angles(angles, 4)
    claims = [("d", 1, "a", "lemma", "lem:x", "Let x be small. Then f is flat.", "f is flat", False), ("d", 2, "b", "lemma", "lem:x_restated", "other", "other", False), ("d", 3, "c", "lemma", None, "Let x be small. Then f is flat!", "f is flat", False), ("d", 4, "e", "theorem", None, "Let x be small. Then f is flat.", "f is flat", False)]
    df = spark.createDataFrame(claims, "doc string, ord int, id string, kind string, label string, statement string, conclusion string, explicit boolean")
    assert {(r.id, r.duplicate_of, r.by) for r in greedy.restatements(df).collect()} == {("b", "a", "label"), ("c", "a", "ratio")}


CROSSREF = '{"message": {"title": ["T"], "author": [{"given": "A", "family": "B"}, {"family": "C"}], "issued": {"date-parts": [[2020, 1]]}, "container-title": ["V"], "volume": "3", "page": "1-2", "DOI": "10.1/x"}}'
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A\n  B</title><published>2021-02-03</published><author><name>N M</name></author></entry></feed>'
DBLP = '{"result": {"hits": {"hit": [{"info": {"title": "T.", "venue": "V", "year": "2019", "authors": {"author": {"text": "Wei Wang 0001"}}}}]}}}'
OPENALEX = '{"results": [{"id": "W1", "title": "T", "publication_year": 2018, "doi": "https://doi.org/10.1/y", "authorships": [{"author": {"display_name": "A"}}], "primary_location": {"source": {"display_name": "J"}}, "referenced_works": ["W2"]}]}'
S2 = '{"data": [{"paperId": "p", "title": "T", "year": 2017, "venue": "V", "externalIds": {"DOI": "10.1/z"}, "authors": [{"name": "A"}]}]}'


def test_payloads(spark):
    def one(adapter, body):
        return adapter(spark.createDataFrame([("l", body), ("bad", "{"), ("none", None)], "lookup string, body string")).collect()

    (c,) = one(payloads.crossref, CROSSREF)
    assert (c.title, c.authors, c.venue, c.year, c.volume, c.pages, c.doi, c.source, c.strong) == ("T", ["A B", "C"], "V", 2020, "3", "1-2", "10.1/x", "crossref", True)
    (a,) = payloads.arxiv(spark.createDataFrame([("l", ATOM)], "lookup string, body string")).collect()
    assert (a.title, a.authors, a.venue, a.year, a.strong) == ("A B", ["N M"], "arXiv", 2021, True)
    (d,) = one(payloads.dblp, DBLP)
    assert (d.title, d.authors, d.year, d.strong) == ("T", ["Wei Wang"], 2019, False)
    (o,) = one(payloads.openalex, OPENALEX)
    assert (o.doi, o.venue, o.cited_by_count, o.referenced) == ("10.1/y", "J", None, ["W2"])
    (s,) = one(payloads.semantic_scholar, S2)
    assert (s.doi, s.year, s.authors) == ("10.1/z", 2017, ["A"])


def test_ladder(spark):
    entries = spark.createDataFrame([("a", "10.1/x", None, "T"), ("b", "10.1/dead", None, "T"), ("c", "", "2101.00001", "T"), ("d", "", None, "Other")], "key string, doi string, arxiv_id string, title string")
    doi = payloads.crossref(spark.createDataFrame([("10.1/x", CROSSREF)], "lookup string, body string"))
    arx = payloads.arxiv(spark.createDataFrame([("2101.00001", ATOM)], "lookup string, body string"))
    title = payloads.dblp(spark.createDataFrame([("t", 3, DBLP)], "title_key string, rung int, body string"))
    got = {(r.entry_key, r.rung, r.venue) for r in payloads.ladder(entries, doi, arx, title).collect()}
    assert got == {("a", 1, "V"), ("b", 1, "__DOI_UNRESOLVED__"), ("b", 3, "V"), ("c", 2, "arXiv"), ("c", 3, "V")}


def test_files(spark):
    f = spark.createDataFrame([("main.tex", "\\input{a} % \\input{no}\n\\include{b.tex}"), ("a.tex", "\\input{b}"), ("b.tex", ""), ("no.tex", "")], "path string, text string")
    assert {(r.path, r.depth) for r in files.include_closure(f, "main.tex").collect()} == {("main.tex", 0), ("a.tex", 1), ("b.tex", 1)}
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as tar:
        for name, text in (("z.tex", "last"), ("a.tex", "first"), ("x.bib", "no")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    rows = spark.createDataFrame([("t", buffer.getvalue()), ("g", gzip.compress(b"zipped")), ("n", None), ("j", b"junk")], "path string, content binary")
    assert {r.path: r.text for r in files.archives(rows).collect()} == {"t": "first\nlast", "g": "zipped", "n": None, "j": None}
    d = files.discover(spark.createDataFrame([("d/refs.bib",), ("d/main.bib",), ("e/corrected.bib",), ("e/x.bib",)], "path string"), ("main.bib",), ".bib")
    assert {r.folder: r.path for r in d.collect()} == {"d": "d/main.bib", "e": "e/x.bib"}


def test_stream(spark, tmp_path):
    rows = [("h", 1, True), ("h", 2, True), ("h", 3, True), ("h", 4, False), ("g", 1, True), ("g", 2, False), ("g", 3, True)]
    spark.createDataFrame(rows, "host string, ts int, failed boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("host string, ts int, failed boolean").parquet(str(tmp_path / "in"))
    q = breaker_stream(stream).writeStream.format("memory").queryName("hosts").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.host, r.attempts, r.refused, r.open) for r in spark.table("hosts").collect()} == {("h", 4, 1, True), ("g", 3, 0, False)}


def test_angles_come_from_all_phrases(spark, tmp_path):
    pairs = [f"{a}{b} {b}{a}" for a in ("red", "green", "blue", "white", "black", "brown", "grey") for b in ("cat", "dog", "hen", "cow", "pig", "bee", "ant")]
    triples = ["sparse attention maps", "graph kernel pruning", "convex loss surfaces", "token budget planning", "proof search trees"]
    text = " the ".join([*pairs, *pairs, *triples])
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["greedy_angles"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [r.angle for r in got] == [*triples, "sparse attention", "graph kernel", "convex loss"]


def test_documents_restate_passages(spark, tmp_path):
    passage = "We show that sparse maps of attention keep their rank under every smooth change of the basis."
    bench = [(1, passage), (2, "No document has this passage in any form at all."), (3, "Three short words")]
    docs = [
        (10, f"Before it come\nsome words. {passage.replace(' of the', chr(10) + 'of the')} After it others."),
        (11, "Other words. " + passage.replace("smooth", "smoother") + " More of them."),
        (12, passage[8:] + " The first words are cut off."),
        (13, "Wholly unlike, with three words in a row: keep their rank, and nothing else."),
        (14, "There are Three short words here."),
        (15, None),
    ]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc, r.duplicate_of): (r.id, r.ratio) for r in catalogue.queries()["fuzzy_ratio"](spark, str(tmp_path)).collect()}
    assert set(got) == {("10", "1"), ("11", "1"), ("12", "1"), ("14", "3")}
    assert got["10", "1"] == ("5", 1.0) and got["14", "3"] == ("2", 1.0)
    assert 0.9 <= got["11", "1"][1] < 1 and 0.9 <= got["12", "1"][1] < 1


def test_planted_passages_are_found(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    planted = docs.join(bench, F.contains(docs["text"], bench["text"])).select("doc_id", "item_id").collect()
    got = {(int(r.doc), int(r.duplicate_of)): r.ratio for r in catalogue.queries()["fuzzy_ratio"](spark, sf).collect()}
    assert planted and all(got[r.doc_id, r.item_id] > 0.99 for r in planted)  # marks may touch a passage's last word


def test_all_documents_less_benchmark_and_three_engines(spark, tmp_path):
    docs = [(1, "Alpha one", "es", "src0", 9), (2, "Beta two", None, "src0", 8), (3, "Gamma!", "en", "src1", 6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "gamma"), (8, "Delta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(5, "http://x.y", "alpha ONE")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalogue.queries()["documents_less_benchmark"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {("src0", 2, False), ("src1", 0, True)}
    got = catalogue.queries()["engines_upsert"](spark, str(tmp_path)).collect()
    want = {("documents", 1, 9, "documents,pages"), ("documents", 2, 8, "documents"), ("documents", 3, 6, "documents,benchmark"), ("benchmark", 8, None, "benchmark")}
    assert {(r.engine, r.id, r.cites, r.paths) for r in got} == want
