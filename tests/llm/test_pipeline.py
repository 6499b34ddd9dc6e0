"""The pipeline's stages against plain Python on small tables."""

import hashlib
import random
import string
from collections import Counter, defaultdict

import corpus_pipeline as C
import public_tokenizers as P
import pytest
import tiktoken

from lectern.llm import bpe, line_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """Each stage's rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in C.STAGES:
        docs = out[name] = C.materialise(stage(spark, docs, SF), "test")
    return out


def test_columns(kept):
    for name in ("language_id", "line_dedup", "near_dedup", "mix_sources"):
        assert kept[name].columns == kept["documents"].columns


def test_language_id_keeps_clean_documents(kept):
    before = {r.doc_id for r in kept["documents"].collect() if any(map(str.isalpha, r.text or ""))}
    assert {r.doc_id for r in kept["language_id"].collect()} == before


def test_line_dedup(kept):
    sites, first = defaultdict(set), {}
    rows = sorted(kept["language_id"].collect())
    for r in rows:
        for pos, line in enumerate(r.text.split("\n")):
            if line.strip():
                sites[line].add(r.source)
                first.setdefault(line, (r.doc_id, pos))
    want = {}
    for r in rows:
        lines = [x for pos, x in enumerate(r.text.split("\n")) if not (x.strip() and len(sites[x]) >= line_dedup.MIN_SITES and first[x] != (r.doc_id, pos))]
        if "".join(lines).strip() or "\n".join(lines) == r.text:
            want[r.doc_id] = "\n".join(lines)
    assert {r.doc_id: r.text for r in kept["line_dedup"].collect()} == want


def test_near_dedup(kept):
    sets = {}
    for r in kept["line_dedup"].collect():
        w = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
    for _ in sets:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert sorted(r.doc_id for r in kept["near_dedup"].collect()) == sorted(i for i in sets if label[i] == i)


def test_mix(kept):
    before = {r.doc_id: r for r in kept["near_dedup"].collect()}
    copies = Counter(r.doc_id for r in kept["mix_sources"].collect())
    size = {i: len(r.text.split()) for i, r in before.items()}
    assert max(copies.values()) <= 2 and set(copies) <= set(before)
    have, taken = sum(size.values()), sum(size[i] * n for i, n in copies.items())
    assert abs(taken - 1.5 * have) <= 20 + 0.01 * have


def test_last_stage(kept):
    exact = tiktoken.Encoding("exact", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in kept["mix_sources"].collect()}
    rows = kept["byte_bpe"].collect()
    assert len(rows) == kept["mix_sources"].count()
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.n_tokens == len(exact.encode_ordinary(texts[r.doc_id]))


#: doc_ids that each stage leaves of the odd rows, repeats as often as they are taken.
ODD = {
    "language_id": ["3", "3", "4", "None"],
    "line_dedup": ["1", "2", "3", "3", "4", "None"],
    "near_dedup": ["1", "2", "3", "4", "None"],
    "byte_bpe": ["1", "2", "3", "3", "4", "None"],
}


def test_noise_goes_in_the_first_stage(spark):
    rng = random.Random(1)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    letters = string.ascii_letters + string.digits + "+/"
    noise = ["".join(rng.choices(letters, k=3000)) for _ in range(20)] + ["".join(chr(rng.randrange(0x100, 0x2000)) for _ in range(1500)) for _ in range(5)]
    planted = spark.createDataFrame([(10**9 + k, t, "en" if k % 2 else None, "s", len(t)) for k, t in enumerate(noise)], docs.schema)
    kept = C.language_id(spark, docs.unionByName(planted), SF)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_odd_rows(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (None, "the words of it " * 9, "en", "a", 0), (3, "the words of it " * 9, "en", "a", 0), (3, "the words of it " * 9, "en", "a", 0), (4, "more words", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    empty = docs.limit(0)
    for name, stage in C.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        rows = stage(spark, docs, SF)
        assert rows.columns == (docs.columns if name != "byte_bpe" else rows.columns), name
        got = Counter(str(r.doc_id) for r in rows.collect())
        if name == "mix_sources":
            assert all(0 < n <= 2 * (2 if i == "3" else 1) for i, n in got.items()) and {"3", "4", "None"} <= set(got)
        else:
            assert sorted(got.elements()) == ODD[name], name
    ids = [r.doc_id for r in C.dedup_documents(spark, docs, SF).collect()]
    assert sorted(map(str, ids)) == ["1", "2", "3", "4", "None"]


def test_run(spark, kept):
    assert sorted(map(str, C.run(spark, SF).collect())) == sorted(map(str, kept["byte_bpe"].collect()))
