"""Code lengths against a plain model, and held-out accuracy."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import langid

SF = "/root/testdata/sf0.01"


def plain_bits(training, text):
    followers = defaultdict(Counter)
    for t in training:
        t = b"   " + t.lower()
        for i in range(3, len(t)):
            for k in range(4):
                followers[t[i - k : i]][t[i]] += 1
    t, total = b"   " + text.lower(), 0.0
    for i in range(3, len(t)):
        for k in range(3, -1, -1):
            c = followers.get(t[i - k : i])
            if c:
                n, u = sum(c.values()), len(c)
                if t[i] in c:
                    total -= math.log2(c[t[i]] / (n + u))
                    break
                total -= math.log2(u / (n + u))
        else:
            total += 8
    return total


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abé C.", min_size=1, max_size=30), min_size=1, max_size=4), st.lists(st.text(alphabet="abéxC. 😀", max_size=30), min_size=1, max_size=4))
def test_code_lengths(training, texts):
    training, texts = [t.encode() for t in training], [t.encode() for t in texts]
    got = langid.Scorer([langid.learn(training)]).bits(texts)[:, 0]
    assert np.allclose(got, [plain_bits(training, t) for t in texts])


def test_pieces_and_table_limits(monkeypatch):
    models = [langid.learn([b"some words of a text", b"more"])]
    texts = [bytes(range(32, 127)) * 30, b"", "日本語のテキスト".encode() * 9, b"some"]
    whole = langid.Scorer(models).bits(texts)
    monkeypatch.setattr(langid, "PIECE", 64)
    monkeypatch.setattr(langid, "PAIRS", 20)
    assert np.allclose(langid.Scorer(models).bits(texts), whole)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 1000
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_odd_rows(spark):
    rows = [(i, w * 20, lang, 0) for i, (w, lang) in enumerate([("the ", "en"), ("der ", "de")] * 20)]
    rows += [(100, None, "en", 0), (101, "", "de", 0), (102, "12 !?", None, 0), (None, "the der", "xx", 0), (103, "der " * 200000, None, 0), (103, "the", "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    assert {r.lang_pred for r in got if r.doc_id in (100, 101, 102)} == {"und"}
    assert sorted(r.lang_pred for r in got if r.doc_id == 103) == ["de", "en"]
    assert langid.identify(docs.limit(0)).count() == 0
    assert langid.reject_unknown(docs).columns == docs.columns
    alone = langid.identify(docs.where("lang is null"))
    assert {r.lang_pred for r in alone.collect()} == {"und"}


@pytest.fixture(autouse=True)
def _no_warnings():
    with np.errstate(all="raise", under="ignore"):
        yield


def test_noise_in_a_sample():
    words = [b"the words of this text are alike but not the same " + str(k).encode() for k in range(30)]
    noise = [bytes(np.random.default_rng(k).integers(33, 126, 900, dtype=np.uint8)) for k in range(4)]
    kept, (mean, var) = langid.without_noise(sorted(words + noise))
    assert sorted(kept) == sorted(words) and 0 < mean < 3 and var > 0
    assert langid.without_noise([b"one"]) == ([b"one"], None)


def test_a_language_of_long_texts_alone_is_learned(spark):
    rows = [(k, w * 30_000, lang) for k, (w, lang) in enumerate([("the words ", "en"), ("der satz ", "de")] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.doc_id % 2) for r in langid.identify(docs).collect()} == {("en", 0), ("de", 1)}
