"""Trie-shared counts against a dynamic program for each pre-token alone."""

import public_tokenizers as P
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from lectern.llm import bpe, token_counts

PATH = P.path("byte_bpe_50k.tiktoken")
COUNTER = token_counts.Counter.of(PATH, P.PATTERN)
COST = token_counts.scores(bpe.read_ranks(PATH))


def alone(p):
    best = [(0, 0)]
    for end in range(1, len(p) + 1):
        best.append(min((best[a][0] + COST[p[a:end]], best[a][1] + 1) for a in range(end) if p[a:end] in COST))
    return best[-1][1]


def whole(text):
    parts = [m.encode() for m in regex.findall(P.PATTERN, text)]
    return len(parts), sum(map(alone, parts))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="then a \n'sé1", max_size=60)), max_size=5))
def test_counts(texts):
    assert COUNTER.count(texts) == [whole(t) for t in texts]


def test_shared_prefixes():
    words = [b"the", b"then", b"thence", b"there", b"a", b"ab", b"abstraction", b"abstractions"]
    assert COUNTER.terminal_counts(words) == {w: alone(w) for w in words}


def test_table(spark):
    rows = [(1, "The cat sat.", 1), (1, "The cat sat.", 1), (None, "x", 2), (2, None, 3), (3, "", 4), (4, "word " * 50000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = token_counts.count_tokens(docs, PATH, P.PATTERN).collect()
    assert sorted(map(str, got)) == sorted(str(expected(r)) for r in rows)
    assert token_counts.count_tokens(docs.limit(0), PATH, P.PATTERN).count() == 0


def expected(r):
    a, b = whole(r[1] or "")
    return Row(doc_id=r[0], n_pretokens=a, n_tokens=b)
