"""Targets and fills of the mix."""

import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import mixing


def levelled(sizes, weights, total):
    """The targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, free = total * sum(sizes.values()), {}, set(names)
    while free:
        unit = left / sum(w[s] for s in free)
        over = {s for s in free if unit * w[s] > 2 * sizes[s]}
        if not over:
            return out | {s: unit * w[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), min_size=1, max_size=8), st.integers(0, 400))
def test_fill_is_as_close_as_subsets_allow_up_to_the_shares(counts, budget):
    sizes, n = list(counts), list(counts.values())
    take = mixing.fit_counts(sizes, n, budget)
    words = sum(s * t for s, t in zip(sizes, take, strict=True))
    have = sum(s * c for s, c in zip(sizes, n, strict=True))
    assert all(0 <= t <= c for t, c in zip(take, n, strict=True)) and words <= budget
    base = [c * budget // have if budget < have else c for c in n]
    sums = {0}
    for s, c, b in zip(sizes, n, base, strict=True):
        sums = {x + s * k for x in sums for k in range(b, c + 1)}
    assert words == max(x for x in sums if x <= budget)


def test_every_stretch_of_lengths_gives_its_share():
    rng = np.random.default_rng(6)
    sizes, counts = (x.tolist() for x in np.unique(rng.lognormal(6, 1.3, 20_000).astype(int) + 1, return_counts=True))
    words = np.array(sizes) * np.array(counts)
    budget = int(words.sum() * 0.3)
    for seed in (1, 2):
        take = mixing.fit_counts(sizes, counts, budget, seed)
        assert take == mixing.fit_counts(sizes, counts, budget, seed)
        got = np.array(sizes) * np.array(take)
        assert got.sum() == budget
        tenth = np.minimum(9, (np.cumsum(words) - 1) * 10 // words.sum())
        for k in range(10):
            assert abs(got[tenth == k].sum() / budget - words[tenth == k].sum() / words.sum()) < 0.02
    rare = [i for i, c in enumerate(counts) if c == 1]
    assert mixing.fit_counts(sizes, counts, budget, 1) != mixing.fit_counts(sizes, counts, budget, 2)
    assert abs(sum(take[i] for i in rare) / len(rare) - 0.3) < 0.05


def test_lengths_with_a_common_factor():
    take = mixing.fit_counts([10, 20, 1_000_000], [50, 50, 3], 1_000_777)
    assert sum(s * t for s, t in zip([10, 20, 1_000_000], take, strict=True)) == 1_000_770


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 5, "o", "z", 9), (2, "c", None, 6, "p", "y", 8)], "doc_id long, text string, source string, bin int, order string, size string, copies int")
    got = mixing.mix(docs, keep=tuple(docs.columns))
    assert got.count() == 2 and {"bin", "order"} <= set(got.columns)


def test_mix(spark):
    texts = [(i, "w " * (1 + i * 7 % 23), ["a", "b", "c", None][i % 4 if i % 3 else 0], "x") for i in range(400)]
    texts += [(900, None, "a", "x"), (901, "", None, "x"), (902, "same words", "b", "x"), (902, "same words", "b", "x"), (None, "no id", "c", "x"), (903, "long " * 300, "b", "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string, size string")
    got = mixing.mix(docs, keep=("source", "text")).toPandas()
    assert len(got) == len(texts)
    again = mixing.mix(docs.repartition(3)).toPandas()
    key = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    got["source"] = [None if x is None or x != x else x for x in got["source"]]
    sizes = {s: sum(len((t or "").split()) for _, t, q, _ in texts if q == s) for s in ("a", "b", "c", None)}
    want = levelled(sizes, (5, 2, 1), 1.5)
    for s, own in itertools.groupby(sorted(got.to_dict("records"), key=lambda r: r["source"] or "~"), key=lambda r: r["source"]):
        own = list(own)
        assert {r["source_size"] for r in own} == {sizes[s]} and all(abs(r["target"] - want[s]) < 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 1
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)
    assert mixing.mix(docs.limit(0)).count() == 0
