"""Near duplicates against all pairs, and the sketch's guarantees."""

import random

import numpy as np
import pytest

from lectern.llm import minhash
from lectern.llm.common import shingles


def plain(rows, width=3):
    """component and set size by doc_id, over all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    label = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def families(seed=2):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{k}" for k in range(3000)]
    for size in (1, 2, 3, 60):
        for _ in range(6):
            base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 300))]
            for _ in range(size):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, len(base) // 18))):
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
                rows.append(" ".join(copy))
    rows += ["a b", "A  B", "b a", "a", "", None, " \n", "x y z", "x y z w"]
    return list(enumerate(rows))


@pytest.mark.parametrize("task_shingles", [minhash.TASK_SHINGLES, 2000])
def test_components(spark, task_shingles):
    rows = families()
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in rows], "doc_id long, text string, fp int, rep string")
    got = minhash.near_duplicates(docs, width=3, num=85, task_shingles=task_shingles).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def templated(seed=8):
    """Pairs of 0.86 to 0.9 in documents that share a template with all others, at about 0.45."""
    rng, rows = random.Random(seed), []
    template = [f"t{k}" for k in range(165)]
    for _ in range(120):
        own = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        for k in range(2):
            copy = template + own
            if k:
                for _ in range(5):
                    copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    return list(enumerate(rows))


def test_pairs_under_leaders_of_a_common_template(spark):
    rows = templated()
    want = plain(rows)
    assert len({c for _, c in want.values()}) < 200
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs, width=3, num=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    sets = [np.unique(pool[a : a + n]) for a, n in ((0, 1), (0, 2), (0, 100), (10, 100), (0, 2000), (200, 2000))]
    s = minhash.sketch(sets)
    assert (s != np.iinfo(np.uint64).max).all()
    for a, b in ((2, 3), (4, 5)):
        true = len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
        assert abs((s[a] == s[b]).mean() - true) < 0.12
    assert (minhash.sketch([sets[2]])[0] == s[2]).all()


def test_shingles():
    assert len(shingles("A b\tC\x0bd")) == 2 and (shingles("A b") == shingles("a  B ")).all()
    assert len(shingles(None)) == 0 and len(shingles("é f")) == 1


def test_nulls_and_repeats(spark):
    big = (1 << 60) + 1
    rows = [(None, "a b c"), (big, "a b c d e"), (big, "a b c d e"), (5, "a b c d e"), (7, None)]
    rows += [(9, "one two three four five six"), (9, "seven eight nine ten eleven twelve"), (12, "seven eight nine ten eleven twelve"), (13, "word " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs).collect()
    nines = sorted((r.doc_id, r.component_id) for r in got if r.doc_id in (9, 12, 13))
    assert nines == [(9, 9), (9, 9), (12, 9), (13, 13)]
    got = [r for r in got if r.doc_id not in (9, 12, 13)]
    by = sorted((r.doc_id or 0, r.component_id, r.kept) for r in got)
    assert by == [(0, None, False), (5, 5, True), (7, 7, True), (big, 5, False), (big, 5, False)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
