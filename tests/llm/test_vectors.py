"""Vector operators against brute force."""

import math

import numpy as np
import pytest

from lectern.llm import ann, embed_dedup

SF = "/root/testdata/sf0.1"


def planted(seed=1):
    """Clusters of near copies, exact copies and noise."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((700, 24))
    x[100:160] = x[0] + 0.1 * rng.standard_normal((60, 24))
    x[160:300] = x[1] + 0.16 * rng.standard_normal((140, 24))
    x[300:320] = x[2]
    x[320:330] = 3 * x[3]
    return x.astype("f4")


def components(link):
    label = np.arange(len(link))
    while True:
        low = np.where(link, label[None, :], len(link)).min(axis=1)
        new = np.minimum(label, low)
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("chunk", [1024, 16])
def test_near_duplicates(spark, chunk):
    x = planted()
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(x)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, weight int")
    got = embed_dedup.near_duplicates(docs, chunk=chunk, miss=1e-6).toPandas().sort_values("vec_id")
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    assert (got.n_links.to_numpy() == link.sum(axis=1)).all()
    assert (got.component_id.to_numpy() == components(link)).all()
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    turn = embed_dedup.rotations(64, 1)[0]
    x, y = rng.standard_normal((2, 4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.2 * y / np.linalg.norm(y, axis=1, keepdims=True)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    code = np.where(x @ turn.T > 0, 1, -1) / 8
    f = (code * (x @ turn.T)).sum(axis=1)
    estimate = (code * (y @ turn.T)).sum(axis=1) / f
    true = (x * y).sum(axis=1)
    error = embed_dedup.SIGMAS * np.sqrt((1 - f * f) / f**2 / 63)
    assert abs((estimate - true).mean()) < 0.005 and (np.abs(estimate - true) <= error).mean() > 0.999


def test_four_bits_estimate_without_bias():
    shape = embed_dedup.Shape(64, 8, 4, 0.95)
    turns = embed_dedup.rotations(64, shape.turns)
    rng = np.random.default_rng(2)
    x, y = (embed_dedup.unit(rng.standard_normal((6000, 64))) for _ in range(2))
    y = embed_dedup.unit(x + 0.3 * y)
    a, b = (embed_dedup.stored(v, turns, shape, 1) for v in (x, y))
    code, planes = embed_dedup.words(a["bits"])[:, :1], embed_dedup.words(b["planes"])
    got = embed_dedup.estimate(code, a["factor"], planes, b["low"], b["step"], 64)
    true = (x * y).sum(axis=1)
    f = a["factor"]
    error = embed_dedup.SIGMAS * np.sqrt((1 - f * f) / f**2 / 63 + (b["step"] / f / 2) ** 2)
    assert abs((got - true).mean()) < 0.005 and (np.abs(got - true) <= error).mean() > 0.999


def at_the_threshold(dims, pairs, noise, seed=7):
    """Unrelated vectors, and pairs whose cosine is a little above the threshold."""
    rng = np.random.default_rng(seed)
    x, e = (embed_dedup.unit(rng.standard_normal((pairs, dims))) for _ in range(2))
    e = embed_dedup.unit(e - (e * x).sum(axis=1, keepdims=True) * x)
    y = 0.951 * x + math.sqrt(1 - 0.951**2) * e
    return np.concatenate([x, y, rng.standard_normal((noise, dims))]).astype("f4")


@pytest.mark.parametrize("dims", [64, 100])
def test_recall_of_links_at_the_shipped_settings(spark, dims):
    x = at_the_threshold(dims, 1500, 3000)
    docs = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = embed_dedup.near_duplicates(docs).toPandas().set_index("vec_id")
    assert (got.n_links.loc[3000:] == 0).all() and got.n_links.max() == 1
    assert got.n_links.loc[:2999].sum() >= 0.97 * 3000


def odd(spark):
    nan, inf = math.nan, math.inf
    rows = [(100, [1.0, 0.0]), (200, None), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [inf, 1.0]), (600, [1.0, None]), (700, []), (None, [1.0, 0.0]), (800, [1.0, 0.0, 0.0]), (900, [2.0, 0.0]), (101, [1.0, 0.001]), (101, [0.0, 1.0])]
    return spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, rank int, keys int")


def test_odd_vectors(spark):
    got = {(r.vec_id, r.n_links): r for r in embed_dedup.near_duplicates(odd(spark)).collect()}
    assert len(got) == 11 and all((i, 0) in got for i in (200, 300, 400, 500, 600, 700, 800, None))
    assert got[None, 0].component_id is None and not got[None, 0].kept
    assert got[100, 2].component_id == got[900, 2].component_id == 100
    assert embed_dedup.near_duplicates(odd(spark).limit(0)).count() == 0
    assert embed_dedup.near_duplicates(odd(spark).where("vec_id = 200")).count() == 1


def test_odd_neighbours(spark):
    d = odd(spark)
    got = ann.nearest(d, d.where("vec_id % 100 = 0")).collect()
    by = {q: [(r.vec_id, r.rank) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (100, 800, 900)}
    assert by == {100: [(101, 1), (900, 2)], 800: [], 900: [(100, 1), (101, 2)]}
    assert {r.query_id for r in got} == {100, 900}
    assert ann.nearest(d.limit(0), d.limit(0)).count() == 0


@pytest.mark.parametrize("block", [8192, 300])
def test_recall(spark, block):
    d = spark.read.parquet(f"{SF}/embeddings.parquet")
    p = d.toPandas()
    x, ids = np.array(list(p.embedding), dtype="f8"), p.vec_id.to_numpy()
    got = ann.nearest(d, d.where("vec_id % 100 = 0"), block=block).toPandas()
    hits = 0
    for q in ids[ids % 100 == 0]:
        dist = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        dist[ids == q] = np.inf
        best = np.lexsort((ids, dist))[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert np.allclose(own.score, [dist[ids == v][0] for v in own.vec_id], rtol=1e-12)
        hits += len(set(ids[best]) & set(own.vec_id))
    assert hits >= 0.95 * len(got)


def test_few_vectors_are_verified():
    """Of 8192 vectors in 64 dimensions, spread like the driver's, a search computes less than a tenth of the distances."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((8192, 64))
    index, hits = ann.Index(np.arange(8192), x), 0
    for q in range(30):
        v = x[q]
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.argsort(d)[:10]
        got = index.search(q, v, 10, float(d[best[-1]]) * 1.05)
        hits += len({i for _, i in got} & set(best.tolist()))
    assert hits >= 0.9 * 300
    assert index.verified < 0.1 * 30 * 8192
