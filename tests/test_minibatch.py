"""Mini-batch k-means: inertia against full k-means, the same result over any partitioning, and odd tables."""

import numpy as np
import pytest

from curatrix import catalog
from curatrix.operators import minibatch, vectors


def inertia(x: dict, labels: dict) -> float:
    out = 0.0
    for c in set(labels.values()):
        own = np.array([x[i] for i in labels if labels[i] == c])
        out += ((own - own.mean(0)) ** 2).sum()
    return out


def planted(rows=1200, groups=6, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dims)) * 5
    at = rng.integers(0, groups, rows)
    return at, middles[at] + rng.normal(size=(rows, dims))


def table(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")


def test_finds_planted_clusters_as_full_k_means_does(spark):
    at, x = planted()
    df = table(spark, x)
    got = {r[0]: r[1] for r in minibatch.minibatch_kmeans(df, "id", 6).collect()}
    full = {r[0]: r[1] for r in vectors.kmeans(df, "id", 6).collect()}
    assert len(got) == len(x)
    assert inertia(dict(enumerate(x)), got) <= 1.05 * inertia(dict(enumerate(x)), full)
    # A planted group is one cluster and the other way round.
    assert len({(a, got[i]) for i, a in enumerate(at.tolist())}) == 6


def test_given_vectors_as_full_k_means_does(spark, sf):
    df = catalog.vecs(spark, sf).select("vec_id", "v").filter("v IS NOT NULL")
    x = {r[0]: np.array(r[1], float) for r in df.collect()}
    got = {r[0]: r[1] for r in catalog.QUERIES["minibatch_kmeans"](spark, sf).collect()}
    full = {r[0]: r[1] for r in vectors.kmeans(df, "vec_id", 5).collect()}
    assert set(got) == set(x)
    assert inertia(x, got) <= 1.05 * inertia(x, full)


def test_same_result_over_any_partitioning(spark):
    _, x = planted(600, 5, 6, 9)
    df = table(spark, x)
    one, other = ({tuple(r) for r in minibatch.minibatch_kmeans(df.repartition(n), "id", 7, epochs=1).collect()} for n in (1, 7))
    assert one == other


def test_each_row_is_in_one_batch_of_an_epoch(spark, monkeypatch):
    _, x = planted(300, 3, 4)
    seen, plain = [], minibatch._batch_sums
    monkeypatch.setattr(minibatch, "_batch_sums", lambda *a: (seen.append(plain(*a)), seen[-1])[1])
    minibatch.fit(table(spark, x), "id", 3, epochs=1)
    assert len(seen) == 10 and sum(n.sum() for n, _ in seen) == 300
    assert np.allclose(sum(s.sum(0) for _, s in seen) * np.abs(x).max(), x.sum(0), atol=1e-4)


@pytest.mark.parametrize("k", [1, 2, 5])
def test_odd_vectors_copies_and_few_rows(spark, k):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, None), (5, [inf, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, []), (None, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = [tuple(r) for r in minibatch.minibatch_kmeans(df, "id", k).collect()]
    by = dict(got)
    assert sorted(map(str, (i for i, _ in got))) == sorted(str(r[0]) for r in rows)
    assert all(by[i] is None for i in (4, 5, 6, 7, 8, 9))
    assert by[1] == by[2] and by[3] == by[None] and (by[1] != by[3]) == (k > 1)


def test_empty_and_unusable_tables(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    assert minibatch.minibatch_kmeans(none, "id", 3).collect() == []
    bad = spark.createDataFrame([(1, None), (2, [None])], "id long, v array<double>")
    assert {tuple(r) for r in minibatch.minibatch_kmeans(bad, "id", 3).collect()} == {(1, None), (2, None)}
    zero = spark.createDataFrame([(1, [0.0]), (2, [0.0])], "id long, v array<double>")
    assert {tuple(r) for r in minibatch.minibatch_kmeans(zero, "id", 3).collect()} == {(1, 0), (2, 0)}
