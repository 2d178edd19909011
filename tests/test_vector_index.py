"""The kept vector index and the graph operators against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import graph
from curatrix.operators.vector_index import VectorIndex
from curatrix.operators.written import new_folder


def clustered(n=900, dims=16, k=12, seed=1):
    r = np.random.default_rng(seed)
    c = r.standard_normal((k, dims))
    x = c[r.integers(0, k, n)] + 0.25 * r.standard_normal((n, dims))
    x[n // 2 : n // 2 + 40] = x[0]  # copies
    return x


@pytest.fixture(scope="module")
def table(spark):
    x = clustered()
    rows = [(f"k{i:04d}", [float(v) for v in x[i]]) for i in range(len(x))]
    odd = [("null", None), ("empty", []), ("zero", [0.0] * 16), ("short", [1.0, 2.0]), ("holes", [1.0, None] * 8), ("nan", [float("nan")] * 16), ("inf", [float("inf")] + [0.0] * 15), (None, [1.0] * 16)]
    return x, spark.createDataFrame(rows + odd, "`the.key` string, `a vec` array<double>").repartition(5)


@pytest.fixture(scope="module")
def index(spark, table):
    return VectorIndex.create(table[1], new_folder(spark), "the.key", "a vec")


def cosines(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.round(u @ u.T, 9)


def test_exact_search_is_brute_force(spark, table, index):
    x, df = table
    s = cosines(x)
    asked = df.filter(F.substring(F.col("`the.key`"), -2, 2) == "00")
    out = index.search(asked, 7, "the.key", "a vec", probes=1, exact=True).collect()
    want = [(f"k{i:04d}", rank, f"k{j:04d}") for i in range(0, len(x), 100) for rank, j in enumerate(sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], j))[:7], 1)]
    assert sorted((r["query"], r["rank"], r["key"]) for r in out) == want
    outside = spark.createDataFrame([("q", [1.0] * 16)], "k string, v array<double>")
    assert index.search(outside, 2000, "k", "v", probes=2, exact=True).count() == len(x)


def test_recall_with_few_probes(spark, table, index, sf):
    x, df = table
    assert len(index.centres) == 30
    assert index.recall(df, 10, "the.key", "a vec", probes=4) >= 0.9
    given = spark.read.parquet(f"{sf}/embeddings.parquet")  # without structure: most lists have to be probed
    own = VectorIndex.create(given, new_folder(spark), "vec_id", "embedding")
    assert own.recall(given, 10, "vec_id", "embedding", probes=int(0.8 * len(own.centres))) >= 0.9


@pytest.mark.parametrize("threshold, rows", [(0.97, 8_000), (0.97, 20), (0.5, 100), (-0.2, 50)])
def test_near_pairs_are_all_pairs(table, index, monkeypatch, threshold, rows):
    """Also with groups of few rows, where copies fill several groups."""
    monkeypatch.setattr(VectorIndex.groups, "__defaults__", (rows,))
    x, _ = table
    s = cosines(x)
    want = {(f"k{i:04d}", f"k{j:04d}") for i, j in zip(*np.nonzero(np.triu(s > threshold, 1)))}
    out = [(r["a"], r["b"]) for r in index.near_pairs(threshold).select("a", "b").collect()]
    assert len(out) == len(set(out)) and set(out) == want


def test_near_pairs_leave_lists_out(index):
    """At a high threshold the bounds rule out most pairs of lists."""
    radii, centres = index.radii(), index.centres
    angle = np.arccos(np.clip(centres @ centres.T, -1, 1))
    assert np.mean(angle > radii[:, None] + radii[None] + np.arccos(0.97)) > 0.5


def test_deduplicated_is_greedy(table, index):
    x, _ = table
    s = cosines(x)
    kept = []
    for i in range(len(x)):
        if not any(s[i, j] > 0.95 for j in kept):
            kept.append(i)
    assert sorted(r["key"] for r in index.deduplicated(0.95).collect()) == [f"k{i:04d}" for i in kept]


def test_batches_are_kept_apart(spark, table):
    x, df = table
    folder = new_folder(spark)
    first = df.filter(F.col("`the.key`") < "k0300")
    index = VectorIndex.create(first, folder, "the.key", "a vec")
    assert index.batches() == 1 and index.rows().count() == 300
    assert index.add(df.filter(F.col("`the.key`") < "k0500").unionByName(df.filter(F.col("`the.key`") < "k0310")), "the.key", "a vec") == 2
    assert VectorIndex(spark, folder).rows().count() == 500 == index.rows().select("key").distinct().count()
    old = index.at(1)
    assert old.rows().count() == 300
    with pytest.raises(ValueError):
        old.add(df, "the.key", "a vec")
    q = df.filter(F.col("`the.key`") == "k0700")
    s = cosines(x)[700]
    for view, n in ((old, 300), (index, 500)):
        got = [r["key"] for r in view.search(q, 3, "the.key", "a vec", exact=True).orderBy("rank").collect()]
        assert got == [f"k{j:04d}" for j in sorted(range(n), key=lambda j: (-s[j], j))[:3]]


def test_an_index_of_nothing(spark, table):
    _, df = table
    index = VectorIndex.create(df.limit(0), new_folder(spark), "the.key", "a vec")
    assert index.rows().count() == 0 and index.near_pairs(0.5).count() == 0 and index.deduplicated().count() == 0
    assert index.search(df, 3, "the.key", "a vec", exact=True).count() == 0


def roots(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_connected(spark):
    r = random.Random(4)
    n = 300
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(170)] + [(i, i + 1) for i in range(200, 280)] + [(5, k) for k in range(100, 130)] + [(7, 7)]
    want = roots(n, edges)
    out = {x["node"]: x["comp"] for x in graph.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {v for a, b in edges if a != b for v in (a, b)}
    assert out == {v: want[v] for v in touched}
    assert graph.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dropped_in_order(spark):
    r = random.Random(5)
    edges = sorted({tuple(sorted(r.sample(range(80), 2))) for _ in range(120)} | {(i, i + 1) for i in range(100, 130)})
    gone = set()
    for a, b in edges:
        if a not in gone:
            gone.add(b)
    df = spark.createDataFrame(edges + edges[:9], "a long, b long")
    for local in (1_000_000, 20, 0):
        assert {x["k"] for x in graph.dropped_in_order(df, local).collect()} == gone
