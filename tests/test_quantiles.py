"""Distributed quantiles and places against numpy and plain sorting."""

import random

import numpy as np
from pyspark.sql import functions as F

from curatrix.operators import frequency, stats


def test_quantiles(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 1.0, 1.0, 2.0, -3.5, r.uniform(-9, 9)])) for _ in range(400)] + [("hot", float(k % 7)) for k in range(2000)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "`g.x` string, `v.x` double").repartition(6)
    probs = {"p0": 0.0, "p5": 0.05, "q1": 0.25, "mid": 0.5, "p99": 0.99, "p100": 1.0}
    out = {x["g.x"]: x for x in frequency.quantiles(df, ["g.x"], "v.x", probs).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(out) == set(groups)
    for g, values in groups.items():
        assert np.allclose([out[g][n] for n in probs], np.quantile(values, list(probs.values())))
    everything = frequency.quantiles(df, [], "v.x", {"mid": 0.5}).collect()
    assert np.isclose(everything[0]["mid"], np.quantile([v for _, v in rows if v is not None], 0.5))
    assert frequency.quantiles(df.limit(0), [], "v.x", {"mid": 0.5}).count() == 0
    assert [tuple(x) for x in frequency.quantiles(df.limit(0), [], "v.x", {"mid": 0.5}, empty=True).collect()] == [(None,)]


def test_profile_keeps_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), ("b", None)], "l string, x double")
    out = {r["l"]: (r["n"], r["median"]) for r in stats.quantile_profile(df, "l", "x").collect()}
    assert out == {"a": (2, 2.0), None: (1, 5.0), "b": (0, None)}
    box = {r["label"]: (r["q1"], r["median"], r["low"], r["high"]) for r in stats.box_stats(df, "l", "x").collect()}
    assert box == {"a": (1.5, 2.0, 1.0, 3.0), None: (5.0, 5.0, 5.0, 5.0), "b": (None, None, None, None)}


def test_places(spark):
    rows = [(g, k * 37 % 101) for g in ("a", None) for k in range(300)] + [("hot", k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, x long").withColumn("i", F.monotonically_increasing_id()).repartition(7)
    out = frequency.ranked(df, "g", [-F.col("x"), F.col("i")], "place").collect()
    assert len(out) == len(rows)
    for g in ("a", None, "hot"):
        mine = sorted((r for r in out if r["g"] == g), key=lambda r: (-r["x"], r["i"]))
        assert [r["place"] for r in mine] == list(range(1, len(mine) + 1))
