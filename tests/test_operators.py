"""Planted cases of joins, sampling, statistics, audits, clustering and validators."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix import catalog
from curatrix.operators import audit, frequency, relational, sampling, stats, validators, vectors
from curatrix.plans import pipelines
from curatrix.streaming import rows as streaming

QA = [
    [("Python的优点有哪些？", "Python简单易学，应用广泛"), ("什么是人工智能？", "人工智能是计算机科学的一个分支"), ("机器学习是什么？", "机器学习是AI的一个子领域"), ("什么是深度学习？", "同")],
    [("什么是人工智能 ？", "人工智能是模拟人类智能的技术"), ("机器学习是什么？", "机器学习是AI的一个子领域")],
    [("Python的优点有哪些？", "Python语法简洁，库丰富"), ("什么是\n人工智能？", "人工智能让机器具有智能")],
    [("机器学习是什么？", "机器学习通过数据训练模型")],
    [("Python的优点有哪些？", "Python简单易学，应用广泛"), ("什么是深度学习？", "同")],
]


def test_conflicts(spark):
    data = [(k * 10 + i, q, a, f"test_file{k + 1}.xlsx") for k, rows in enumerate(QA) for i, (q, a) in enumerate(rows)]
    df = spark.createDataFrame(data, "ord int, question string, answer string, source string")
    out = relational.conflicts(df).orderBy("group_no", "answer").collect()
    assert [(r.group_no, r.n_answers) for r in out] == [(1, 2)] * 2 + [(2, 3)] * 3 + [(3, 2)] * 2
    assert {(r.answer, r.sources, r.n_rows) for r in out if r.group_no == 1} == {("Python简单易学，应用广泛", "test_file1.xlsx, test_file5.xlsx", 2), ("Python语法简洁，库丰富", "test_file3.xlsx", 1)}


def test_allocation_example(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 90)], "stratum string, size long")
    assert {r.stratum: r.quota for r in sampling.allocation(sizes, 40, "hybrid", 5).collect()} == {"a": 10, "b": 30}
    with pytest.raises(ValueError):
        sampling.allocation(sizes, 40, "other")


def test_ratio_floors(spark):
    df = spark.createDataFrame([(i, "a" if i < 7 else "b" if i < 10 else "c") for i in range(11)], "id int, l string")
    assert {r.l: r["count"] for r in sampling.ratio_sample(df, 10, "l", "id").groupBy("l").count().collect()} == {"a": 6, "b": 2}
    assert sampling.ratio_sample(df, 100, "l", "id").count() == 11


def test_draws_ignore_partitioning(spark):
    df = spark.range(500).withColumn("w", F.col("id") + 1)
    a = sampling.weighted_sample(df, 50, "id", F.col("w")).select("id").collect()
    b = sampling.weighted_sample(df.repartition(7), 50, "id", F.col("w")).select("id").collect()
    assert sorted(a) == sorted(b) and len(set(a)) == 50
    s = sampling.stratified_sample(df.withColumn("g", F.col("id") % 3), 30, "g", "id", "balanced")
    assert s.count() == 30 and s.select("id").distinct().count() == 30


def test_anti_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (3, "y")], "id int, s string")
    assert sorted(r.id for r in relational.exclude(a, spark.createDataFrame([("x",), (None,)], "s string"), "s").collect()) == [2, 3, 3]
    b = spark.createDataFrame([(2, None), (3, "y")], "id int, s string")
    assert [r.id for r in relational.exclude_rows(a, b).collect()] == [1]


def test_locate_and_merge(spark):
    q = spark.createDataFrame([(1, "A b"), (2, "none"), (3, " ")], "seq int, question string")
    s = spark.createDataFrame([("f1", 0, 2, "ab", "x"), ("f2", 1, 2, "a B", "y")], "file string, file_ord int, row_no int, question string, answer string")
    assert sorted((r.seq, r.file) for r in relational.locate(q, s).collect()) == [(1, "f1"), (1, "f2"), (2, "未找到")]
    m = lambda rows: spark.createDataFrame(rows, "msg string, frequency int, ord int")
    out = relational.merge_and_filter(m([("a", 5, 1)]), m([("a", 1, 2), ("b", 9, 3)]), m([("c", 1, 4), ("d", 2, 5)]), m([("b", 1, 0)]))
    assert sorted(r.msg for r in out.collect()) == ["a", "c"]


def test_annotators(spark):
    r = spark.createDataFrame([("r1", 0, "u1", "submitted", "label", "A"), ("r1", 1, "u2", "submitted", "label", "B"), ("r2", 0, "u1", "submitted", "label", "A"), ("r2", 1, "u1", "submitted", "label", "B"), ("r3", 0, "u1", "draft", "label", "A"), ("r3", 1, "u2", "submitted", "label", "<B>")], "id string, pos int, user_id string, status string, question_name string, value string")
    c = relational.annotator_conflicts(r)
    assert [x.id for x in c.collect()] == ["r1"]
    cards = relational.conflict_cards(c, r, spark.createDataFrame([("u1", "Ann & Co")], "user_id string, name string")).collect()
    assert cards[0].card == "<ul><li>Ann &amp; Co: A</li><li>u2: B</li></ul>"


def test_splits(spark):
    pool = spark.createDataFrame([(i, f"t{i}", "ab"[i % 2]) for i in range(100)], "id int, text string, label string")
    base = spark.createDataFrame([(1000, "base", "a")], "id int, text string, label string")
    parts = relational.split_tables(base, pool, "label", "id", 30, 1 / 3)
    assert {k: v.count() for k, v in parts.items()} == {"train": 71, "val": 20, "test": 10}
    assert relational.leakage(*(parts[k].select("text", "label") for k in ("train", "val", "test"))).filter("NOT clean").count() == 0
    x = sampling.stratified_split(pool, "label", "id", {"test": 0.1, "train": 0.9})
    assert x.groupBy("split").count().orderBy("split").collect()[0]["count"] == 10


def test_fanout(spark):
    df = spark.createDataFrame([("产品名称：N 产品代码：C", '1:{"questions":["q1","q2"]}')], "a string, b string")
    assert [r.question for r in relational.product_rows(df, "a", "b").orderBy("pos").collect()] == ["N", "C", "q1", "q2"]
    df = spark.createDataFrame([("s", "a|0||b"), ("t", None)], "`标问` string, `相似问` string")
    assert [r.question for r in relational.similar_questions(df).orderBy("standard", "pos").collect()] == ["s", "a", "b", "t"]


def test_chunks(spark):
    df = spark.range(2500)
    assert [r["count"] for r in frequency.chunked(df, ["id"], 1000).groupBy("chunk_id").count().orderBy("chunk_id").collect()] == [1000, 1000, 500]


def test_percentiles_and_entropy(spark):
    df = spark.createDataFrame([(v, "a") for v in (1.0, 2.0, 4.0, 8.0)], "v double, l string")
    r = stats.quantile_profile(df, "l", "v").collect()[0]
    assert (r.p5, r.p25, r.median, r.p95) == pytest.approx((1.15, 1.75, 3.0, 7.4))
    two = spark.createDataFrame([(i % 2,) for i in range(10)], "c int")
    assert stats.cluster_sizes(two, "c").collect()[0].normalized_entropy == pytest.approx(1)
    assert stats.cluster_sizes(two.filter("c = 0"), "c").collect()[0].normalized_entropy == 0


def test_correlation_p_value(spark):
    # r = 0.5 of 10 pairs: t = 1.6330, two-sided p = 0.1411 (tables of Student's t)
    assert stats.p_value(0.5, 10) == pytest.approx(0.1411, abs=1e-4)
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(20)], "a double, b double")
    assert stats.correlations(df, "a", "b").collect()[0].spearman == pytest.approx(1)


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "t int, g int")
    r = stats.summary_metrics(df, "t", "g").collect()[0]
    assert r.accuracy == 0.75 and r.macro_recall == pytest.approx(0.75) and r.weighted_precision == pytest.approx((2 * 1 + 2 * 2 / 3) / 4)


def test_label_issues_by_hand(spark):
    rows = [(i, 0, [0.9, 0.1]) for i in range(8)] + [(8, 0, [0.05, 0.95])] + [(9 + i, 1, [0.1, 0.9]) for i in range(8)]
    out = audit.label_issues(spark.createDataFrame(rows, "id int, label int, probs array<double>"), "id").filter("is_issue").collect()
    assert [r.id for r in out] == [8]


def test_energy_search(spark):
    df = spark.createDataFrame([(float(i), i >= 50) for i in range(100)], "energy double, is_ood boolean")
    b = audit.best_threshold(audit.energy_search(df)).collect()[0]
    assert b.score == pytest.approx(2) and b.threshold == pytest.approx(50)


def blobs(spark, noise=0):
    rng = np.random.default_rng(0)
    c = np.eye(3) * 5
    v = np.concatenate([c[i] + rng.normal(0, 0.2, (30, 3)) for i in range(3)])
    return spark.createDataFrame([(i, x.tolist(), i // 30) for i, x in enumerate(v)], "id int, v array<double>, truth int")


@pytest.mark.parametrize("method", ["kmeans", "agglomerative", "hdbscan", "hybrid"])
def test_clusterings_find_blobs(spark, method):
    df = blobs(spark)
    out = df.join(vectors.fit_predict(df, "id", method, 3), "id")
    assert out.select("truth", "cluster").distinct().count() == 3


def greedy_linkage(x, k):
    """Average linkage by its definition: the two clusters of the least mean distance meet."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    parts = [[i] for i in range(len(x))]
    while len(parts) > k:
        mean = lambda p: d[np.ix_(parts[p[0]], parts[p[1]])].mean()
        i, j = min(((i, j) for j in range(len(parts)) for i in range(j)), key=mean)
        parts[i] += parts.pop(j)
    return {frozenset(p) for p in parts}


def groups_of(rows):
    out = collections.defaultdict(set)
    for r in rows:
        out[r.cluster].add(r.id)
    return {frozenset(p) for p in out.values()}


def test_agglomerative_links_all_rows(spark, monkeypatch):
    x = np.random.default_rng(8).normal(0, 1, (60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartition(3)
    want = greedy_linkage(x, 5)
    monkeypatch.setattr(vectors, "kmeans", lambda *a, **b: pytest.fail("centres instead of rows"))
    assert groups_of(vectors.agglomerative(df, "id", 5).collect()) == want
    assert groups_of(vectors.fit_predict(df, "id", "agglomerative", 5).collect()) == want


def test_agglomerative_centres_follow_k(spark, monkeypatch):
    seen, plain = [], vectors.kmeans
    monkeypatch.setattr(vectors, "kmeans", lambda df, key, k, *a: (seen.append(k), plain(df, key, k, *a))[1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(9).normal(0, 1, (80, 4)))], "id int, v array<double>")
    assert len(groups_of(vectors.agglomerative(df, "id", 3, direct=60).collect())) == 3
    assert len(groups_of(vectors.agglomerative(df, "id", 55, direct=60).collect())) > 40
    assert seen == [30, 55]


def test_density_clusters_of_any_size(spark):
    rng = np.random.default_rng(3)
    c = rng.normal(0, 1, (6, 8))
    x = np.concatenate([c[i] + rng.normal(0, 0.15, (110, 8)) for i in range(6)] + [rng.normal(0, 1, (90, 8)), np.tile(c[0], (40, 1))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartition(3)
    want = vectors.hdbscan(x)
    ids, edges = vectors.spanning_edges(df, "id", block=128, near=8)
    assert ids == list(range(len(x))) and len(edges) == len(x) - 1
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.maximum(1 - u @ u.T, 0)
    core = np.sort(d, axis=1)[:, 5]
    d = np.maximum(np.maximum(core[:, None], core[None]), d)
    near, total, done = d[0].copy(), 0.0, {0}
    while len(done) < len(x):
        near[list(done)] = np.inf
        i = int(near.argmin())
        total, near = total + near[i], np.minimum(near, d[i])
        done.add(i)
    assert sum(e[0] for e in edges) == pytest.approx(total)
    out = {r.id: r.cluster for r in vectors.density_clusters(df, "id", most=100).collect()}
    # Names aside the same clusters; a row that two clusters reach at one height may fall to either.
    pairs = collections.Counter((int(w), out[i]) for i, w in enumerate(want))
    same = [p for p, count in pairs.items() if count > 3]
    assert len(set(want)) > 3 and len(same) == len(set(want)) == len({b for _, b in same}) and (-1, -1) in same
    with pytest.raises(ValueError):
        vectors.density_clusters(df, "id", limit=100)


def test_later_scans_send_only_rows_in_need(spark, monkeypatch):
    x = np.random.default_rng(4).normal(0, 1, (600, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    sent, frame = [], type(df)
    plain = frame.crossJoin
    monkeypatch.setattr(frame, "crossJoin", lambda self, other: (sent.append(self.agg(F.sum(F.length("u"))).first()[0]), plain(self, other))[1])
    assert len(vectors.spanning_edges(df, "id", block=64, near=8)[1]) == len(x) - 1
    assert len(sent) > 1 and min(sent[1:]) < sent[0]


def test_hdbscan_keeps_its_method_above_the_bound(spark, monkeypatch):
    monkeypatch.setattr(vectors, "kmeans", lambda *a, **b: pytest.fail("k-means instead of density clusters"))
    n = vectors.BOUNDED + 100
    angle = np.random.default_rng(5).normal(0, 0.02, n) + np.arange(n) % 2 * np.pi / 2
    df = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angle)], "id int, v array<double>")
    out = vectors.fit_predict(df, "id", "hdbscan", 5, min_cluster_size=1000)
    assert {(r.id % 2, r.cluster) for r in out.select("id", "cluster").collect()} in ({(0, 0), (1, 1)}, {(0, 1), (1, 0)})


def test_near_duplicates_and_greedy(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [1.0, 0.02]), (3, [0.0, 1.0])], "id int, v array<double>")
    exact = vectors.near_pairs(df, "id", threshold=0.99995, bits=0)
    assert sorted((r.a, r.b) for r in exact.collect()) == [(0, 1), (1, 2)]
    # 0 stays, 1 goes, so 2 has no kept neighbour before it
    assert sorted(r.id for r in vectors.greedy_kept(df.select("id"), exact, "id").collect()) == [0, 2, 3]
    assert vectors.near_pairs(df, "id", threshold=0.99).count() == 3


def test_greedy_follows_long_chains(spark):
    n = 120  # two keys are settled a round
    ids = spark.range(n).withColumnRenamed("id", "k")
    pairs = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert sorted(r.k for r in vectors.greedy_kept(ids, pairs, "k").collect()) == list(range(0, n, 2))
    assert vectors.greedy_kept(ids, pairs.limit(0), "k").count() == n


def test_validators(spark):
    df = spark.createDataFrame([(f"text {i}", 0.9, i % 10) for i in range(100)], "text string, quality_score double, cluster_id int")
    checks = validators.sampling_checks(df, 12)
    assert {r["name"]: r.status for r in checks.collect()} == {"sample_size": "WARN", "cluster_coverage": "FAIL", "diversity": "PASS", "mean_quality": "PASS", "cluster_balance": "PASS", "integrity": "PASS"}
    assert validators.overall(checks).collect()[0].overall_status == "ACCEPTABLE"
    s = spark.createDataFrame([(0.96, 0.9, 0.7, 20000)], "coverage double, entropy double, quality double, n int")
    assert [r.code for r in validators.recommendations(s).orderBy("pos").collect()][:5] == ["coverage_good", "diversity_good", "quality_good", "size_good", "ready_to_label"]
    assert "rows: 100" in validators.text_report(df)
    doc = validators.statistics_document(df, df, df, df).collect()[0]
    assert doc.pipeline_stats.after_dedup == 100


def test_training_format(spark):
    df = spark.createDataFrame([(1, "q", "拒识"), (2, "q", "寿险相关"), (3, "r", ""), (4, "s", "其它"), (5, "t", None)], "original_index int, text string, label string")
    assert [tuple(r) for r in pipelines.training_format(df).collect()] == [("q", "其他")]


def test_stream_of_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"text": "定期寿险  好吗？"}\n{"text": "a"}\n')
    s = spark.readStream.schema("text string").json(str(tmp_path / "in"))
    q = streaming.curated(s).writeStream.format("memory").queryName("curated").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert [r.text for r in spark.sql("SELECT * FROM curated").collect()] == ["定期寿险 好吗？"]


def test_silhouette_query_takes_a_thousand_rows(spark, tmp_path):
    x = np.random.default_rng(4).normal(0, 1, (600, 64))
    c = np.arange(600) % 3
    x += c[:, None] * 0.2
    rows = [(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(c, x))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0))
    mean = np.stack([d[:, c == k].sum(1) / ((c == k).sum() - (c == k)) for k in range(3)], 1)
    a = mean[np.arange(600), c]
    mean[np.arange(600), c] = np.inf
    b = mean.min(1)
    got = catalog.QUERIES["silhouette_1000"](spark, str(tmp_path)).collect()[0].silhouette
    assert got == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=2e-6)


def test_tfidf_query_has_the_whole_vocabulary(spark, tmp_path):
    # 5,100 terms in two documents each of three: 5,000 are taken
    words = [f"w{i:04d}" for i in range(5100)]
    docs = [(0, " ".join(words)), (1, " ".join(words[:2550])), (2, " ".join(words[2550:]))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = catalog.QUERIES["tfidf"](spark, str(tmp_path)).collect()
    assert {r.term for r in out} == set(words[:5000])
    assert {r.weight for r in out if r.doc_id == 1} == {round(2550**-0.5, 6)} and {r.weight for r in out if r.doc_id == 0} == {round(5000**-0.5, 6)}


def test_tfidf_moves_no_terms_and_keeps_rows_without_a_key(spark):
    rows = [(1, "a b a"), (1, "b c"), (2, "a-c"), (None, "b b"), (None, "c"), (3, None), (4, "d")]
    out = vectors.tfidf(spark.createDataFrame(rows, "k long, text string"), "k", min_df=2)
    n, df = 7, {"a": 2, "b": 2, "c": 3}
    counts = {1: {"a": 2, "b": 2, "c": 1}, 2: {"a": 1, "c": 1}, None: {"b": 2, "c": 1}}
    weights = {k: {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in own.items()} for k, own in counts.items()}
    want = {(k, t): (counts[k][t], w / math.sqrt(sum(x * x for x in own.values()))) for k, own in weights.items() for t, w in own.items()}
    assert {(r["k"], r["term"]): (r["tf"], pytest.approx(r["weight"])) for r in out.collect()} == want
    single = vectors.tfidf(spark.range(50).selectExpr("id AS k", "concat('x y ', id % 5) AS text"), "k")
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()


def test_spread_sample_is_the_uniform_one_over_parts(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    for n in (0, 1, 437, 1000, 2000):
        want = [r["k"] for r in sampling.uniform_sample(df, n, "k").collect()]
        out = sampling.spread_sample(df, n, "k", rows=100)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert [r["k"] for r in out.collect()] == want and max(sizes, default=0) <= 110
        assert [r["k"] for r in sampling.spread_sample(df, n, "k").collect()] == want


def test_tfidf_classifier(spark):
    df = spark.createDataFrame([("good film", 1.0), ("bad film", 0.0)] * 10, "text string, label double")
    m = vectors.text_classifier(df)
    assert m.transform(df).filter("prediction = label").count() == 20


def test_comparison_recommends_the_largest_silhouette(spark, sf):
    from curatrix import catalog

    out = {r["method"]: r for r in catalog.clustering_comparison(spark, sf).collect()}
    assert set(out) == {"kmeans", "agglomerative", "hybrid"}
    best = max(out.values(), key=lambda r: r["silhouette"])["silhouette"]
    assert [r["silhouette"] for r in out.values() if r["recommended"]] == [best]


def test_ranks_and_totals_of_sampled_ranges(spark):
    """Range bounds are drawn from a sample where a partition has many rows, so two readings of one plan may part rows differently."""
    df = spark.range(0, 60_000, 1, 3).select("id", (F.xxhash64("id") % 1_000_003).alias("x"), (F.col("id") % 3).alias("g"))
    # Small tables would be put into one part.
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        out = frequency.ranked(df, "g", [F.col("x"), F.col("id")], "r").select("id", "g", "x", "r").toPandas()
        total = frequency.running_total(df, ["x", "id"], None, "before").select("x", "id", "before", "g").toPandas()
    finally:
        spark.conf.unset(coalesce)
    assert len(out) == 60_000
    assert (out["r"] == (out.sort_values(["g", "x", "id"]).groupby("g").cumcount() + 1).reindex(out.index)).all()
    assert total.sort_values(["x", "id"])["before"].tolist() == list(range(60_000))
