"""The pipeline's stages on a small table, and the registered queries of the subpackage with SQL."""

import corpus_pipeline
from curatrix.llm import oracles, queries


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        n = out.count()
        assert 0 < n <= before
        docs, before = spark.createDataFrame(out.toPandas(), out.schema), n
    assert len(corpus_pipeline.STAGES) == 5


def test_empty_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_near_copies_leave_one_row(spark):
    words = [f"w{i}" for i in range(40)]
    text, other, near = " ".join(words), " ".join(words[::-1]), " ".join(words + ["x"])
    rows = [(1, text, "a"), (1, text, "a"), (1, text, "b"), (2, near, "a"), (None, text, "a"), (None, near, "a"), (None, other, "a"), (None, other, "a"), (3, "alone here", "a"), (None, None, "a"), (None, "", "a"), (4, None, "a"), (4, None, "b"), (1, "quite another text of the same id", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = [(1, text), (1, rows[-1][1]), (None, other), (3, "alone here"), (None, None), (None, ""), (4, None)]
    assert kept == sorted(want, key=str)


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(oracles.ORACLES) <= set(queries.QUERIES)


def test_mix_matches_sql(spark, duck, sf):
    key = lambda r: str([round(x, 6) if isinstance(x, float) else x for x in r])
    got = sorted(map(key, queries.QUERIES["op6_pareto_mix"](spark, sf).collect()))
    assert got == sorted(map(key, duck.execute(oracles.ORACLES["op6_pareto_mix"]).fetchall()))


def test_stages_take_any_columns(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60")
    wide = docs.withColumns({"b.c": F.col("doc_id"), "a map": F.create_map(F.lit("k"), F.create_map(F.lit("x"), F.col("doc_id"))), "d`e": F.array(F.create_map(F.lit(1), F.lit(2))), "size": F.lit("s"), "copies": F.lit(7)})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, sf)
        assert out.columns[: len(wide.columns)] == wide.columns, name
        got = out.select("doc_id", F.col("`b.c`").alias("x"), F.col("`a map`").alias("m"), F.col("`d``e`").alias("d"), "size", "copies").collect()
        assert got and all((r.x, r.m, r.d, r["size"], r.copies) == (r.doc_id, {"k": {"x": r.doc_id}}, [{1: 2}], "s", 7) for r in got), name
        assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in stage(spark, docs, sf).select("doc_id").collect()), name
