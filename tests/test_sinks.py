"""Sinks that commit: round trips, marks, failing tasks, several sheets."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from curatrix.sources import sinks, tables


def test_csv_parts_have_marks_and_round_trip(spark, tmp_path):
    rows = [(1, 'a"b|c', None), (2, "", "x\ny"), (3, " lead", "条款"), (4, None, "z"), (5, "t", "")]
    df = spark.createDataFrame(rows, "n int, `a.b` string, c string").repartition(3)
    out = str(tmp_path / "out")
    for sep in ("|", ","):  # the second write replaces the first
        tables.write_csv(df, out, sep)
        parts = tables.files_of(out)
        assert len(parts) == 3 and all(open(p, "rb").read(3) == b"\xef\xbb\xbf" for p in parts)
        back = tables.read_csv(spark, out, sep)
        assert back.columns == ["n", "a.b", "c"]
        assert sorted((int(r[0]), r[1], r[2]) for r in back.collect()) == [tuple(v if v != "" else None for v in r) for r in rows]
        lines = "".join(open(p, encoding="utf-8-sig", newline="").read() for p in parts).split("\n")
        assert sep.join(("4", "", "z")) in lines and sep.join(("5", "t", '""')) in lines  # a null and an empty text
    assert os.listdir(tmp_path) == ["out"]


def test_empty_table_keeps_its_header(spark, tmp_path):
    empty = spark.createDataFrame([], "a string, b int")
    tables.write_csv(empty.coalesce(1), str(tmp_path / "e"))
    for f in tables.files_of(str(tmp_path / "e")):
        assert open(f, encoding="utf-8-sig").read() == "a,b\n"


@pytest.mark.parametrize("fmt", ["marked_csv", "xlsx"])
def test_failed_write_leaves_nothing(spark, tmp_path, fmt):
    tables.register(spark)
    good = spark.range(4).select(F.col("id").cast("string").alias("s")).repartition(2)
    good.write.format(fmt).mode("append").save(str(tmp_path / "o"))
    before = sorted(os.listdir(tmp_path / "o"))
    bad = spark.range(0, 400, 1, 4).select(F.when(F.col("id") == 399, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("s"))
    with pytest.raises(Exception):
        bad.write.format(fmt).mode("overwrite").save(str(tmp_path / "o"))
    assert sorted(os.listdir(tmp_path / "o")) == before and os.listdir(tmp_path) == ["o"]


def test_long_tables_go_on_in_another_part(spark, tmp_path):
    tables.register(spark)
    spark.range(0, 25, 1, 1).selectExpr("id", "repeat('x', int(id)) AS t").write.format("xlsx").option("rows", "11").mode("append").save(str(tmp_path / "o"))
    assert len(tables.files_of(str(tmp_path / "o"))) == 3
    back = tables.read_table(spark, str(tmp_path / "o" / "*.xlsx"))
    assert sorted((int(r.id), r.t or "") for r in back.collect()) == [(i, "x" * i) for i in range(25)]


def test_workbook_of_several_sheets(spark, tmp_path):
    df = spark.createDataFrame([(i, f"q{i}", None if i % 3 else f"f{i}") for i in range(9)], "sheet int, q string, file string").repartition(4)
    found = F.col("file").isNotNull()
    path = str(tmp_path / "b.xlsx")
    tables.write_workbook(df, path, {"all": F.lit(True), "found <&>": found, "not found": ~found, "none": F.lit(False)}, ["sheet"])
    assert os.listdir(tmp_path) == ["b.xlsx"]
    with zipfile.ZipFile(path) as z:
        names = [z.read(f"xl/worksheets/sheet{i}.xml").decode().count("<row ") - 1 for i in range(1, 5)]
        assert names == [9, 3, 6, 0] and 'name="found &lt;&amp;&gt;"' in z.read("xl/workbook.xml").decode()
        assert '<col min="2" max="2" width="4" customWidth="1"/>' in z.read("xl/worksheets/sheet1.xml").decode()
    back = tables.read_table(spark, path).orderBy("row_no").collect()
    assert [(r.sheet, r.q, r.file) for r in back] == [(str(i), f"q{i}", None if i % 3 else f"f{i}") for i in range(9)]
