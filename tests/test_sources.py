"""Round trips of the sources and sinks."""

import pytest

from curatrix.sources import tables


@pytest.fixture
def odd_csv(tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("a,b,c\n1,2,3\n4,5\n6,7,8,9\n", encoding="utf-8-sig")
    return str(p)


def test_tolerant_csv(spark, odd_csv):
    tables.register(spark)
    cut = spark.read.format("tolerant_csv").option("path", odd_csv).load().collect()
    assert [(r.a, r.b, r.c) for r in cut] == [("1", "2", "3"), ("4", "5", ""), ("6", "7", "8")]
    drop = spark.read.format("tolerant_csv").option("path", odd_csv).option("long_rows", "drop").load().collect()
    assert [(r.a, r.c, r.row_no) for r in drop] == [("1", "3", 2), ("4", None, 3)]


def test_encodings(spark, tmp_path):
    p = tmp_path / "g.csv"
    p.write_bytes("text,n\n定期寿险,1\n".encode("gbk"))
    assert tables.ranges.encodings(spark, [str(p)], tables.ENCODINGS) == {str(p): "gbk"}
    assert tables.read_table(spark, str(p)).collect()[0].text == "定期寿险"


def test_spreadsheet_round_trip(spark, tmp_path):
    rows = [["什么<&>", "1"], [None, "x\ny"], ["z", None]]
    tables.write_xlsx(str(tmp_path / "a.xlsx"), {"all": (["q", "a"], rows), "none": (["q"], [])})
    got = tables.read_table(spark, str(tmp_path / "a.xlsx")).orderBy("row_no").collect()
    assert [[r.q, r.a] for r in got] == rows and [r.row_no for r in got] == [2, 3, 4]
    df = spark.createDataFrame([("a", 1), ("b", 2)], "s string, n int").coalesce(1)
    df.write.format("xlsx").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("xlsx").option("path", str(tmp_path / "out")).load()
    assert sorted((r.s, r.n) for r in back.collect()) == [("a", "1"), ("b", "2")]


def test_many_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("q,x\n1,2\n")
    (tmp_path / "b.csv").write_text("q\n3\n")
    (tmp_path / "c.csv").write_text("other\n3\n")
    with pytest.warns(UserWarning):
        got = tables.read_many(spark, [str(tmp_path / f"{n}.csv") for n in "abcd"], ("q",))
    assert sorted((r.q, r.x, r.source_file) for r in got.collect()) == [("1", "2", "a.csv"), ("3", None, "b.csv")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), ("c", 2), ("d", 3)], "s string, n int")
    tables.write_csv(df, str(tmp_path / "p"), "|")
    assert sorted(r.s for r in tables.read_csv(spark, str(tmp_path / "p"), "|").collect()) == ["a|b", "c", "d"]
    tables.export_csv_file(df, str(tmp_path / "x.csv"))
    assert (tmp_path / "x.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    tables.write_chunks(df, str(tmp_path / "ch"), ["n"], 2)
    assert spark.read.parquet(str(tmp_path / "ch")).groupBy("chunk_id").count().count() == 2
    assert tables.export_dated(df, str(tmp_path), "w", "2024-01-01", "parquet").endswith("w/2024-01-01")
    tables.write_document(df.limit(1), str(tmp_path / "doc"))
    assert tables.read_document(spark, str(tmp_path / "doc")).count() == 1


def test_model_client(spark):
    calls = iter(range(1000))

    def client(x):
        if next(calls) % 2 == 0:
            raise OSError
        return f"<{x}>"

    df = spark.createDataFrame([("a",), ("b",)], "text string")
    assert sorted(r.response for r in tables.scored_by_model(df, client).collect()) == ["<a>", "<b>"]


@pytest.mark.parametrize("encoding", ["utf-8-sig", "gbk"])
@pytest.mark.parametrize("sep", [",", "|"])
def test_ranges_give_the_rows_of_one_task(spark, tmp_path, encoding, sep):
    import csv
    import io
    import random

    r = random.Random(8)
    pieces = ["a", "", 'say ""x""', "two\nlines", "\n\n", "险" * 30, sep, 'half"quote', "泂燶", " ", "x" * 300]
    out = io.StringIO()
    w = csv.writer(out, delimiter=sep, lineterminator="\n")
    w.writerow(["a", "b.c", "d"])
    for k in range(400):
        w.writerow([str(k), "".join(r.choice(pieces) for _ in range(r.randrange(4))), r.choice(pieces)][: r.choice([2, 3, 3])] + ["more"] * (k % 50 == 7))
        if k % 40 == 3:
            out.write("\n" + f'{k}{sep}pipe 5" long{sep}"open\n' + "y\n" * 60 + '"\n')
    (tmp_path / "f.csv").write_bytes(out.getvalue().encode(encoding))
    (tmp_path / "g.csv").write_bytes(f"a{sep}b.c{sep}d\n1{sep}2{sep}3".encode(encoding))
    plain = []
    for name in ("f.csv", "g.csv"):
        text = (tmp_path / name).read_bytes().decode(encoding)
        for no, row in enumerate(csv.reader(io.StringIO(text), delimiter=sep), 1):
            if no > 1 and row:
                plain.append((*[*row[:3], *[""] * (3 - len(row))], no, name))
    for size in (97, 1000, 1 << 26):
        got = tables.read_large_csv(spark, str(tmp_path / "*.csv"), sep, size=size)
        assert sorted(tuple(x) for x in got.collect()) == sorted(plain)
        assert got.columns == ["a", "b.c", "d", "row_no", "source_file"]
    first = tables.read_large_csv(spark, str(tmp_path / "*.csv"), sep, size=200, limit=50).collect()
    assert [tuple(x) for x in first] == plain[:50]


def test_a_very_long_field(spark, tmp_path):
    (tmp_path / "l.csv").write_text('a,b\n1,"' + "line\n" * 60_000 + '"\n2,x\n')
    got = tables.read_large_csv(spark, str(tmp_path / "l.csv"), size=10_000).orderBy("row_no").collect()
    assert [(r.a, len(r.b), r.row_no) for r in got] == [("1", 300_000, 2), ("2", 1, 3)]


def test_model_answers_are_kept(spark, tmp_path):
    log = str(tmp_path / "calls")

    def client(x):
        with open(log, "a") as f:
            f.write(f"{x!r}\n")
        n = open(log).read().count(f"{x!r}\n")
        if x == "never" or (x == "late" and n < 3):
            raise ConnectionError
        return f"<{x}>"

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "late"), (4, "never"), (5, None)], "id long, `t.x` string").repartition(3)
    kept = str(tmp_path / "answers")
    ask = lambda d: {r.id: r.response for r in tables.scored_by_model(d, client, "t.x", wait=0.01, answers=kept).collect()}
    assert ask(df) == {1: "<a>", 2: "<a>", 3: "<late>", 4: None, 5: "<>"}
    calls = open(log).read().splitlines()
    assert calls.count("'a'") == 1 and calls.count("'late'") == 3 and calls.count("'never'") == 3
    more = df.unionByName(spark.createDataFrame([(6, "b")], df.schema))
    assert ask(more) == {1: "<a>", 2: "<a>", 3: "<late>", 4: None, 5: "<>", 6: "<b>"}
    assert open(log).read().splitlines()[len(calls) :].count("'a'") == 0
