"""Filter audit, erasure and archives against plain versions, on small tables with nulls, empties, ties and repeats."""

import base64
import collections
import glob
import hashlib
import itertools
import math
import random
import re
import zlib
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curatrix.llm import erasure, filter_audit, oracles, queries, warc_index
from curatrix.llm.common import scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# op11


def plain_audit(docs, labels):
    least, out = {}, collections.Counter()
    for i, x, _ in docs:
        if i is not None:
            least[x or ""] = min(i, least.get(x or "", i))
    parts = {s or "" for *_, s in docs}
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    for i, x, s in docs:
        x = x or ""
        w = WORD.findall(x)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", x)) > 2 * len(x), "D": bool(re.search(r"[#$%&*|]", x)), "E": i is not None and x in least and i > least[x]}
        for order in itertools.permutations("ABCDE"):
            first = next((k for k, c in enumerate(order) if fails[c]), 9)
            for k, c in enumerate(order):
                key = (s or "", "".join(order), k + 1)
                out[(*key, "kept")] += first > k
                out[(*key, "removed")] += first == k
                out[(*key, "redundant")] += fails[c] and first < k
                out[(*key, "unique_fails")] += fails[c] and sum(fails.values()) == 1
                out[(*key, "good_lost")] += first == k and i in good
                out[(*key, "toxic_lost")] += first == k and i in bad
                out[(s or "", c, "shapley")] += first == k
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return {(p, "".join(o), k + 1): (*[out[(p, "".join(o), k + 1, n)] for n in names], out[(p, c, "shapley")]) for p in parts for o in itertools.permutations("ABCDE") for k, c in enumerate(o)}


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def test_audit(spark):
    r = random.Random(3)
    many = " ".join(f"w{k}" for k in range(250))
    texts = [many, many + " X#", "word " * 300, "ABC def", None, "", " \t\n", "é" * 50 + " $", many.upper(), " ".join(f"v{k}" for k in range(20_000))]
    docs = [(r.choice([None, *range(40)]), r.choice(texts), r.choice(["a", "b", None, ""])) for _ in range(80)] + [(5, many, "a"), (5, many, "a"), (5, many, "b")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 40, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    wide = d.select("*", *[F.lit(1).alias(c) for c in ("mask", "part", "h", "n", "a.b", "copy", "good")]).withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    assert audited(filter_audit.audit(wide.repartition(3), lab)) == plain_audit(docs, labels)
    assert filter_audit.audit(d.limit(0), lab).count() == 0
    assert sum(v[4] for v in audited(filter_audit.audit(d, lab.limit(0))).values()) == 0


def test_audit_takes_other_filters(spark):
    rows = spark.createDataFrame([("p", 1, True, False), ("p", 3, False, True), ("p", 0, True, True)], "part string, mask int, good boolean, toxic boolean")
    out = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in filter_audit.replay(rows, "XY").collect()}
    assert out == {("XY", 1): (1, 2, 0, 3), ("XY", 2): (1, 0, 1, 1), ("YX", 1): (2, 1, 0, 1), ("YX", 2): (1, 1, 1, 3)}
    with pytest.raises(ValueError):
        filter_audit.replay(rows, "ABCDEFGH")


def test_audit_matches_sql(spark, duck, sf):
    out = queries.op11_filter_audit(spark, sf)
    want = duck.execute(oracles.ORACLES["op11_filter_audit"])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(out.columns)
    assert sorted(out.select(*names).collect()) == sorted(want.fetchall())


# op12

VALUE = st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.one_of(st.none(), st.floats(allow_nan=False)), st.one_of(st.none(), st.text(alphabet="\0\x01aé￿𐍈", max_size=20)), st.one_of(st.none(), st.booleans()), st.one_of(st.none(), st.datetimes(datetime(1900, 1, 1), datetime(2200, 1, 1)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), *VALUE), min_size=1, max_size=40))
def test_keys_order_as_values(rows):
    kinds = [pa.int64(), pa.float64(), pa.string(), pa.bool_(), pa.timestamp("us")]
    columns = [pa.array([r[i + 1] for r in rows], k) for i, k in enumerate(kinds)]
    order = erasure.counted_order(erasure.encoded(np.array([r[0] for r in rows], np.uint32), columns))
    # UTF-8 and code points order alike, None is first.
    plain = sorted(rows, key=lambda r: (r[0], *[(v is not None, v if v is not None else 0) for v in r[1:]]))
    assert [rows[i] for i in order] == plain
    keys = erasure.as_list(erasure.encoded(np.array([r[0] for r in rows], np.uint32), columns))
    assert [rows[i] for i in sorted(range(len(rows)), key=lambda i: keys[i])] == plain


def test_keys_of_other_types():
    from datetime import date
    from decimal import Decimal

    kinds = [(pa.decimal128(20, 2), [Decimal("-1.50"), None, Decimal("2.00"), Decimal("-300.25")]), (pa.date32(), [date(1960, 1, 1), date(2020, 1, 1), None, date(1970, 1, 1)]), (pa.binary(), [b"b", b"a\0", None, b"a"]), (pa.float32(), [float("nan"), -1.5, None, float("inf")])]
    for kind, values in kinds:
        order = erasure.counted_order(erasure.encoded(np.zeros(4, np.uint32), [pa.array(values, kind)]))
        nan = lambda v: (v != v, 0 if v != v else v)
        assert [repr(values[i]) for i in order] == [repr(v) for v in sorted(values, key=lambda v: (v is not None, nan(v) if isinstance(v, float) else v if v is not None else 0))]
    with pytest.raises(TypeError):
        erasure.fixed_bytes(pa.array([[1]]))


def plain_cascade(c):
    """What the erasure has to leave, by DuckDB: (table, file_no): (n_rows, n_erased, cents, rewritten, ids, columns, rows)."""
    c.create_function("crc", lambda x: zlib.crc32(x.encode()), ["VARCHAR"], "BIGINT")
    top = c.execute("SELECT master_id FROM (SELECT DISTINCT client_id, master_id FROM clients WHERE master_id IS NOT NULL) o LEFT JOIN (SELECT client_id, client_id AS kept_id FROM clicks) clicks USING (client_id) GROUP BY 1 ORDER BY count(clicks.kept_id) DESC, 1 LIMIT 1").fetchone()
    c.execute(f"CREATE OR REPLACE TEMP TABLE v AS SELECT DISTINCT client_id FROM clients WHERE client_id IS NOT NULL AND master_id IS NOT NULL AND (crc(master_id::VARCHAR) % 100 = 0 OR master_id = {top[0] if top else -1})")
    c.execute("CREATE OR REPLACE TEMP TABLE vs AS SELECT DISTINCT sale_id FROM sales WHERE client_id IN (FROM v) AND sale_id IS NOT NULL")
    out = {}
    for t, key, gone, measure in (("clients", "client_id", "v", "balance"), ("clicks", "client_id", "v", "value"), ("sales", "client_id", "v", "total"), ("sale_lines", "sale_id", "vs", "amount")):
        cols = [x[0] for x in c.execute(f"DESCRIBE {t}").fetchall()]
        join, owner = ("LEFT JOIN (SELECT sale_id, min(client_id) AS owner FROM sales GROUP BY 1) s USING (sale_id)", "owner") if t == "sale_lines" else ("", "client_id")
        rows = c.execute(f"SELECT {', '.join('t.' + x for x in cols)}, coalesce(t.{key} IN (SELECT {key} FROM {gone}), false) FROM {t} t {join} ORDER BY crc(coalesce({owner}::VARCHAR, '')), {', '.join(f't.{x} NULLS FIRST' for x in cols)}").fetchall()
        each, m = 1 + len(rows) // 150, cols.index(measure)
        for f in range(-(-len(rows) // each)):
            part = rows[f * each : (f + 1) * each]
            keep = [r[:-1] for r in part if not r[-1]]
            if keep:
                ids = ",".join("" if r[0] is None else str(r[0]) for r in keep)
                out[t, f] = (len(keep), len(part) - len(keep), sum(math.floor(100 * (r[m] or 0) + 0.5) for r in keep), len(keep) < len(part), hashlib.sha256(ids.encode()).hexdigest(), ",".join(cols), keep)
    return out


def check_cascade(found, want):
    assert {(r["table_name"], r["file_no"]) for r in found} == set(want) and len(found) == len(want)
    for r in found:
        w = want[r["table_name"], r["file_no"]]
        assert (r["n_rows"], r["n_erased"], r["cents"], r["rewritten"], r["ids_sha256"], r["columns"]) == w[:6]
        t = pq.read_table(r["path"])
        assert [tuple(x.values()) for x in t.to_pylist()] == w[6]
        ids = [x[0] for x in w[6] if x[0] is not None]
        stats = [pq.ParquetFile(r["path"]).metadata.row_group(g).column(0).statistics for g in range(pq.ParquetFile(r["path"]).metadata.num_row_groups)]
        assert not ids or (min(s.min for s in stats if s.has_min_max), max(s.max for s in stats if s.has_min_max)) == (min(ids), max(ids))
    if found:
        top = found[0]["path"].rsplit("/", 2)[0]
        assert sorted(glob.glob(f"{top}/**/*.*", recursive=True)) == sorted(r["path"] for r in found)


def test_cascade_on_the_given_tables(spark, sf):
    c = duckdb.connect()
    for t in ("clients", "clicks", "sales", "sale_lines"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    out = queries.op12_erasure_rewrite(spark, sf)
    assert out.columns[:8] == ["file_no", "n_rows", "n_erased", "cents", "rewritten", "ids_sha256", "columns", "path"]
    check_cascade(out.collect(), plain_cascade(c))


SHOP = {
    "clients": "client_id long, master_id long, balance double, `odd.name` string",
    "clicks": "click_id long, client_id long, value double, crc long, bucket int, file_no int",
    "sales": "sale_id long, client_id long, total double",
    "sale_lines": "sale_id long, line_no int, amount double, note string",
}


def shop(seed, hot=False):
    r = random.Random(seed)
    x = lambda: r.choice([None, -0.0, 0.0, 1.005, -2.675, r.uniform(-9, 9)])
    clients = [(i, r.choice([None, *range(400)]), x(), r.choice([None, "", "a", "a\0b", "ü" * 30])) for i in range(500)] + [(None, 7, 1.0, "no id")]
    clicks = [(r.choice([None, k]), r.choice([None, 3, r.randrange(600)]), x(), 1, k % 3, 5) for k in range(900)]
    clicks += clicks[:50] + ([(1, 3, 2.5, 1, 1, 1)] * 2000 if hot else [])
    sales = [(k, r.choice([None, 3, r.randrange(600)]), x()) for k in range(700)] + [(None, 3, 1.0), (5, 3, 1.0), (5, None, 2.0)]
    lines = [(r.choice([None, 4, 5, r.randrange(900)]), r.randrange(4), x(), r.choice([None, "n", "n" * 200])) for _ in range(1500)]
    return {"clients": clients, "clicks": clicks, "sales": sales, "sale_lines": lines + lines[:100]}


def cascaded(spark, tables):
    dfs = {t: spark.createDataFrame(rows, SHOP[t]).repartition(3) for t, rows in tables.items()}
    c = duckdb.connect()
    for t, df in dfs.items():
        c.register(f"{t}_", df.toArrow())
        c.execute(f"CREATE TABLE {t} AS SELECT {', '.join(f'"{x}"' for x in df.columns)} FROM {t}_")
    out = erasure.cascade(spark, dfs["clients"], dfs["clicks"], dfs["sales"], dfs["sale_lines"]).collect()
    return out, c


def test_cascade_with_nulls_ties_and_identical_rows(spark, monkeypatch):
    monkeypatch.setattr(erasure, "LEAST_ROWS", 3)  # many levels, and buckets of identical rows over several files
    tables = shop(5, hot=True)
    # The plain version has no rule for rows that SQL holds equal, so zeros have one sign; its names have no dots.
    tables = {t: [tuple(0.0 if isinstance(v, float) and v == 0 else v for v in r) for r in rows] for t, rows in tables.items()}
    tables["clients"] = [r for r in tables["clients"] if r[0] is not None]
    monkeypatch.setitem(SHOP, "clients", SHOP["clients"].replace("`odd.name`", "odd"))
    out, c = cascaded(spark, tables)
    check_cascade(out, plain_cascade(c))


def test_cascade_edges(spark):
    tables = shop(6)
    out, _ = cascaded(spark, tables)  # a name with a dot, columns named as ours, signed zeros
    left = collections.Counter()
    for r in out:
        left[r["table_name"]] += r["n_rows"]
    gone = collections.Counter()
    for r in out:
        gone[r["table_name"]] += r["n_erased"]
    assert all(left[t] + gone[t] <= len(tables[t]) for t in tables) and gone["clicks"] > 0
    nothing = {t: [] for t in tables}
    assert cascaded(spark, nothing)[0] == []
    one = nothing | {"clients": [(1, 2, 3.0, "x")], "clicks": [(9, None, 1.0, 0, 0, 0)]}
    assert [(r["table_name"], r["n_rows"]) for r in cascaded(spark, one)[0]] == [("clicks", 1)]  # master 2 leads even at 0 clicks


def test_written_files_survive_a_second_try(spark):
    df = spark.range(1000).select(F.col("id"), F.lit(1.0).alias("x"), (F.col("id") % 7).alias("crc"))
    folder = scratch(spark)
    written = erasure.write_sorted(df, "crc", f"{folder}/t", 10)
    again = erasure.write_sorted(df, "crc", f"{folder}/t", 10)
    assert [r["n"] for r in sorted(again.collect())] == [101] * 9 + [91]
    assert len(glob.glob(f"{folder.removeprefix('file://')}/t/*")) == 10
    out = erasure.rewrite(written, spark.createDataFrame([(3, 3), (0, 7), (0, 12)], "crc long, id long"), "t", "id", "x")
    assert sum(r["n_erased"] for r in out.collect()) == 2  # 12 has another crc, so no file is asked for it


# op13


def plain_captures(pages):
    by = collections.defaultdict(list)
    for i, _, x in pages:
        by[x or ""].append(i)
    out = []
    for x, ids in by.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0))
        b = x.encode()
        for k, i in enumerate(ids):
            out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if k == len(ids) - 1 else "revisit", None if k == len(ids) - 1 else ids[-1]))
    return sorted(map(repr, out))


def rows_of(df):
    return sorted(repr((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in df.collect())


@pytest.fixture(scope="module")
def pages():
    r = random.Random(11)
    texts = ["<p>a</p>", "<p>a</p>", None, "", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "é" * 100_000, *[f"<html>{k}</html>" for k in range(40)]]
    urls = ["http://www.B.org/x?y#z", "https://a.org:8080/\n b", None, "", "no url", *[f"http://h{k % 3}.org/{k % 5}" for k in range(20)]]
    return [(k, r.choice(urls), r.choice(texts)) for k in range(150)] + [(3, "http://a/1", "twice"), (3, "http://a/1", "twice"), (3, "http://a/2", "twice"), (2, "http://a/1", "twice"), (None, "u", "<p>a</p>"), (None, "u", "no id"), (None, "u", "no id"), (-5, "u", "minus")]


SCHEMA = "page_id long, url string, html string"


def test_archives(spark, pages):
    df = spark.createDataFrame(pages, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("h", "id", "x", "to", "a.b", "key")]).repartition(5)
    out = warc_index.archive_and_index(spark, df)
    assert rows_of(out) == plain_captures(pages)
    assert warc_index.archive_and_index(spark, df.limit(0)).count() == 0
    found = out.collect()
    order = [(r["url_key"].encode(), r["captured_at"], r["page_id"] if r["page_id"] is not None else -(2**63)) for r in found]
    assert order == sorted(order) and [r["position"] for r in found] == list(range(len(found)))
    # Records are where the index says, each a gzip member of its own.
    for r in found[::17]:
        with open(r["archive"], "rb") as f:
            f.seek(r["offset"])
            fields, block = warc_index.parsed(zlib.decompress(f.read(r["length"]), 31))
        assert fields["warc-type"] == r["record_type"] and fields["warc-payload-digest"] == "sha1:" + r["payload_digest"]
        assert (block.partition(b"\r\n\r\n")[2] == b"") == (r["record_type"] == "revisit" or not r["payload_bytes"])


def test_merge_in_rounds(spark, pages, monkeypatch):
    monkeypatch.setattr(warc_index, "RUN_ROWS", 3)
    monkeypatch.setattr(warc_index, "RANGE_ROWS", 10)
    monkeypatch.setattr(warc_index, "READ_ROWS", 2)
    folder = scratch(spark)
    same = [(k, "http://hot.org/", f"t{k}") for k in range(1000, 1060)]  # one URL over several ranges
    df = spark.createDataFrame(pages + same, SCHEMA).repartition(4)
    archives = warc_index.write_archives(df, f"{folder}/a")
    runs = warc_index.sorted_runs(archives, f"{folder}/r")
    assert runs.count() > 60 and len(warc_index.cuts_of(runs)) > 10
    out = warc_index.merge_runs(runs, f"{folder}/r", fan_in=4)
    found = out.collect()
    assert rows_of(out) == plain_captures(pages + same)
    assert [r["position"] for r in found] == list(range(len(found)))
    count = collections.Counter()
    for r in found:
        count[r["url_key"]] += 1
        assert r["capture_no"] == count[r["url_key"]]


def test_least_payload_and_dates(spark):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("seen", F.expr("timestamp'2020-05-01 00:00:00' - make_interval(0, 0, 0, page_id)"))
    out = {r["page_id"]: r for r in warc_index.archive_and_index(spark, df, least=4, date="seen").collect()}
    assert [out[i]["record_type"] for i in (1, 2, 3, 4)] == ["response", "response", "revisit", "response"]
    assert out[4]["captured_at"] == datetime(2020, 5, 1) - timedelta(days=4) and [out[i]["position"] for i in (4, 3, 2, 1)] == [0, 1, 2, 3]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=2), max_size=8), max_size=9))
def test_loser_tree(lists):
    streams = [iter([(k, s) for k in sorted(x)]) for s, x in enumerate(lists)]
    assert list(warc_index.loser_merge(streams)) == sorted((k, s) for s, x in enumerate(lists) for k in x)


def test_broken_archives_are_noticed(tmp_path):
    good = warc_index.page_record(1, "http://a.org/", b"payload", b"h", datetime(2024, 1, 1).astimezone(), None, 0)
    fields, block = warc_index.parsed(zlib.decompress(good, 31))
    assert warc_index.capture(fields, block)[4:7] == (7, warc_index.base32_sha1(b"payload"), "response")
    with pytest.raises(ValueError):
        warc_index.parsed(zlib.decompress(good, 31).replace(b"payload", b"pavload"))
    with pytest.raises(ValueError):
        warc_index.capture(fields, block.replace(b"payload", b"pavload"))
    (tmp_path / "x").write_bytes(good[:-9])
    with open(tmp_path / "x", "rb") as f, pytest.raises(ValueError):
        list(warc_index.members(f))


def test_url_keys():
    keys = {"http://www.B.org/x?y#z": "org,b,www)/x?y", "https://a.org:8080": "org,a:8080)/", "https://u@a.org:443/p": "org,a)/p", "no url#f": "no url", "": ""}
    assert {u: warc_index.url_key(u) for u in keys} == keys
