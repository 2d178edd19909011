"""Cascading erasure: tables as globally ordered files, and the rewrite of just those files that hold victims.

**Order.** A row's key is the big-endian crc32 of a grouping id, then every column
from left to right as bytes that compare as the values do: a flag (0 null, 1 not),
then integers and times with the sign bit turned, floats with the sign bit turned
or, if negative, all bits, texts and bytes ended by a zero (zeros inside become
00 FF). -0.0 orders as 0.0, NaN above all numbers.

**Ranks.** Keys are partitioned from their most significant bytes: rows are counted
by a digit of two bytes, runs of digits make buckets of bounded size, and a digit
with too many rows is opened again after the longest common prefix of its keys, until
no bucket is too large or all its rows are identical. A bucket's rank is the number of
rows in smaller ones, which tells the file, so that one exchange brings rows to
the task of their file; there each bucket is refined in memory, eight bytes at a time,
and ranks come from counting. A bucket at a file's edge goes to both files; identical
rows that fill several files go as one row from each task and are repeated by count.

**Bounds.** A table has at most 2**20 buckets of about a sixteenth of a file, 256 rows
at least and 65,536 at most, or a 2**18th of the table where that is more. A file is written
by one task, streaming, bucket by bucket. Files get their names by a move when whole,
and files that are erased from are replaced under a new name and removed only after
all tasks have ended, so that a task that runs again finds what it needs.

Null ids belong to nobody. Repeated rows are kept and erased one by one. Nested
columns have no order and raise TypeError. Empty tables make no files. Columns may
have any name. Values that are not finite count as 0 in sums.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import discard, fresh, materialize, ranges, scratch
from curatrix.llm.files import FileInWork, place, removed

#: Rows of a bucket: a sixteenth of a file between these bounds, more only beyond MOST_BUCKETS / 4 buckets.
LEAST_ROWS = 256
BUCKET_ROWS = 1 << 16
MOST_BUCKETS = 1 << 20
#: Small files share a task up to so many rows.
TASK_ROWS = 50_000
#: Rows read and written at once.
WRITE_ROWS = 1 << 16
#: A master is a victim if the crc32 of its id divides by this.
SHARE = 100


# keys


def fixed_bytes(col: pa.Array) -> np.ndarray | None:
    """A column of fixed width as a matrix of bytes, flag first; None for texts and bytes."""
    kind = col.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        return None
    valid = np.asarray(col.is_valid())
    if pa.types.is_decimal(kind):
        wide = np.array([int(v.scaleb(kind.scale)).to_bytes(16, "big", signed=True) if v is not None else bytes(16) for v in col.to_pylist()], dtype="S16")
        body = np.frombuffer(wide.tobytes(), np.uint8).reshape(-1, 16).copy()
        body[:, 0] ^= 128
    elif pa.types.is_floating(kind):
        x = col.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0  # -0.0 becomes 0.0
        minus = np.signbit(col.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)) & (x == 0)
        bits = np.where(np.isnan(x), np.nan, x).view(np.uint64)
        bits = np.where((bits >> np.uint64(63)).astype(bool), ~bits, bits | np.uint64(1 << 63))
        bits[np.isnan(x)] = np.uint64(0xFFFFFFFFFFFFFFFF)
        body = bits.astype(">u8").view(np.uint8).reshape(-1, 8)
        # The zero's sign comes last, to tell rows apart that SQL holds equal.
        body = np.concatenate([body, minus.astype(np.uint8)[:, None]], axis=1)
    else:
        if pa.types.is_timestamp(kind) or pa.types.is_time(kind) or pa.types.is_duration(kind) or pa.types.is_date64(kind):
            col = col.cast(pa.int64())
        elif pa.types.is_date32(kind):
            col = col.cast(pa.int32()).cast(pa.int64())
        elif pa.types.is_boolean(kind) or pa.types.is_integer(kind):
            col = col.cast(pa.int64())
        else:
            raise TypeError(f"columns of type {kind} have no order")
        x = col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        body = (x.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    out = np.concatenate([valid.astype(np.uint8)[:, None], body], axis=1)
    out[~valid] = 0
    return out


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows end to end, length of each): flag, escaped value, zero; a null is its flag alone."""
    valid = np.asarray(col.is_valid())
    raw = col.cast(pa.large_binary()) if pa.types.is_large_string(col.type) or pa.types.is_string(col.type) or pa.types.is_binary(col.type) else col
    if any(b"\0" in v for v in raw.to_pylist() if v) if len(raw) else False:
        raw = pa.array([None if v is None else v.replace(b"\0", b"\0\xff") for v in raw.to_pylist()], pa.large_binary())
    raw = raw.fill_null(b"")
    off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    size = np.diff(off)
    lens = np.where(valid, size + 2, 1)
    out = np.zeros(int(lens.sum()), np.uint8)
    at = np.cumsum(lens) - lens
    out[at] = valid
    out[ranges(at + 1, size)] = data
    return out, lens


def encoded(crc: np.ndarray, columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the keys of rows: crc32 first, then the columns."""
    n = len(crc)
    parts = [crc.astype(">u4").view(np.uint8).reshape(n, 4)]
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        made = fixed_bytes(c)
        parts.append(text_bytes(c) if made is None else made)
    lens = [np.full(n, p.shape[1]) if isinstance(p, np.ndarray) else p[1] for p in parts]
    offsets = np.concatenate([[0], np.cumsum(np.sum(lens, axis=0))]).astype(np.int64)
    out = np.empty(int(offsets[-1]), np.uint8)
    at = offsets[:-1].copy()
    for p, size in zip(parts, lens):
        if isinstance(p, np.ndarray):
            out[(at[:, None] + np.arange(p.shape[1])).ravel()] = p.ravel()
        else:
            out[ranges(at, size)] = p[0]
        at += size
    return out, offsets


def as_list(keys: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    raw, off = keys[0].tobytes(), keys[1].tolist()
    return [raw[a:b] for a, b in zip(off, off[1:])]


def counted_order(keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rows in key order. A row's rank is the number of rows whose prefix is smaller; rows that share one go on with the next eight bytes."""
    raw, off = keys
    n = len(off) - 1
    ends, rank, live, word = off[1:], np.zeros(n, np.int64), np.arange(n), 0
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    while len(live) > 1:
        begin = off[live] + 8 * word
        at = begin[:, None] + np.arange(8)
        piece = np.where(at < ends[live][:, None], raw[np.minimum(at, len(raw) - 1)], 0).astype(np.uint8)
        value, parent = piece.view(">u8").ravel().astype(np.uint64), rank[live]
        order = np.lexsort((value, parent))
        v, p, place = value[order], parent[order], np.arange(len(live))
        other = np.concatenate([[True], p[1:] != p[:-1]])
        new = other | np.concatenate([[True], v[1:] != v[:-1]])
        first = np.maximum.accumulate(np.where(new, place, 0))
        rank[live[order]] = p + first - np.maximum.accumulate(np.where(other, place, 0))
        run = np.cumsum(new) - 1
        together = np.bincount(run)[run] > 1
        live = live[order][together & (begin[order] + 8 < ends[live[order]])]
        word += 1
    return np.argsort(rank, kind="stable")


def shared_prefix(a: bytes, b: bytes) -> bytes:
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[:n]


# ranks by counting


def buckets(rows: DataFrame, columns: list[str], most: int) -> list[tuple[bytes, int, bool]]:
    """(first bytes, rows, all identical) of the buckets of rows (crc, columns) in key order; only buckets of identical rows have over 1.5 * most rows."""

    def folded(counts: DataFrame) -> list[Row]:
        """Runs of digits with some most / 2 rows, inside blocks of 256 digits; a digit with too many rows alone."""
        w = W.partitionBy("b", F.shiftright("digit", 8)).orderBy("digit").rowsBetween(W.unboundedPreceding, -1)
        before, big = F.coalesce(F.sum("n").over(w), F.lit(0)), F.col("n") > most
        t = counts.withColumn("big", big).withColumn("run", F.floor(before / max(1, most / 2))).withColumn("passed", F.coalesce(F.sum(F.col("big").cast("int")).over(w), F.lit(0)))
        g = t.groupBy("b", F.shiftright("digit", 8).alias("block"), "run", "passed", "big")
        return g.agg(F.min("digit").alias("digit"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()  # at most MOST_BUCKETS

    def counts_in(open_: list[bytes]) -> DataFrame:
        """(b, digit, n, lo, hi) of the rows in the buckets that begin with one of the prefixes."""
        spark = rows.sparkSession
        tops = F.broadcast(spark.createDataFrame([(d,) for d in sorted({int.from_bytes(p[:2], "big") for p in open_})], "top int"))  # at most 65,536
        near = rows.join(tops, F.shiftright("crc", 16) == F.col("top"), "left_semi").select("crc", *columns)

        def run(batches):
            seen: dict = {}

            def out():
                ks, vs = list(seen), list(seen.values())
                return pa.RecordBatch.from_pydict({"b": pa.array([k[0] for k in ks], pa.int32()), "digit": pa.array([k[1] for k in ks], pa.int32()), "n": pa.array([v[0] for v in vs], pa.int64()), "lo": pa.array([v[1] for v in vs], pa.binary()), "hi": pa.array([v[2] for v in vs], pa.binary())})

            for t in batches:
                for k in as_list(encoded(t.column(0).to_numpy().astype(np.uint32), t.columns[1:])):
                    b = bisect.bisect_right(open_, k) - 1
                    if b < 0 or not k.startswith(open_[b]):
                        continue
                    at = len(open_[b])
                    digit = int.from_bytes(k[at : at + 2].ljust(2, b"\0"), "big")
                    v = seen.get((b, digit))
                    if v is None:
                        seen[b, digit] = [1, k, k]
                    else:
                        v[0] += 1
                        if k < v[1]:
                            v[1] = k
                        elif k > v[2]:
                            v[2] = k
                if len(seen) > 100_000:
                    yield out()
                    seen.clear()
            if seen:
                yield out()

        made = near.mapInArrow(run, "b int, digit int, n long, lo binary, hi binary")
        return made.groupBy("b", "digit").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    closed: list[tuple[bytes, int, bool]] = []
    none = F.lit(None).cast("binary")
    top = rows.groupBy(F.shiftright("crc", 16).cast("int").alias("digit")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("b"), "digit", "n", none.alias("lo"), none.alias("hi"))
    open_, found = [b""], folded(top)
    while found:
        deeper = []
        for r in found:
            start = open_[r["b"]] + r["digit"].to_bytes(2, "big")
            # A key may end inside the digit, which counts as zeros: a first key without them is smaller than none of its bucket.
            first = open_[r["b"]] + r["digit"].to_bytes(2, "big").rstrip(b"\0")
            if not r["big"]:
                closed.append((first, r["n"], False))
            elif r["lo"] is not None and r["lo"] == r["hi"]:
                closed.append((first, r["n"], True))
            else:
                deeper.append(start if r["lo"] is None else shared_prefix(bytes(r["lo"]), bytes(r["hi"])))
        open_ = sorted(deeper)
        found = folded(counts_in(open_)) if open_ else []
    return sorted(closed)


# files


def write_sorted(rows: DataFrame, crc: str, folder: str, files: int = 150) -> DataFrame:
    """Write rows (readable again and alike) as files of 1 + n // files consecutive rows, and return (file_no, path, first_key, last_key, n), materialized.

    crc is the long column that leads the order and is not written. Keys are cut at 13 bytes.
    """
    names = [c for c in rows.columns if c != crc]
    columns = [f"c{i}" for i in range(len(names))]  # inside tasks, as names may hold dots
    rows = rows.select(F.col(f"`{crc}`").alias("crc"), *[F.col(f"`{c}`").alias(x) for c, x in zip(names, columns)])
    n = rows.count()
    each = 1 + n // files
    # A sixteenth of a file keeps what straddles two files small.
    most = max(LEAST_ROWS, min(each // 16, BUCKET_ROWS), -(-4 * n // MOST_BUCKETS))
    found = buckets(rows, columns, most) if n else []
    starts, sizes, same = [b[0] for b in found], np.array([b[1] for b in found], np.int64), [b[2] for b in found]
    ranks = np.cumsum(sizes) - sizes
    low, high = ranks // each, (ranks + np.maximum(sizes, 1) - 1) // each
    fields = [T.StructField("file_no", T.IntegerType()), T.StructField("bucket", T.IntegerType()), *rows.schema.fields]

    def route(batches):
        sent: set[int] = set()
        for t in batches:
            keys = as_list(encoded(t.column(0).to_numpy().astype(np.uint32), t.columns[1:]))
            b = np.array([bisect.bisect_right(starts, k) - 1 for k in keys], np.int64)
            many = high[b] - low[b] + 1
            for i in np.flatnonzero(many > 1).tolist():
                if same[b[i]]:
                    many[i] = 0 if int(b[i]) in sent else many[i]
                    sent.add(int(b[i]))
            row = np.repeat(np.arange(len(b)), many)
            file_no = ranges(low[b], many)
            out = t.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(file_no, pa.int32()), pa.array(b[row], pa.int32()), *out.columns], names=["file_no", "bucket", *t.schema.names])

    def write(batches):
        now, file, bucket, held, edge, report = None, None, None, [], [b"", b""], []

        def settle():
            """The rows of one bucket in order, those of this file."""
            nonlocal held
            t, held = pa.Table.from_batches(held), []
            begin, end = (int(x) for x in (ranks[bucket], ranks[bucket] + sizes[bucket]))
            lo, hi = max(begin, now * each), min(end, (now + 1) * each)
            data = t.select(columns)
            if same[bucket] and high[bucket] > low[bucket]:
                order = np.zeros(hi - lo, np.int64)
            else:
                order = counted_order(encoded(t.column("crc").to_numpy().astype(np.uint32), data.columns))[lo - begin : hi - begin]
            for at in range(0, len(order), WRITE_ROWS):
                file.add(data.take(pa.array(order[at : at + WRITE_ROWS])).rename_columns(names))
            ends = t.take(pa.array(order[[0, -1]]))
            first, last = as_list(encoded(ends.column("crc").to_numpy().astype(np.uint32), ends.select(columns).columns[:1]))
            edge[:] = [edge[0] or first, last]

        try:
            for t in batches:
                f, b = t.column(0).to_numpy(), t.column(1).to_numpy()
                cuts = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (b[1:] != b[:-1])])) if len(f) else []
                for a, z in zip(cuts, [*cuts[1:], len(f)]):
                    if held and (f[a], b[a]) != (now, bucket):
                        settle()
                    if f[a] != now:
                        if file:
                            file.close()
                            report.append((now, file.path, *edge, file.n))
                        now, edge = int(f[a]), [b"", b""]
                        file = FileInWork(f"{folder}/{now:05d}.parquet", pa.schema([t.schema.field(c).with_name(x) for c, x in zip(columns, names)]))
                    bucket = int(b[a])
                    held.append(t.slice(a, z - a).select([*columns, "crc"]))
            if file:
                settle()
                file.close()
                report.append((now, file.path, *edge, file.n))
        except BaseException:
            if file:
                file.abort()
            raise
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in report], k) for i, k in enumerate((pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64()))], names=["file_no", "path", "first_key", "last_key", "n"])

    last = int(high[-1]) + 1 if len(high) else 1
    parts = min(last, 1 + n // TASK_ROWS)
    sent_ = rows.mapInArrow(route, T.StructType(fields)).repartitionById(parts, F.floor(F.col("file_no") * parts / last).cast("int")).sortWithinPartitions("file_no", "bucket")
    return materialize(sent_.mapInArrow(write, "file_no int, path string, first_key binary, last_key binary, n long"))


# erasure


def rewrite(written: DataFrame, victims: DataFrame, name: str, id_col: str, measure: str, further=None, width: int = 4) -> DataFrame:
    """Erase the rows whose id_col is a victim, file by file, and report every file that is left, materialized.

    victims: (crc, id), each id once or more often. written: what write_sorted has
    returned, whose keys' first `width` bytes (4: crc; 13: crc and a first column that
    is id_col) send a victim to the files that may hold it, so that a task holds the
    sorted victims of its own file only. further: a function of a batch that marks
    further rows to erase.
    """
    found_ = written.collect()  # as many as the layout has
    n_rows = sum(r["n"] for r in found_)
    files = sorted((r["file_no"], r["path"], bytes(r["first_key"])[:width], bytes(r["last_key"])[:width]) for r in found_)
    first, last, numbers, paths = [f[2] for f in files], [f[3] for f in files], [f[0] for f in files], {f[0]: f[1] for f in files}

    def route(batches):
        for t in batches:
            ids = t.column(1)
            keys = [k[:width] for k in as_list(encoded(t.column(0).to_numpy().astype(np.uint32), [ids]))]
            lo = np.array([bisect.bisect_left(last, k) for k in keys], np.int64)
            many = np.maximum(np.array([bisect.bisect_right(first, k) for k in keys], np.int64) - lo, 0)
            row = np.repeat(np.arange(len(keys)), many)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(numbers, np.int32)[ranges(lo, many)]), ids.cast(pa.int64()).take(pa.array(row))], names=["file_no", "id"])

    def one(file_no: int, gone: np.ndarray) -> dict | None:
        gone = np.unique(gone)
        fs, path = place(paths[file_no])

        def marked(t: pa.RecordBatch) -> np.ndarray:
            x = t.column(id_col).fill_null(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(gone, x), max(len(gone) - 1, 0))
            hit = (gone[at] == x) if len(gone) else np.zeros(len(x), bool)
            hit &= np.asarray(t.column(id_col).is_valid())
            return hit | further(t) if further else hit

        with fs.open_input_file(path) as source:
            parquet = pq.ParquetFile(source)
            columns, measures = parquet.schema_arrow.names, [measure]
            need = list(dict.fromkeys([id_col, *getattr(further, "columns", [])]))
            found = sum(int(marked(t).sum()) for t in parquet.iter_batches(WRITE_ROWS, columns=need))
            ids, cents, left = hashlib.sha256(), 0, 0
            target = FileInWork(path.removesuffix(".parquet") + "-kept.parquet", parquet.schema_arrow) if 0 < found < parquet.metadata.num_rows else None
            if found == parquet.metadata.num_rows:
                return {"file_no": file_no, "n_rows": 0, "n_erased": found, "cents": 0, "rewritten": True, "ids_sha256": "", "columns": "", "path": "", "old": path}
            try:
                for t in parquet.iter_batches(WRITE_ROWS, columns=None if target else list(dict.fromkeys([columns[0], *need, *measures]))):
                    if target:
                        t = t.filter(pa.array(~marked(t)))
                        target.add(pa.Table.from_batches([t]))
                    if len(t):
                        text = ",".join(pc.fill_null(pc.cast(t.column(columns[0]), pa.string()), "").to_pylist())
                        ids.update((b"," if left else b"") + text.encode())
                        x = t.column(measure).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
                        cents += int(np.floor(100 * x[np.isfinite(x)] + 0.5).astype(np.int64).sum())
                        left += len(t)
                if target:
                    target.close()
            except BaseException:
                if target:
                    target.abort()
                raise
        return {"file_no": file_no, "n_rows": left, "n_erased": found, "cents": cents, "rewritten": found > 0, "ids_sha256": ids.hexdigest(), "columns": ",".join(columns), "path": target.path if target else path, "old": path if target else ""}

    schema = T._parse_datatype_string("file_no long, n_rows long, n_erased long, cents long, rewritten boolean, ids_sha256 string, columns string, path string, old string")
    arrow = pa.schema([("file_no", pa.int64()), ("n_rows", pa.int64()), ("n_erased", pa.int64()), ("cents", pa.int64()), ("rewritten", pa.bool_()), ("ids_sha256", pa.string()), ("columns", pa.string()), ("path", pa.string()), ("old", pa.string())])

    def erase(batches):
        now, gone = None, []
        for t in batches:
            f = t.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else []
            for a, z in zip(cuts, [*cuts[1:], len(f)]):
                if now is not None and f[a] != now:
                    yield pa.RecordBatch.from_pylist([one(now, np.concatenate(gone))], arrow)
                    gone = []
                now = int(f[a])
                gone.append(t.column(1).slice(a, z - a).drop_null().to_numpy())
        if now is not None:
            yield pa.RecordBatch.from_pylist([one(now, np.concatenate(gone))], arrow)

    sent = victims.select("crc", "id").mapInArrow(route, "file_no int, id long").unionByName(written.select("file_no", F.lit(None).cast("long").alias("id")))
    parts, last = max(1, min(len(files), 1 + n_rows // TASK_ROWS)), 1 + max(numbers, default=0)
    sent = sent.repartitionById(parts, F.floor(F.col("file_no") * parts / last).cast("int")).sortWithinPartitions("file_no", "id")
    out = materialize(sent.mapInArrow(erase, schema))
    for r in out.filter("old <> ''").select("old").collect():  # all tasks have ended; as many as the layout has files
        removed(r["old"])
    return out.filter("n_rows > 0").drop("old").withColumn("table_name", F.lit(name))


def crc_of(x: Column) -> Column:
    return F.crc32(F.coalesce(x.cast("string"), F.lit("")).cast("binary"))


def victim_clients(clients: DataFrame, clicks: DataFrame, share: int = SHARE) -> tuple[DataFrame, int | None]:
    """(crc, id) of the clients whose master is a victim, and the one master with most clicks rows (None without masters)."""
    owned = clients.filter("master_id IS NOT NULL").select("client_id", "master_id").distinct()
    counts = clicks.filter("client_id IS NOT NULL").groupBy(F.col("client_id").alias("c_")).agg(F.count(F.lit(1)).alias("n"))
    per_master = owned.join(counts, F.col("client_id") == F.col("c_"), "left").groupBy("master_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    top = per_master.orderBy(F.desc("n"), "master_id").limit(1).collect()
    top = top[0]["master_id"] if top else None
    hit = crc_of(F.col("master_id")) % share == 0
    if top is not None:
        hit = hit | (F.col("master_id") == top)
    gone = owned.filter(hit & F.col("client_id").isNotNull()).select("client_id").distinct()
    return gone.select(crc_of(F.col("client_id")).alias("crc"), F.col("client_id").alias("id")), top


def of_victim_master(top: int | None, share: int = SHARE):
    """Marks client rows without an id whose master is a victim."""

    def marks(t: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(len(t), bool)
        for i in np.flatnonzero(~np.asarray(t.column("client_id").is_valid())).tolist():
            m = t.column("master_id")[i].as_py()
            out[i] = m is not None and (m == top or zlib.crc32(str(m).encode()) % share == 0)
        return out

    marks.columns = ["master_id"]
    return marks


def cascade(spark: SparkSession, clients: DataFrame, clicks: DataFrame, sales: DataFrame, lines: DataFrame, folder: str | None = None, files: int = 150, share: int = SHARE) -> DataFrame:
    """Write the four tables as ordered files in a new folder, erase the victims from them, and report the files that are left.

    A sale's lines follow it by sale_id; of several sales of one id the smallest
    client_id leads the order of the lines, and a line goes if any of them goes.
    """
    folder = (folder or scratch(spark)).rstrip("/")
    gone, top = victim_clients(clients, clicks, share)
    gone = materialize(gone)
    sold = sales.filter("sale_id IS NOT NULL")
    gone_sales = materialize(sold.join(gone.select("id"), F.col("client_id") == F.col("id"), "left_semi").select(F.col("sale_id").alias("id")).distinct())
    owner = materialize(sold.groupBy(F.col("sale_id").alias("s_")).agg(F.min("client_id").alias("c_")))
    key = fresh(["crc"], clients.columns + clicks.columns + sales.columns + lines.columns)[0]
    by_owner = lines.join(owner, F.col("sale_id") == F.col("s_"), "left").select(*[F.col(f"`{c}`") for c in lines.columns], crc_of(F.col("c_")).alias(key))
    gone_lines = gone_sales.join(owner, F.col("id") == F.col("s_")).select(crc_of(F.col("c_")).alias("crc"), "id")
    placed = materialize(by_owner)
    plan = [
        ("clients", clients.withColumn(key, crc_of(F.col("client_id"))), gone, "client_id", "balance", of_victim_master(top, share), 4),
        ("clicks", clicks.withColumn(key, crc_of(F.col("client_id"))), gone, "client_id", "value", None, 4),
        ("sales", sales.withColumn(key, crc_of(F.col("client_id"))), gone, "client_id", "total", None, 4),
        ("sale_lines", placed, gone_lines, "sale_id", "amount", None, 13 if lines.columns[0] == "sale_id" else 4),
    ]
    out = None
    for name, rows, victims, id_col, measure, further, width in plan:
        written = write_sorted(rows, key, f"{folder}/{name}", files)
        part = rewrite(written, victims, name, id_col, measure, further, width)
        out = part if out is None else out.unionByName(part)
        discard(written)
    discard(placed, gone, gone_sales, owner)
    return out
