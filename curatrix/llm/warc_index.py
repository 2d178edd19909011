"""Pages as WARC archives, read back into an index of captures in order of URL key and time.

**Archives.** Each task writes its pages as gzip members of one WARC 1.1 file, which
begins with a warcinfo record. Of the pages with equal payloads (told apart by
SHA-256) of at least `least` bytes, the one with the largest page_id is a response
record and the others are revisit records without the payload that refer to it; a
record holds the HTTP head and the payload's SHA-1 in base 32.

**Index.** Reading an archive back checks every digest and leaves runs of captures
sorted by URL key (host parts from last to first, then path and query), time and
page_id. A bounded sample of their keys cuts the order into ranges; each run knows
where a range begins in it. For every range a loser tree merges the slices of some 32
runs while they stream; if there are more runs, what it has merged is a longer run
of the next round. Ranges cut by the whole key, so that a URL with very many captures
spreads over several. The order of ranges and rows is the order of all captures.

**Cases.** Null html is empty, and empty payloads are equal. Of repeated rows of one
page_id and payload one is the response, the others revisit the same page_id. A null
page_id is smaller than any other. A null URL has no target and the empty key. Very
long pages are one record each, held whole by their task. Empty tables give no
rows. Only the named columns are read. Pages carry no time, so a capture is dated by
page_id, a second apart, unless `date` names a timestamp column.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import beside_groups, discard, materialize, scratch, sliced
from curatrix.llm.files import FileInWork, place

#: A new archive begins after so many bytes.
ARCHIVE_BYTES = 1 << 30
#: Most captures of a run, which are sorted in memory.
RUN_ROWS = 200_000
#: Captures of a run that are read at once.
READ_ROWS = 2_048
#: Runs that are merged at once: half of it on average, more than it hardly ever.
FAN_IN = 64
#: Captures of a range, while there are at most MOST_RANGES.
RANGE_ROWS = 50_000
MOST_RANGES = 4_096
#: Keys that come to the driver to cut ranges.
SAMPLE_KEYS = 20_000
#: Date of page_id 0, where pages have no time.
START = datetime(2024, 1, 1, tzinfo=timezone.utc)
NO_ID = -(2**63)

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key binary, url_key string, captured_at timestamp, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
ARROW = pa.schema(
    [("key", pa.binary()), ("url_key", pa.string()), ("captured_at", pa.timestamp("us", tz="UTC")), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)


# records


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_value(s: str) -> str:
    """A URI without spaces and control characters, which would end a header line."""
    return re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), s)


def url_key(url: str) -> str:
    """Host parts from last to first, then path and query: http://www.a.org/x?y is org,a,www)/x?y."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)(?::(\d*))?([^#]*)", url)
    if not m:
        return url.partition("#")[0]
    host = ",".join(reversed(m[1].lower().split(".")))
    return f"{host}{':' + m[2] if m[2] and m[2] not in ('80', '443') else ''}){m[3] or '/'}"


def member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", "sha1:" + base32_sha1(block)), ("Content-Length", len(block))] if v is not None) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode()).digest(), version=4)}>"


def iso(at: datetime) -> str:
    return at.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def page_record(page_id: int | None, url: str | None, payload: bytes, identity: bytes, at: datetime, refers: tuple[int | None, str | None, datetime] | None, serial: object) -> bytes:
    """A response, or a revisit that refers to the response of (page_id, url, date) with the same payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    own = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", record_id("revisit", serial) if refers else record_id(identity, page_id)),
        ("WARC-Date", iso(at)),
        ("WARC-Target-URI", None if url is None else header_value(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
        ("Page-ID", page_id),
    ]
    if not refers:
        return member(own, http + payload)
    to, to_url, to_at = refers
    return member([*own, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(identity, to)), ("WARC-Refers-To-Target-URI", None if to_url is None else header_value(to_url)), ("WARC-Refers-To-Date", iso(to_at)), ("Refers-To-Page-ID", to)], http)


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of a file, read from begin to end."""
    at, rest = 0, b""
    while True:
        if not rest:
            rest = stream.read(chunk)
            if not rest:
                return
        undo, parts, size = zlib.decompressobj(wbits=31), [], 0
        while not undo.eof:
            if not rest:
                rest = stream.read(chunk)
                if not rest:
                    raise ValueError("the archive ends inside a record")
            parts.append(undo.decompress(rest))
            size += len(rest) - len(undo.unused_data)
            rest = undo.unused_data
        yield at, size, b"".join(parts)
        at += size


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """(named fields in lower case, block) of a record."""
    head, sep, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if fields.get("warc-block-digest", "sha1:" + base32_sha1(block)) != "sha1:" + base32_sha1(block):
        raise ValueError(f"the block of {fields.get('warc-record-id')} does not have its digest")
    return fields, block


def capture(fields: dict[str, str], block: bytes) -> tuple:
    """Key, URL key, time, page_id, payload bytes and digest, type and refers_to of a response or revisit record."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))[15:])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} does not have its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    at = datetime.strptime(fields["warc-date"], "%Y-%m-%dT%H:%M:%S.%fZ").replace(tzinfo=timezone.utc)
    key, page = url_key(fields.get("warc-target-uri", "")), number("page-id")
    order = key.encode() + b"\0" + (int((at - START) / timedelta(microseconds=1)) + 2**63).to_bytes(8, "big") + ((NO_ID if page is None else page) + 2**63).to_bytes(8, "big")
    return order, key, at, page, size, digest, fields["warc-type"], number("refers-to-page-id")


# archives


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files in folder and return (archive, n, bytes), materialized.

    Only ids, URLs and hashes are shuffled to find equal payloads; pages move once, by
    hash and page_id, so that repeated rows of a page come to one task.
    """
    x = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    made = F.col(f"`{date}`").cast("timestamp") if date else F.timestamp_seconds(F.lit(int(START.timestamp())) + F.coalesce(F.pmod(F.col("page_id"), F.lit(1 << 28)), F.lit(0)))
    full = pages.select("page_id", "url", x.alias("x"), made.alias("made"), F.unhex(F.sha2(x, 256)).alias("h"), F.coalesce("page_id", F.lit(NO_ID)).alias("id"))
    thin = materialize(full.filter(F.octet_length("x") >= least).select("h", "id", "url", "made"))
    top = F.max("id").alias("to"), F.max_by("url", "id").alias("to_url"), F.max_by("made", "id").alias("to_made")
    shared = beside_groups(thin, "h", *top).filter("to IS NOT NULL").groupBy(F.col("h").alias("h_"), F.col("id").alias("id_")).agg(*[F.first(c).alias(c) for c in ("to", "to_url", "to_made")])
    rows = full.repartition("h", "id").join(shared, (F.col("h") == F.col("h_")) & (F.col("id") == F.col("id_")), "left").select("page_id", "url", "x", "made", "h", "to", "to_url", "to_made")

    def write(batches):
        file = None
        seen: set[bytes] = set()
        made_files = []
        try:
            for t in sliced(batches, 500):
                for page, url, payload, at, h, to, to_url, to_at in zip(*[c.to_pylist() for c in t.columns]):
                    mine = NO_ID if page is None else page
                    refers = None
                    if to is not None:
                        if to != mine or h in seen:
                            refers = (None if to == NO_ID else to, to_url, to_at)
                        else:
                            seen.add(h)
                    if file is None:
                        file = Archive(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                    file.add(page_record(page, url, payload, h, at, refers, (file.name, file.n)))
                    if file.size >= ARCHIVE_BYTES:
                        made_files.append(file.close())
                        file = None
            if file:
                made_files.append(file.close())
        except BaseException:
            if file:
                file.abort()
            raise
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in made_files], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "n", "bytes"])

    out = materialize(rows.mapInArrow(write, "archive string, n long, bytes long"))
    discard(thin)
    return out


class Archive:
    """A WARC file that gets its name once it is whole."""

    def __init__(self, path: str):
        self.fs, self.path = place(path)
        folder, _, self.name = self.path.rpartition("/")
        self.fs.create_dir(folder, recursive=True)
        self.temp = f"{folder}/_{self.name}"
        self.stream = self.fs.open_output_stream(self.temp, compression=None)
        self.n = self.size = 0
        info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", self.name)), ("WARC-Date", iso(START)), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        self.stream.write(info)
        self.size += len(info)

    def add(self, data: bytes) -> None:
        self.stream.write(data)
        self.n += 1
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.stream.close()
        self.fs.move(self.temp, self.path)
        return self.path, self.n, self.size

    def abort(self) -> None:
        try:
            self.stream.close()
            self.fs.delete_file(self.temp)
        except OSError:
            pass


# runs


def sorted_runs(archives: DataFrame, folder: str, keys: int = 64) -> DataFrame:
    """Read archives back and return their sorted runs (path, n, sample: up to `keys` keys of the run in order), materialized."""

    def read(batches):
        for t in batches:
            for path in t.column(0).to_pylist():
                fs, name = place(path)
                made = []
                with fs.open_input_stream(name, compression=None) as stream:
                    held = []
                    for offset, length, content in members(stream):
                        fields, block = parsed(content)
                        if fields["warc-type"] in ("response", "revisit"):
                            held.append((*capture(fields, block), name, offset, length))
                        if len(held) == RUN_ROWS:
                            made.append(run_of(held))
                            held = []
                    if held:
                        made.append(run_of(held))
                yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate((pa.string(), pa.int64(), pa.list_(pa.binary())))], names=["path", "n", "sample"])

    def run_of(held: list) -> tuple[str, int, list[bytes]]:
        held.sort(key=lambda r: r[0])
        path = written_run(f"{folder}/{uuid.uuid4().hex}.parquet", iter(held))[0]
        return path, len(held), [held[i][0] for i in sorted({int(i) for i in np.linspace(0, len(held) - 1, min(keys, len(held)))})]

    spread = archives.select("archive").repartition(max(1, archives.count()))
    return materialize(spread.mapInArrow(read, "path string, n long, sample array<binary>"))


def written_run(path: str, rows: Iterator[tuple]) -> tuple[str, int]:
    """Write rows in their order; (path, number)."""
    file = FileInWork(path, ARROW, READ_ROWS)
    try:
        for t in batches_of(rows):
            file.add(pa.Table.from_batches([t]))
        file.close()
    except BaseException:
        file.abort()
        raise
    return file.path, file.n


def batches_of(rows: Iterator[tuple], size: int = READ_ROWS) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), ARROW)], schema=ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), ARROW)], schema=ARROW)


def slice_of(path: str, first: int, n: int) -> Iterator[tuple]:
    """Rows first to first + n of a run, some at a time."""
    fs, name = place(path)
    with fs.open_input_file(name) as source:
        parquet, at = pq.ParquetFile(source), 0
        for g in range(parquet.metadata.num_row_groups):
            size = parquet.metadata.row_group(g).num_rows
            if at < first + n and at + size > first:
                lo, hi = max(first - at, 0), min(first + n - at, size)
                t = parquet.read_row_group(g).slice(lo, hi - lo)
                yield from zip(*[c.to_pylist() for c in t.columns])
            at += size


def loser_merge(streams: list[Iterator[tuple]]) -> Iterator[tuple]:
    """One stream of the rows of sorted streams, by their first item. Every inner node keeps the loser of its match, so a row costs one path of matches."""
    k = len(streams)
    heads = [next(s, None) for s in streams]
    loser, winner = [-1] * max(k, 1), -1

    def wins(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    for leaf in range(k):
        best, node = leaf, (leaf + k) // 2
        while node > 0:
            if loser[node] < 0:
                loser[node], best = best, -1
                break
            if wins(loser[node], best):
                loser[node], best = best, loser[node]
            node //= 2
        if best >= 0:
            winner = best
    while k and heads[winner] is not None:
        yield heads[winner]
        heads[winner] = next(streams[winner], None)
        best, node = winner, (winner + k) // 2
        while node > 0:
            if wins(loser[node], best):
                loser[node], best = best, loser[node]
            node //= 2
        winner = best


# merge


def cuts_of(runs: DataFrame) -> list[bytes]:
    """Keys that part all captures into ranges of some RANGE_ROWS, from a sample of at most some SAMPLE_KEYS keys; it only balances the work."""
    n_runs, n = runs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_runs:
        return []
    each = max(1, min(64, SAMPLE_KEYS // n_runs))
    some = runs.filter(F.pmod(F.xxhash64("path"), F.lit(-(-n_runs // SAMPLE_KEYS))) == 0).select(F.posexplode("sample").alias("i", "k"), "n")
    step = -(-64 // each)
    weighted = sorted((bytes(r["k"]), r["n"]) for r in some.filter(F.col("i") % step == 0).collect())
    parts = int(min(MOST_RANGES, max(1, -(-n // RANGE_ROWS))))
    if not weighted or parts == 1:
        return []
    reach = np.cumsum([w for _, w in weighted])
    return sorted({weighted[int(i)][0] for i in np.searchsorted(reach, reach[-1] * np.arange(1, parts) / parts)})


def sliced_runs(runs: DataFrame, cuts: list[bytes]) -> DataFrame:
    """(range, path, first, n, before) for each run and range that it has rows in: place and number of its rows there; before: its rows of the cut's URL that are smaller than the cut. Materialized."""

    def cut(batches):
        for t in batches:
            for path in t.column(0).to_pylist():
                fs, name = place(path)
                with fs.open_input_file(name) as source:
                    keys = pq.ParquetFile(source).read(columns=["key"]).column(0).to_pylist()
                at, same = [0], [0]
                for c in cuts:
                    at.append(bisect.bisect_left(keys, c))
                    same.append(at[-1] - bisect.bisect_left(keys, c[:-16]))
                n = np.diff([*at, len(keys)])
                keep = [i for i in range(len(n)) if n[i] or same[i]]
                yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([path] * len(keep), pa.string()), pa.array([at[i] for i in keep], pa.int64()), pa.array([int(n[i]) for i in keep], pa.int64()), pa.array([same[i] for i in keep], pa.int64())], names=["range", "path", "first", "n", "before"])

    return materialize(runs.select("path").repartition(max(1, runs.count())).mapInArrow(cut, "range int, path string, first long, n long, before long"))


def merge_runs(runs: DataFrame, folder: str, fan_in: int = FAN_IN) -> DataFrame:
    """All captures of sorted runs in order, with position (from 0, over all) and capture_no (from 1, within the URL key); partition i holds range i."""
    cuts = cuts_of(runs)
    parts = len(cuts) + 1
    slices = sliced_runs(runs, cuts)
    per_range = {r["range"]: (r["n"], r["before"]) for r in slices.groupBy("range").agg(F.sum("n").alias("n"), F.sum("before").alias("before")).collect()}  # MOST_RANGES at most
    starts = np.cumsum([0, *[per_range.get(i, (0, 0))[0] for i in range(parts)]]).tolist()
    level = slices.filter("n > 0").select("range", "path", "first", "n")
    n_runs = runs.count()
    while n_runs > fan_in:
        groups = -(-n_runs // (fan_in // 2))
        work = level.groupBy("range", F.pmod(F.xxhash64("path"), F.lit(groups)).alias("g")).agg(F.collect_list(F.struct("path", "first", "n")).alias("runs"))

        def longer(batches):
            for t in batches:
                made = []
                for r, group in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
                    made.append((r, *written_run(f"{folder}/{uuid.uuid4().hex}.parquet", loser_merge([slice_of(s["path"], s["first"], s["n"]) for s in group]))))
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.string()), pa.array([0] * len(made), pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=["range", "path", "first", "n"])

        level = materialize(work.select("range", "runs").repartition(parts * groups).mapInArrow(longer, "range int, path string, first long, n long"))
        n_runs = groups

    def merge(batches):
        for t in batches:
            for r, group in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
                position = starts[r]
                now, count = (cuts[r - 1][:-16], per_range[r][1]) if r else (None, 0)
                for b in batches_of(loser_merge([slice_of(s["path"], s["first"], s["n"]) for s in group])):
                    numbers = []
                    for k in b.column(0).to_pylist():
                        if k[:-16] != now:
                            now, count = k[:-16], 0
                        count += 1
                        numbers.append(count)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(range(position, position + len(b)), pa.int64()), pa.array(numbers, pa.int64())], names=[*b.schema.names, "position", "capture_no"])
                    position += len(b)

    work = level.groupBy("range").agg(F.collect_list(F.struct("path", "first", "n")).alias("runs"))
    return work.repartitionById(parts, "range").mapInArrow(merge, CAPTURE + ", position long, capture_no long").drop("key")


def archive_and_index(spark: SparkSession, pages: DataFrame, folder: str | None = None, least: int = 0, date: str | None = None) -> DataFrame:
    """Write pages as archives in a new folder, read them back, and return all captures in order."""
    folder = (folder or scratch(spark)).rstrip("/")
    archives = write_archives(pages, f"{folder}/archives", least, date)
    return merge_runs(sorted_runs(archives, f"{folder}/runs"), f"{folder}/runs")
