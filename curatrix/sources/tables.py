"""Sources and sinks: delimited text with tolerant parsing, spreadsheets, JSON and chunked files.

The tolerant CSV and the spreadsheet reader are Python data sources: one partition
for each file, rows stream out, nothing is read on the driver but the header.
Register them with `register(spark)`.
"""

from __future__ import annotations

import csv
import glob
import io
import os
import re
import time
import zipfile
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from curatrix.sources import ranges
from curatrix.sources.sinks import MarkedCsv, WorkbookWriter, write_csv, write_workbook, write_xlsx  # noqa: F401

# Encodings that are tried, in order.
ENCODINGS = ("utf-8-sig", "gbk", "gb18030", "gb2312", "latin1")
NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def files_of(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(f for f in glob.glob(f"{path}/*") if os.path.isfile(f) and not os.path.basename(f).startswith(("_", ".")))
    return sorted(glob.glob(path))


def decoded(raw: bytes) -> str:
    """Text in the first encoding that fits; bad bytes of UTF-8 are dropped in the end."""
    for e in ENCODINGS:
        try:
            return raw.decode(e)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", errors="ignore")


class TolerantCsv(DataSource):
    """format('tolerant_csv'): options path, sep (sniffed if absent), long_rows 'cut' or 'drop'. Short rows are padded with '' ('cut') or null ('drop')."""

    @classmethod
    def name(cls) -> str:
        return "tolerant_csv"

    def _rows(self, path: str):
        with open(path, "rb") as f:
            text = decoded(f.read())
        sep = self.options.get("sep")
        if not sep:
            try:
                sep = csv.Sniffer().sniff(text[:1024], ",;\t|").delimiter
            except csv.Error:
                sep = ","
        return csv.reader(io.StringIO(text.replace("\x00", "")), delimiter=sep)

    def schema(self) -> str:
        header = next(iter(self._rows(files_of(self.options["path"])[0])))
        return ", ".join(f"`{c.strip()}` string" for c in header) + ", row_no long, source_file string"

    def reader(self, schema) -> DataSourceReader:
        return _CsvReader(self, len(schema.fields) - 2)


class _CsvReader(DataSourceReader):
    def __init__(self, source: TolerantCsv, width: int):
        self.source, self.width = source, width

    def partitions(self):
        return [InputPartition(f) for f in files_of(self.source.options["path"])]

    def read(self, partition):
        drop, w = self.source.options.get("long_rows") == "drop", self.width
        rows = self.source._rows(partition.value)
        next(rows, None)
        for no, row in enumerate(rows, 2):
            if not row or (drop and len(row) > w):
                continue
            row = [*row[:w], *([None if drop else ""] * (w - len(row)))]
            yield (*((x if x != "" or not drop else None) for x in row), no, os.path.basename(partition.value))


def _cells(book: zipfile.ZipFile):
    """Rows of the first sheet as lists of text (None where there is no cell)."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
            shared.append("".join(t.text or "" for t in si.iter(f"{NS}t")))
    sheets = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n.rsplit("/", 1)[1])))
    for _, row in ElementTree.iterparse(io.BytesIO(book.read(sheets[0]))):
        if row.tag != f"{NS}row":
            continue
        out: list[str | None] = []
        for c in row:
            at = 0
            for ch in re.match(r"[A-Z]*", c.get("r") or "")[0]:
                at = at * 26 + ord(ch) - 64
            at = at or len(out) + 1
            out += [None] * (at - len(out))
            v = c.find(f"{NS}v")
            if c.get("t") == "inlineStr":
                out[at - 1] = "".join(t.text or "" for t in c.iter(f"{NS}t"))
            elif v is not None and v.text is not None:
                out[at - 1] = shared[int(v.text)] if c.get("t") == "s" else re.sub(r"^(-?\d+)\.0$", r"\1", v.text)
        yield out
        row.clear()


class Spreadsheet(DataSource):
    """format('xlsx'): first sheet with a header row, all columns text, plus row_no (2 for the first data row) and source_file. Writes a workbook a task; see sinks."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        with zipfile.ZipFile(files_of(self.options["path"])[0]) as book:
            header = next(iter(_cells(book)), [])
        return ", ".join(f"`{c or f'column_{i}'}` string" for i, c in enumerate(header)) + ", row_no long, source_file string"

    def reader(self, schema) -> DataSourceReader:
        return _SheetReader(self.options["path"], len(schema.fields) - 2)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WorkbookWriter(self.options, [f.name for f in schema.fields], overwrite)


class _SheetReader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def partitions(self):
        return [InputPartition(f) for f in files_of(self.path)]

    def read(self, partition):
        with zipfile.ZipFile(partition.value) as book:
            for no, row in enumerate(_cells(book), 1):
                if no > 1:
                    yield (*row[: self.width], *[None] * (self.width - len(row)), no, os.path.basename(partition.value))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TolerantCsv)
    spark.dataSource.register(Spreadsheet)
    spark.dataSource.register(MarkedCsv)


def read_csv(spark: SparkSession, path: str, sep: str = ",", limit: int | None = None) -> DataFrame:
    """Plain CSV with a header: UTF-8 with or without a mark, quoted line feeds; limit keeps the first rows in file order."""
    if limit is None:
        return spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')
    return read_large_csv(spark, path, sep, long_rows="drop", limit=limit).drop("row_no", "source_file")


def read_large_csv(spark: SparkSession, path: str, sep: str | None = None, long_rows: str = "cut", limit: int | None = None, size: int = ranges.RANGE_BYTES) -> DataFrame:
    """Tolerant CSV whose files are read by several tasks each, in ranges of `size` bytes; see ranges.read_ranges."""
    return ranges.read_ranges(spark, files_of(path), ENCODINGS, sep, long_rows, size, limit)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By extension: CSV (tolerant if the encoding isn't UTF-8), JSON lines, Parquet or spreadsheet."""
    ext = path.rsplit(".", 1)[-1].lower()
    if ext in ("jsonl", "json"):
        return spark.read.json(path)
    if ext == "parquet":
        return spark.read.parquet(path)
    register(spark)
    if ext == "xlsx":
        return spark.read.format("xlsx").load(path)
    if ext == "csv":
        if "://" in path and not path.startswith("file://") or set(ranges.encodings(spark, files_of(path), ENCODINGS).values()) == {"utf-8-sig"}:
            return read_csv(spark, path)
        return read_large_csv(spark, path)
    raise ValueError(f"unknown kind of file {path}")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_many(spark: SparkSession, paths: list[str], required: tuple[str, ...] = ()) -> DataFrame:
    """Union by name of all files that are there and have the required columns, with source_file; the rest are skipped with a warning."""
    import warnings

    frames = []
    for p in paths:
        found = files_of(p)
        if not found:
            warnings.warn(f"{p} is missing", stacklevel=2)
        for f in found:
            try:
                df = read_table(spark, f)
            except (OSError, ValueError, csv.Error, zipfile.BadZipFile, ElementTree.ParseError, PySparkException) as e:  # an unreadable file is skipped, as stated
                warnings.warn(f"{f} can't be read: {str(e)[:200]}", stacklevel=2)
                continue
            if set(required) - set(df.columns):
                warnings.warn(f"{f} lacks {sorted(set(required) - set(df.columns))}", stacklevel=2)
                continue
            frames.append(df if "source_file" in df.columns else df.withColumn("source_file", F.lit(os.path.basename(f))))
    if not frames:
        raise ValueError("no file could be read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def export_csv_file(df: DataFrame, path: str, sep: str = ",") -> None:
    """One local file with a byte order mark, rows streamed through the driver (for reports that a person opens)."""
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, delimiter=sep)
        out.writerow(df.columns)
        out.writerows(df.toLocalIterator())


def write_document(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)


def write_chunks(df: DataFrame, path: str, order: list[str], size: int, fmt: str = "parquet") -> None:
    """Files of `size` rows in order, in folders chunk_id=..."""
    from curatrix.operators.frequency import chunked

    chunked(df, order, size).write.mode("overwrite").partitionBy("chunk_id").format(fmt).save(path)


def export_dated(df: DataFrame, base: str, workspace: str, day: str, fmt: str = "csv") -> str:
    """Write to base/workspace/YYYY-MM-DD and return that path."""
    path = f"{base.rstrip('/')}/{workspace}/{day}"
    w = df.write.mode("overwrite").format(fmt)
    (w.option("header", True) if fmt == "csv" else w).save(path)
    return path


def scored_by_model(df: DataFrame, client, text: str = "text", tries: int = 3, wait: float = 0.5, at_once: int = 4, answers: str | None = None) -> DataFrame:
    """df plus response: an injected client (text -> JSON text) called in the tasks, null after `tries` failures; equal texts are asked once.

    Between tries a task waits `wait` seconds, twice as long each time; it has at_once
    calls in flight. With a folder of answers, what was answered is kept there under
    the SHA-256 of the text, and a later run asks only for what is missing.
    """
    from curatrix.operators.written import cut

    h = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)
    asked = df.select(h.alias("h"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("x")).groupBy("h").agg(F.first("x").alias("x"))
    known = None
    if answers and os.path.exists(answers.removeprefix("file:")):
        known = df.sparkSession.read.schema("h string, response string").parquet(answers)
        asked = asked.join(known, "h", "left_anti")

    def ask(x):
        for k in range(tries):
            try:
                return client(x)
            except Exception:  # the client's own errors; the row gets null in the end
                if k + 1 < tries:
                    time.sleep(wait * 2**k)
        return None

    def run(batches):
        with ThreadPoolExecutor(at_once) as pool:
            for t in batches:
                yield pa.RecordBatch.from_arrays([t.column(0), pa.array(list(pool.map(ask, t.column(1).to_pylist())), pa.string())], names=["h", "response"])

    new = cut(asked.mapInArrow(run, "h string, response string"))  # the client is asked once, whatever reads the result
    if answers:
        new.filter("response IS NOT NULL").write.mode("append").parquet(answers)
    got = new if known is None else new.unionByName(known)
    key, value = ("h_", "response_")
    got = got.select(F.col("h").alias(key), F.col("response").alias(value))
    return df.join(got, h == F.col(key), "left").select(*[F.col(f"`{c}`") for c in df.columns], F.col(value).alias("response"))
