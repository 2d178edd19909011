"""Delimited text by ranges of bytes: several tasks read one file, with quoted line feeds, and give the rows that one would.

A range is moved to the next line feed, so at its begin the parser is either before
a record or inside quotes. Three small jobs precede the rows: which encodings every
range fits; for both states at its begin, how many records begin in a range and
whether it ends inside quotes; and, file by file over one short row for each range,
which state holds and how many records came before. Then each task parses the
records that begin in its range, and reads on to the end of the last one.

Paths are of a file system that all executors mount.
"""

from __future__ import annotations

import csv
import os
import sys
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.operators.written import cut

#: Bytes of a range.
RANGE_BYTES = 64 << 20
#: A line that no file has.
MARK = "\x01\x02end\x02\x01"


def lines(path: str, begin: int, end: int | None) -> Iterator[bytes]:
    """Lines that begin in [begin, end) of a file; to its end without end."""
    with open(path, "rb") as f:
        if begin:
            f.seek(begin - 1)
            f.readline()
        while end is None or f.tell() < end:
            line = f.readline()
            if not line:
                return
            yield line


def text_lines(path: str, begin: int, end: int | None, encoding: str) -> Iterator[str]:
    """Decoded lines without zero bytes and byte order mark; bytes that do not fit are dropped."""
    for i, line in enumerate(lines(path, begin, end)):
        text = line.decode(encoding.removesuffix("-sig"), "ignore").replace("\x00", "")
        yield text.removeprefix("﻿") if begin == 0 and i == 0 else text


def records(texts: Iterator[str], sep: str, inside: bool) -> Iterator[list[str]]:
    """Records of lines; inside: the first one is the rest of a record that began inside quotes."""
    csv.field_size_limit(sys.maxsize)
    if inside:
        first = next(texts, None)
        texts = chain(['"' + first] if first is not None else [], texts)
    return csv.reader(texts, delimiter=sep)


def counted(path: str, begin: int, end: int, sep: str, encoding: str, inside: bool) -> tuple[int, bool]:
    """(records that begin in a range, whether it ends inside quotes) if it begins inside quotes or not."""
    texts = text_lines(path, begin, end, encoding)
    first = next(texts, None)
    if first is None:
        return 0, inside  # a long line goes over the whole range
    n, last = 0, None
    for last in records(chain([first], texts, [MARK]), sep, inside):  # noqa: B007
        n += 1
    closed = last == [MARK]
    return n - closed - inside, not closed


def sniffed(path: str, encoding: str) -> str:
    head = "".join(islice(text_lines(path, 0, None, encoding), 64))[:1024]
    try:
        return csv.Sniffer().sniff(head, ",;\t|").delimiter
    except csv.Error:
        return ","


def ranges_of(spark: SparkSession, files: list[str], size: int) -> DataFrame:
    """(file_no, file, k, begin, end): at least one range for each file."""
    sized = spark.createDataFrame([(i, f, os.path.getsize(f)) for i, f in enumerate(files)], "file_no int, file string, bytes long")
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("bytes") / size) - 1, F.lit(0)).cast("int"))
    t = sized.select("file_no", "file", F.explode(cuts).alias("k"))
    n = sum(max(1, -(-os.path.getsize(f) // size)) for f in files)
    return t.select("file_no", "file", "k", (F.col("k").cast("long") * size).alias("begin"), ((F.col("k").cast("long") + 1) * size).alias("end")).repartition(max(1, n), "file_no", "k")


def encodings(spark: SparkSession, files: list[str], ladder: tuple[str, ...], size: int = RANGE_BYTES) -> dict[str, str]:
    """The first encoding of the ladder that all bytes of a file fit, for each file; the last one, if none does."""

    def fits(batches):
        for t in batches:
            out = []
            for file_no, path, begin, end in zip(*[t.column(i).to_pylist() for i in (0, 1, 3, 4)]):
                left = list(ladder)
                for line in lines(path, begin, end):
                    for e in list(left):
                        try:
                            line.decode(e)
                        except UnicodeDecodeError:
                            left.remove(e)
                out.append((file_no, [e in left for e in ladder]))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.list_(pa.bool_()))], names=["file_no", "fit"])

    found = ranges_of(spark, files, size).mapInArrow(fits, "file_no int, fit array<boolean>")
    all_fit = found.groupBy("file_no").agg(*[F.min(F.get("fit", F.lit(i))).alias(str(i)) for i in range(len(ladder))])
    return {files[r["file_no"]]: next((e for i, e in enumerate(ladder) if r[str(i)]), ladder[-1]) for r in all_fit.collect()}  # a row for each file


def read_ranges(spark: SparkSession, files: list[str], ladder: tuple[str, ...], sep: str | None = None, long_rows: str = "cut", size: int = RANGE_BYTES, limit: int | None = None) -> DataFrame:
    """Text columns by the first file's header, row_no (2 for the first record after the header) and source_file.

    Short rows are padded with '' and long ones cut; with long_rows='drop' short ones
    get nulls, long ones go and empty values are null. Empty records go. limit keeps the
    first rows in the order of files and rows.
    """
    if not files:
        raise ValueError("no files")
    codes = encodings(spark, files, ladder, size)
    seps = {f: sep or sniffed(f, codes[f]) for f in files}
    header = next(records(text_lines(files[0], 0, None, codes[files[0]]), seps[files[0]], False), [])
    names, width, drop = [c.strip() for c in header], len(header), long_rows == "drop"

    def states(batches):
        for t in batches:
            rows = []
            for file_no, path, k, begin, end in zip(*[c.to_pylist() for c in t.columns]):
                ways = [counted(path, begin, end, seps[path], codes[path], inside) for inside in (False, True)]
                rows.append((file_no, path, k, begin, end, ways[0][0], ways[0][1], ways[1][0], ways[1][1]))
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)] if rows else [pa.array([], kind) for kind in kinds], names=["file_no", "file", "k", "begin", "end", "n_out", "end_out", "n_in", "end_in"])

    def scan(t: pa.Table) -> pa.Table:
        """The state at the begin of each range of a file, and the records before it."""
        t = t.sort_by("k")
        inside, before, out = False, 0, ([], [], [])
        for n_out, end_out, n_in, end_in in zip(*[t.column(c).to_pylist() for c in ("n_out", "end_out", "n_in", "end_in")]):
            n = n_in if inside else n_out
            for o, v in zip(out, (inside, before, n)):
                o.append(v)
            inside, before = (end_in if inside else end_out), before + n
        return pa.table({"file_no": t.column("file_no"), "file": t.column("file"), "k": t.column("k"), "begin": t.column("begin"), "inside": pa.array(out[0], pa.bool_()), "before": pa.array(out[1], pa.int64()), "n": pa.array(out[2], pa.int64())})

    found = ranges_of(spark, files, size).mapInArrow(states, "file_no int, file string, k int, begin long, end long, n_out long, end_out boolean, n_in long, end_in boolean")
    placed = cut(found.groupBy("file_no").applyInArrow(scan, "file_no int, file string, k int, begin long, inside boolean, before long, n long"))

    def parse(batches):
        kinds = [pa.string()] * width + [pa.int64(), pa.string(), pa.int32()]
        for t in batches:
            for file_no, path, begin, inside, before, n in zip(*[t.column(c).to_pylist() for c in ("file_no", "file", "begin", "inside", "before", "n")]):
                rows = islice(records(text_lines(path, begin, None, codes[path]), seps[path], inside), int(inside), int(inside) + n)
                held, name = [], os.path.basename(path)
                for no, row in enumerate(rows, before + 1):
                    if no == 1 or not row or (drop and len(row) > width):
                        continue
                    row = [*row[:width], *([None if drop else ""] * (width - len(row)))]
                    held.append((*((x if x != "" or not drop else None) for x in row), no, name, file_no))
                    if len(held) == 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*held), kinds)], names=[*map(str, range(width)), "row_no", "source_file", "file_no"])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*held), kinds)], names=[*map(str, range(width)), "row_no", "source_file", "file_no"])

    schema = ", ".join(f"`{i}` string" for i in range(width)) + (", " if width else "") + "row_no long, source_file string, file_no int"
    parts = max(1, placed.count())
    out = placed.filter("n > 0").repartition(parts, "file_no", "k").mapInArrow(parse, schema)
    if limit is not None:
        out = out.orderBy("file_no", "row_no").limit(limit)
    return out.select(*[F.col(f"`{i}`").alias(c) for i, c in enumerate(names)], "row_no", "source_file")
