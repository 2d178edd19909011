"""Shared plumbing of the training-data operators.

Texts and candidate keys move between tasks as compressed blocks: one row holds
the numpy arrays of many documents. A shuffle then moves few, dense rows, and
each task works on whole blocks with numpy.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: doc_id of a null, inside blocks; it sorts before every other id.
NULL_ID = -(2**63)

GOLD = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
#: An odd base of the positional hash.
BASE = 0xD6E8FEB86659FD93


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(names: list[str], taken: list[str]) -> list[str]:
    """The names, each with underscores added until no column of the input has it."""
    out = []
    for n in names:
        while n in taken or n in out:
            n += "_"
        out.append(n)
    return out


def packed(columns: list[str], name: str = "d"):
    """All columns of the input as one struct, so that columns added beside it cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]).alias(name)


def unpacked(columns: list[str], name: str = "d") -> list:
    return [F.col(name).getField(c).alias(c) for c in columns]


def sliced(batches, rows: int = 1000):
    """Arrow batches in slices of at most `rows` rows, so that very long texts do not add up in the worker's arrays."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder of the session; a folder of this machine only where all of Spark is in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/curatrix/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared checkpoint folder and read back."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete materialized tables that nothing reads any more: all that came from them has been written itself."""
    for t in tables:
        path = getattr(t, "scratch_path", None)
        if path:
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: Groups with at least 1 in so many rows are hot, so that at most so many are hot.
HOT_SHARE = 10_000


def beside_groups(rows: DataFrame, key: str, *sums) -> DataFrame:
    """rows (a table that can be read again) with the sums of the rows of their key; null where the key has one row.

    Sums combine on the map side. The few keys with a ten-thousandth of all rows or
    more, at most 10,000 by that bound, are broadcast to their rows; the others meet
    in a join whose keys are small by the same bound. Null keys are not for this.
    """
    total = rows.count()
    key_c, n_c = fresh(["key", "n"], rows.columns)
    groups = rows.groupBy(F.col(key).alias(key_c)).agg(F.count(F.lit(1)).alias(n_c), *sums)
    groups = materialize(groups.filter(F.col(n_c) > 1))
    hot = groups.filter(F.col(n_c) * HOT_SHARE >= total).drop(n_c)
    rest = groups.filter(F.col(n_c) * HOT_SHARE < total).drop(n_c)
    same = F.col(key) == F.col(key_c)
    near = rows.join(F.broadcast(hot), same)
    return near.unionByName(rows.join(F.broadcast(hot), same, "left_anti").join(rest, same, "left")).drop(key_c)


def trim() -> None:
    """Give freed memory of this worker back to the system, where the C library can."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def splitmix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values (wraps modulo 2**64)."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64, kept for the next call."""
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(1 << 12, 1 << (n - 1).bit_length()), BASE, dtype=np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[:n]


def pack(*arrays: np.ndarray | bytes, level: int = 3) -> bytes:
    """Arrays and byte strings as one compressed block."""
    parts = [a if isinstance(a, (bytes, bytearray, memoryview)) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(parts))


def unpack(block: bytes) -> list[memoryview]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(block))
    n = int(np.frombuffer(raw[:8], dtype=np.int64)[0])
    sizes = np.frombuffer(raw[8 : 8 + 8 * n], dtype=np.int64)
    out, at = [], 8 + 8 * n
    for s in sizes.tolist():
        out.append(raw[at : at + s])
        at += s
    return out


def as_text_arrays(batch: pa.RecordBatch, text: str = "text", doc_id: str = "doc_id") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, bytes) of a batch; null texts are empty, null ids are NULL_ID."""
    ids = batch.column(doc_id).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
    texts = batch.column(text)
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return ids, (off - off[0]), raw


def id_array(ids: np.ndarray) -> pa.Array:
    """Ids as an Arrow column, NULL_ID as null."""
    ids = np.asarray(ids, dtype=np.int64)
    return pa.array(ids, type=pa.int64(), mask=ids == NULL_ID)


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, ... for lens[i] values each, in one array."""
    lens = np.asarray(lens, dtype=np.int64)
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lens > 0
    starts, lens = np.asarray(starts, dtype=np.int64)[keep], lens[keep]
    out = np.ones(total, dtype=np.int64)
    ends = np.cumsum(lens)
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - (starts[:-1] + lens[:-1] - 1)
    return np.cumsum(out)


#: Bytes that part words: space and \t \n \v \f \r.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the words of texts laid end to end: runs of bytes other than space and 0x09-0x0D; texts do not share words."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < n]
    begins[edges] = solid[edges]
    starts = np.flatnonzero(begins)
    ends = solid
    ends[:-1] &= begins[1:] | ~solid[1:]
    return starts, np.flatnonzero(ends) + 1 - starts


def word_hashes(raw: np.ndarray, offsets: np.ndarray, spans=None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts laid end to end, A-Z lower-cased.

    Returns (hash of each word, number of words of each text); spans: word_spans, if known.
    """
    starts, lens = word_spans(raw, offsets) if spans is None else spans
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(max(0, len(offsets) - 1), np.int64)
    h = np.empty(len(starts), np.uint64)
    # Some words at a time, as every byte takes 8 here.
    for lo in range(0, len(starts), 1 << 16):
        part, size = starts[lo : lo + (1 << 16)], lens[lo : lo + (1 << 16)]
        begin, end = part[0], part[-1] + size[-1]
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        own = raw[begin:end]
        values = _LOWER[own[~_SPACE[own]]].astype(np.uint64) + np.uint64(1)
        values *= powers(int(size.max()))[np.arange(len(values)) - np.repeat(first, size)]
        h[lo : lo + (1 << 16)] = splitmix(np.add.reduceat(values, first) + size.astype(np.uint64) * GOLD)
    return h, np.diff(np.searchsorted(starts, offsets)).astype(np.int64)


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs of each text and their number; a text of 1 to k-1 words has one for the whole."""
    n = len(words)
    first = np.concatenate([[0], np.cumsum(counts)])
    out_counts = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    if not n:
        return np.zeros(0, np.uint64), out_counts
    padded = np.concatenate([words, np.zeros(k - 1, np.uint64)])
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = splitmix(acc * GOLD + padded[j : j + n])
    short = np.flatnonzero((counts > 0) & (counts < k))
    at = ranges(first[:-1], out_counts)
    res = acc[at]
    if len(short):
        where = np.concatenate([[0], np.cumsum(out_counts)])[short]
        vals = []
        for i in short.tolist():
            x = np.zeros(1, np.uint64)
            for w in words[first[i] : first[i + 1]]:
                x = splitmix(x * GOLD + w)
            vals.append(splitmix(x + np.uint64(counts[i]))[0])
        res[where] = np.array(vals, dtype=np.uint64)
    return res, out_counts


def crc_mod(col: str, m: int):
    """crc32 of a column as text, modulo m."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(m)


def lbfgs(loss_grad, x: np.ndarray, steps: int = 60, memory: int = 8, tol: float = 1e-5) -> np.ndarray:
    """Minimise a smooth function given as x -> (loss, gradient), with limited-memory BFGS and backtracking."""
    f, g = loss_grad(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, coef = -g, []
        for s, y, rho in reversed(past):
            a = rho * (s @ d)
            coef.append(a)
            d = d - a * y
        if past:
            s, y, _ = past[-1]
            d = d * ((s @ y) / (y @ y))
        else:
            d = d / max(1.0, np.linalg.norm(g))
        for (s, y, rho), a in zip(past, reversed(coef)):
            d = d + (a - rho * (y @ d)) * s
        slope, step = g @ d, 1.0
        if slope >= 0:
            d, slope, past = -g, -(g @ g), []
        for _ in range(25):
            fn, gn = loss_grad(x + step * d)
            if fn <= f + 1e-4 * step * slope:
                break
            step *= 0.5
        else:
            break
        s, y = step * d, gn - g
        if s @ y > 1e-12:
            past = [*past[-(memory - 1) :], (s, y, 1.0 / (s @ y))]
        done = abs(f - fn) <= tol * max(1.0, abs(f))
        x, f, g = x + s, fn, gn
        if done:
            break
    return x
