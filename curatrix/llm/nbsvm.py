"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of byte n-grams (lengths in LENGTHS) of the text with
A-Z lower-cased and a space at either end, hashed to 2**BITS slots. Every slot
has the log ratio r of its smoothed share among toxic and among other training
documents; a logistic regression on presence * r gives the weights. Slots met in
fewer than min_df training documents, or whose log ratio is within min_ratio
of 0, count for nothing.

The classifier is fitted on the driver from at most max_each labelled rows of
either label (rows in the order of a hash of doc_id). Their slots are written once;
tasks count them by label, and only those that are used come to the driver. Scoring
goes over every whole text in Arrow batches with the fixed-size weight table.

Defined results: null and empty texts have no n-grams but the boundary and are
scored by the intercept; a label that is null is ignored; a doc_id with several
labels takes the largest; with labels of one kind only, all scores are that
share, smoothed; repeated rows are scored alike; an empty table gives an empty
table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import _LOWER, GOLD, crc_mod, discard, fresh, lbfgs, materialize, pack, sliced, trim, unpack

BITS = 20
LENGTHS = (4, 5, 6)
#: Columns of training rows that are expanded at once while fitting.
PART = 1_000_000


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def ngram_slots(raw: np.ndarray, lengths=LENGTHS, bits: int = BITS) -> list[np.ndarray]:
    """For each length, the slot of the n-gram that starts at each byte (one array each)."""
    n = len(raw)
    out, key = [], np.zeros(n, np.uint64)
    for j in range(max(lengths)):
        if n > j:
            key[: n - j] |= raw[j:].astype(np.uint64) << np.uint64(8 * j)
        if j + 1 in lengths:
            h = (key[: max(0, n - j)] + np.uint64(j)) * GOLD
            h ^= h >> np.uint64(29)
            out.append(((h * GOLD) >> np.uint64(64 - bits)).astype(np.uint32))
    return out


def _lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of ' text ' in lower case."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    pad = pa.scalar(" ", pa.large_string())
    # Letters are lowered by table: of a slice of a batch, Arrow's ascii_lower may give zero bytes.
    texts = pc.binary_join_element_wise(pad, texts, pad, pa.scalar("", pa.large_string()))
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]]
    return _LOWER[raw], off - off[0]


class Distinct:
    """Distinct slots of a list of slots, without sorting."""

    def __init__(self, bits: int = BITS):
        self.last = np.zeros(1 << bits, np.int32)

    def __call__(self, slots: np.ndarray) -> np.ndarray:
        at = np.arange(len(slots), dtype=np.int32)
        self.last[slots] = at
        return slots[self.last[slots] == at]


def document_slots(texts: pa.Array, useful: np.ndarray | None = None):
    """Distinct slots of each text; only those marked as useful, if given."""
    raw, off = _lowered(texts)
    parts = ngram_slots(raw)
    starts = []
    if useful is not None:
        for k, s in enumerate(parts):
            at = np.flatnonzero(useful[s])
            parts[k] = s[at]
            starts.append(at)
    distinct = Distinct()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        own = []
        for k, n in enumerate(LENGTHS):
            if useful is None:
                own.append(parts[k][a : max(a, b - n + 1)])
            else:
                lo, hi = np.searchsorted(starts[k], (a, max(a, b - n + 1)))
                own.append(parts[k][lo:hi])
        yield distinct(np.concatenate(own))


def counted(rows) -> tuple[np.ndarray, np.ndarray]:
    """(number, number of label 1) of the rows of each slot, from (label, distinct slots) pairs."""
    df, pos = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for label, slots in rows:
        df[slots] += 1
        pos[slots] += label
    return df, pos


def log_ratios(df: np.ndarray, pos: np.ndarray, n: int, n_pos: int, min_df: int = 5, alpha: float = 1.0, min_ratio: float = 0.3) -> np.ndarray:
    """The log ratio of each slot, 0 where it counts for nothing."""
    p, q = pos + alpha, df - pos + alpha
    ratio = np.log((p / (n_pos + 2 * alpha)) / (q / (n - n_pos + 2 * alpha)))
    return np.where((df >= min_df) & (np.abs(ratio) >= min_ratio), ratio, 0.0)


def fit(rows: list[tuple[int, np.ndarray]], min_df: int = 5, alpha: float = 1.0, l2: float = 30.0, min_ratio: float = 0.3, steps: int = 60) -> Model:
    """Weights from (label, distinct slots) pairs."""
    return solve(rows, log_ratios(*counted(rows), len(rows), sum(y for y, _ in rows), min_df, alpha, min_ratio), l2, steps)


def solve(rows: list[tuple[int, np.ndarray]], ratio: np.ndarray, l2: float = 30.0, steps: int = 60) -> Model:
    """Weights from (label, distinct slots) pairs and the slots' log ratios; slots of ratio 0 may be left out of the pairs."""
    size = 1 << BITS
    y = np.array([r[0] for r in rows], dtype=np.float64)
    if not len(rows) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(rows) + 1.0)
        return Model(np.zeros(size, np.float32), float(np.log(p / (1 - p))))
    used = ratio != 0
    lens = np.array([np.count_nonzero(used[s]) for _, s in rows])
    ends = np.cumsum(lens)
    ids = np.flatnonzero(used)
    place = (np.cumsum(used) - 1).astype(np.int32)
    # Columns of all rows one after the other; the only array of their total length.
    col = np.empty(int(ends[-1]), np.int32)
    for (_, s), a, n in zip(rows, ends - lens, lens):
        col[a : a + n] = place[s[used[s]]]
    r = ratio[ids]
    # Rows of about PART columns together.
    edges = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(PART, int(ends[-1]), PART)), [len(y)]]))
    parts = [(int(i), int(j), col[(ends[i] - lens[i]) : ends[j - 1]]) for i, j in zip(edges[:-1], edges[1:])]

    def loss_grad(x):
        w, b = x[:-1], x[-1]
        v, z, g = w * r, np.full(len(y), b), np.zeros(len(ids))
        for i, j, c in parts:
            z[i:j] += np.bincount(np.repeat(np.arange(j - i), lens[i:j]), weights=v[c], minlength=j - i)
        d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        for i, j, c in parts:
            g += np.bincount(c, weights=np.repeat(d[i:j], lens[i:j]), minlength=len(ids))
        g = g * r + l2 * w
        return np.sum(np.logaddexp(0, z) - y * z) + 0.5 * l2 * (w @ w), np.append(g, d.sum())

    x = lbfgs(loss_grad, np.append(np.zeros(len(ids)), np.log(y.mean() / (1 - y.mean()))), steps)
    w, b = x[:-1], x[-1]
    weights = np.zeros(size, np.float32)
    weights[ids] = w * r
    return Model(weights, float(b))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_each: int) -> tuple[DataFrame, float]:
    """(label, text) of at most max_each rows of either label in the training fold, in the order of a hash of doc_id; the log odds of all its labels."""
    lab = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).filter(crc_mod("doc_id", 3) != 1)
    lab = lab.groupBy("doc_id").agg((F.max(F.col(label).cast("int")) > 0).cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    kinds = [lab.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(max_each) for y in (0, 1)]
    # max_each bounds the labels' side, so it can be sent to every task.
    rows = docs.select("doc_id", "text").join(F.broadcast(kinds[0].union(kinds[1])), "doc_id").select("y", "text")
    return rows, float(np.log((n.get(1, 0) + 0.5) / (n.get(0, 0) + 0.5)))


def _packed(slots: np.ndarray) -> bytes:
    return pack(np.diff(np.sort(slots).astype(np.uint32), prepend=np.uint32(0)))


def _slots(block) -> np.ndarray:
    return np.cumsum(np.frombuffer(unpack(block.as_py())[0], np.uint32), dtype=np.uint32)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_each: int = 1_500, min_df: int = 5) -> Model:
    """Fit on at most max_each labelled rows of either label of the training fold; the intercept follows the odds of all of its labels."""

    def blocks(batches):
        for batch in sliced(batches, 100):
            got = document_slots(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"y": batch.column("y").cast(pa.int32()), "slots": pa.array([_packed(g) for g in got], pa.binary())})

    def counts(batches):
        n, n_pos, df, pos = 0, 0, np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
        for batch in sliced(batches, 100):
            ys = batch.column("y").to_pylist()
            more = counted(zip(ys, map(_slots, batch.column("slots"))))
            n, n_pos, df, pos = n + len(ys), n_pos + sum(ys), df + more[0], pos + more[1]
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int32()), "n_pos": pa.array([n_pos], pa.int32()), "df": pa.array([pack(df)], pa.binary()), "pos": pa.array([pack(pos)], pa.binary())})

    sample, odds = training_rows(docs, labels, label, max_each)
    written = materialize(sample.mapInArrow(blocks, "y int, slots binary"))
    n, n_pos, df, pos = 0, 0, np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    # One row for each task over the bounded sample, taken one after the other.
    for r in written.mapInArrow(counts, "n int, n_pos int, df binary, pos binary").toLocalIterator():
        n, n_pos = n + r["n"], n_pos + r["n_pos"]
        df += np.frombuffer(unpack(r["df"])[0], np.int32)
        pos += np.frombuffer(unpack(r["pos"])[0], np.int32)
    ratio = log_ratios(df, pos, n, n_pos, min_df)
    del df, pos
    useful = docs.sparkSession.sparkContext.broadcast(np.packbits(ratio != 0))

    def narrowed(batches):
        used = np.unpackbits(useful.value).astype(bool)
        for batch in sliced(batches, 100):
            own = map(_slots, batch.column("slots"))
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "slots": pa.array([_packed(g[used[g]]) for g in own], pa.binary())})

    got = written.mapInArrow(narrowed, "y int, slots binary").toArrow()
    rows = [(y, _slots(s)) for y, s in zip(got.column("y").to_pylist(), got.column("slots"))]
    del got
    useful.unpersist()
    discard(written)
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    model = solve(rows, ratio)
    if rows and model.weights.any():
        model.bias += odds - float(np.log((n_pos + 0.5) / (n - n_pos + 0.5)))
    rows.clear()
    trim()
    return model


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs plus the score of every text (0 to 1); a name that docs has already gets underscores added."""
    (name,) = fresh([name], docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    useful = model.weights != 0
    bundle = docs.sparkSession.sparkContext.broadcast((model.weights, useful, model.bias))

    def scored(batches):
        weights, useful, bias = bundle.value
        for batch in sliced(batches, 200):
            z = np.array([weights[s].sum(dtype=np.float64) for s in document_slots(batch.column("text"), useful)], dtype=np.float64) + bias
            s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(scored, schema)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7) of every document."""
    model = train(docs, labels, **options)
    out = score(docs.select("doc_id", "text"), model)
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return out.select(F.col("doc_id").cast("long"), held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
