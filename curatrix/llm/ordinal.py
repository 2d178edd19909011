"""Quality: ordinal cumulative-link regression on graded ratings over hashed text.

Grades 0..G share one weight vector over hashed features of a text and have
ordered thresholds: P(grade > g) = sigmoid(x.w - t_g), t_0 < t_1 < ... . The
features are byte n-grams (lengths 2 to 4) of the lower-cased text, hashed to
2**BITS slots, with log counts scaled to unit length, and a few shares of
character classes. Weights and thresholds are fitted on the driver by L-BFGS on
at most max_each rated rows of each grade (in the order of a hash of doc_id); the
thresholds then move so that the mean tail probabilities follow all ratings.

Scores of a text: the expected grade, the tail probability of each grade, and
whether it is selected (tail probability of `keep_grade` at least `keep_least`).

Defined results: null and empty texts have no features and are scored by the
thresholds alone; null ratings are ignored; a doc_id with several ratings takes
the least; with ratings of one grade only, that grade is predicted; repeated rows
score alike; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import as_text_arrays, fresh, lbfgs, sliced
from curatrix.llm.nbsvm import ngram_slots

BITS = 16
LENGTHS = (2, 3, 4)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_CLASS = np.zeros((256, 5))
_CLASS[65:91, 0] = _CLASS[48:58, 1] = _CLASS[[32, 9, 10, 13], 2] = _CLASS[128:, 3] = 1
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], 4] = 1


@dataclass
class Model:
    weights: np.ndarray
    dense: np.ndarray
    thresholds: np.ndarray


def features(ids_off_raw) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Sparse (slots, values) and dense features of each text of a batch."""
    _, off, raw = ids_off_raw
    parts = ngram_slots(_LOW[raw], LENGTHS, BITS)
    sparse, dense = [], np.zeros((len(off) - 1, _CLASS.shape[1] + 1))
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        if a == b:
            sparse.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        counts = np.bincount(np.concatenate([p[a : max(a, b - n + 1)] for p, n in zip(parts, LENGTHS)]), minlength=1)
        slots = np.flatnonzero(counts)
        values = 1 + np.log(counts[slots])
        sparse.append((slots, values / max(1e-12, np.sqrt((values**2).sum()))))
        dense[i, :-1] = np.bincount(raw[a:b], minlength=256) @ _CLASS / (b - a)
        dense[i, -1] = np.log1p(b - a) / 10
    return sparse, dense


def _sig(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def tails(model: Model, sparse, dense) -> np.ndarray:
    """P(grade > g) for each text and threshold."""
    z = np.array([model.weights[s] @ v for s, v in sparse]) + dense @ model.dense if len(sparse) else np.zeros(0)
    return _sig(z[:, None] - model.thresholds[None])


def fit(rows: list[tuple[int, tuple, np.ndarray]], grades: int, l2: float = 0.3, steps: int = 80) -> Model:
    """Maximise the penalised likelihood of (grade, sparse, dense) rows."""
    size, k, width = 1 << BITS, grades - 1, _CLASS.shape[1] + 1
    y = np.array([r[0] for r in rows], dtype=np.int64)
    share = (np.array([(y > g).sum() for g in range(k)]) + 0.5) / (len(y) + 1.0)
    t0 = np.maximum.accumulate(np.log((1 - share) / share) + 1e-3 * np.arange(k))
    if not len(rows) or len(np.unique(y)) < 2:
        return Model(np.zeros(size, np.float32), np.zeros(width), t0)
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[1][0]) for r in rows])
    slot = np.concatenate([r[1][0] for r in rows])
    val = np.concatenate([r[1][1] for r in rows])
    dense = np.stack([r[2] for r in rows])

    def parts(x):
        raw = x[size + width :]
        t = raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])  # ordered by construction
        return x[:size], x[size : size + width], raw, t

    def loss_grad(x):
        w, v, raw, t = parts(x)
        z = np.bincount(doc, weights=w[slot] * val, minlength=len(y)) + dense @ v
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        hi, lo = _sig(z - edge[y]), _sig(z - edge[y + 1])  # P(grade > y-1), P(grade > y)
        p = np.maximum(hi - lo, 1e-12)
        dh, dl = hi * (1 - hi) / p, lo * (1 - lo) / p
        dz = -(dh - dl)
        gt = np.zeros(k + 2)
        np.add.at(gt, y, dh)
        np.add.at(gt, y + 1, -dl)
        gt = gt[1:-1]
        graw = np.concatenate([[gt.sum()], [gt[j:].sum() * np.exp(raw[j]) for j in range(1, k)]])
        gw = np.bincount(slot, weights=dz[doc] * val, minlength=size) + l2 * w
        loss = -np.log(p).sum() + 0.5 * l2 * (w @ w + v @ v)
        return loss, np.concatenate([gw, dense.T @ dz + l2 * v, graw])

    start = np.concatenate([np.zeros(size + width), t0[:1], np.log(np.maximum(np.diff(t0), 1e-2))])
    w, v, _, t = parts(lbfgs(loss_grad, start, steps))
    return Model(w.astype(np.float32), v, t)


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id, grade of the rated documents: 0 low quality, 1 good but toxic, 2 good."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) > 0
    grade = F.when(F.col("quality") <= 0, 0).when(toxic, 1).otherwise(2)
    return labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, grades: int = 3, max_each: int = 1_500) -> Model:
    """Fit on at most max_each rated rows of each grade; ratings: (doc_id, grade)."""
    n = {r["grade"]: r["n"] for r in ratings.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    kinds = [ratings.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(max_each) for g in range(grades)]
    picked = kinds[0]
    for kind in kinds[1:]:
        picked = picked.unionAll(kind)

    def blocks(batches):
        for b in sliced(batches, 100):
            sparse, dense = features(as_text_arrays(b))
            yield pa.RecordBatch.from_pydict({"grade": b.column("grade").cast(pa.int32()), "doc_id": b.column("doc_id"), "s": pa.array([s.astype(np.uint16).tobytes() for s, _ in sparse], pa.binary()), "v": pa.array([v.astype(np.float32).tobytes() for _, v in sparse], pa.binary()), "d": pa.array([d.tobytes() for d in dense], pa.binary())})

    # grades * max_each bounds the ratings' side.
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    got = sample.mapInArrow(blocks, "grade int, doc_id long, s binary, v binary, d binary").toArrow()
    rows = [(g, i, (np.frombuffer(s.as_buffer(), np.uint16), np.frombuffer(v.as_buffer(), np.float32)), np.frombuffer(d.as_buffer(), np.float64)) for g, i, s, v, d in zip(got.column("grade").to_pylist(), got.column("doc_id").to_pylist(), got.column("s"), got.column("v"), got.column("d"))]
    rows.sort(key=lambda r: (r[1], r[0], len(r[2][0])))
    model = fit([(g, s, d) for g, _, s, d in rows], grades)
    own = np.bincount([r[0] for r in rows], minlength=grades)
    # Move the thresholds from the shares of the sample to those of all ratings.
    tail = lambda c: np.array([(sum(c[g + 1 :]) + 0.5) / (sum(c) + 1.0) for g in range(grades - 1)])
    odds = lambda p: np.log(p / (1 - p))
    model.thresholds = np.maximum.accumulate(model.thresholds + odds(tail(own)) - odds(tail([n.get(g, 0) for g in range(grades)])))
    return model


def rate(docs: DataFrame, model: Model, keep_grade: int = 1, keep_least: float = 0.5) -> DataFrame:
    """docs plus expected_grade, tail_<g> of each grade above 0, and selected; a name that docs has already gets underscores added."""
    names = fresh(["expected_grade", *(f"tail_{g + 1}" for g in range(len(model.thresholds))), "selected"], docs.columns)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names[:-1]), T.StructField(names[-1], T.BooleanType())])
    share = docs.sparkSession.sparkContext.broadcast(model)

    def rated(batches):
        for b in sliced(batches, 200):
            p = tails(share.value, *features(as_text_arrays(b)))
            p = p.reshape(b.num_rows, -1)
            more = [pa.array(p.sum(1)), *(pa.array(np.ascontiguousarray(p[:, g])) for g in range(p.shape[1])), pa.array(p[:, keep_grade - 1] >= keep_least)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *names])

    return docs.mapInArrow(rated, schema)


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, expected_grade, tail_1, tail_2, selected of every document."""
    model = train(docs, grades_of(labels), **options)
    return rate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).drop("text")
