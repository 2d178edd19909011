"""Mini-batch k-means: parallel oversampled seeding, then centres that move batch by batch at decaying rates.

Every row belongs to one of `batches` batches by a hash of its key and vector,
so a batch grows with the table and an epoch reads each row once. Seeding starts
at one row and takes `rounds` rounds: a row becomes a candidate with probability
2 k times its share of the squared distances to the candidates so far, some 2 k a
round whatever the size of the table. Candidates are weighted by the rows nearest
to them, and the driver seeds k centres from these few. A batch then moves each
centre towards the mean of its rows there, at a rate of their number over all that
the centre has met. What reaches the driver is k sums for each dimension.

Distances and sums are added up as whole numbers, so that the result does not
depend on the partitioning (but for ties within rounding of a product).

Defined results: rows whose vector is null, holds null or non-finite components,
or is shorter than the longest one take no part and get a null cluster; copies of
a row are in one batch and get one cluster; ties go to the smaller cluster; fewer
than k different vectors give fewer clusters; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from curatrix.functions.logits import doubles
from curatrix.operators.written import new_folder

#: Steps of the whole numbers that stand for 0 .. the largest value.
STEPS = float(1 << 30)


def _matrix(column, dims: int) -> np.ndarray:
    """The rows of a list column that are not null."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _nearest(x: np.ndarray, centres: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, squared distance to it) of each row, a block of rows at a time."""
    at, far, own = np.zeros(len(x), np.int32), np.zeros(len(x)), (centres * centres).sum(1)
    for lo in range(0, len(x), block):
        part = x[lo : lo + block]
        d = own - 2 * (part @ centres.T)
        at[lo : lo + block] = d.argmin(1)
        near = part - centres[at[lo : lo + block]]
        far[lo : lo + block] = (near * near).sum(1)
    return at, far


def _seeded(x: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """At most k of the weighted rows, each drawn by its weight times its squared distance to those drawn, then moved by ten weighted means."""
    best, best_cost = x[:1], np.inf
    for _ in range(5):
        chosen = [int(rng.choice(len(x), p=weight / weight.sum()))]
        far = ((x - x[chosen[0]]) ** 2).sum(1)
        while len(chosen) < k and (far * weight).sum() > 0:
            chosen.append(int(rng.choice(len(x), p=far * weight / (far * weight).sum())))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        centres = x[chosen].copy()
        for _ in range(10):
            at, _ = _nearest(x, centres)
            n = np.bincount(at, weights=weight, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, at, x * weight[:, None])
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        cost = float((_nearest(x, centres)[1] * weight).sum())
        if cost < best_cost:
            best, best_cost = centres, cost
    return best


def usable(vec, dims: int):
    """vec if it has dims finite components, else null."""
    v = doubles(vec)
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.when((F.size(v) == dims) & fine, v)


def fit(df: DataFrame, key: str, k: int, vec: str = "v", seed: int = 42, batches: int = 10, epochs: int = 3, rounds: int = 4) -> np.ndarray | None:
    """The centres, a row each; None without a usable vector."""
    spark = df.sparkSession
    dims = df.agg(F.max(F.size(F.col(vec)))).first()[0]
    if not dims or dims < 1:
        return None
    rows = df.select(key, usable(F.col(vec), dims).alias("v")).filter("v IS NOT NULL")
    drawn = F.xxhash64(F.lit(seed), F.col(key), F.col("v"))
    path = new_folder(spark)
    rows.select("v", drawn.alias("draw"), F.pmod(drawn, F.lit(batches)).cast("int").alias("batch")).write.partitionBy("batch").parquet(path)
    table = spark.read.schema("v array<double>, draw long, batch int").parquet(path)
    first = table.agg(F.min(F.struct("draw", "v")).alias("first"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    if first["first"] is None:
        return None
    most = max(first["most"], 1e-300)
    unit = STEPS / (4 * dims)

    def costs(centres: np.ndarray) -> DataFrame:
        """Rows with the nearest centre and the squared distance in whole steps."""
        share = spark.sparkContext.broadcast(centres / most)

        def run(parts):
            for b in parts:
                at, far = _nearest(_matrix(b.column(0), dims) / most, share.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at), pa.array(np.rint(far * unit).astype(np.int64))], names=["v", "draw", "centre", "cost"])

        return table.select("v", "draw").mapInArrow(run, "v array<double>, draw long, centre int, cost long")

    found = np.array([first["first"]["v"]], dtype=float)
    for r in range(rounds):
        costed = costs(found)
        total = costed.agg(F.sum(F.col("cost").cast("decimal(20,0)"))).first()[0]
        if not total:
            break
        chance = F.pmod(F.xxhash64(F.lit(r), F.col("draw")), F.lit(1 << 52)) / float(1 << 52)
        # Some 2 k rows: chances add up to at most 2 k, and copies are one.
        picked = costed.filter(chance < F.col("cost") * (2.0 * k / float(total))).select("v").distinct().orderBy("v").toArrow()
        if picked.num_rows:
            found = np.concatenate([found, _matrix(picked.column("v").combine_chunks(), dims)])
    weight = np.zeros(len(found))
    for c in costs(found).groupBy("centre").count().collect():  # a row for each candidate
        weight[c["centre"]] = c["count"]
    centres = _seeded(found[weight > 0] / most, weight[weight > 0], k, np.random.default_rng(seed))
    met = np.zeros(len(centres))
    for _ in range(epochs):
        for part in range(batches):
            n, sums = _batch_sums(table.filter(F.col("batch") == part), centres, most, dims)
            met += n
            own = n > 0
            centres[own] += (sums[own] - n[own, None] * centres[own]) / met[own, None]
    return centres * most


def _batch_sums(batch: DataFrame, centres: np.ndarray, most: float, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sum of the rows) of each centre over one batch, of vectors divided by most."""
    share = batch.sparkSession.sparkContext.broadcast(centres)
    k = len(centres)

    def run(parts):
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in parts:
            x = _matrix(b.column(0), dims) / most
            at, _ = _nearest(x, share.value)
            if len(at):
                n += np.bincount(at, minlength=k)
                order = np.argsort(at, kind="stable")
                starts = np.flatnonzero(np.diff(at[order], prepend=-1))
                sums[at[order][starts]] += np.add.reduceat(np.rint(x[order] * STEPS).astype(np.int64), starts)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array(sums[own].tolist(), pa.list_(pa.int64()))], names=["centre", "n", "s"])

    per_task = batch.select("v").mapInArrow(run, "centre int, n long, s array<long>")
    cells = per_task.select("centre", F.posexplode(F.concat(F.array("n"), "s")).alias("pos", "x"))
    got = cells.groupBy("centre", "pos").agg(F.sum(F.col("x").cast("decimal(20,0)")).cast("double").alias("x")).toArrow()  # k * (dims + 1) cells
    out = np.zeros((k, dims + 1))
    out[got.column("centre").to_numpy(), got.column("pos").to_numpy()] = got.column("x").to_numpy()
    return out[:, 0], out[:, 1:] / STEPS


def minibatch_kmeans(df: DataFrame, key: str, k: int, vec: str = "v", seed: int = 42, batches: int = 10, epochs: int = 3, rounds: int = 4) -> DataFrame:
    """(key, cluster) of every row."""
    schema = StructType([df.select(key).schema[0], StructField("cluster", IntegerType())])
    centres = fit(df, key, k, vec, seed, batches, epochs, rounds)
    if centres is None:
        return df.select(key, F.lit(None).cast("int").alias("cluster"))
    share = df.sparkSession.sparkContext.broadcast(centres)

    def run(parts):
        for b in parts:
            at, _ = _nearest(_matrix(b.column(1), centres.shape[1]), share.value)
            out = np.full(b.num_rows, -1, np.int32)
            here = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            out[here] = at
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, mask=~here)], names=[key, "cluster"])

    return df.select(key, usable(F.col(vec), centres.shape[1]).alias("v")).mapInArrow(run, schema)
