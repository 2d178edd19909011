"""A kept vector index: rows in lists around centres, written as blocks in batches, searched by joins on the list.

**Layout.** `path/centres` has a unit vector for each list; `path/blocks/batch=N` has
what the N-th batch added, as rows of at most BLOCK vectors of one list (keys, unit
vectors as float64 bytes, the largest angle to the centre). Centres come from k-means
over a sample of at most SAMPLE rows of the first batch; every row is indexed. A
version is a number of batches, and `at(version)` reads an older one.

**Search.** A query goes to its nearest `probes` lists; blocks and queries meet in a
join on the list, and products of blocks give cosines. `exact=True` then goes to every
list that the bound of the triangle inequality for angles does not rule out: a row y
of list L is at least angle(q, centre) - radius(L) from q. near_pairs uses that bound,
and the one that follows from y being nearer to its own centre, so that it finds all
pairs over a threshold; on vectors without structure, or at a low threshold, the bounds
rule little out and the work is that of all pairs, spread over pairs of groups of rows.

**Cases.** Rows with a null key, and vectors that are null, empty, zero, of another
length or hold nulls or non-finite values, take no part. A key that the index has is not
added again; of one key's rows in a batch the one with the smallest vector counts.
Scores rank by their first 9 digits, ties to the smaller key.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.operators.graph import dropped_in_order
from curatrix.operators.sampling import uniform_sample
from curatrix.operators.written import cut

#: Most rows that centres are fitted on.
SAMPLE = 20_000
#: Most bytes of all centres, which every task holds.
CENTRE_BYTES = 32 << 20
#: Vectors of a block.
BLOCK = 1_024
#: Rows of a group that one task compares with another.
GROUP_ROWS = 8_000
#: Rows of a group whose pairs are found at once.
PAIR_ROWS = 256
#: Digits by which scores rank.
DIGITS = 9
#: Angles are trusted to so much.
SLACK = 1e-6


def usable(df: DataFrame, key: str, vec: str, dims: int) -> DataFrame:
    """(key, v): unit vectors of the rows that take part, in Arrow batches (array functions of columns are interpreted, element by element)."""

    def run(batches):
        for t in batches:
            v = t.column(1)
            t = t.filter(pc.and_(t.column(0).is_valid(), pc.fill_null(pc.equal(pc.list_value_length(v), dims), False)))
            flat = t.column(1).flatten()
            x = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                norm = np.sqrt((x * x).sum(1))
                u = x / norm[:, None]
            keep = np.isfinite(norm) & (norm > 0)
            u = np.ascontiguousarray(u[keep])
            offsets = pa.array(np.arange(len(u) + 1, dtype=np.int32) * dims)
            yield pa.RecordBatch.from_arrays([t.column(0).filter(pa.array(keep)), pa.ListArray.from_arrays(offsets, pa.array(u.ravel()))], names=["key", "v"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vec}`").alias("v")).mapInArrow(run, f"key {kind}, v array<double>")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def from_bytes(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(-1, dims)


def packed(batches, size: int):
    """Rows (list, key, u, angle), ordered by list, as blocks (list, keys, vectors, n, radius)."""
    held: list[pa.RecordBatch] = []
    n, now = 0, None

    def block():
        t = pa.Table.from_batches(held).combine_chunks()
        t = t.take(pc.sort_indices(t.column("key")))  # so that ties go to the smaller key
        keys = t.column("key").combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([b"".join(t.column("u").to_pylist())], pa.binary()), pa.array([len(keys)], pa.int32()), pa.array([max(t.column("angle").to_pylist())], pa.float64())], names=["list", "keys", "vectors", "n", "radius"])

    for t in batches:
        lists = t.column(0).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]])) if len(lists) else []
        for a, z in zip(edges, [*edges[1:], len(lists)]):
            while a < z:
                if held and (lists[a] != now or n == size):
                    yield block()
                    held, n = [], 0
                now = int(lists[a])
                step = min(z - a, size - n)
                held.append(t.slice(a, step))
                n, a = n + step, a + step
    if held:
        yield block()


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path, self.version = spark, path.rstrip("/"), version
        rows = spark.read.parquet(f"{self.path}/centres").orderBy("list").collect()  # at most CENTRE_BYTES
        self.centres = np.array([r["centre"] for r in rows])
        self.dims = self.centres.shape[1]

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, vec: str, lists: int | None = None, seed: int = 42) -> VectorIndex:
        """A new index at path with df as its first batch. Its vectors have the length of the first that is not empty, by key; 1, if there is none."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = df.sparkSession
        size = F.size(F.col(f"`{vec}`"))
        dims = df.filter((size > 0) & F.col(f"`{key}`").isNotNull()).agg(F.min_by(size, F.col(f"`{key}`"))).first()[0] or 1
        rows = usable(df, key, vec, dims)
        n = rows.count()
        lists = max(1, min(lists or math.isqrt(n), CENTRE_BYTES // (8 * dims), SAMPLE // 4, n))
        sample = cut(uniform_sample(rows, SAMPLE, "key", seed))
        if lists > 1:
            model = KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine").fit(sample.select(array_to_vector("v").alias("features")))
            centres = [c / max(np.linalg.norm(c), 1e-12) for c in model.clusterCenters()]
        else:
            centres = [np.eye(1, dims)[0]]
        table = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list int, centre array<double>")
        table.coalesce(1).write.parquet(f"{path.rstrip('/')}/centres")
        index = cls(spark, path)
        index.add(df, key, vec)
        return index

    def at(self, version: int) -> VectorIndex:
        """The index as it was after so many batches."""
        return VectorIndex(self.spark, self.path, version)

    def batches(self) -> int:
        """The last batch written, 0 before the first."""
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/blocks")
        system = fs.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        names = [f.getPath().getName() for f in system.listStatus(fs)] if system.exists(fs) else []
        done = [int(x.partition("=")[2]) for x in names if x.startswith("batch=")]
        return max(done, default=0)

    def blocks(self) -> DataFrame:
        t = self.spark.read.parquet(f"{self.path}/blocks")
        return t if self.version is None else t.filter(F.col("batch") <= self.version)

    def rows(self) -> DataFrame:
        """(key, list, batch) of all rows."""
        return self.blocks().select(F.explode("keys").alias("key"), "list", "batch")

    def add(self, df: DataFrame, key: str, vec: str) -> int:
        """Write df as the next batch and return its number. Two writers of one batch do not mix: the later one fails."""
        if self.version is not None:
            raise ValueError("an older version takes no batches")
        last = self.batches()
        rows = usable(df, key, vec, self.dims).groupBy("key").agg(F.min("v").alias("v"))
        if last:
            rows = rows.join(self.rows().select("key"), "key", "left_anti")
        kind = dict(rows.dtypes)["key"]
        centres, dims = self.centres, self.dims

        def assign(batches):
            for t in batches:
                if len(t):
                    u = matrix(t.column(1), dims)
                    near = u @ centres.T
                    best = near.argmax(1)
                    angle = np.arccos(np.clip(near[np.arange(len(u)), best], -1, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(best, pa.int32()), t.column(0), pa.array([x.tobytes() for x in u], pa.binary()), pa.array(angle)], names=["list", "key", "u", "angle"])

        placed = rows.mapInArrow(assign, f"list int, key {kind}, u binary, angle double")
        # Rebalancing keeps a list together and lets Spark split the lists that are large.
        placed = placed.hint("rebalance", "list").sortWithinPartitions("list")
        made = placed.mapInArrow(lambda b: packed(b, BLOCK), f"list int, keys array<{kind}>, vectors binary, n int, radius double")
        made.write.parquet(f"{self.path}/blocks/batch={last + 1:06d}")
        return last + 1

    def radii(self) -> np.ndarray:
        """The largest angle of each list's rows to its centre, -inf for empty lists."""
        out = np.full(len(self.centres), -np.inf)
        for r in self.blocks().groupBy("list").agg(F.max("radius").alias("r")).collect():  # a row for each list
            out[r["list"]] = r["r"]
        return out

    def _met(self, asked: DataFrame, score, schema: str) -> DataFrame:
        """score(query block, block) over all pairs of asked blocks (q_list, q_keys, q_vectors) and index blocks of one list."""
        # Never broadcast: asked blocks are many more bytes than the queries they come from, by which Spark would judge.
        pairs = self.blocks().select("list", "keys", "vectors").hint("merge").join(asked, "list")

        def run(batches):
            for t in batches:
                for row in range(t.num_rows):
                    made = score(t.slice(row, 1))
                    if made is not None:
                        yield made

        return pairs.mapInArrow(run, schema)

    def search(self, queries: DataFrame, k: int, key: str, vec: str, probes: int = 8, exact: bool = False) -> DataFrame:
        """(query, rank, key, sim): the k most similar rows of each query but the row of its own key."""
        asked = cut(usable(queries, key, vec, self.dims))
        first = self._found(asked.withColumn("least", F.lit(-2.0)), k, probes, None)
        if not exact:
            return self._ranked(first, k)
        first = cut(first)
        bound = first.groupBy("query").agg(F.min("sim").alias("s"), F.count(F.lit(1)).alias("n"))
        least = asked.join(bound, F.col("key") == F.col("query"), "left").select("key", "v", F.when(F.col("n") >= k, F.col("s")).otherwise(-2.0).alias("least"))
        return self._ranked(first.unionByName(self._found(least, k, probes, self.radii())), k)

    def _ranked(self, found: DataFrame, k: int) -> DataFrame:
        w = W.partitionBy("query").orderBy(F.desc("sim"), "key")  # k rows of a query from each task at most
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "rank", "key", "sim")

    def _found(self, asked: DataFrame, k: int, probes: int, radii: np.ndarray | None) -> DataFrame:
        """(query, key, sim): the k best of the `probes` nearest lists; with radii, of the other lists that may hold a row over `least`."""
        kind, centres, dims = dict(asked.dtypes)["key"], self.centres, self.dims
        probes = min(probes, len(centres))

        def route(batches):
            for t in batches:
                if not len(t):
                    continue
                u = matrix(t.column(1), dims)
                near = u @ centres.T
                order = np.argsort(-near, axis=1, kind="stable")
                pick = np.zeros(near.shape, bool)
                np.put_along_axis(pick, order[:, :probes], True, axis=1)
                if radii is not None:
                    reach = np.arccos(np.clip(t.column(2).to_numpy(), -1, 1))
                    reach[t.column(2).to_numpy() < -1] = np.inf
                    pick = ~pick & (np.arccos(np.clip(near, -1, 1)) - radii <= reach[:, None] + SLACK)
                row, lists = np.nonzero(pick)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), t.column(0).take(pa.array(row)), pa.array([u[i].tobytes() for i in row.tolist()], pa.binary()), pa.array(np.zeros(len(row)))], names=["list", "key", "u", "angle"])

        sent = asked.select("key", "v", "least").mapInArrow(route, f"list int, key {kind}, u binary, angle double").hint("rebalance", "list").sortWithinPartitions("list")
        blocks = sent.mapInArrow(lambda b: packed(b, 256), f"list int, keys array<{kind}>, vectors binary, n int, radius double")

        def score(t):
            q_keys, keys = t.column("q_keys")[0].values, t.column("keys")[0].values
            sim = np.round(from_bytes(t.column("q_vectors")[0].as_py(), dims) @ from_bytes(t.column("vectors")[0].as_py(), dims).T, DIGITS)
            at = {x: i for i, x in enumerate(keys.to_pylist())}
            own = [at.get(x, -1) for x in q_keys.to_pylist()]
            for i, j in enumerate(own):
                if j >= 0:
                    sim[i, j] = -np.inf
            best = np.argsort(-sim, axis=1, kind="stable")[:, :k]  # keys ascend, so ties are right
            values = np.take_along_axis(sim, best, 1).ravel()
            keep = np.isfinite(values)
            rows = np.repeat(np.arange(len(q_keys)), best.shape[1])[keep]
            return pa.RecordBatch.from_arrays([q_keys.take(pa.array(rows)), keys.take(pa.array(best.ravel()[keep])), pa.array(values[keep])], names=["query", "key", "sim"])

        found = self._met(blocks.select("list", F.col("keys").alias("q_keys"), F.col("vectors").alias("q_vectors")), score, f"query {kind}, key {dict(self.rows().dtypes)['key']}, sim double")
        w = W.partitionBy("query").orderBy(F.desc("sim"), "key")
        return found.withColumn("r_", F.row_number().over(w)).filter(F.col("r_") <= k).drop("r_")

    def recall(self, queries: DataFrame, k: int, key: str, vec: str, probes: int) -> float:
        """The share of each query's true k best that a search of `probes` lists finds."""
        got = self.search(queries, k, key, vec, probes).select("query", "key")
        want = cut(self.search(queries, k, key, vec, probes, exact=True).select("query", "key"))
        return want.join(got, ["query", "key"], "left_semi").count() / max(1, want.count())

    def groups(self, rows: int = GROUP_ROWS) -> tuple[np.ndarray, np.ndarray]:
        """(first group, number of groups) of each list: neighbouring small lists share a group of some `rows` rows, large ones have several."""
        sizes = np.zeros(len(self.centres), np.int64)
        for r in self.blocks().groupBy("list").agg(F.sum("n").alias("n")).collect():  # a row for each list
            sizes[r["list"]] = r["n"]
        first, many, group, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
        for i in np.argsort(-(self.centres @ self.centres[0]), kind="stable").tolist():
            if held and held + sizes[i] > rows:
                group, held = group + 1, 0
            first[i], many[i] = group, max(1, -(-sizes[i] // rows))
            group, held = (group + int(many[i]), 0) if many[i] > 1 else (group, held + int(sizes[i]))
        return first, many

    def near_pairs(self, threshold: float = 0.95) -> DataFrame:
        """(a, b, sim): all pairs a < b of cosine over the threshold.

        A row goes to the pairs of its own group of rows and each other group that the
        bounds leave; a pair of groups, some 2 * GROUP_ROWS rows, is compared by one task.
        """
        kind, centres, dims, radii = dict(self.rows().dtypes)["key"], self.centres, self.dims, self.radii()
        reach = math.acos(max(-1.0, min(1.0, threshold))) + SLACK
        first, many = self.groups()
        member = [np.arange(f, f + m) for f, m in zip(first, many)]
        total = int((first + many).max())

        def route(batches):
            for t in batches:
                for home, keys, raw in zip(t.column(0).to_pylist(), t.column(1), t.column(2).to_pylist()):
                    u = from_bytes(raw, dims)
                    angle = np.arccos(np.clip(u @ centres.T, -1, 1))
                    # y is within reach of x, within radii of its centre, and no further from it than from x's own.
                    may = angle <= reach + np.minimum(radii[None], reach + angle[:, [home]])
                    may[:, home] = True
                    to = np.zeros((len(u), total), bool)
                    for other in np.flatnonzero(may.any(0)).tolist():
                        to[:, member[other]] |= may[:, [other]]
                    # A list of several groups is dealt by hash; which part a row is in only has to be the same for its own side.
                    own = first[home] + np.array([zlib.crc32(str(k).encode()) for k in keys.values.to_pylist()]) % many[home]
                    row, group = np.nonzero(to)
                    low, high = np.minimum(own[row], group), np.maximum(own[row], group)
                    for lo in range(0, len(row), 8_192):
                        at = slice(lo, lo + 8_192)
                        yield pa.RecordBatch.from_arrays([pa.array(low[at], pa.int32()), pa.array(high[at], pa.int32()), pa.array(own[row[at]], pa.int32()), keys.values.take(pa.array(row[at])), pa.array([u[i].tobytes() for i in row[at].tolist()], pa.binary())], names=["low", "high", "side", "key", "u"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(batches)
            low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
            side = t.column("side").to_numpy()
            keys = t.column("key").combine_chunks()
            u = np.frombuffer(b"".join(t.column("u").to_pylist())).reshape(-1, dims)
            left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
            del t
            other = u[right].T
            # Pairs of some rows go out before the next are compared, so that a task never holds those of its groups.
            for lo in range(0, len(left), PAIR_ROWS):
                sim = u[left[lo : lo + PAIR_ROWS]] @ other
                i, j = np.nonzero(sim > threshold)
                a, b = keys.take(pa.array(left[lo + i])), keys.take(pa.array(right[j]))
                less = pc.less(a, b)
                keep = less if low == high else pc.not_equal(a, b)  # a group meets itself in both directions
                yield pa.RecordBatch.from_arrays([pc.if_else(less, a, b).filter(keep), pc.if_else(less, b, a).filter(keep), pa.array(sim[i, j]).filter(keep)], names=["a", "b", "sim"])

        sent = self.blocks().select("list", "keys", "vectors").mapInArrow(route, f"low int, high int, side int, key {kind}, u binary")
        return sent.groupBy("low", "high").applyInArrow(compare, f"a {kind}, b {kind}, sim double")

    def deduplicated(self, threshold: float = 0.95) -> DataFrame:
        """(key): the rows that stay if rows are taken in order of key and each that stays drops the later ones more similar than the threshold."""
        return self.rows().select("key").join(dropped_in_order(self.near_pairs(threshold)).withColumnRenamed("k", "key"), "key", "left_anti")
