"""Approximate nearest neighbours by adaptive dimension scan over inverted lists.

Largest inner product is turned into smallest distance by one more coordinate,
sqrt(M**2 - |x|**2) for rows and 0 for queries (M: the largest norm). Vectors are
rotated by a random orthogonal matrix, so that the first d of D coordinates hold
about d / D of a squared distance. Rows are dealt to the lists of a k-means
quantizer fitted on a bounded sample; lists number about the square root of the
rows, through a second level of centroids above FINEST. A query probes the lists
of its nearest centroids. Inside a list, candidates are scanned in column blocks:
after each block, a candidate is abandoned if its partial distance, scaled to all
D coordinates, exceeds the distance of the query's present K-th best by more than
the margin (1 + eps / sqrt(d)) of a hypothesis test. The K-th best is tightened
after every CHUNK candidates. A query's nearest lists, an eighth of those it
probes, are scanned first, and the K-th best found there goes along to its other
lists, so that the tests act from their first candidate on. Survivors get the
exact inner product of the original vectors in double precision.

How many lists to probe, and the eps of the tests, are set together: for a bounded
sample of queries the true neighbours are found by brute force over all rows, with
the list of each and its partial distances. From these follows the recall of any
number of lists and any eps, and from a bounded sample of rows the share of column
sums that is left; the cheapest pair that reaches `recall` is taken. The search
itself is then held against the true neighbours, and a dearer pair is taken where
it finds less; the last one is all lists without tests. Long lists are split into
blocks of bounded size, and each block of a list is a task's group of its own.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part; ties go to the smaller id;
repeated rows are separate candidates and separate queries, told apart by a
number among the rows of a vec_id, so each is a neighbour of the other; with
fewer candidates than K all are returned; an empty table gives an empty result;
other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.llm.common import GOLD, materialize, sliced, splitmix

#: Rows of the k-means sample, of a block of a list, queries in the recall sample, and rows in the sample for costs.
SAMPLE, BLOCK, TUNE, COSTS = 20_000, 4_096, 256, 1_024
#: Columns added at each step of a scan, eps of the test, and candidates between two looks at the K-th best.
COLUMNS, EPS, CHUNK = 8, 2.1, 512
#: Values of eps to choose from; at the last nothing is abandoned before its whole distance is known.
CHOICES = (0.4, 0.6, 0.8, 1.0, 1.2, 1.5, 2.1, 1e9)
#: Centroids that are fitted directly; more lists come from a second level.
FINEST = 1024


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, copy, v) of the rows that take part; copy: number among the rows of a vec_id."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    big = float(np.finfo(np.float64).max)
    df = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= big)) & F.exists("v", lambda x: x != 0)
    df = df.filter(fine)
    size = df.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    n = size.collect()
    df = df.filter(F.size("v") == F.lit(n[0]["n"])) if n else df
    # The ids alone tell whether there are repeats; only then are rows numbered.
    most = df.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).collect()[0][0]
    if (most or 0) < 2:
        return df.select("vec_id", F.lit(0).alias("copy"), "v")
    return materialize(df.select("vec_id", (F.row_number().over(W.partitionBy("vec_id").orderBy("v")) - 1).alias("copy"), "v"))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Index:
    def __init__(self, sample: np.ndarray, top: float, k: int, seed: int = 5):
        self.top, d = top, sample.shape[1]
        q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d + 1, d + 1)))
        self.rotation = q
        x = self.rotate(sample, True)
        self.centroids = kmeans(x, min(k, FINEST, max(1, len(x) // 16)), seed=seed)
        if k > FINEST:
            # Second level: centroids of what is left of the sample after the first, at each of the first.
            left = x - self.centroids[self.lists(x, 1)[:, 0]]
            fine = kmeans(left, -(-k // FINEST), seed=seed)
            self.centroids = (self.centroids[:, None] + fine[None]).reshape(-1, x.shape[1])
        self.blocks = np.ones(len(self.centroids), np.int64)

    def rotate(self, v: np.ndarray, rows: bool) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.top**2 - (v * v).sum(1), 0.0)) if rows else np.zeros(len(v))
        return np.hstack([v, extra[:, None]]) @ self.rotation

    def lists(self, rotated: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each vector, nearest first."""
        norm, out = (self.centroids**2).sum(1)[None], []
        step = max(1, 4_000_000 // norm.shape[1])
        for lo in range(0, len(rotated), step):
            d = norm - 2 * rotated[lo : lo + step] @ self.centroids.T
            at = d.argmin(1)[:, None] if n == 1 else np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
            out.append(np.take_along_axis(at, np.take_along_axis(d, at, 1).argsort(1, kind="stable"), 1))
        return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def scan(q_vec, q_rot, own, bound, ids, vec, rot, k: int, columns: int = COLUMNS, eps: float = EPS, chunk: int = CHUNK):
    """(query index, row index, score) of the k best of a block for each query by adaptive dimension scan, and the share of column sums spared.

    own: row index of the query itself, or -1; bound: squared distance of its K-th best so far, or infinity.
    """
    n, dims = rot.shape
    out, spared, whole = [], 0, 0
    most = float((rot[0] ** 2).sum()) if n else 0.0
    for a in range(len(q_vec)):
        slack = 1e-12 * (most + float((q_rot[a] ** 2).sum()))  # rounding; copies are at distances of next to nothing
        limit, best = bound[a], np.zeros(0)
        rows, dist = [], []
        lo, size = 0, max(2 * k, 64)
        while lo < n:
            alive = np.arange(lo, min(n, lo + size))
            alive = alive[alive != own[a]]
            part, d = np.zeros(len(alive)), 0
            whole += len(alive) * dims
            while d < dims and len(alive):
                e = min(dims, d + columns)
                diff = rot[alive, d:e] - q_rot[a, d:e]
                part += np.einsum("ij,ij->i", diff, diff)
                d = e
                ok = part * (dims / d) <= (limit + slack) * (1 + eps / np.sqrt(d)) ** 2 if d < dims else part <= limit * (1 + 1e-9) + slack
                if not ok.all():
                    spared += int((~ok).sum()) * (dims - d)
                    alive, part = alive[ok], part[ok]
            rows.append(alive)
            dist.append(part)
            best = np.concatenate([best, part])
            if len(best) >= k:
                best = np.partition(best, k - 1)[:k]
                limit = min(limit, float(best.max()))
            lo, size = lo + size, chunk
        cand, dist = np.concatenate(rows), np.concatenate(dist)
        cand = cand[dist <= limit * (1 + 1e-9) + slack]  # those that tie with the k-th stay, for the ids to decide
        s = (vec[cand] * q_vec[a]).sum(1)  # row by row, so that equal vectors have equal scores
        top = np.lexsort((ids[cand], -s))[:k]
        out.append((np.full(len(top), a), cand[top], s[top]))
    q, i, s = (np.concatenate([o[j] for o in out]) if out else np.zeros(0) for j in range(3))
    return q.astype(np.int64), i.astype(np.int64), s.astype(np.float64), spared / max(1, whole)


def _matrix(blobs) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float64) for b in blobs]) if len(blobs) else np.zeros((0, 0))


def _vectors(column: pa.Array) -> np.ndarray:
    """An array column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def profiles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Partial squared distances of the rows of a and b after each step of COLUMNS columns."""
    ends = np.append(np.arange(COLUMNS, a.shape[-1], COLUMNS), a.shape[-1]) - 1
    return np.cumsum((a - b) ** 2, axis=-1)[..., ends]


def passes(profile: np.ndarray, bound: np.ndarray, eps: float, dims: int) -> np.ndarray:
    """Of each profile, whether it stands the test after each step but the last and all before it."""
    d = np.arange(1, profile.shape[-1]) * COLUMNS
    return np.logical_and.accumulate(profile[..., :-1] * (dims / d) <= bound[..., None] * (1 + eps / np.sqrt(d)) ** 2, axis=-1)


HITS = "query_id long, query_copy int, vec_id long, copy int, score double"
FOUND = "query_id long, rank int, vec_id long, score double, probed_share double, spared_share double, sample_recall double"


@dataclass
class Plan:
    """Lists that a query scans first, lists it probes, eps; recall on the sample, and the share of column sums that tests spare by the sample of rows."""

    near: int
    lists: int
    eps: float
    recall: float | None = None
    spared: float | None = None


def neighbours(df: DataFrame, is_query, k: int = 20, recall: float = 0.915, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every query row (is_query: a condition on vec_id).

    probed_share, spared_share and sample_recall are those of the whole search: lists
    probed of all, column sums spared by the tests as estimated, recall on the sample
    (null where nothing was to be chosen). recall = 1 compares with all rows.
    """
    spark = df.sparkSession
    vectors = usable(df, id_col, vec_col)
    stats = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).collect()[0]
    if not stats["n"]:
        return spark.createDataFrame([], FOUND)
    picked = vectors.orderBy(F.xxhash64("vec_id", "copy", F.lit(3)), "vec_id", "copy").limit(SAMPLE).toArrow()
    sample = np.array(picked.column("v").to_pylist(), dtype=np.float64)
    index = Index(sample, float(np.sqrt(stats["m"])) or 1.0, int(max(1, round(np.sqrt(stats["n"])))))
    del picked, sample
    return Search(spark, vectors, index, k).run(vectors.filter(is_query), recall)


class Search:
    """The rows of an index, and the two rounds of a search."""

    def __init__(self, spark, vectors: DataFrame, index: Index, k: int):
        self.spark, self.index, self.k = spark, index, k
        plain = self.assign(vectors, 0, 1, True)
        # One row for each list; lists number about the square root of the rows.
        for r in plain.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
            index.blocks[r["list"]] = max(1, -(-r["n"] // BLOCK))
        self.rows = materialize(self.assign(vectors, 0, 1, True))

    def assign(self, table: DataFrame, first: int, last: int, rows: bool) -> DataFrame:
        """(list, block, vec_id, copy, v, bound): rows go to one block of their nearest list, queries to all blocks of their nearest lists first..last-1."""
        share = self.spark.sparkContext.broadcast(self.index)

        def run(batches):
            ix = share.value
            for b in sliced(batches, 2000):
                ids, copy, v = b.column("vec_id").to_numpy(zero_copy_only=False), b.column("copy").to_numpy(zero_copy_only=False), _vectors(b.column("v"))
                at = ix.lists(ix.rotate(v, rows), last)[:, first:]
                who, to = np.repeat(np.arange(len(ids)), at.shape[1]), at.ravel()
                if rows:
                    block = (splitmix(ids.view(np.uint64) + copy.astype(np.uint64) * GOLD) % ix.blocks[to].astype(np.uint64)).astype(np.int32)
                else:
                    n = ix.blocks[to]
                    block = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
                    who, to = np.repeat(who, n), np.repeat(to, n)
                bound = np.full(len(who), np.inf) if rows or "bound" not in b.schema.names else b.column("bound").fill_null(np.inf).to_numpy(zero_copy_only=False)[who]
                yield pa.RecordBatch.from_pydict({"list": pa.array(to.astype(np.int32)), "block": pa.array(block), "vec_id": pa.array(ids[who]), "copy": pa.array(copy[who].astype(np.int32)), "v": pa.array([v[w].tobytes() for w in who], pa.binary()), "bound": pa.array(bound, pa.float64())})

        return table.mapInArrow(run, "list int, block int, vec_id long, copy int, v binary, bound double")

    def probe(self, queries: DataFrame, first: int, last: int, eps: float) -> DataFrame:
        """HITS of the lists first..last-1 of the queries: at most k of each block for each query."""
        share, k = self.spark.sparkContext.broadcast(self.index), self.k

        def join(key, q: pa.Table, c: pa.Table) -> pa.Table:
            ix = share.value
            if not (q.num_rows and c.num_rows):
                return pa.table({n: pa.array([], t) for n, t in zip(("query_id", "query_copy", "vec_id", "copy", "score"), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64()))})
            qi, qc, ci, cc = (t.column(n).to_numpy() for t in (q, c) for n in ("vec_id", "copy"))
            order = np.lexsort((cc, ci))  # ties then go to the smaller id, and the query's own row is found by search
            ci, cc = ci[order], cc[order]
            qv, cv = _matrix(q.column("v").to_pylist()), _matrix(c.column("v").to_pylist())[order]
            own = np.full(len(qi), -1)
            for j in range(len(qi)):
                lo, hi = np.searchsorted(ci, qi[j]), np.searchsorted(ci, qi[j], side="right")
                at = lo + np.searchsorted(cc[lo:hi], qc[j])
                if at < hi and cc[at] == qc[j]:
                    own[j] = at
            mixed = np.random.default_rng(len(ci)).permutation(len(ci))  # ids may go with places; a scan wants any order
            back = np.empty(len(ci), np.int64)
            back[mixed] = np.arange(len(ci))
            a, i, s, _ = scan(qv, ix.rotate(qv, False), np.where(own >= 0, back[own], -1), q.column("bound").to_numpy(), mixed, cv[mixed], ix.rotate(cv[mixed], True), k, eps=eps)
            i = mixed[i]
            return pa.table({"query_id": pa.array(qi[a]), "query_copy": pa.array(qc[a]), "vec_id": pa.array(ci[i]), "copy": pa.array(cc[i]), "score": pa.array(s)})

        return self.assign(queries, first, last, False).groupBy("list", "block").cogroup(self.rows.groupBy("list", "block")).applyInArrow(join, HITS)

    def ranked(self, hits: DataFrame) -> DataFrame:
        order = W.partitionBy("query_id", "query_copy").orderBy(F.desc("score"), "vec_id", "copy")
        return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= self.k)

    def search(self, queries: DataFrame, plan: Plan) -> DataFrame:
        """Ranked hits; the nearest lists first, the others with the K-th best of these as bound."""
        near = materialize(self.ranked(self.probe(queries, 0, plan.near, plan.eps)))
        if plan.lists <= plan.near:
            return near
        # Squared distances: |q|**2 + M**2 - 2 * score, where all rows have norm M.
        kth = near.filter(F.col("rank") == self.k).select(F.col("query_id").alias("vec_id"), F.col("query_copy").alias("copy"), F.col("score").alias("kth"))
        size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        # A little room for rounding, as the bound comes from scores and is held against distances.
        square = size + F.lit(self.index.top**2) - 2 * F.col("kth")
        bound = F.when(F.col("kth").isNotNull(), F.greatest(square, F.lit(0.0)) * F.lit(1 + 1e-6) + F.lit(1e-9 * self.index.top**2))
        more = queries.join(kth, ["vec_id", "copy"], "left").select("vec_id", "copy", "v", bound.alias("bound"))
        return self.ranked(near.drop("rank").unionByName(self.probe(more, plan.near, plan.lists, plan.eps)))

    def run(self, queries: DataFrame, recall: float) -> DataFrame:
        plan = self.tuned(queries, recall)
        told = [F.lit(v).cast("double").alias(n) for n, v in (("probed_share", plan.lists / len(self.index.centroids)), ("spared_share", plan.spared), ("sample_recall", plan.recall))]
        return self.search(queries, plan).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", *told)

    def truth(self, qi, qc, qv):
        """(q, list, profile) of the true neighbours of the sample queries and the score of the last of each, by brute force; a task gives at most k rows for each query."""
        k, bundle = self.k, self.spark.sparkContext.broadcast((qi, qc, qv, self.index))

        def brute(batches):
            ids, copies, vs, ix = bundle.value
            rot = ix.rotate(vs, False)
            best = [np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64), None]
            for b in sliced(batches, 2000):
                ci, cc, cl = (b.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "copy", "list"))
                m = _matrix(b.column("v").to_pylist())
                s = vs @ m.T
                s[(ids[:, None] == ci[None]) & (copies[:, None] == cc[None])] = -np.inf
                n = min(k, s.shape[1])
                at = np.argpartition(-s, n - 1, axis=1)[:, :n]
                new = [np.take_along_axis(s, at, 1), cl[at].astype(np.int64), profiles(ix.rotate(m, True)[at], rot[:, None])]
                best = new if best[2] is None else [np.concatenate([x, y], 1) for x, y in zip(best, new)]
                if best[0].shape[1] > k:
                    at = np.argpartition(-best[0], k - 1, axis=1)[:, :k]
                    best = [np.take_along_axis(x, at if x.ndim == 2 else at[..., None], 1) for x in best]
            if best[2] is not None:
                s, cl, prof = (x.reshape(-1, *x.shape[2:]) for x in best)
                who = np.repeat(np.arange(len(ids)), best[0].shape[1])
                yield pa.RecordBatch.from_pydict({"q": pa.array(who), "score": pa.array(s), "list": pa.array(cl), "profile": pa.array([p.tobytes() for p in prof], pa.binary())})

        best = self.rows.mapInArrow(brute, "q long, score double, list long, profile binary").filter(F.col("score") > float("-inf"))
        first = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))
        t = best.withColumn("r", first).filter(F.col("r") <= k).toArrow()
        q, score = t.column("q").to_numpy(), t.column("score").to_numpy()
        worst = np.full(len(qi), np.inf)
        np.minimum.at(worst, q, score)
        return q, t.column("list").to_numpy(), _matrix(t.column("profile").to_pylist()), worst

    def tuned(self, queries: DataFrame, recall: float) -> Plan:
        """The cheapest number of lists and eps whose search finds `recall` of the true neighbours of the sample queries."""
        ix, k, total = self.index, self.k, len(self.index.centroids)
        picked = queries.orderBy(F.xxhash64("vec_id", "copy", F.lit(4)), "vec_id", "copy").limit(TUNE).toArrow()
        if not picked.num_rows or total == 1 or recall >= 1:
            return Plan(1, total, CHOICES[-1] if recall >= 1 else EPS)
        qi, qc, qv = picked.column("vec_id").to_numpy(), picked.column("copy").to_numpy(), np.array(picked.column("v").to_pylist(), dtype=np.float64)
        rot = ix.rotate(qv, False)
        dims = rot.shape[1]
        place = np.empty((len(qi), total), np.int64)
        np.put_along_axis(place, ix.lists(rot, total), np.arange(total)[None], 1)
        q, at, profile, worst = self.truth(qi, qc, qv)
        if not len(q):
            return Plan(1, total, CHOICES[-1])
        need = place[q, at]
        near = max(1, int(round((np.sort(need)[min(len(need) - 1, int(recall * len(need)))] + 1) / 8)))
        sample = self.spark.createDataFrame([(int(i), int(c), v.tolist()) for i, c, v in zip(qi, qc, qv)], "vec_id long, copy int, v array<double>")
        spot = {(int(i), int(c)): j for j, (i, c) in enumerate(zip(qi, qc))}
        # The bound that the further lists get, and what tests against it spare of a sample of rows.
        bound = np.full(len(qi), np.inf)
        for r in self.ranked(self.probe(sample, 0, near, EPS)).filter(F.col("rank") == k).collect():
            j = spot[r["query_id"], r["query_copy"]]
            bound[j] = max(0.0, (qv[j] ** 2).sum() + ix.top**2 - 2 * r["score"]) * (1 + 1e-6) + 1e-9 * ix.top**2
        rows = self.rows.orderBy(F.xxhash64("vec_id", "copy", F.lit(5)), "vec_id", "copy").limit(COSTS).select("list", "v").toArrow()
        there = place[:, rows.column("list").to_numpy()]
        other = ix.rotate(_matrix(rows.column("v").to_pylist()), True)
        steps = np.diff(np.append(np.arange(0, dims, COLUMNS), dims)) / dims
        counts = sorted({min(total, max(near, int(round(1.1**i)))) for i in range(int(np.log(total) / np.log(1.1)) + 2)})
        plans = []
        for eps in CHOICES:
            held = (need < near) | passes(profile, bound[q], eps, dims).all(-1)
            cost = np.stack([steps[0] + passes(profiles(rot[j][None], other), np.full(len(other), bound[j]), eps, dims) @ steps[1:] for j in range(len(qi))])
            cost[there < near] = 1.0
            for n in counts:
                looked = there < n
                plans.append((float((cost * looked).mean()), float((held & (need < n)).mean()), n, eps, 1 - float((cost * looked).sum()) / max(1, int(looked.sum()))))
        plans.sort()
        want = recall
        while True:
            chosen = next((p for p in plans if p[1] >= want), None)
            if chosen is None:
                return Plan(near, total, CHOICES[-1], 1.0, 0.0)
            plan = Plan(near, chosen[2], chosen[3], spared=chosen[4])
            got = self.search(sample, plan).select("query_id", "query_copy", "score").collect()
            plan.recall = sum(r["score"] >= worst[spot[r["query_id"], r["query_copy"]]] - 1e-9 * ix.top**2 for r in got) / len(q)
            if plan.recall >= recall:
                return plan
            want = chosen[1] + max(0.004, recall - plan.recall)
