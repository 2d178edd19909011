"""Vectors: centroids, cluster quality, nearest centroids, near duplicates and clustering.

Vector columns are array<double>. Work on components goes through posexplode and
sums, which combine before the shuffle, or through array functions on one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions.logits import dot, doubles, square_distance, unit
from curatrix.operators.graph import dropped_in_order
from curatrix.operators.minibatch import minibatch_kmeans
from curatrix.operators.sampling import uniform_sample
from curatrix.operators.written import cut

#: Most rows that bounded algorithms take on one machine (a documented parameter of theirs).
BOUNDED = 5_000
#: Most rows that average linkage takes at once: their distances are 800 MB.
LINKED = 10_000
#: Most rows of the spanning tree of density_clusters, which the driver holds (some 1 KB a row).
TREE_ROWS = 500_000


def centroids(df: DataFrame, cluster: str = "cluster", vec: str = "v") -> DataFrame:
    """(cluster, centroid, size): the mean vector of each cluster but noise (-1)."""
    t = df.filter(F.col(cluster) != -1).select(cluster, F.posexplode(vec).alias("i", "x"))
    per = t.groupBy(cluster, "i").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    got = per.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"), F.max("n").alias("size"))
    return got.select(F.col(cluster).alias("cluster"), F.transform("c", lambda p: p["x"]).alias("centroid"), "size")


def cluster_shape(df: DataFrame, cluster: str = "cluster", vec: str = "v") -> DataFrame:
    """(cluster, size, mean_distance, density, diameter): distances to the centroid; diameter is the largest."""
    c = centroids(df, cluster, vec)
    t = df.join(c.withColumnRenamed("cluster", "c_"), F.col(cluster) == F.col("c_")).withColumn("d", F.sqrt(square_distance(F.col(vec), F.col("centroid"))))
    out = t.groupBy(F.col("c_").alias("cluster")).agg(F.first("size").alias("size"), F.avg("d").alias("mean_distance"), F.max("d").alias("diameter"))
    return out.select("cluster", "size", "mean_distance", (1.0 / (F.col("mean_distance") + 1e-6)).alias("density"), "diameter")


def davies_bouldin(df: DataFrame, cluster: str = "cluster", vec: str = "v") -> DataFrame:
    """One row: davies_bouldin (999 for fewer than two clusters). Pairs are of clusters, not of rows."""
    c = centroids(df, cluster, vec)
    s = cluster_shape(df, cluster, vec).select("cluster", F.col("mean_distance").alias("s"))
    t = c.join(s, "cluster")
    a = t.select(F.col("cluster").alias("i"), F.col("centroid").alias("ci"), F.col("s").alias("si"), F.explode(F.array(F.lit(1))).alias("one"))
    b = t.select(F.col("cluster").alias("j"), F.col("centroid").alias("cj"), F.col("s").alias("sj"), F.lit(1).alias("one"))
    r = a.join(b, "one").filter("i <> j").withColumn("r", (F.col("si") + F.col("sj")) / F.sqrt(square_distance(F.col("ci"), F.col("cj"))))
    return r.groupBy("i").agg(F.max("r").alias("r")).agg(F.coalesce(F.avg("r"), F.lit(999.0)).alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, cluster: str = "cluster", vec: str = "v") -> DataFrame:
    """One row: between over within dispersion (0 for fewer than two clusters)."""
    df = df.filter(F.col(cluster) != -1)
    c = centroids(df, cluster, vec)
    everything = centroids(df.withColumn("all_", F.lit(0)), "all_", vec).select(F.col("centroid").alias("mean"))
    between = c.join(F.broadcast(everything)).agg(F.sum(F.col("size") * square_distance(F.col("centroid"), F.col("mean"))).alias("b"), F.count(F.lit(1)).alias("k"), F.sum("size").alias("n"))
    t = df.join(c.withColumnRenamed("cluster", "c_"), F.col(cluster) == F.col("c_"))
    within = t.agg(F.sum(square_distance(F.col(vec), F.col("centroid"))).alias("w"))
    ratio = (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))
    return between.join(F.broadcast(within)).select(F.when(F.col("k") > 1, ratio).otherwise(0.0).alias("calinski_harabasz"))


def silhouette(df: DataFrame, key: str, cluster: str = "cluster", vec: str = "v", sample: int = 1000, seed: int = 42) -> DataFrame:
    """One row: mean Euclidean silhouette of a sample of at most `sample` rows, drawn by key (the limit is the feature: the metric is of a sample)."""
    t = uniform_sample(df.filter(F.col(cluster) != -1), sample, key, seed).select(F.col(key).alias("k"), F.col(cluster).alias("c"), F.col(vec).alias("v"), F.lit(1).alias("one"))
    b = t.select(F.col("k").alias("k2"), F.col("c").alias("c2"), F.col("v").alias("v2"), "one")
    d = t.join(b, "one").filter("k <> k2").withColumn("d", F.sqrt(square_distance(F.col("v"), F.col("v2"))))
    m = d.groupBy("k", "c", "c2").agg(F.avg("d").alias("d"))
    s = m.groupBy("k").agg(F.max(F.when(F.col("c") == F.col("c2"), F.col("d"))).alias("a"), F.min(F.when(F.col("c") != F.col("c2"), F.col("d"))).alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return s.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("silhouette"))


def nearest_centroid(points: DataFrame, cents: DataFrame, key: str, vec: str = "v", max_broadcast: int = 100_000) -> DataFrame:
    """(key, cluster): the centroid of least Euclidean distance, ties to the smaller cluster.

    Centroids are one row for each cluster; they are sent to all tasks as one array
    while their counted number is at most max_broadcast.
    """
    if cents.count() > max_broadcast:
        raise ValueError("more clusters than max_broadcast; raise the bound if so many centroids fit in a task")
    all_ = cents.agg(F.collect_list(F.struct("cluster", "centroid")).alias("cs"))
    t = points.select(key, vec).join(F.broadcast(all_))
    best = F.array_min(F.transform("cs", lambda c: F.struct(square_distance(F.col(vec), c["centroid"]).alias("d"), c["cluster"].alias("cluster"))))
    return t.select(key, best["cluster"].alias("cluster"))


def without_noise(df: DataFrame, key: str, cluster: str = "cluster", vec: str = "v") -> DataFrame:
    """df with the rows of cluster -1 moved to their nearest centroid."""
    moved = nearest_centroid(df.filter(F.col(cluster) == -1), centroids(df, cluster, vec), key, vec).withColumnRenamed("cluster", "to_")
    return df.join(moved, key, "left").withColumn(cluster, F.coalesce("to_", cluster)).drop("to_")


def near_pairs(df: DataFrame, key: str, vec: str = "v", threshold: float = 0.95, metric: str = "cosine", tables: int = 12, bits: int | None = None, seed: int = 7) -> DataFrame:
    """(a, b, sim): pairs a < b of similarity over the threshold, by random hyperplanes with exact verification.

    metric 'cosine', or 'sql2_compat' for 1 - squared distance of unit vectors, that
    is 2 cos - 1. With bits = 0 all pairs of a block are compared, exact for small tables.
    """
    t = df.select(F.col(key).alias("k"), unit(F.col(vec)).alias("v"))
    limit = threshold if metric == "cosine" else (1 + threshold) / 2
    if bits is None:
        bits = 8
    if bits:
        dim = t.select(F.size("v").alias("n")).limit(1).collect()
        planes = np.random.default_rng(seed).standard_normal((tables, bits, dim[0]["n"] if dim else 1))

        def code(table: int):
            out = F.lit(table * (1 << bits))
            for b in range(bits):
                out = out + F.when(dot(F.col("v"), F.array(*map(F.lit, planes[table, b].tolist()))) >= 0, 1 << b).otherwise(0)
            return out

        t = t.withColumn("code", F.explode(F.array(*map(code, range(tables)))))
    else:
        t = t.withColumn("code", F.lit(0))
    other = t.select(F.col("k").alias("k2"), F.col("v").alias("v2"), "code")
    pairs = t.join(other, "code").filter("k < k2").withColumn("cos", dot(F.col("v"), F.col("v2"))).filter(F.col("cos") > limit)
    sim = F.col("cos") if metric == "cosine" else 2 * F.col("cos") - 1
    return pairs.groupBy(F.col("k").alias("a"), F.col("k2").alias("b")).agg(F.max(sim).alias("sim"))


def greedy_kept(ids: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """The keys that stay if rows are taken in order of key and one similar to a kept earlier row goes (a fixed point, not components); pairs are a < b."""
    return ids.join(dropped_in_order(pairs).withColumnRenamed("k", key), key, "left_anti")


def kmeans(df: DataFrame, key: str, k: int, vec: str = "v", seed: int = 42) -> DataFrame:
    """(key, cluster) by MLlib k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    t = df.select(key, array_to_vector(doubles(F.col(vec))).alias("features")).persist()  # every round of the fit reads it
    model = KMeans(k=k, seed=seed, maxIter=20).fit(t)
    t.unpersist()
    return model.transform(t).select(key, F.col("prediction").alias("cluster"))


def _bounded(df: DataFrame, key: str, vec: str, most: int) -> tuple[list, np.ndarray]:
    rows = df.select(key, vec).orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; use kmeans or agglomerative in two stages")
    return [r[0] for r in rows], np.array([list(r[1]) for r in rows], dtype=float)


def average_linkage(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of average linkage on cosine distance down to k clusters (for bounded tables), by chains of nearest neighbours."""
    n = len(x)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    d = u @ u.T
    np.subtract(1, d, out=d)
    np.fill_diagonal(d, np.inf)
    size, live, merges, chain = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(live.argmax()))
        while True:
            i = chain[-1]
            j = int(d[i].argmin())
            if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
                j = chain[-2]
                break
            chain.append(j)
        del chain[-2:]
        i, j = min(i, j), max(i, j)
        merges.append((d[i, j], len(merges), i, j))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        row[[i, j]] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        live[j] = False
    # The heights of the tree never fall, so its lowest merges are those of the greedy order.
    root = list(range(n))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for _, _, i, j in sorted(merges)[: n - max(1, k)] if n > k else []:
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def agglomerative(df: DataFrame, key: str, k: int, vec: str = "v", coarse: int | None = None, seed: int = 42, direct: int = LINKED) -> DataFrame:
    """(key, cluster): average linkage on cosine distance of all rows, of at most `direct`; over the centres of k-means above that, mapped back.

    There are 10 k centres, or `coarse`, at most half the rows and k at least. More
    than `direct` centres raise.
    """
    n = df.count()
    if n <= direct:
        ids, x = _bounded(df, key, vec, direct)
        names = average_linkage(x, k) if ids else []
        table = pa.table({key: pa.array(ids), "cluster": pa.array(names, pa.int32())})
        return df.sparkSession.createDataFrame(table, f"{key} {dict(df.dtypes)[key]}, cluster int")
    cs = max(k, min(coarse or 10 * k, n // 2))
    if cs > direct:
        raise ValueError(f"{cs} centres; average linkage is for at most direct = {direct}")
    first = kmeans(df, key, cs, vec, seed)
    c = centroids(df.join(first, key), "cluster", vec)
    ids, x = _bounded(c, "cluster", "centroid", cs)
    names = average_linkage(x, k)
    table = df.sparkSession.createDataFrame([(int(i), int(l)) for i, l in zip(ids, names)], "cluster int, label int")
    return first.join(F.broadcast(table), "cluster").select(key, F.col("label").alias("cluster"))


def density_clusters(df: DataFrame, key: str, vec: str = "v", min_cluster_size: int = 15, min_samples: int = 5, most: int = BOUNDED, limit: int = TREE_ROWS) -> DataFrame:
    """(key, cluster) by hierarchical density clustering on cosine distance, excess of mass; -1 is noise.

    Tables of over `most` rows get the edges of the same spanning tree from block
    products on the executors; the tree itself is built on the driver, so tables of
    over `limit` rows raise. Keys are unique.
    """
    n = df.count()
    if n > limit:
        raise ValueError(f"{n} rows; the spanning tree of density_clusters is for at most limit = {limit} rows")
    if n <= most:
        ids, x = _bounded(df, key, vec, most)
        labels = hdbscan(x, min_cluster_size, min_samples)
    else:
        ids, edges = spanning_edges(df, key, vec, min_samples)
        labels = condensed_labels(len(ids), edges, min_cluster_size)
    table = pa.table({key: pa.array(ids), "cluster": pa.array(labels, pa.int32())})
    return df.sparkSession.createDataFrame(table, f"{key} {dict(df.dtypes)[key]}, cluster int")


def spanning_edges(df: DataFrame, key: str, vec: str = "v", min_samples: int = 5, block: int = 1024, near: int = 24) -> tuple[list, list]:
    """Keys in order and the edges (height, i, j) of a minimum spanning tree of mutual reachability, i and j places in that order.

    Boruvka's rounds. The driver keeps each row's `near` nearest rows; a row whose
    list may miss its component's shortest way out is compared with all rows
    again. A way out only gets longer as components grow, so the length found
    last bounds the row's next one from below. Of edges of one height any may be taken.
    """
    spark = df.sparkSession
    parts = max(1, -(-df.count() // block))

    def pack_rows(batches):
        held = []

        def flush(rows):
            u = np.array([r[1] for r in rows], dtype=float)
            u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
            return pa.RecordBatch.from_arrays([pa.array([[r[0] for r in rows]], pa.list_(key_type[0])), pa.array([u.tobytes()], pa.binary())], names=["keys", "u"])

        key_type = [None]
        for b in batches:
            key_type[0] = b.schema.field(0).type
            held += zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            while len(held) >= block:
                yield flush(held[:block])
                del held[:block]
        if held:
            yield flush(held)

    rows = df.select(key, doubles(F.col(vec)).alias("v")).repartition(parts)
    blocks = cut(rows.mapInArrow(pack_rows, f"keys array<{dict(df.dtypes)[key]}>, u binary").withColumn("id", F.monotonically_increasing_id()))
    found = blocks.select("id", "keys").orderBy("id").collect()
    ids = [k for r in found for k in r["keys"]]
    starts = dict(zip([r["id"] for r in found], np.cumsum([0] + [len(r["keys"]) for r in found[:-1]]).tolist()))
    sizes = {r["id"]: len(r["keys"]) for r in found}
    n, near = len(ids), min(near, len(ids))
    near = max(near, min(min_samples + 1, n))

    def over_pairs(task, need, schema):
        """task(places of rows of need, their vectors, start of b, b, what it made of these rows before) for all blocks b, and what it made of each chunk of rows."""

        def pick(batches):
            held, n = [], 0
            for t in batches:
                for p, q in zip(t.column("id").to_pylist(), t.column("u").to_pylist()):
                    own = np.flatnonzero(need[starts[p] : starts[p] + sizes[p]])
                    if held and n + len(own) > block:
                        yield chunk(held)
                        held, n = [], 0
                    if len(own):
                        held.append((starts[p] + own, np.frombuffer(q).reshape(sizes[p], -1)[own]))
                        n += len(own)
            if held:
                yield chunk(held)

        def chunk(held):
            at, u = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_pydict({"at": [at.astype(np.int64).tobytes()], "u": [u.tobytes()]})

        def run(batches):
            made = {}
            for t in batches:
                for p, q, r, s in zip(t.column("at").to_pylist(), t.column("u").to_pylist(), t.column("id2").to_pylist(), t.column("u2").to_pylist()):
                    at = np.frombuffer(p, np.int64)
                    made[at[0]] = task(at, np.frombuffer(q).reshape(len(at), -1), starts[r], np.frombuffer(s).reshape(sizes[r], -1), made.get(at[0]))
            for at, d, j in made.values():
                yield pa.RecordBatch.from_pydict({"at": [at.astype(np.int64).tobytes()], "d": [d.astype(float).tobytes()], "j": [j.astype(np.int64).tobytes()]})

        # Some 48 tasks: many rows are spread by themselves, few by the blocks they are compared with.
        lanes = max(1, min(-(-int(need.sum()) // block), 24))
        left = blocks.select("id", "u").mapInArrow(pick, "at binary, u binary").repartition(lanes)
        right = blocks.select(F.col("id").alias("id2"), F.col("u").alias("u2")).repartition(min(parts, max(2, 48 // lanes)))
        return left.crossJoin(right).mapInArrow(run, schema).toArrow().to_pylist()

    def nearest(at, a, rb, b, made):
        d = 1 - a @ b.T
        if made is not None and made[1].shape[1] == near:
            # Lists are full: only what is nearer than a list's last goes on.
            last = made[1].max(1)
            row, j = np.divmod(np.flatnonzero(d < np.where(last > 0, last, -np.inf)[:, None]), len(b))
            if not len(row):
                return made
            mine, count = np.unique(row, return_counts=True)
            slot = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            more_d, more_j = np.full((len(mine), count.max()), np.inf), np.zeros((len(mine), count.max()), np.int64)
            where = np.repeat(np.arange(len(mine)), count)
            more_d[where, slot], more_j[where, slot] = np.maximum(d[row, j], 0), j + rb
            more_d, more_j = np.concatenate([made[1][mine], more_d], 1), np.concatenate([made[2][mine], more_j], 1)
            o = np.argpartition(more_d, near - 1, axis=1)[:, :near]
            made[1][mine], made[2][mine] = np.take_along_axis(more_d, o, 1), np.take_along_axis(more_j, o, 1)
            return made
        np.maximum(d, 0, out=d)
        m = min(near, len(b))
        j = np.argpartition(d, m - 1, axis=1)[:, :m] if m < len(b) else np.tile(np.arange(m), (len(a), 1))
        d, j = np.take_along_axis(d, j, 1), j + rb
        if made is not None:
            d, j = np.concatenate([made[1], d], 1), np.concatenate([made[2], j], 1)
            if d.shape[1] > near:
                o = np.argpartition(d, near - 1, axis=1)[:, :near]
                d, j = np.take_along_axis(d, o, 1), np.take_along_axis(j, o, 1)
        return at, d, j

    schema = "at binary, d binary, j binary"
    list_d, list_j = np.full((n, 0), np.inf), np.zeros((n, 0), np.int64)
    parts_of = {}
    for r in over_pairs(nearest, np.ones(n, bool), schema):
        at = np.frombuffer(r["at"], np.int64)
        d, j = np.frombuffer(r["d"]).reshape(len(at), -1), np.frombuffer(r["j"], np.int64).reshape(len(at), -1)
        was = parts_of.get(at[0])
        parts_of[at[0]] = (at, d, j) if was is None else (at, np.concatenate([was[1], d], 1), np.concatenate([was[2], j], 1))
    list_d, list_j = np.zeros((n, near)), np.zeros((n, near), np.int64)
    for at, d, j in parts_of.values():
        o = np.argsort(d, axis=1, kind="stable")[:, :near]
        list_d[at], list_j[at] = np.take_along_axis(d, o, 1), np.take_along_axis(j, o, 1)
    del parts_of
    core = list_d[:, min(min_samples, n - 1)].copy()
    low = np.maximum(core, list_d[:, -1]) if near < n else np.full(n, np.inf)  # no row outside the list is nearer
    reach = np.maximum(np.maximum(list_d, core[:, None]), core[list_j])
    way, to = np.full(n, np.inf), np.full(n, -1)  # shortest way out of a row that a scan found
    comp, edges = np.arange(n), []
    while True:
        count = len(np.unique(comp))
        if count < 2:
            break
        scanned = (to >= 0) & (comp[to] != comp)
        out = np.where(comp[list_j] != comp[:, None], reach, np.inf)
        slot = out.argmin(1)
        best, goal = out[np.arange(n), slot], list_j[np.arange(n), slot]
        best, goal = np.where(scanned, np.minimum(way, np.inf), best), np.where(scanned, to, goal)
        top = np.full(n, np.inf)
        np.minimum.at(top, comp, best)
        need = ~scanned & (low < np.minimum(best, top[comp]))
        if need.any():
            share = spark.sparkContext.broadcast((comp, core))

            def outward(at, a, rb, b, made):
                comp, core = share.value
                d = 1 - a @ b.T
                if made is not None:
                    # Only what is nearer than the way found so far can be a shorter one.
                    row, j = np.divmod(np.flatnonzero(d < made[1][:, None]), len(b))
                    out = comp[at][row] != comp[rb + j]
                    row, j = row[out], j[out]
                    if len(row):
                        d = np.maximum(np.maximum(d[row, j], core[rb + j]), core[at][row])
                        first = np.lexsort((j, d, row))
                        first = first[np.diff(row[first], prepend=-1) > 0]
                        first = first[d[first] < made[1][row[first]]]
                        made[1][row[first]], made[2][row[first]] = d[first], j[first] + rb
                    return made
                np.maximum(d, core[rb : rb + len(b)], out=d)
                d[comp[at][:, None] == comp[rb : rb + len(b)]] = np.inf
                j = d.argmin(1)
                return at, np.maximum(d[np.arange(len(at)), j], core[at]), j + rb

            way[need], to[need] = np.inf, -1
            for r in over_pairs(outward, need, schema):
                at, d, j = np.frombuffer(r["at"], np.int64), np.frombuffer(r["d"]), np.frombuffer(r["j"], np.int64)
                less = d < way[at]
                way[at[less]], to[at[less]] = d[less], j[less]
            low[need] = np.maximum(low[need], way[need])
            share.unpersist()
            best, goal = np.where(need, way, best), np.where(need, to, goal)
        # The shortest way out of each component, then Kruskal over these: a tie never closes a circle.
        order = np.lexsort((goal, best))
        order = order[np.isfinite(best[order])]
        first = order[np.sort(np.unique(comp[order], return_index=True)[1])]
        root = {int(c): int(c) for c in np.unique(comp)}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for i in first.tolist():
            a, b = find(int(comp[i])), find(int(comp[goal[i]]))
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((float(best[i]), i, int(goal[i])))
        names = np.zeros(n, np.int64)
        for c in root:
            names[c] = find(c)
        comp = names[comp]
    order = sorted(range(n), key=lambda i: ids[i])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    edges = sorted((h, *sorted((int(place[i]), int(place[j])))) for h, i, j in edges)
    return [ids[i] for i in order], edges


def hdbscan(x: np.ndarray, min_cluster_size: int = 15, min_samples: int = 5) -> np.ndarray:
    """Labels by the published method (Campello, Moulavi and Sander 2013): mutual reachability, spanning tree, condensed tree, excess of mass."""
    n = len(x)
    if n < 2:
        return np.full(n, -1)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    d = np.maximum(1 - u @ u.T, 0)
    core = np.sort(d, axis=1)[:, min(min_samples, n - 1)]
    d = np.maximum(np.maximum(core[:, None], core[None]), d)
    # Minimum spanning tree (Prim).
    done, best, frm, edges = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    now = 0
    for _ in range(n - 1):
        done[now] = True
        up = ~done & (d[now] < best)
        best[up], frm[up] = d[now][up], now
        nxt = int(np.where(done, np.inf, best).argmin())
        edges.append((best[nxt], frm[nxt], nxt))
        now = nxt
    return condensed_labels(n, sorted(edges), min_cluster_size)


def condensed_labels(n: int, edges: list, min_cluster_size: int) -> np.ndarray:
    """Labels of n rows from the edges (height, i, j) of their spanning tree, in order of height."""
    # Single-linkage tree: node -> (children, height).
    root, kids, size = list(range(n)), {}, {i: 1 for i in range(n)}

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for h, a, b in edges:
        a, b = find(a), find(b)
        c = len(root)
        root.append(c)
        root[a] = root[b] = c
        kids[c], size[c] = (a, b, h), size[a] + size[b]

    def leaves(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            v = stack.pop()
            stack += kids[v][:2] if v in kids else []
            if v not in kids:
                out.append(v)
        return out

    top = len(root) - 1
    tree: list[dict] = [{"node": top, "birth": 0.0, "mass": 0.0, "kids": []}]
    stack = [(top, 0)]
    while stack:
        node, c = stack.pop()
        a, b, h = kids[node]
        lam = 1 / max(h, 1e-12)
        big = [v for v in (a, b) if size[v] >= min_cluster_size]
        for v in (a, b):
            if len(big) == 2:
                tree.append({"node": v, "birth": lam, "mass": 0.0, "kids": []})
                tree[c]["kids"].append(len(tree) - 1)
                tree[c]["mass"] += size[v] * (lam - tree[c]["birth"])
                if v in kids:
                    stack.append((v, len(tree) - 1))
            elif v in big:
                if v in kids:
                    stack.append((v, c))
            else:
                tree[c]["mass"] += size[v] * (lam - tree[c]["birth"])
    chosen: set[int] = set()
    value = [0.0] * len(tree)
    for c in range(len(tree) - 1, 0, -1):
        below = sum(value[k] for k in tree[c]["kids"])
        if tree[c]["mass"] >= below:
            value[c] = tree[c]["mass"]
            drop = list(tree[c]["kids"])
            while drop:
                k = drop.pop()
                chosen.discard(k)
                drop += tree[k]["kids"]
            chosen.add(c)
        else:
            value[c] = below
    labels = np.full(n, -1)
    for i, c in enumerate(sorted(chosen)):
        labels[leaves(tree[c]["node"])] = i
    return labels


def refined(df: DataFrame, key: str, k: int, vec: str = "v", seed: int = 42) -> DataFrame:
    """(key, cluster): k-means, then clusters that are large (size over the 75th percentile) and loose (density under the 25th) are split into min(3, size // 50); the first part keeps the id."""
    first = df.join(kmeans(df, key, k, vec, seed), key)
    shape = cluster_shape(first, "cluster", vec)
    cut = shape.agg(F.percentile("size", 0.75).alias("s"), F.percentile("density", 0.25).alias("d"))
    loose = shape.join(F.broadcast(cut)).filter((F.col("size") > F.col("s")) & (F.col("density") < F.col("d"))).select("cluster", "size").orderBy("cluster").collect()
    out, next_id = first.select(key, "cluster"), k
    for r in loose:  # at most a quarter of k clusters
        parts = min(3, r["size"] // 50)
        if parts > 1:
            sub = kmeans(first.filter(F.col("cluster") == r["cluster"]), key, parts, vec, seed).withColumnRenamed("cluster", "sub_")
            new = F.when(F.col("sub_") > 0, F.col("sub_") - 1 + next_id).otherwise(F.col("cluster"))
            out = out.join(sub, key, "left").withColumn("cluster", new).drop("sub_")
            next_id += parts - 1
    return out


def fit_predict(df: DataFrame, key: str, method: str = "kmeans", k: int = 10, vec: str = "v", seed: int = 42, **options) -> DataFrame:
    """(key, cluster) by method: kmeans, minibatch, hdbscan (noise moved to the nearest cluster), agglomerative or hybrid."""
    if method == "kmeans":
        return kmeans(df, key, k, vec, seed)
    if method == "minibatch":
        return minibatch_kmeans(df, key, k, vec, seed, **options)
    if method == "agglomerative":
        return agglomerative(df, key, k, vec, seed=seed)
    if method == "hybrid":
        return refined(df, key, k, vec, seed)
    if method == "hdbscan":
        found = df.join(density_clusters(df, key, vec, **options), key)
        if not found.filter("cluster >= 0").take(1):
            return found.select(key, "cluster")
        return without_noise(found, key, "cluster", vec).select(key, "cluster")
    raise ValueError(f"unknown method {method}")


def cluster_evaluation(df: DataFrame, key: str, cluster: str = "cluster", vec: str = "v") -> DataFrame:
    """One row: size statistics, entropy and the three quality indices of a clustering."""
    from curatrix.operators.stats import cluster_sizes

    noise = df.agg(F.count(F.when(F.col(cluster) == -1, 1)).alias("n_noise"))
    out = cluster_sizes(df, cluster).join(F.broadcast(noise))
    for part in (silhouette(df, key, cluster, vec), davies_bouldin(df, cluster, vec), calinski_harabasz(df, cluster, vec)):
        out = out.join(F.broadcast(part))
    return out


def compare_methods(df: DataFrame, key: str, methods: list[str], k: int, vec: str = "v") -> DataFrame:
    """One row of cluster_evaluation for each method, with its time in seconds; recommended is the first of the largest silhouette."""
    import time

    rows = []
    for m in methods:
        began = time.time()
        labels = cut(fit_predict(df, key, m, k, vec))
        rows.append(cluster_evaluation(df.join(labels, key), key, "cluster", vec).withColumns({"method": F.lit(m), "seconds": F.lit(time.time() - began)}))
    out = cut(reduce(lambda a, b: a.unionByName(b), rows))
    order = F.create_map(*[x for i, m in enumerate(methods) for x in (F.lit(m), F.lit(i))])
    best = out.orderBy(F.desc("silhouette"), order[F.col("method")]).limit(1).select(F.col("method").alias("best_"))  # a row for each method
    return out.join(F.broadcast(best)).withColumn("recommended", F.col("method") == F.col("best_")).drop("best_")


def hashed_ngrams(df: DataFrame, text: str = "text", dims: int = 256, n: int = 2) -> DataFrame:
    """df plus v: counts of character n-grams of the lower-cased text hashed to dims slots, at unit length (an offline stand-in for an embedding model, in Arrow batches)."""
    @F.arrow_udf("array<double>", F.ArrowUDFType.SCALAR_ITER)
    def embed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            out = np.zeros((len(texts), dims))
            for row, x in enumerate(texts):
                code = np.frombuffer((x.as_py() or "").lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
                h = np.zeros(max(0, len(code) - n + 1), np.uint64)
                for j in range(n):
                    h = (h ^ code[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                v = np.bincount(((h >> np.uint64(40)) % np.uint64(dims)).astype(np.int64), minlength=dims).astype(float)
                out[row] = v / max(np.linalg.norm(v), 1e-12)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * dims), pa.array(out.ravel()))

    return df.withColumn("v", embed(F.col(text)))


def tfidf(df: DataFrame, key: str, text: str = "text", max_features: int = 5000, min_df: int = 2, max_df: float = 0.8) -> DataFrame:
    """(key, term, tf, weight): raw counts times ln((1 + n) / (1 + df)) + 1, at unit length for each row; terms are runs of letters and digits.

    The vocabulary is the max_features most frequent terms within the bounds (ties by
    term); its size is bounded by the parameter, so it is sent to all tasks.
    """
    spark, name = df.sparkSession, dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("k_"), F.coalesce(F.col(text), F.lit("")).alias("t_"))
    # Rows of one key are one document; where keys are unique, as they mostly are, no text moves.
    twice = cut(rows.groupBy("k_").agg(F.count(F.lit(1)).alias("n_")).filter("n_ > 1").select(F.col("k_").alias("d_")))
    if twice.take(1):
        same = F.col("k_").eqNullSafe(F.col("d_"))
        joined = rows.join(twice, same, "left_semi").groupBy("k_").agg(F.concat_ws(" ", F.collect_list("t_")).alias("t_"))
        rows = rows.join(twice, same, "left_anti").unionByName(joined)
    rows = rows.select("k_", F.split("t_", r"[^\p{L}\p{N}]+").alias("w_"))

    def count(batches):
        for keys, terms, row, term, tf in _term_counts(batches):
            yield pa.RecordBatch.from_pydict({"term": terms, "df": pa.array(np.bincount(term, minlength=len(terms))), "total": pa.array(np.bincount(term, tf, len(terms)).astype(np.int64))})

    vocab = rows.mapInArrow(count, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    vocab = vocab.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("n_docs"))))
    vocab = vocab.filter((F.col("df") >= min_df) & (F.col("df") <= F.col("n_docs") * max_df)).orderBy(F.desc("total"), "term").limit(max_features)
    found = vocab.select("term", F.ln((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0).toArrow().combine_chunks()
    share = spark.sparkContext.broadcast((found.column(0).to_pylist(), found.column(1).to_numpy()))

    def weigh(batches):
        known, idf = pa.array(share.value[0], pa.string()), share.value[1]
        for keys, terms, row, term, tf in _term_counts(batches):
            place = pc.index_in(terms, known).fill_null(-1).to_numpy()[term]
            keep = place >= 0
            row, term, tf, w = row[keep], term[keep], tf[keep], tf[keep] * idf[place[keep]]
            norm = np.sqrt(np.bincount(row, w * w, len(keys)))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), terms.take(pa.array(term)), pa.array(tf), pa.array(w / norm[row])], names=["k_", "term", "tf", "weight"])

    return rows.mapInArrow(weigh, f"k_ {name}, term string, tf long, weight double").withColumnRenamed("k_", key)


def _term_counts(batches, rows: int = 2000) -> Iterator[tuple]:
    """(keys, distinct terms, row, term, count) for slices of batches of a key and its words: row and term are places, one of each pair."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            part = b.slice(lo, rows)
            words = part.column(1).flatten().cast(pa.string()).dictionary_encode()
            row = np.repeat(np.arange(part.num_rows), part.column(1).value_lengths().to_numpy())
            terms, term = words.dictionary, words.indices.to_numpy().astype(np.int64)
            full = pc.greater(pc.binary_length(terms), 0).to_numpy(zero_copy_only=False)[term]
            pair, tf = np.unique(row[full] * max(1, len(terms)) + term[full], return_counts=True)
            yield part.column(0), terms, pair // max(1, len(terms)), pair % max(1, len(terms)), tf


def text_classifier(train: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 16):
    """A fitted MLlib pipeline: words, hashed counts, inverse document frequency, logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    words = RegexTokenizer(inputCol=text, outputCol="words_", pattern=r"[^\p{L}\p{N}]+", minTokenLength=1)
    counts = HashingTF(inputCol="words_", outputCol="tf_", numFeatures=features)
    return Pipeline(stages=[words, counts, IDF(inputCol="tf_", outputCol="x_"), LogisticRegression(featuresCol="x_", labelCol=label, maxIter=30)]).fit(train)
