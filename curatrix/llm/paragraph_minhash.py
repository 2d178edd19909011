"""Substring dedup: paragraph MinHash banding, over lines and over passages cut by content.

Lines: texts part into lines at line feeds. Lines of at least `least_words` words
become sets of k-word shingles, their MinHash signatures are cut into bands, and
lines that share a band are candidates. The bands are tuned: of all ways to cut
the signature, the one with the most rows in a band that still finds a pair at
the threshold with probability `recall`. Candidates are verified by exact Jaccard
similarity, and the lines of a connected component are one cluster: its first
line (smallest doc_id, then position) stays, all others go. Equal lines are one
node from the start and never compared in pairs; see setlinks for how large groups
are linked without all pairs.

Passages: repeated text seldom keeps to lines: it is wrapped anew, or lies inside
a longer line. So the words of a whole text are one stream as well, and passages
of `width` words begin at its anchors: words whose md5 is smaller than those of
the `reach` words before and not larger than those of the `reach` words after,
besides the first word and the last place where a passage fits. Whether a word is
an anchor depends on its neighbours only, so a repeated stretch of more than
`width + 2 * reach` words has the same passages wherever it stands (unless its
words repeat one another). Passages are asked for at a threshold of 1, where a
band of one hash of the whole passage finds every pair; passages of one hash in
documents of different doc_id are a cluster, and its first one (smallest doc_id,
then place) stays. Overlapping passages of a document that go, or that stay, are
reported as one run of words.

Defined results: null and empty texts have neither lines nor passages; texts of
under `width` words have no passages, and shorter lines are not compared as
lines; repeated rows of a doc_id count as one and are no copies of each other; a
null doc_id sorts first; an empty table gives an empty result; other columns are
not read, and without_copies keeps them whatever their names. Passages are told
apart by a 64-bit hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import GOLD, NULL_ID, as_text_arrays, id_array, materialize, pack, sliced, splitmix, unpack, word_hashes, word_spans
from curatrix.llm.setlinks import CELLS, Rule, linked

#: Hash functions of a signature, and the wanted chance to find a pair at the threshold.
PERMS, RECALL = 64, 0.999
#: Words of a passage, and words on either side that decide on an anchor.
WIDTH, REACH = 20, 5
#: Bytes of text in a block, and for each task that compares passages.
BLOCK, SHARE = 8 << 20, 24_000_000
U64, I64 = np.uint64, np.int64


def tuned(threshold: float, perms: int = PERMS, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows): most rows in a band at which a pair at the threshold is found with the chance `recall`."""
    best = (perms, 1)
    for rows in range(1, perms + 1):
        bands = perms // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            best = (bands, rows)
    return best


def band_keys(sets: list[np.ndarray], context: dict) -> list[np.ndarray]:
    """One key for each band of the MinHash signature of each set."""
    bands, rows = context["bands"], context["rows"]
    least = np.full((len(sets), bands * rows), np.uint64(2**64 - 1))
    for i, s in enumerate(sets):
        for lo in range(0, len(s), 512):
            mixed = s[lo : lo + 512, None] ^ context["b"][None]
            mixed *= context["a"][None]
            mixed ^= mixed >> np.uint64(32)
            mixed *= GOLD
            np.minimum(least[i], mixed.min(0), out=least[i])
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLD, (len(sets), bands))
    for r in range(rows):
        key = splitmix(key * GOLD + least[:, r::rows])
    return list(key)


def rule(k: int = 5, num: int = 80, least_words: int = 20) -> Rule:
    return Rule(k=k, num=num, paragraphs=True, least_words=least_words, cells=CELLS, keys=band_keys)


class _Context(dict):
    """A context whose counting rule stays on the driver."""

    def __reduce__(self):
        return (dict, ({k: v for k, v in self.items() if not callable(v)},))


def similar_lines(docs: DataFrame, k: int = 5, num: int = 80, least_words: int = 20) -> DataFrame:
    """doc_id, place (number of the line), n_words, kept_doc_id, kept_place, removed of every line that is like another one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bands, rows = tuned(num / 100)
    rng = np.random.default_rng(17)
    a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    context = _Context(bands=bands, rows=rows, a=a, b=b, keys=lambda shingles, nodes: nodes * bands)
    table, comps = linked(docs, rule(k, num, least_words), lambda nodes, often: context, False)
    named = table.join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    named = named.select("comp", "doc_id", "para", "words").distinct()
    # Partial sums first; the join back splits a key that many paragraphs have.
    first = named.groupBy("comp").agg(F.min(F.struct("doc_id", "para")).alias("kept"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    out = named.join(first, "comp")
    null = F.lit(NULL_ID)
    removed = (F.col("doc_id") != F.col("kept.doc_id")) | (F.col("para") != F.col("kept.para"))
    return out.select(F.nullif("doc_id", null).alias("doc_id"), F.col("para").cast("long").alias("place"), F.col("words").cast("long").alias("n_words"), F.nullif("kept.doc_id", null).alias("kept_doc_id"), F.col("kept.para").cast("long").alias("kept_place"), removed.alias("removed"))


# Passages


def word_order(raw: np.ndarray, spans, hashes: np.ndarray) -> np.ndarray:
    """The first 8 bytes of the md5 of each word, A-Z lower-cased; each distinct word is hashed once."""
    names, first, inv = np.unique(hashes, return_index=True, return_inverse=True)
    starts, lens = spans
    digests = b"".join(hashlib.md5(raw[a : a + n].tobytes().lower()).digest()[:8] for a, n in zip(starts[first].tolist(), lens[first].tolist()))
    return np.frombuffer(digests, ">u8").astype(U64)[inv] if len(names) else np.zeros(0, U64)


def anchors(order: np.ndarray, counts: np.ndarray, width: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, place in its text) of the words where a passage begins."""
    n = len(order)
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    left = np.repeat(counts, counts) - place - 1
    least = np.ones(n, bool)
    for d in range(1, min(reach, n - 1) + 1):
        least[d:] &= (place[d:] < d) | (order[d:] < order[:-d])
        least[:-d] &= (left[:-d] < d) | (order[:-d] <= order[d:])
    at = np.flatnonzero((least | (place == 0) | (left == width - 1)) & (left >= width - 1))
    return at, place[at]


def passage_keys(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` words from each of some places, by doubling."""
    key, now, size = np.zeros(len(at), U64), at.copy(), 1
    while size <= width:
        if width & size:
            key = splitmix(key * GOLD + words[now])
            now += size
        words = splitmix(words[:-size] * GOLD + words[size:]) if 2 * size <= width else words
        size *= 2
    return key


def runs_of(row: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first passage of each run, words of the run); passages in order of row and place."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] > place[:-1] + width)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row))[: len(first)] - 1
    return first, place[last] + width - place[first]


def repeated_passages(docs: DataFrame, width: int = WIDTH, reach: int = REACH) -> DataFrame:
    """doc_id, place (number of the first word), n_words, kept_doc_id, kept_place, removed of every run of passages that other documents have, too.

    Every task sends a passage once, with its first place in the task; answers name
    the first place of all for passages that several documents have, so that a
    passage of a third of all documents costs one entry for each block of text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    buckets = int(max(12, size // SHARE))

    def blocks(batches):
        from pyspark import TaskContext

        task, seq, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block(name):
            ids, per, place, key = (np.concatenate([h[j] for h in held]) for j in range(4))
            rows = [(name, -1, pack(ids, per, place, key, level=1))]
            owner = np.repeat(ids, per)
            order = np.lexsort((place, owner, key))
            k, o = key[order], owner[order]
            cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, I64)
            several = o[np.append(cuts[1:], len(k)) - 1] != o[cuts] if len(k) else np.zeros(0, bool)
            first, to = order[cuts], (k[cuts] % U64(buckets)).astype(I64)
            by = np.argsort(to, kind="stable")
            edge = np.searchsorted(to[by], np.arange(buckets + 1))
            for b, (x, y) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
                if y > x:
                    f = first[by[x:y]]
                    rows.append((name, b, pack(key[f], owner[f], place[f], several[by[x:y]], level=1)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], names=["name", "bucket", "block"])

        for b in sliced(batches):
            ids, off, raw = as_text_arrays(b)
            spans = word_spans(raw, off)
            words, counts = word_hashes(raw, off, spans)
            at, place = anchors(word_order(raw, spans, words), counts, width, reach)
            ends = np.cumsum(counts)
            held.append((ids, np.bincount(np.searchsorted(ends, at, side="right"), minlength=len(ids)).astype(np.int32), place.astype(np.int32), passage_keys(words, at, width)))
            n += len(raw)
            if n >= BLOCK:
                yield block(task * (1 << 32) + seq)
                seq, n = seq + 1, 0
        if held:
            yield block(task * (1 << 32) + seq)

    table = materialize(docs.mapInArrow(blocks, "name long, bucket int, block binary"))

    def answer(t: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in t.column("block").to_pylist()]
        key, owner, place, several = (np.concatenate([np.frombuffer(p[j], d) for p in parts]) if parts else np.zeros(0, d) for j, d in enumerate((U64, I64, np.int32, bool)))
        block = np.repeat(t.column("name").to_numpy(), [len(p[0]) // 8 for p in parts]) if parts else np.zeros(0, I64)
        order = np.lexsort((place, owner, key))
        k, o = key[order], owner[order]
        cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, I64)
        n = np.diff(np.append(cuts, len(k)))
        shared = (o[cuts + n - 1] != o[cuts]) | (np.maximum.reduceat(several[order], cuts) if len(k) else several)
        hit = np.repeat(shared, n)
        head = order[np.repeat(cuts, n)[hit]]
        to, names = block[order[hit]], k[hit]
        by = np.argsort(to, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], to[by][1:] != to[by][:-1], [True]])) if len(by) else np.zeros(1, I64)
        rows = [(int(to[by[x]]), pack(names[by[x:y]], owner[head[by[x:y]]], place[head[by[x:y]]], level=1)) for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]
        return pa.table({"name": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([r[1] for r in rows], pa.binary())})

    answers = table.filter("bucket >= 0").groupBy("bucket").applyInArrow(answer, "name long, block binary")

    def finish(name, lists: pa.Table, replies: pa.Table) -> pa.Table:
        cols: list = [[] for _ in range(6)]
        got = [unpack(x) for x in replies.column("block").to_pylist()]
        if got and lists.num_rows:
            known, kept, kept_at = (np.concatenate([np.frombuffer(p[j], d) for p in got]) for j, d in enumerate((U64, I64, np.int32)))
            order = np.argsort(known)
            known, kept, kept_at = known[order], kept[order], kept_at[order]
            for x in lists.column("block").to_pylist():
                ids, per, place, key = (np.frombuffer(v, d) for v, d in zip(unpack(x), (I64, np.int32, np.int32, U64)))
                row = np.repeat(np.arange(len(ids)), per)
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[at] == key
                for gone in (False, True):
                    own = np.flatnonzero(hit & ((kept[at] != ids[row]) == gone))
                    first, n = runs_of(row[own], place[own].astype(I64), width)
                    f = own[first]
                    for c, v in zip(cols, (ids[row[f]], place[f], n, kept[at[f]], kept_at[at[f]], np.full(len(f), gone))):
                        c.append(v)
        a = [np.concatenate(c) if c else np.zeros(0, I64) for c in cols]
        return pa.table([id_array(a[0]), pa.array(a[1], pa.int64()), pa.array(a[2], pa.int64()), id_array(a[3]), pa.array(a[4], pa.int64()), pa.array(a[5].astype(bool))], names=["doc_id", "place", "n_words", "kept_doc_id", "kept_place", "removed"])

    lists = table.filter("bucket < 0").select("name", "block")
    runs = lists.groupBy("name").cogroup(answers.groupBy("name")).applyInArrow(finish, "doc_id long, place long, n_words long, kept_doc_id long, kept_place long, removed boolean")
    return runs.distinct()


def clusters(docs: DataFrame, k: int = 5, num: int = 80, least_words: int = 20, width: int = WIDTH, reach: int = REACH) -> DataFrame:
    """kind ('line' or 'passage'), doc_id, place, n_words, kept_doc_id, kept_place, removed: similar_lines and repeated_passages."""
    lines = similar_lines(docs, k, num, least_words).withColumn("kind", F.lit("line"))
    return lines.unionByName(repeated_passages(docs, width, reach).withColumn("kind", F.lit("passage"))).select("kind", "doc_id", "place", "n_words", "kept_doc_id", "kept_place", "removed")


def _cut(text: str, gone: list) -> str:
    """The text without the given lines and runs of words."""
    raw = np.frombuffer(text.encode(), np.uint8)
    stays = np.ones(len(raw), bool)
    starts, lens = word_spans(raw, np.array([0, len(raw)]))
    for g in gone:
        if g["kind"] == "passage":
            last = g["place"] + g["n_words"] - 1
            stays[starts[g["place"]] : starts[last] + lens[last]] = False
    stays |= raw == 10  # so that lines keep their numbers
    lines = raw[stays].tobytes().decode().split("\n")
    out = {g["place"] for g in gone if g["kind"] == "line"}
    return "\n".join(x for i, x in enumerate(lines) if i not in out)


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """docs whose texts have lost the removed lines and passages."""
    gone = clusters(docs, **options).filter("removed").groupBy(F.col("doc_id").alias("g_id")).agg(F.collect_set(F.struct("kind", "place", "n_words")).alias("g"))
    rows = docs.select(F.struct(*docs.columns).alias("d"))  # a struct, as the input may have columns of any name
    rows = rows.join(gone, F.col("d.doc_id").cast("long").eqNullSafe(F.col("g_id")), "left").select("d", "g")
    kind = docs.schema["text"].dataType

    def cut(batches):
        for b in batches:
            texts = b.column("d").field("text").to_pylist()
            new = [_cut(t, g) if g and t else t for t, g in zip(texts, b.column("g").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(new, pa.string())], names=["d", "t"])

    rows = rows.mapInArrow(cut, T.StructType([T.StructField("d", docs.schema), T.StructField("t", kind)]))
    return rows.select(*[F.col("t").alias(c) if c == "text" else F.col("d").getField(c).alias(c) for c in docs.columns])
