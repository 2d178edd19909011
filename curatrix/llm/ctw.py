"""Language-model scoring by context-tree weighting over bytes.

The model predicts every byte of a text from the DEPTH bytes before it (zero
bytes before the start), as eight binary decisions. Each decision has a context
tree of its own (one for each prefix of bits), whose nodes are the last 0..DEPTH
bytes and hold how often the training documents had a 0 and a 1 there. Every node
has the Krichevsky-Trofimov probability of its counts, and the weighted
probability of a node is half of that plus half of the product over its children;
the leaves are at DEPTH. A bit is then predicted by mixing the estimates of all
depths along its context, each node with the posterior weight of stopping there.
The code length of a text is the sum over its bytes.

Counts come from all training documents. Texts travel in blocks; each block asks
for the distinct (context, byte) it holds, keyed by the last two context bytes,
so that a task has all counts below those nodes. The nodes of depth 0 and 1 need
sums over all tasks: at most 256 * 255 rows, whatever the size of the corpus,
which the driver adds up. Answers go back to the blocks. Words for the base score
take the same way; they are told apart by a 64-bit hash.

Defined results: null texts are empty (one token, the end; model score 0); with no
training documents counts are 0 and every bit has probability 1/2; a null doc_id
is in the training part; repeated rows count and score as often as they occur; an
empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import NULL_ID, as_text_arrays, id_array, materialize, pack, sliced, splitmix, trim, unpack, word_hashes

DEPTH = 5
#: Bytes of text in a block.
BLOCK = 4 << 20
#: Cells of a lookup table.
TABLE = 1 << 23
U64, I64 = np.uint64, np.int64
#: Rows of the block table.
TEXTS, GRAMS, WORDS = 0, 1, 2


def held_out(ids: np.ndarray, parts: int = 5) -> np.ndarray:
    return np.array([i != NULL_ID and zlib.crc32(str(i).encode()) % parts == 1 for i in ids.tolist()], dtype=bool)


def gram_codes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct codes, index of each byte's code): a code is DEPTH context bytes, oldest first, and the byte."""
    n, docs = len(raw), len(off) - 1
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int32)
    # DEPTH zero bytes before each text; real: where a text's own bytes are.
    gap = bytes(DEPTH)
    wide = np.frombuffer(b"".join(x for a, b in zip(off[:-1].tolist(), off[1:].tolist()) for x in (gap, raw[a:b])), np.uint8)
    real = np.ones(len(wide), bool)
    pad = (off[:-1] + np.arange(docs) * DEPTH)[:, None] + np.arange(DEPTH)[None]
    real[pad.ravel()] = False
    seen = np.zeros(256, bool)
    seen[wide] = True
    alphabet = np.flatnonzero(seen).astype(U64)
    m = len(alphabet)
    x = (np.cumsum(seen) - 1).astype(np.int32)[wide]
    code, ids = alphabet.copy(), x
    for _ in range(DEPTH):
        ids, code = _longer(ids, code, x[len(x) - len(ids) + 1 :], alphabet)
    # The padded texts have other windows as well; keep those that end in a text's byte.
    ids = ids[real[DEPTH:]]
    have = np.zeros(len(code), bool)
    have[ids] = True
    return code[have], (np.cumsum(have) - 1).astype(np.int32)[ids]


def _longer(ids: np.ndarray, code: np.ndarray, x: np.ndarray, alphabet: np.ndarray):
    """Windows one byte longer: (index of each in the distinct codes, ascending codes). Tables of at most TABLE cells at a time."""
    m = len(alphabet)
    step = max(1, TABLE // m)
    both = ids[:-1].astype(I64 if len(code) * m >= 1 << 31 else np.int32)
    both *= m
    both += x
    out, codes, n = np.empty(len(both), np.int32), [], 0
    for lo in range(0, len(code), step):
        first, last = lo * m, min(len(code), lo + step) * m
        at = slice(None) if len(code) <= step else (both >= first) & (both < last)
        own = both[at] - first
        have = np.zeros(last - first, bool)
        have[own] = True
        used = np.flatnonzero(have)
        rank = np.zeros(last - first, np.int32)
        rank[used] = np.arange(n, n + len(used), dtype=np.int32)
        out[at] = rank[own]
        codes.append((code[lo + used // m] << U64(8)) | alphabet[used % m])
        n += len(used)
    return out, np.concatenate(codes) if codes else code[:0]


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    """By the two context bytes next to the predicted one."""
    return (splitmix((codes >> U64(8)) & U64(0xFFFF)) % U64(buckets)).astype(I64)


def split(values: np.ndarray, to: np.ndarray):
    """(bucket, places) for each bucket met; places ascend."""
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], to[order][1:] != to[order][:-1], [True]])) if len(to) else np.zeros(1, I64)
    return [(int(to[order[a]]), order[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


# log of the Krichevsky-Trofimov probability of counts


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0 (Stirling's series after shifting up)."""
    x = np.asarray(x, dtype=np.float64)
    shift, small = np.zeros_like(x), x < 8
    y = x.copy()
    while small.any():
        shift[small] += np.log(y[small])
        y[small] += 1
        small = y < 8
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    half = 0.5723649429247001  # log gamma(1/2)
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - 2 * half - _log_gamma(a + b + 1.0)


LOG_HALF = float(np.log(0.5))


def bit_counts(ctx: np.ndarray, byte: np.ndarray, count: np.ndarray):
    """(context, prefix) nodes in order with counts of 0 and 1; prefix: bits so far after a leading 1 (1..255)."""
    keys, ones, n = [], [], []
    for k in range(8):
        prefix = (U64(1) << U64(k)) | (byte >> U64(8 - k))
        keys.append((ctx << U64(8)) | prefix)
        ones.append((byte >> U64(7 - k)) & U64(1))
        n.append(count)
    keys, ones, n = map(np.concatenate, (keys, ones, n))
    nodes, inv = np.unique(keys, return_inverse=True)
    c1 = np.bincount(inv, weights=n * ones, minlength=len(nodes))
    c0 = np.bincount(inv, weights=n, minlength=len(nodes)) - c1
    return nodes, c0, c1


def parents(nodes: np.ndarray, c0, c1, logw, depth: int):
    """The level above: the oldest context byte goes; counts and log weights of children are added."""
    keep = (nodes & U64(0xFF)) | ((nodes >> U64(8)) & U64((1 << (8 * (depth - 1))) - 1)) << U64(8)
    up, inv = np.unique(keep, return_inverse=True)
    add = lambda v: np.bincount(inv, weights=v, minlength=len(up))
    return up, add(c0), add(c1), add(logw)


def weigh(c0, c1, below):
    """(log weighted probability, posterior weight of the node's own estimate)."""
    own = LOG_HALF + log_kt(c0, c1)
    both = np.logaddexp(own, LOG_HALF + below)
    return both, np.exp(own - both)


def tree(codes: np.ndarray, counts: np.ndarray, top: int):
    """Levels DEPTH..top of the trees: {depth: (nodes, c0, c1, beta)}, and the sums (nodes, c0, c1, log weight) of level top for its parents."""
    used = counts > 0
    codes, counts = codes[used], counts[used].astype(np.float64)
    nodes, c0, c1 = bit_counts(codes >> U64(8), codes & U64(0xFF), counts)
    logw, levels = log_kt(c0, c1), {DEPTH: (nodes, c0, c1, np.ones(len(nodes)))}
    for depth in range(DEPTH - 1, top - 1, -1):
        nodes, c0, c1, below = parents(nodes, c0, c1, logw, depth + 1)
        logw, beta = weigh(c0, c1, below)
        levels[depth] = (nodes, c0, c1, beta)
    return levels, (nodes, c0, c1, logw)


def log10_prob(codes: np.ndarray, levels: dict) -> np.ndarray:
    """log10 of the mixed probability of each code's byte in its context."""
    out = np.zeros(len(codes))
    byte, ctx = codes & U64(0xFF), codes >> U64(8)
    for k in range(8):
        prefix = (U64(1) << U64(k)) | (byte >> U64(8 - k))
        one = ((byte >> U64(7 - k)) & U64(1)).astype(bool)
        p = None
        for depth in range(DEPTH, -1, -1):
            nodes, c0, c1, beta = levels[depth]
            key = ((ctx & U64((1 << (8 * depth)) - 1)) << U64(8)) | prefix
            if len(nodes):
                at = np.minimum(np.searchsorted(nodes, key), len(nodes) - 1)
                hit = nodes[at] == key
                a, b = np.where(hit, c0[at], 0.0), np.where(hit, c1[at], 0.0)
                w = np.where(hit, beta[at], 0.5 if depth < DEPTH else 1.0)
            else:
                a, b, w = np.zeros(len(key)), np.zeros(len(key)), np.full(len(key), 0.5 if depth < DEPTH else 1.0)
            own = (np.where(one, b, a) + 0.5) / (a + b + 1.0)
            p = own if p is None else w * own + (1 - w) * p
        out += np.log10(p)
    return out


def scores(docs: DataFrame, parts: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (code length; 0 for empty texts) of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    buckets = int(max(12, size // 16_000_000))

    def blocks(batches):
        from pyspark import TaskContext

        task, seq, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block():
            ids = np.concatenate([h[0] for h in held])
            lens = np.concatenate([np.diff(h[1]) for h in held])
            raw = np.concatenate([h[2] for h in held])
            # Training documents first, so that their bytes and words are at the front.
            out = held_out(ids, parts)
            order = np.argsort(out, kind="stable")
            off = np.concatenate([[0], np.cumsum(lens)])
            raw = b"".join(raw[off[i] : off[i + 1]].tobytes() for i in order.tolist())
            ids, lens, out = ids[order], lens[order], out[order]
            off = np.concatenate([[0], np.cumsum(lens)])
            raw = np.frombuffer(raw, np.uint8)
            name = task * (1 << 32) + seq
            rows = [(name, TEXTS, -1, pack(ids, lens, out, raw))]
            codes, at = gram_codes(raw, off)
            front = int(lens[~out].sum())
            counts = np.bincount(at[:front], minlength=len(codes)).astype(np.uint32)
            for b, own in split(codes, bucket_of(codes, buckets)):
                rows.append((name, GRAMS, b, pack(codes[own], counts[own])))
            words, per = word_hashes(raw, off)
            known = int(per[~out].sum())
            names, inv = np.unique(words, return_inverse=True)
            counts = np.bincount(inv[:known], minlength=len(names)).astype(np.uint32)
            for b, own in split(names, (names % U64(buckets)).astype(I64)):
                rows.append((name, WORDS, b, pack(names[own], counts[own])))
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int8(), pa.int32(), pa.binary()))], names=["name", "kind", "bucket", "block"])

        for b in sliced(batches):
            if b.num_rows:
                held.append(as_text_arrays(b))
                n += len(held[-1][2])
            if n >= BLOCK:
                yield block()
                seq, held, n = seq + 1, [], 0
                trim()
        if held:
            yield block()
        held.clear()
        trim()

    table = materialize(docs.mapInArrow(blocks, "name long, kind byte, bucket int, block binary"))

    def merged(t: pa.Table, value):
        parts = [unpack(x) for x in t.column("block").to_pylist()]
        keys = [np.frombuffer(p[0], U64) for p in parts]
        names, inv = np.unique(np.concatenate(keys), return_inverse=True)
        return keys, names, np.bincount(inv, weights=np.concatenate([np.frombuffer(p[1], np.uint32) for p in parts]), minlength=len(names)), inv

    def summary(t: pa.Table) -> pa.Table:
        _, codes, counts, _ = merged(t, None)
        _, (nodes, c0, c1, logw) = tree(codes, counts, 2)
        up, c0, c1, logw = parents(nodes, c0, c1, logw, 2) if len(nodes) else (nodes, c0, c1, logw)
        return pa.table({"node": pa.array(up.view(I64)), "c0": pa.array(c0), "c1": pa.array(c1), "logw": pa.array(logw)})

    sums = table.filter(F.col("kind") == GRAMS).groupBy("bucket").applyInArrow(summary, "node long, c0 double, c1 double, logw double")
    # Nodes of depth 1: at most 256 * 255 rows.
    got = sums.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("c0", "c1", "logw"))).orderBy("node").toArrow()
    nodes = got.column("node").to_numpy().view(U64)
    c0, c1, below = (got.column(c).to_numpy() for c in ("c0", "c1", "logw"))
    logw, beta = weigh(c0, c1, below) if len(nodes) else (below, below)
    upper = {1: (nodes, c0, c1, beta)}
    nodes, c0, c1, below = parents(nodes, c0, c1, logw, 1) if len(nodes) else (nodes, c0, c1, logw)
    upper[0] = (nodes, c0, c1, weigh(c0, c1, below)[1] if len(nodes) else below)
    share = spark.sparkContext.broadcast(upper)

    def answer(t: pa.Table) -> pa.Table:
        rows = []
        if t.num_rows:
            kind = t.column("kind")[0].as_py()
            keys, names, counts, inv = merged(t, None)
            if kind == GRAMS:
                levels, _ = tree(names, counts, 2)
                value = log10_prob(names, {**levels, **share.value}).astype(np.float32)
            else:
                value = counts.astype(np.uint32)
                rows.append((None, kind, -1, None, int(counts.sum()), int((counts > 0).sum())))
            at = 0
            for name, bucket, k in zip(t.column("name").to_pylist(), t.column("bucket").to_pylist(), keys):
                rows.append((name, kind, bucket, pack(value[inv[at : at + len(k)]]), 0, 0))
                at += len(k)
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int8(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["name", "kind", "bucket", "block", "total", "distinct"])

    asked = table.filter(F.col("kind") != TEXTS).groupBy("kind", "bucket")
    answers = materialize(asked.applyInArrow(answer, "name long, kind byte, bucket int, block binary, total long, distinct long"))
    ends = docs.agg(F.count(F.when(~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == 1, F.lit(False)), 1))).collect()[0][0]
    seen = answers.filter("name IS NULL").agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).collect()[0]
    n_train, v_train = (seen["n"] or 0) + ends, (seen["v"] or 0) + (ends > 0)
    norm = float(np.log10(n_train + 0.5 * (v_train + 1)))
    end_log, end_known = float(np.log10(ends + 0.5)), int(ends > 0)

    def finish(key, texts: pa.Table, replies: pa.Table) -> pa.Table:
        cols: list = [[] for _ in range(8)]
        by = {(k, b): x for k, b, x in zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "block")))}
        for x in texts.column("block").to_pylist():
            ids, lens, out, raw = unpack(x)
            ids, lens, out, raw = np.frombuffer(ids, I64), np.frombuffer(lens, I64), np.frombuffer(out, bool), np.frombuffer(raw, np.uint8)
            off = np.concatenate([[0], np.cumsum(lens)])
            codes, at = gram_codes(raw, off)
            value = np.zeros(len(codes), np.float32)
            for b, own in split(codes, bucket_of(codes, buckets)):
                value[own] = np.frombuffer(unpack(by[GRAMS, b])[0], np.float32)
            model = np.array([value[at[a:b]].sum(dtype=np.float64) for a, b in zip(off[:-1].tolist(), off[1:].tolist())])
            words, per = word_hashes(raw, off)
            names, inv = np.unique(words, return_inverse=True)
            counts = np.zeros(len(names))
            for b, own in split(names, (names % U64(buckets)).astype(I64)):
                counts[own] = np.frombuffer(unpack(by[WORDS, b])[0], np.uint32)
            c = counts[inv]
            edge = np.concatenate([[0], np.cumsum(per)])
            known, logs = np.concatenate([[0], np.cumsum(c > 0)]), np.log10(c + 0.5)
            base = np.array([logs[a:b].sum() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())])
            tokens = per + 1
            cols[0].append(ids)
            cols[1].append(out)
            cols[2].append(tokens)
            cols[3].append(known[edge[1:]] - known[edge[:-1]] + end_known)
            cols[4].append(np.full(len(ids), n_train))
            cols[5].append(base + end_log - tokens * norm)
            cols[6].append(model)
            cols[7].append(np.where(lens > 0, -model * np.log2(10.0) / np.maximum(lens, 1), 0.0))
        trim()
        kinds = (I64, bool, I64, I64, I64, np.float64, np.float64, np.float64)
        cols = [np.concatenate(c).astype(k) if c else np.zeros(0, k) for c, k in zip(cols, kinds)]
        return pa.table([id_array(cols[0]), *(pa.array(c) for c in cols[1:])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    texts = table.filter(F.col("kind") == TEXTS).select("name", "block")
    replies = answers.filter("name IS NOT NULL").select("name", "kind", "bucket", "block")
    return texts.groupBy("name").cogroup(replies.groupBy("name")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
