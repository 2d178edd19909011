"""Suffix-array dedup by bucket-pointer refinement: bytes of long strings seen in an earlier document go.

A byte is removed if a string of `length` bytes that covers it also starts in a
document with a smaller doc_id. Every string of that length is dealt to a task by
its minimizer, the q-gram in it with the smallest hash: equal strings have equal
minimizers, so they meet, and a run of neighbouring strings with one minimizer
travels as one piece of text. Pieces that a task has twice are sent once, with
the smallest doc_id; the other copies in that task are marked at once.

A task sorts the suffixes of its pieces by bucket-pointer refinement: suffixes
start in buckets of equal q-grams, and a pointer table holds the bucket of every
position. Buckets are then refined one after the other (small neighbouring ones
together): the members of a bucket are sorted on the pointers at an offset of q,
the pointers of its members are set to the new sub-buckets at once, and the
sub-buckets with more than one member are refined in the same way at 2q, 3q, ...
before the next bucket is begun. So a bucket reuses what earlier ones have
settled: their pointers tell more than q bytes apart, and it seldom has to go
through all offsets. Refinement of a bucket ends when its members agree in
`length` bytes at least; strings of equal `length` bytes are then neighbours in
the order, and are told from others by their bytes, so nothing rests on a hash
being unique. All of them but those of the smallest doc_id are marked.

What skips the sorting: a piece that equals another one of the task byte by byte
(found by a hash of its words) is marked in full if a smaller doc_id has the other,
and pieces that share neither side of their minimizer with a piece of another
document hold no shared string at all.

Marks travel back as runs of string starts, keyed by document, to the blocks of
texts, where the covered bytes are taken out.

Defined results: null texts are empty; texts shorter than the string keep all
bytes; a null doc_id sorts before all others and is returned as null; rows that
repeat a doc_id are not earlier than each other; an empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import GOLD, as_text_arrays, id_array, pack, ranges, sliced, splitmix, unpack

#: Bytes of a minimizer. Short q-grams make longer pieces, so fewer and smaller.
Q = 12
#: Bytes of text for a task that sorts suffixes, and for one that rebuilds texts.
SORT_BYTES, TEXT_BYTES = 12_000_000, 24_000_000
#: Bytes of pieces that are sorted at once.
CHUNK = 1_500_000
#: Members of buckets that are refined together.
WAVE = 1 << 15
U64 = np.uint64
I64 = np.int64


def words8(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number, where they fit."""
    n = len(raw) - 7
    if n <= 0:
        return np.zeros(0, U64)
    raw = np.ascontiguousarray(raw)
    out = np.empty(n, U64)
    for k in range(min(8, n)):
        m = (len(raw) - k) // 8
        out[k::8] = raw[k : k + 8 * m].view(U64)[: len(out[k::8])]
    return out


def _mixed(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    h = first * GOLD
    h ^= h >> U64(32)
    h = (h ^ last) * GOLD
    return h ^ (h >> U64(29))


def grams(raw: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q (8 to 16) bytes from each position, where they fit."""
    w = words8(raw)
    n = len(raw) - q + 1
    return _mixed(w[:n], w[q - 8 : q - 8 + n]) * GOLD if n > 0 else np.zeros(0, U64)


def grams_at(raw: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
    """As grams, at some positions only."""
    first, last = np.zeros(len(at), U64), np.zeros(len(at), U64)
    for j in range(8):
        first |= raw[at + j].astype(U64) << U64(8 * j)
        last |= raw[at + (q - 8 + j)].astype(U64) << U64(8 * j)
    return _mixed(first, last) * GOLD


def rows_of(raw: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """The `width` bytes from each of some positions as rows; zeros past the end."""
    padded = np.concatenate([raw, np.zeros(width, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, width)[first]


def gathered(raw: np.ndarray, first: np.ndarray, span: np.ndarray) -> np.ndarray:
    """The pieces of raw one after the other."""
    if not len(first):
        return raw[:0]
    width, out = int(span.max()), []
    for lo in range(0, len(first), 1 << 17):
        f, s = first[lo : lo + (1 << 17)], span[lo : lo + (1 << 17)]
        out.append(rows_of(raw, f, width)[np.arange(width)[None] < s[:, None]])
    return np.concatenate(out)


def minimizers(raw: np.ndarray, length: int, q: int) -> np.ndarray:
    """For each start of a string of `length` bytes, the position of its minimizer (leftmost of the smallest hashes)."""
    w = length - q + 1
    h = grams(raw, q)
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, I64)
    bits = 24
    h = (h >> U64(bits) << U64(bits)) | np.arange(len(h), dtype=U64)  # positions decide ties
    span = 1
    while span * 2 <= w:
        h = np.minimum(h[: len(h) - span], h[span:])
        span *= 2
    if span < w:
        h = np.minimum(h[: len(h) - (w - span)], h[w - span :])
    return (h & U64((1 << bits) - 1)).astype(I64)


def pieces(raw: np.ndarray, off: np.ndarray, length: int, q: int):
    """(document, first start, number of starts, minimizer) of each run of strings with one minimizer."""
    lens = np.diff(off)
    parts = []
    # Text by text groups of under 2**24 bytes, as positions take 24 bits.
    i = 0
    while i < len(lens):
        j, size = i, 0
        while j < len(lens) and (j == i or size + lens[j] < (1 << 22)):
            size += lens[j]
            j += 1
        base, end = int(off[i]), int(off[j])
        for lo in range(base, end, (1 << 24) - length) if end - base >= (1 << 24) else (base,):
            hi = min(end, lo + (1 << 24) - 1)
            m = minimizers(raw[lo:hi], length, q)
            if not len(m):
                continue
            at = lo + np.arange(len(m))
            cut = np.clip(off[i : j + 1], lo, lo + len(m))
            doc = np.repeat(np.arange(i, j), np.diff(cut))
            inside = at + length <= np.repeat(off[i + 1 : j + 1], np.diff(cut))
            new = np.concatenate([[True], (m[1:] != m[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])])
            first = np.flatnonzero(new)
            runs = np.diff(np.append(first, len(m)))
            ok = inside[first]
            parts.append(np.stack([doc[first][ok], at[first][ok], runs[ok], lo + m[first][ok]], 1))
        i = j
    return np.concatenate(parts).astype(I64) if parts else np.zeros((0, 4), I64)


def text_key(ids: np.ndarray, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Tells rows of one doc_id but different texts apart."""
    return np.array([int.from_bytes(hashlib.blake2b(raw[a:b].tobytes(), digest_size=4).digest(), "little") for a, b in zip(off[:-1].tolist(), off[1:].tolist())], dtype=np.uint32) if len(ids) else np.zeros(0, np.uint32)


def refined_order(text: np.ndarray, length: int, wave: int = WAVE) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions in the order of their suffixes, as far as `length` bytes tell; pointer of each position; members sorted).

    Suffixes of one pointer agree in `length` bytes at least. wave: members of
    neighbouring buckets that are refined together; a larger bucket goes alone.
    """
    n, q = len(text), 8
    # Byte order as in the text, so that strings of a common start are neighbours however long the start.
    word = words8(np.concatenate([text, np.zeros(q - 1, np.uint8)])).byteswap()
    order = np.argsort(word, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], word[order][1:] != word[order][:-1]])) if n else np.zeros(0, I64)
    sizes = np.diff(np.append(starts, n))
    pointer = np.zeros(n + length + q, I64)  # 0 is past the end
    pointer[order] = np.repeat(starts, sizes) + 1
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    ends, lo, work = np.cumsum(sizes), 0, 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + wave, side="right")))
        place, offset = ranges(starts[lo:hi], sizes[lo:hi]), q
        while offset < length and len(place):
            at = order[place]
            own, ahead = pointer[at], pointer[at + offset]
            by = np.lexsort((ahead, own))  # members of a bucket are neighbours, so `own` ascends and only they change places
            at, own, ahead = at[by], own[by], ahead[by]
            order[place] = at
            head = np.concatenate([[True], (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])])
            first = np.flatnonzero(head)
            size = np.diff(np.append(first, len(place)))
            pointer[at] = np.repeat(place[first], size) + 1
            work += len(place)
            place = place[np.repeat(size > 1, size)]
            offset += q
        lo = hi
    return order, pointer[:n], work


def refine(text: np.ndarray, at: np.ndarray, length: int, wave: int = WAVE) -> np.ndarray:
    """Bucket of each suffix at[i] of text by its first `length` bytes (equal strings, equal buckets), by bucket-pointer refinement."""
    _, pointer, _ = refined_order(text, length, wave)
    by = np.argsort(pointer[at], kind="stable")
    here = at[by]
    # Neighbours of different pointers may still agree in `length` bytes, as pointers tell more bytes apart.
    new = np.concatenate([[True], pointer[here][1:] != pointer[here][:-1]]) if len(at) else np.zeros(0, bool)
    edge = np.flatnonzero(new[1:]) + 1
    spans = np.full(len(edge), length)
    new[edge] = ~equal_pieces(text, here[edge], here[edge - 1], spans, spans)
    out = np.empty(len(at), I64)
    out[by] = np.cumsum(new)
    return out


def dedup(docs: DataFrame, length: int = 50, q: int = Q) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return rebuilt(docs, length, q, False)


def kept_texts(docs: DataFrame, length: int = 50, q: int = Q) -> DataFrame:
    """As dedup, and `kept`, the bytes that stay."""
    return rebuilt(docs, length, q, True)


def rebuilt(docs: DataFrame, length: int, q: int, with_bytes: bool) -> DataFrame:
    if length < q + 8:
        raise ValueError("length must be at least q + 8")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    buckets = int(max(12, total // SORT_BYTES))
    homes = int(max(12, total // TEXT_BYTES))

    def home_of(ids: np.ndarray, key: np.ndarray) -> np.ndarray:
        return (splitmix(ids.view(U64) + key.astype(U64) * GOLD) % U64(homes)).astype(I64)

    def marks_out(home, ids, keys, first, runs):
        """Rows (home, marks) of runs of marked starts."""
        order = np.argsort(home, kind="stable")
        home, ids, keys, first, runs = (x[order] for x in (home, ids, keys, first, runs))
        cuts = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]])) if len(home) else np.zeros(0, I64)
        return [(int(home[a]), pack(ids[a:b].astype(I64), keys[a:b].astype(np.uint32), first[a:b].astype(np.int32), runs[a:b].astype(np.int32))) for a, b in zip(cuts[:-1], cuts[1:])]

    def send(batches):
        # Arrow batches are put together up to about 16 MB of text, for longer blocks.
        held: list = []
        size = 0
        for b in sliced(batches):
            held.append(as_text_arrays(b))
            size += len(held[-1][2])
            if size >= (16 << 20):
                yield from sent(held)
                held, size = [], 0
        if held:
            yield from sent(held)

    def sent(held):
        ids = np.concatenate([h[0] for h in held])
        raw = np.concatenate([h[2] for h in held])
        lens = np.concatenate([np.diff(h[1]) for h in held])
        # In order of doc_id, so that the first of equal pieces has the smallest.
        off = np.concatenate([[0], np.cumsum(lens)]).astype(I64)
        keys = text_key(ids, raw, off)
        p = pieces(raw, off, length, q)
        if not len(p):
            return
        name = splitmix(grams_at(raw, p[:, 3], q))
        doc, first, runs = p[:, 0], p[:, 1], p[:, 2]
        owner = ids[doc]
        # Equal pieces of this task: by a hash of their words, then by bytes.
        span = runs + length - 1
        content = piece_hash(raw, first, span, name)
        order = np.lexsort((first, owner, content))
        same = np.concatenate([[False], content[order][1:] == content[order][:-1]])
        group = np.cumsum(~same) - 1
        head = order[np.flatnonzero(~same)][group]
        copy = np.flatnonzero(same)
        ok = equal_pieces(raw, first[order[copy]], first[head[copy]], span[order[copy]], span[head[copy]])
        copies = copy[ok]
        late = owner[order[copies]] > owner[head[copies]]
        who = order[copies[late]]
        rel = first - off[doc]
        marks = marks_out(home_of(owner[who], keys[doc[who]]), owner[who], keys[doc[who]], rel[who], runs[who])
        if marks:
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(i % buckets) for i in range(len(marks))], pa.int32()), "home": pa.array([m[0] for m in marks], pa.int32()), "block": pa.array([m[1] for m in marks], pa.binary())})
        unique = np.ones(len(p), bool)
        unique[who] = False
        keep = np.flatnonzero(unique)
        to = (name[keep] % U64(buckets)).astype(I64)
        srt = np.argsort(to, kind="stable")
        keep, to = keep[srt], to[srt]
        cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
        rows = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = keep[a:b]
            d = doc[own]
            fresh = np.concatenate([[True], d[1:] != d[:-1]])
            docs_of = d[fresh]
            text = gathered(raw, first[own], span[own])
            rows.append((int(to[a]), pack(ids[docs_of], keys[docs_of], np.diff(np.append(np.flatnonzero(fresh), len(d))).astype(np.int32), rel[own].astype(np.int32), runs[own].astype(np.uint8), (p[own, 3] - first[own]).astype(np.uint8), text)))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "home": pa.array([-1] * len(rows), pa.int32()), "block": pa.array([r[1] for r in rows], pa.binary())})

    def sort(t: pa.Table) -> pa.Table:
        home, block = t.column("home").to_pylist(), t.column("block").to_pylist()
        out = [(h, b) for h, b in zip(home, block) if h >= 0]
        ids, keys, rel, runs, lead, text = [], [], [], [], [], []
        for h, b in zip(home, block):
            if h < 0:
                i, k, n, r, u, m, x = unpack(b)
                n = np.frombuffer(n, np.int32)
                ids.append(np.repeat(np.frombuffer(i, I64), n))
                keys.append(np.repeat(np.frombuffer(k, np.uint32), n))
                rel.append(np.frombuffer(r, np.int32))
                runs.append(np.frombuffer(u, np.uint8))
                lead.append(np.frombuffer(m, np.uint8))
                text.append(np.frombuffer(x, np.uint8))
        if ids:
            ids, keys, rel, runs, lead, text = map(np.concatenate, (ids, keys, rel, runs, lead, text))
            runs, lead = runs.astype(I64), lead.astype(I64)
            out += marked(ids, keys, rel, runs, lead, text)
        return pa.table({"home": pa.array([r[0] for r in out], pa.int32()), "block": pa.array([r[1] for r in out], pa.binary())})

    def marked(ids, keys, rel, runs, lead, text):
        span = runs + length - 1
        at = np.concatenate([[0], np.cumsum(span)])[:-1]
        gram = grams_at(text, at + lead, q)
        # Equal pieces: all but those of the smallest document are marked in full and need no sorting.
        content = piece_hash(text, at, span, gram)
        order = np.lexsort((ids, content))
        same = np.concatenate([[False], content[order][1:] == content[order][:-1]])
        head = order[np.flatnonzero(~same)][np.cumsum(~same) - 1]
        copy = np.flatnonzero(same)
        copy = copy[ids[order[copy]] > ids[head[copy]]]
        copy = copy[equal_pieces(text, at[order[copy]], at[head[copy]], span[order[copy]], span[head[copy]])]
        whole = order[copy]
        rows = [(home_of(ids[whole], keys[whole]), ids[whole], keys[whole], rel[whole].astype(I64), runs[whole])] if len(whole) else []
        left = np.ones(len(ids), bool)
        left[whole] = False
        # A string has its minimizer with at least `side` more bytes on one side: pieces that share
        # neither side with a piece of another document share no string with it.
        side = (length - q) // 2
        near = np.zeros(len(ids), bool)
        for begin, ok in ((at + lead, lead + q + side <= span), (at + lead - side, lead >= side)):
            own = np.flatnonzero(left & ok)
            h = grams_at(text, begin[own], 16)
            for j in range(16, q + side, 16):
                h = h * GOLD ^ grams_at(text, begin[own] + min(j, q + side - 16), 16)
            order = np.argsort(h, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]])) if len(own) else np.zeros(0, I64)
            if len(own):
                who = ids[own][order]
                varied = np.maximum.reduceat(who, cuts) != np.minimum.reduceat(who, cuts)
                near[own[order[np.repeat(varied, np.diff(np.append(cuts, len(own))))]]] = True
        keep = np.flatnonzero(near)
        keep = keep[np.argsort(gram[keep], kind="stable")]
        # Pieces of one minimizer stay together.
        g = gram[keep]
        grp = np.cumsum(np.concatenate([[True], g[1:] != g[:-1]])) - 1 if len(g) else np.zeros(0, I64)
        ends = np.cumsum(span[keep])
        lo = 0
        while lo < len(keep):
            # Whole groups up to CHUNK bytes (a larger group alone).
            hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, side="right"))
            hi = max(hi, lo + 1)
            if hi < len(keep):
                back = int(np.searchsorted(grp, grp[hi - 1]))
                hi = back if back > lo else int(np.searchsorted(grp, grp[lo], side="right"))
            own = keep[lo:hi]
            rows += one_chunk(own, ids, keys, rel, runs, span, at, text)
            lo = hi
        if not rows:
            return []
        home, i, k, f, r = (np.concatenate([x[j] for x in rows]) for j in range(5))
        return marks_out(home, i, k, f, r)

    def one_chunk(own, ids, keys, rel, runs, span, at, text):
        part = gathered(text, at[own], span[own])
        begin = np.concatenate([[0], np.cumsum(span[own])])[:-1]
        starts = ranges(begin, runs[own])  # the strings of length bytes in all pieces
        piece = np.repeat(np.arange(len(own)), runs[own])
        bucket = refine(part, starts, length)
        # The smallest doc_id of each bucket of equal strings.
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, I64)
        who = ids[own][piece]
        least = np.minimum.reduceat(who[order], cuts) if len(cuts) else who[:0]
        low = np.empty(len(b), I64)
        low[order] = np.repeat(least, np.diff(np.append(cuts, len(b))))
        # Runs of starts with a smaller document, for the piece's own document.
        hit = low < who
        first = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | (piece[1:] != piece[:-1])]))
        if not len(first):
            return []
        stop = np.flatnonzero(hit & np.concatenate([~hit[1:] | (piece[1:] != piece[:-1]), [True]]))
        p = own[piece[first]]
        offset = starts[first] - begin[piece[first]]
        return [(home_of(ids[p], keys[p]), ids[p], keys[p], rel[p] + offset, stop - first + 1)]

    def to_home(batches):
        for b in sliced(batches):
            ids, off, raw = as_text_arrays(b)
            keys = text_key(ids, raw, off)
            home = home_of(ids, keys)
            rows = []
            for h in np.unique(home).tolist():
                own = np.flatnonzero(home == h)
                rows.append((h, pack(ids[own], keys[own], off[own + 1] - off[own], raw[ranges(off[own], off[own + 1] - off[own])])))
            yield pa.RecordBatch.from_pydict({"home": pa.array([r[0] for r in rows], pa.int32()), "texts": pa.array([r[1] for r in rows], pa.binary())})

    def rebuild(key, texts: pa.Table, marks: pa.Table) -> pa.Table:
        m = [unpack(x) for x in marks.column("block").to_pylist()]
        mi, mk, mf, mr = (np.concatenate([np.frombuffer(x[j], d) for x in m]) if m else np.zeros(0, d) for j, d in enumerate((I64, np.uint32, np.int32, np.int32)))
        order = np.lexsort((mf, mk, mi))
        mi, mk, mf, mr = mi[order], mk[order], mf[order].astype(I64), mr[order].astype(I64)
        cols: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for x in texts.column("texts").to_pylist():
            ids, keys, lens, data = unpack(x)
            ids, keys, ends = np.frombuffer(ids, I64), np.frombuffer(keys, np.uint32), np.cumsum(np.frombuffer(lens, I64))
            lo, hi = np.searchsorted(mi, ids), np.searchsorted(mi, ids, side="right")
            for i in range(len(ids)):
                text = data[(ends[i - 1] if i else 0) : ends[i]]
                own = np.arange(lo[i], hi[i])
                own = own[mk[own] == keys[i]]
                removed = spans = 0
                kept = text
                if len(own):
                    change = np.zeros(len(text) + 1, I64)
                    np.add.at(change, mf[own], 1)
                    np.add.at(change, mf[own] + mr[own] + length - 1, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                cols["doc_id"].append(ids[i])
                cols["n_bytes"].append(len(text))
                cols["n_removed"].append(removed)
                cols["n_spans"].append(spans)
                cols["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_bytes:
                    cols["kept"].append(bytes(kept))
        out = {"doc_id": id_array(np.array(cols["doc_id"], I64))}
        out |= {c: pa.array(cols[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")}
        out["kept_sha256"] = pa.array(cols["kept_sha256"], pa.string())
        if with_bytes:
            out["kept"] = pa.array(cols["kept"], pa.binary())
        return pa.table(out)

    sent_rows = docs.mapInArrow(send, "bucket int, home int, block binary")
    marks = sent_rows.groupBy("bucket").applyInArrow(sort, "home int, block binary")
    texts = docs.mapInArrow(to_home, "home int, texts binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return texts.groupBy("home").cogroup(marks.groupBy("home")).applyInArrow(rebuild, schema)


def piece_hash(raw: np.ndarray, first: np.ndarray, span: np.ndarray, name: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each piece (equal pieces, equal hashes)."""
    out = np.empty(len(first), U64)
    width = (int(span.max()) + 7) // 8 * 8 if len(span) else 8
    for lo in range(0, len(first), 1 << 17):
        s = span[lo : lo + (1 << 17)]
        rows = rows_of(raw, first[lo : lo + (1 << 17)], width)
        rows[np.arange(width)[None] >= s[:, None]] = 0
        h = name[lo : lo + (1 << 17)] + s.astype(U64) * GOLD
        for w in rows.view(U64).T:
            h = (h ^ w) * GOLD
            h ^= h >> U64(29)
        out[lo : lo + (1 << 17)] = h
    return out


def equal_pieces(raw: np.ndarray, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether the pieces at a and b are equal, byte by byte."""
    ok = na == nb
    if len(a):
        width = int(na.max())
        for lo in range(0, len(a), 1 << 17):
            part = slice(lo, lo + (1 << 17))
            past = np.arange(width)[None] >= na[part][:, None]
            ok[part] &= ((rows_of(raw, a[part], width) == rows_of(raw, b[part], width)) | past).all(1)
    return ok
