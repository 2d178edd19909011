"""Linking sets of word shingles by exact Jaccard similarity, from any candidate keys.

Items (documents or their paragraphs) become sets of shingle hashes. Equal sets
are one node (named by a hash of the set), so copies never meet in pairs. Nodes
that share a candidate key are compared:

* of a short list of nodes with one key, all pairs of fitting sizes;
* of a long list, each node with the first and with the one before it in order of
  size; after the links found that way are joined into components, only nodes of
  different components are still compared, so groups of copies don't make all
  pairs and yet no link between components is lost.

Pairs first pass a bound that is never below the true overlap (`sketch`: counts
of shingles over 128 cells, then over more cells for larger sets); the items of
the rest are fetched and compared in full. All tables are keyed by hashes, spread evenly; a node that many
others are compared with is sent once to each of the blocks that need it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import GOLD, NULL_ID, as_text_arrays, discard, materialize, pack, shingles, sliced, splitmix, unpack, word_hashes
from curatrix.llm.components import components

CELLS = 128
#: Lists of at most SHORT nodes are compared in full at once; longer ones in parts of about PART nodes.
SHORT, PART = 12, 2000
#: Groups that the members of long lists are dealt to before their sketches are sent.
CUTS = 1024
#: Bits of the table that tells which documents are to be fetched.
NEED_BITS = 22
#: Frequent shingles that are sent to every task (16 bytes each).
OFTEN = 250_000
I64 = np.int64


@dataclass(frozen=True)
class Rule:
    """Shingle length, similarity num / 100, whether items are paragraphs, fewest words of an item, cells of the fine sketch, key function."""

    k: int
    num: int
    paragraphs: bool
    least_words: int
    cells: int
    #: (sets of hashes, each ascending; shared context) -> candidate keys of each
    keys: Callable


def fits(a, b, num: int):
    """Whether sizes allow the similarity."""
    return 100 * np.minimum(a, b) >= num * np.maximum(a, b)


def similar(common, a, b, num: int):
    return 100 * common >= num * (a + b - common)


def item_sets(batch: pa.RecordBatch, rule: Rule):
    """(doc id, paragraph, words, name of the set, ascending distinct shingle hashes, bytes) of the items of a batch that have a set."""
    ids, off, raw = as_text_arrays(batch)
    owner, para = np.arange(len(ids)), np.zeros(len(ids), I64)
    if rule.paragraphs and len(raw):
        cuts = np.flatnonzero(raw == 10) + 1
        starts = np.unique(np.concatenate([off[:-1], cuts[cuts < off[-1]]]))
        owner = np.searchsorted(off, starts, side="right") - 1
        firsts = np.concatenate([[True], owner[1:] != owner[:-1]])
        at = np.flatnonzero(firsts)
        para = np.arange(len(starts)) - np.repeat(at, np.diff(np.append(at, len(starts))))
        off = np.append(starts, off[-1])
    words, counts = word_hashes(raw, off)
    sh, n = shingles(words, counts, rule.k)
    ends = np.cumsum(n)
    own = np.flatnonzero((n > 0) & (counts >= rule.least_words))
    sets = []
    for a, b in zip((ends[own] - n[own]).tolist(), ends[own].tolist()):
        s = np.sort(sh[a:b])
        keep = s[1:] != s[:-1]
        sets.append(s if keep.all() else s[np.concatenate([[True], keep])])
    names = set_names(sets)
    for i, name, s in zip(own.tolist(), names.tolist(), sets):
        yield int(ids[owner[i]]), int(para[i]), int(counts[i]), name, s, raw[off[i] : off[i + 1]]


def set_names(sets: list[np.ndarray]) -> np.ndarray:
    """Names of sets: a hash of the members and their number."""
    if not sets:
        return np.zeros(0, I64)
    lens = np.array([len(s) for s in sets])
    sums = np.add.reduceat(splitmix(np.concatenate(sets) + GOLD), np.concatenate([[0], np.cumsum(lens)[:-1]]))
    return splitmix(sums ^ (lens.astype(np.uint64) * GOLD)).view(I64)


def sketch(s: np.ndarray, n_cells: int = CELLS) -> bytes:
    """Counts of members over the cells (a power of two); 255 means 255 or more."""
    cells = np.bincount((s & np.uint64(n_cells - 1)).astype(I64), minlength=n_cells)
    return np.minimum(cells, 255).astype(np.uint8).tobytes()


def sketch_passes(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, num: int) -> np.ndarray:
    """Whether the sketches (rows of cells) leave room for the similarity."""
    low = np.minimum(a, b)
    most = low.sum(1, dtype=I64)
    open_ended = (low == 255).any(1)
    return open_ended | similar(most, na, nb, num)


def items(docs: DataFrame, rule: Rule, frequent: bool) -> tuple[DataFrame, np.ndarray]:
    """Table (doc_id, para, sid, n, words, cells, fine) of the items; frequent shingles as (hash, count) rows in order, if asked for.

    Frequent shingles only steer the order in which a set lists its members; any
    order gives the same links. So they are gathered from shingles that occur
    four times in a task, equal sets once: a table of hashed counts lets the first
    two occurrences pass, later ones are counted by themselves. At most OFTEN are kept.
    """

    def table_of(rows):
        kinds = [pa.int8(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["kind", "doc_id", "para", "sid", "n", "words", "cells", "fine"])

    def run(batches):
        seen: set[int] = set()
        counts = np.zeros((0, 2), np.uint64)
        cells = np.zeros(1 << 24 if frequent else 1, np.uint8)
        for b in sliced(batches):
            rows, pool = [], []
            for doc, para, words, sid, s, _ in item_sets(b, rule):
                rows.append((0, doc, para, sid, len(s), words, sketch(s), pack(sketch(s, rule.cells), level=1) if rule.cells > CELLS else b""))
                if frequent and sid not in seen:
                    seen.add(sid)
                    pool.append(s)
            if pool:
                h, c = np.unique(np.concatenate(pool), return_counts=True)
                at = (h >> np.uint64(40)).astype(I64)
                now = cells[at] + c
                cells[at] = np.minimum(now, 255)
                later = now > 2
                counts = np.concatenate([counts, np.stack([h[later], c[later].astype(np.uint64)], 1)])
                if len(counts) > 1 << 21:
                    counts = summed(counts)
                    counts = counts[counts[:, 1] > np.uint64(1)]
            if rows:
                yield table_of(rows)
        counts = summed(counts)
        counts = counts[counts[:, 1] >= np.uint64(2)]
        if len(counts):
            yield table_of([(1, NULL_ID, 0, h, c, 0, b"", b"") for h, c in zip(counts[:, 0].view(I64).tolist(), counts[:, 1].tolist())])

    out = materialize(docs.select("doc_id", "text").mapInArrow(run, "kind byte, doc_id long, para int, sid long, n int, words int, cells binary, fine binary"))
    table = out.filter("kind = 0").drop("kind")
    often = np.zeros((0, 2), np.uint64)
    if frequent:
        top = out.filter("kind = 1").groupBy("sid").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "sid").limit(OFTEN).toArrow()
        h = top.column("sid").to_numpy().astype(I64).view(np.uint64)
        order = np.argsort(h)
        often = np.stack([h[order], top.column("n").to_numpy().astype(np.uint64)[order]], 1)
    return table, often


def summed(counts: np.ndarray) -> np.ndarray:
    """(key, count) rows with the counts of a key added up."""
    h, inv = np.unique(counts[:, 0], return_inverse=True)
    return np.stack([h, np.bincount(inv, weights=counts[:, 1], minlength=len(h)).astype(np.uint64)], 1)


def postings(docs: DataFrame, rule: Rule, context, buckets: int) -> DataFrame:
    """(bucket, block) rows of candidate keys; equal sets of a task post once."""
    share = docs.sparkSession.sparkContext.broadcast(context)

    def run(batches):
        seen: set[int] = set()
        held: list = []
        size = 0

        def flush():
            key = np.concatenate([h[0] for h in held])
            reps = [len(h[0]) for h in held]
            sid = np.repeat(np.array([h[1] for h in held], I64), reps)
            n = np.repeat(np.array([h[2] for h in held], np.int32), reps)
            to = (key % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            ends = np.cumsum(np.bincount(to, minlength=buckets))
            rows = []
            for b in range(buckets):
                at = order[(ends[b - 1] if b else 0) : ends[b]]
                if len(at):
                    rows.append((b, pack(key[at], sid[at], n[at], level=1)))
            held.clear()
            return pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.binary())})

        for b in sliced(batches):
            fresh = {sid: s for _, _, _, sid, s, _ in item_sets(b, rule) if sid not in seen}
            seen.update(fresh)
            for (sid, s), keys in zip(fresh.items(), rule.keys(list(fresh.values()), share.value)):
                if len(keys):
                    held.append((keys, sid, len(s)))
                    size += len(keys)
            if size > 600_000:
                yield flush()
                size = 0
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, block binary")


def candidates(posted: DataFrame, num: int) -> DataFrame:
    """(list, a, b, na, nb, key): list 0, pairs of nodes to compare and a key they share; other lists, long ones: member a of size na."""

    def run(t: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in t.column("block").to_pylist()]
        key, sid, n = (np.concatenate([np.frombuffer(p[j], d) for p in parts]) for j, d in ((0, np.uint64), (1, I64), (2, np.int32)))
        order = np.lexsort((sid, n, key))
        key, sid, n = key[order], sid[order], n[order].astype(I64)
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])]) if len(key) else np.zeros(0, bool)
        key, sid, n = key[first], sid[first], n[first]
        out = []
        if len(key):
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            lens = np.diff(np.append(starts, len(key)))
            head = np.repeat(starts, lens)
            length = np.repeat(lens, lens)
            pos = np.arange(len(key))
            pairs = [(pos[1:], pos[:-1]), (pos, head)]
            for d in range(2, SHORT):
                i = pos[d:][(length[d:] <= SHORT)]
                pairs.append((i, i - d))
            for i, j in pairs:
                ok = (head[i] == head[j]) & (i != j)
                i, j = i[ok], j[ok]
                ok = fits(n[i], n[j], num)
                i, j = i[ok], j[ok]
                swap = sid[i] > sid[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                out.append(np.stack([np.zeros(len(i), I64), sid[i], sid[j], n[i], n[j], key[i].view(I64)], 1))
            long_ones = length > SHORT
            if long_ones.any():
                names = key[long_ones].view(I64)
                out.append(np.stack([np.where(names == 0, 1, names), sid[long_ones], np.zeros(int(long_ones.sum()), I64), n[long_ones], np.zeros(int(long_ones.sum()), I64), names], 1))
        rows = np.concatenate(out) if out else np.zeros((0, 6), I64)
        if len(rows):
            pair = rows[:, 0] == 0
            a = rows[pair]
            a = a[np.lexsort((a[:, 5], a[:, 2], a[:, 1]))]
            a = a[np.concatenate([[True], (a[1:, 1:3] != a[:-1, 1:3]).any(1)])] if len(a) else a
            rows = np.concatenate([a, rows[~pair]])
        return pa.table({c: pa.array(np.ascontiguousarray(rows[:, i]), pa.int64()) for i, c in enumerate(("list", "a", "b", "na", "nb", "key"))})

    return posted.groupBy("bucket").applyInArrow(run, "list long, a long, b long, na long, nb long, key long")


def sketched(pairs: DataFrame, nodes: DataFrame, num: int, column: str = "cells") -> DataFrame:
    """The pairs (a, b, key) of (a, b, key) whose sketches, the coarse or the fine ones, leave room for the similarity."""
    own = nodes.select("sid", "n", F.col(column).alias("x"))
    pairs = pairs.select("a", "b", "key")
    for c in ("a", "b"):
        pairs = pairs.join(own.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("x").alias(f"c{c}")), c)

    def run(batches):
        for t in batches:
            if t.num_rows:
                rows = [t.column(c).to_pylist() for c in ("ca", "cb")]
                if column == "fine":
                    rows = [[unpack(x)[0] for x in r] for r in rows]
                ca, cb = (np.frombuffer(b"".join(r), np.uint8).reshape(t.num_rows, -1) for r in rows)
                ok = sketch_passes(ca, cb, t.column("na").to_numpy().astype(I64), t.column("nb").to_numpy().astype(I64), num)
                yield t.select(["a", "b", "key"]).filter(pa.array(ok))

    return pairs.select("a", "b", "na", "nb", "key", "ca", "cb").mapInArrow(run, "a long, b long, key long")


def verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, rule: Rule, blocks: int, sharp: bool = False) -> DataFrame:
    """The pairs (a, b) of (a, b, key) whose sets are similar, compared in full; texts: see stored; sharp: fine sketches have been compared."""
    num = rule.num
    rough = pairs = materialize(sketched(pairs, nodes, num, "fine")) if rule.cells > CELLS and not sharp else pairs
    # Pairs with a common key go to one block, so that a set is sent to few blocks; keys with many pairs to a grid of blocks.
    per = pairs.groupBy("key").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / F.lit(20_000.0))).alias("grid"))
    pairs = pairs.join(per, "key")
    cell = lambda c: F.pmod(F.xxhash64(c), F.col("grid"))
    pairs = materialize(pairs.select("a", "b", F.pmod(F.xxhash64("key", cell("a"), cell("b")), F.lit(blocks)).cast("int").alias("block")))
    wanted = pairs.select(F.col("a").alias("sid"), "block").unionByName(pairs.select(F.col("b").alias("sid"), "block")).distinct()
    wanted = materialize(wanted.join(nodes.select("sid", "doc_id", "para"), "sid"))
    out = materialize(_verified(pairs, wanted, texts, rule, blocks, num))
    discard(rough, pairs, wanted)
    return out


def _cell(x: np.ndarray) -> np.ndarray:
    return (splitmix(x.astype(I64).view(np.uint64)) >> np.uint64(64 - NEED_BITS)).astype(I64)


def bit_table(df: DataFrame, column: str):
    """A broadcast table of 2**NEED_BITS bits with those of the column's values set, whatever their number: it only spares rows that nobody asks for."""

    def cells(batches):
        # One table for the whole task; the words of it that hold a bit go out once.
        own = np.zeros(1 << (NEED_BITS - 6), np.uint64)
        for t in batches:
            c = _cell(t.column(0).to_numpy(zero_copy_only=False))
            np.bitwise_or.at(own, c >> 6, np.left_shift(np.uint64(1), (c & 63).astype(np.uint64)))
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_pydict({"word": pa.array(at), "bit": pa.array(own[at].view(I64))})

    got = df.select(column).mapInArrow(cells, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(1 << (NEED_BITS - 6), np.uint64)
    table[got.column("word").to_numpy()] = got.column("bit").to_numpy().view(np.uint64)
    return df.sparkSession.sparkContext.broadcast(table)


def has_bit(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    c = _cell(x)
    return ((table[c >> 6] >> (c & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def concerned(table: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes (sid, doc_id, para, n, cells, fine) of the items whose set is in some candidate pair or list."""
    bits = bit_table(found.select(F.col("a").alias("x")).unionAll(found.filter("list = 0").select(F.col("b").alias("x"))), "x")

    def run(batches):
        for t in batches:
            keep = has_bit(bits.value, t.column("sid").to_numpy(zero_copy_only=False))
            if keep.any():
                yield t.filter(pa.array(keep))

    names = ["sid", "doc_id", "para", "n", "cells", "fine"]
    rows = table.select(*names)
    rows = rows.mapInArrow(run, rows.schema)
    least = rows.groupBy("sid").agg(F.min(F.struct(*names[1:])).alias("x"))
    return materialize(least.select("sid", *[f"x.{c}" for c in names[1:]]))


def stored(docs: DataFrame, nodes: DataFrame, blocks: int) -> DataFrame:
    """(home, texts): the texts of the documents that hold a node, written once, in blocks dealt by doc_id."""
    needed = bit_table(nodes, "doc_id")

    def to_send(batches):
        for b in sliced(batches):
            ids, off, raw = as_text_arrays(b)
            hit = np.flatnonzero(has_bit(needed.value, ids))
            if not len(hit):
                continue
            to = (splitmix(ids[hit].view(np.uint64) + GOLD) % np.uint64(blocks)).astype(np.int32)
            rows = []
            for k in np.unique(to).tolist():
                own = hit[to == k]
                rows.append((k, pack(ids[own], (off[own + 1] - off[own]), b"".join(raw[off[i] : off[i + 1]].tobytes() for i in own))))
            yield pa.RecordBatch.from_pydict({"home": pa.array([r[0] for r in rows], pa.int32()), "texts": pa.array([r[1] for r in rows], pa.binary())})

    return materialize(docs.select("doc_id", "text").mapInArrow(to_send, "home int, texts binary"))


def _verified(pairs, wanted, texts, rule, blocks, num):
    needed = bit_table(wanted, "doc_id")

    def of_round(batches):
        # Only the texts that some pair of this round asks for are sent.
        for t in batches:
            rows = []
            for home, x in zip(t.column("home").to_pylist(), t.column("texts").to_pylist()):
                ids, lens, data = unpack(x)
                ids, lens = np.frombuffer(ids, I64), np.frombuffer(lens, I64)
                ends, hit = np.cumsum(lens), np.flatnonzero(has_bit(needed.value, ids))
                if len(hit):
                    rows.append((home, pack(ids[hit], lens[hit], b"".join(data[ends[i] - lens[i] : ends[i]] for i in hit.tolist()))))
            yield pa.RecordBatch.from_pydict({"home": pa.array([r[0] for r in rows], pa.int32()), "texts": pa.array([r[1] for r in rows], pa.binary())})

    texts = texts.mapInArrow(of_round, "home int, texts binary")

    def homes(batches):
        for t in batches:
            ids = t.column("doc_id").to_numpy(zero_copy_only=False)
            yield t.append_column("home", pa.array((splitmix(ids.astype(I64).view(np.uint64) + GOLD) % np.uint64(blocks)).astype(np.int32)))

    asked = wanted.select("sid", "block", "doc_id", "para").mapInArrow(homes, "sid long, block int, doc_id long, para int, home int")

    def fetch(key, t: pa.Table, q: pa.Table) -> pa.Table:
        want: dict[int, set[int]] = {}
        to: dict[int, list[int]] = {}
        for sid, block, doc, _ in zip(*(q.column(c).to_pylist() for c in ("sid", "block", "doc_id", "para"))):
            want.setdefault(doc, set()).add(sid)
            to.setdefault(sid, []).append(block)
        done: set[int] = set()
        rows: list = []
        for x in t.column("texts").to_pylist():
            ids, lens, data = unpack(x)
            ids, ends = np.frombuffer(ids, I64), np.cumsum(np.frombuffer(lens, I64))
            own = [i for i in range(len(ids)) if int(ids[i]) in want]
            part = [bytes(data[(ends[i - 1] if i else 0) : ends[i]]) for i in own]
            batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([int(ids[i]) for i in own], pa.int64()), "text": pa.array(part, pa.binary())})
            for doc, _, _, sid, _, item in item_sets(batch, rule) if own else ():
                if sid in want[doc] and sid not in done:
                    done.add(sid)
                    z = pack(item)  # the text is a few times smaller than its set of hashes
                    rows += [(b, sid, z) for b in to[sid]]
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "sid": pa.array([r[1] for r in rows], pa.int64()), "members": pa.array([r[2] for r in rows], pa.binary())})

    sets = texts.groupBy("home").cogroup(asked.groupBy("home")).applyInArrow(fetch, "block int, sid long, members binary")

    def members(block: bytes) -> np.ndarray:
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([0], pa.int64()), "text": pa.array([bytes(unpack(block)[0])], pa.binary())})
        return next(item_sets(batch, rule))[4]

    def compare(key, p: pa.Table, s: pa.Table) -> pa.Table:
        packed = dict(zip(s.column("sid").to_pylist(), s.column("members").to_pylist()))
        a, b = p.column("a").to_numpy(), p.column("b").to_numpy()
        order, keep, now = np.lexsort((a, b)), np.zeros(len(a), bool), None
        held: dict[int, np.ndarray] = {}
        for i in order.tolist():
            if now is None or now[0] != b[i]:
                now = (b[i], members(packed[int(b[i])]))
            x = held.get(int(a[i]))
            if x is None:
                if len(held) > 2000:
                    held.clear()
                x = held[int(a[i])] = members(packed[int(a[i])])
            y = now[1]
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            keep[i] = similar(int((y[at] == x).sum()), len(x), len(y), num)
        return pa.table({"a": pa.array(a[keep]), "b": pa.array(b[keep])})

    return pairs.groupBy("block").cogroup(sets.groupBy("block")).applyInArrow(compare, "a long, b long")


def crossing(named: DataFrame, num: int) -> DataFrame:
    """(list, sid, n, comp, parts): the members of lists (list, sid, n, comp) that have a member of another component and of a fitting size in their list.

    Lists that are left with the same members become the first of them, as words
    that go together make the same list again and again. So sketches are only sent
    where a pair may come of it, and once for such lists. parts: how many parts of
    about PART members a list makes.
    """

    def run(t: pa.Table) -> pa.Table:
        lst, sid, n, comp = (t.column(c).to_numpy().astype(I64) for c in ("list", "sid", "n", "comp"))
        order = np.lexsort((n, lst))
        lst, sid, n, comp = lst[order], sid[order], n[order], comp[order]
        heads = np.flatnonzero(np.concatenate([[True], lst[1:] != lst[:-1]]))
        place = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(lst))))
        # The next member of another component, by size, and the one before; any other is further away in size.
        change = np.flatnonzero((lst[1:] != lst[:-1]) | (comp[1:] != comp[:-1])) + 1
        stretch = np.searchsorted(change, np.arange(len(lst)), side="right")
        after, before = np.append(change, -1)[stretch], np.concatenate([[0], change])[stretch] - 1
        keep = (after >= 0) & (lst[after] == lst) & fits(n, n[after], num)
        keep |= (before >= 0) & (lst[before] == lst) & fits(n, n[before], num)
        lst, sid, n, comp, place = lst[keep], sid[keep], n[keep], comp[keep], place[keep]
        size = np.bincount(place)
        names = np.zeros(len(size), np.uint64)
        np.add.at(names, place, splitmix(sid.view(np.uint64) + GOLD))
        names = splitmix(names ^ (size.astype(np.uint64) * GOLD)).view(I64)
        parts = -(-size[place] // PART)
        return pa.table({"same": pa.array(names[place]), "list": pa.array(lst), "sid": pa.array(sid), "n": pa.array(n), "comp": pa.array(comp), "parts": pa.array(parts.astype(np.int32))})

    schema = "same long, list long, sid long, n long, comp long, parts int"
    kept = named.select("list", "sid", "n", "comp", F.pmod(F.xxhash64("list"), F.lit(CUTS)).alias("cut")).groupBy("cut").applyInArrow(run, schema)
    one = kept.groupBy("same", "sid").agg(*(F.min(c).alias(c) for c in ("list", "n", "comp", "parts")))
    return one.select("list", "sid", "n", "comp", "parts")


def met(lists: DataFrame, nodes: DataFrame, comps: DataFrame, rule: Rule, best: bool) -> DataFrame:
    """(x, y, near, key, mates): pairs of the long lists (list, sid, n) that different components hold and whose sketches, coarse and fine, leave room.

    All such pairs; or, with `best`, for each node of a part of a list the partner
    whose sketch is nearest, and how many pairs of the node there are in all. A pair goes out of the first of the lists that hold both
    its nodes only, so that long texts, which meet in many lists, do not multiply it.
    """
    num, sharp = rule.num, rule.cells > CELLS
    nodes = nodes.select("sid", F.col("fine" if sharp else "cells").alias("cells"))
    named = lists.join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    rest = materialize(crossing(named, num))
    of = rest.groupBy("sid").agg(F.array_sort(F.collect_set("list")).alias("every"))
    rest = rest.join(nodes, "sid").join(of, "sid")
    # A list of many members is cut into parts, and each pair of parts is a task's group of its own.
    rest = rest.withColumn("part", F.pmod(F.xxhash64("sid", F.lit(21)), F.col("parts")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = rest.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})

    def run(t: pa.Table) -> pa.Table:
        sid, comp, n, part = (t.column(c).to_numpy().astype(I64) for c in ("sid", "comp", "n", "part"))
        alone = not t.num_rows or t.column("lo")[0].as_py() == t.column("hi")[0].as_py()
        cells = t.column("cells").to_pylist()
        fine = np.frombuffer(b"".join([unpack(x)[0] for x in cells] if sharp else cells), np.uint8).reshape(-1, rule.cells)
        order = np.argsort(n, kind="stable")
        sid, comp, n, part, fine = sid[order], comp[order], n[order], part[order], fine[order]
        # The coarse sketch is the fine one with its cells added up; a full cell stays full.
        cells = np.minimum(fine.reshape(len(fine), rule.cells // CELLS, CELLS).sum(1, dtype=I64), 255).astype(np.uint8)
        every = t.column("every").combine_chunks()
        own, ends = every.values.to_numpy(), every.offsets.to_numpy()
        key = t.column("list")[0].as_py() if t.num_rows else 0

        def before(i: int) -> np.ndarray:
            """Lists of node i that come before this one."""
            its = own[ends[order[i]] : ends[order[i] + 1]]
            return its[: np.searchsorted(its, key)]

        top, mate, mates = np.full(len(sid), -1.0), np.zeros(len(sid), I64), np.zeros(len(sid), I64)
        out = []
        for i in range(len(sid) - 1):
            hi = np.searchsorted(100 * n[i] < num * n, True)  # sizes ascend
            j = np.arange(i + 1, hi)
            j = j[(comp[j] != comp[i]) & (alone | (part[j] != part[i]))]
            if not len(j):
                continue
            j = j[sketch_passes(cells[j], cells[i][None], n[j], np.full(len(j), n[i]), num)]
            if sharp and len(j):
                j = j[sketch_passes(fine[j], fine[i][None], n[j], np.full(len(j), n[i]), num)]
            if len(j):
                j = j[[not len(np.intersect1d(before(i), before(x), assume_unique=True)) for x in j.tolist()]]
            if best and len(j):
                most = np.minimum(fine[j], fine[i][None]).sum(1, dtype=I64)
                near = most / np.maximum(1, n[i] + n[j] - most)
                up = near > top[j]
                top[j[up]], mate[j[up]] = near[up], i
                mates[j] += 1
                mates[i] += len(j)
                k = int(near.argmax())
                if near[k] > top[i]:
                    top[i], mate[i] = near[k], j[k]
            elif len(j):
                out.append(np.stack([sid[np.full(len(j), i)], sid[j], np.zeros(len(j), I64), np.ones(len(j), I64)], 1))
        if best:
            i = np.flatnonzero(top >= 0)
            out.append(np.stack([sid[i], sid[mate[i]], (top[i] * 1e9).astype(I64), mates[i]], 1))
        rows = np.concatenate(out) if out else np.zeros((0, 4), I64)
        return pa.table({"x": pa.array(np.ascontiguousarray(rows[:, 0])), "y": pa.array(np.ascontiguousarray(rows[:, 1])), "near": pa.array(np.ascontiguousarray(rows[:, 2])), "key": pa.array(np.full(len(rows), key), pa.int64()), "mates": pa.array(np.ascontiguousarray(rows[:, 3]))})

    return rest.select("list", "lo", "hi", "part", "sid", "comp", "n", "cells", "every").groupBy("list", "lo", "hi").applyInArrow(run, "x long, y long, near long, key long, mates long")


def across(lists: DataFrame, nodes: DataFrame, comps: DataFrame, rule: Rule, best: bool) -> DataFrame:
    """(a, b, key): the pairs of `met`; with `best`, for each node only the partner whose sketch is nearest."""
    return chosen(met(lists, nodes, comps, rule, best), best)


def chosen(pairs: DataFrame, best: bool) -> DataFrame:
    """(a, b, key) of the pairs of `met`, see across."""
    if best:
        pairs = pairs.groupBy("x").agg(F.max(F.struct("near", "y", "key")).alias("m")).select("x", F.col("m.y").alias("y"), F.col("m.key").alias("key"))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "key")
    return pairs.groupBy("a", "b").agg(F.min("key").alias("key"))


def linked(docs: DataFrame, rule: Rule, context_of, frequent: bool) -> tuple[DataFrame, DataFrame]:
    """(items, components of set names): items (doc_id, para, sid, n, words), and (node, comp) of the nodes with links."""
    table, often = items(docs, rule, frequent)
    total = table.agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("c")).collect()[0]
    if not total["c"]:
        empty = docs.sparkSession.createDataFrame([], "node long, comp long")
        return table, empty
    context = context_of(table, often)
    # About 400,000 keys and 4 million shingles for a task.
    buckets = int(max(12, context["keys"](total["s"], total["c"]) // 400_000))
    blocks = int(max(12, total["s"] // 4_000_000))
    found = materialize(candidates(postings(docs, rule, context, buckets), rule.num))
    nodes = concerned(table, found)
    pairs = found.filter("list = 0").groupBy("a", "b").agg(*(F.min(c).alias(c) for c in ("na", "nb", "key")))
    texts = stored(docs, nodes, blocks)
    edges = verified(sketched(pairs, nodes, rule.num), texts, nodes, rule, blocks)
    comps = components(edges)
    lists = found.filter("list <> 0").select("list", F.col("a").alias("sid"), F.col("na").alias("n"))
    held = materialize(nodes.join(lists.select("sid").distinct(), "sid", "left_semi").select("sid", "cells", "fine"))
    # Join components by each node's nearest partner first; then compare whatever is left between components.
    for best in (True, False):
        seen = materialize(met(lists, held, comps, rule, best))
        more = materialize(chosen(seen, best))
        if not more.take(1):
            break
        fresh = verified(more, texts, nodes, rule, blocks, sharp=True)
        discard(more)
        if fresh.take(1):
            edges = edges.unionByName(fresh)
            comps = components(edges)
        if best:
            # A pair that was not chosen is neither node's nearest, so both have two pairs or more; only they are sent again.
            again = materialize(seen.groupBy("x").agg(F.sum("mates").alias("m")).filter("m > 1").select(F.col("x").alias("sid")))
            lists = lists.join(again, "sid", "left_semi")
        discard(seen)
    discard(found, nodes, held, texts)
    return table, comps
