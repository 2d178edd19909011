"""Benchmark decontamination by spaced-seed hashing (DataFrame functions only).

Texts become words: lower case, parted at everything but letters and digits. A
spaced seed is a fixed mask over a window of words that ignores some positions,
so windows that differ there by a substitution still have the same hash. The
windows of documents and benchmark items join on those hashes, and every hit
names a diagonal (word offset of document minus item). Around a hit, document
and item are laid along the diagonal and compared word by word: the pair counts
as leaked if some window of `span` aligned words (all words, for shorter items)
agrees in at least `least` of its words.

The seeds of the benchmark are sent to all tasks only while their counted number
is at most MAX_BROADCAST; beyond it they are joined by shuffle. Texts are only
fetched for documents that have hits.

Defined results: null or empty texts and items have no words and no hits; items
of fewer words than the widest mask are too short to count as leaked; repeated
rows and items are reported for each doc_id and item_id once; empty tables give
an empty result; rows of null doc_id or item_id are reported with null ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import materialize, packed, unpacked

#: Masks: 1 is compared, 0 is ignored.
MASKS = ("110110101", "1011001011")
#: Words of the windows that are compared around a hit, and the share that must agree.
SPAN, LEAST = 13, 0.75
#: Benchmark windows that may be sent to every task (about 40 bytes each).
MAX_BROADCAST = 1_000_000
NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text):
    """Array of lower-case words of a text column."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def seeds(hashes, masks=MASKS):
    """Array of the seed hashes of all windows: for each mask, in the order of the windows."""

    def of(k: int, mask: str):
        at = [i for i, c in enumerate(mask) if c == "1"]
        last = F.size(hashes) - F.lit(len(mask))
        windows = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(windows, lambda i: F.xxhash64(F.lit(k), *(F.get(hashes, i + F.lit(a)) for a in at)))

    return [of(k, m) for k, m in enumerate(masks)]


def windows(table: DataFrame, key: str, masks=MASKS) -> DataFrame:
    """(key, at, seed): one row for each mask and window."""
    hashed = table.select(key, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("d_h"))
    parts = [hashed.select(key, F.posexplode_outer(of).alias("at", "seed")) for of in seeds(F.col("d_h"), masks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, masks=MASKS, span: int = SPAN, least: float = LEAST, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, item_id, n_words (of the item), n_equal (most equal words on one diagonal), best (share of the best window) of every leaked pair."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "text"))
    probes = windows(items, "item", masks).select("item", F.col("at").alias("item_at"), "seed").distinct()
    n = probes.count()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Outer, as a plain explode adds a filter on the array, whose lambdas would be pushed below and hash a text once a window.
    # One pass over the texts: all seeds of a document in one array, the mask and window told by position.
    hashed = texts.select("doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("d_h"))
    packed = hashed.select("doc_id", F.size("d_h").alias("n"), F.concat(*seeds(F.col("d_h"), masks)).alias("s"))
    rows = packed.select("doc_id", "n", F.posexplode_outer("s").alias("p", "seed"))
    hits = rows.join(F.broadcast(probes) if n <= max_broadcast else probes, "seed")
    at, before = F.col("p"), F.lit(0)
    start = None
    for mask in masks:
        count = F.greatest(F.col("n") - F.lit(len(mask) - 1), F.lit(0))
        inside = (F.col("p") >= before) & (F.col("p") < before + count)
        start = F.when(inside, at - before) if start is None else start.when(inside, at - before)
        before = before + count
    hits = materialize(hits.select("doc_id", "item", (start - F.col("item_at")).alias("diagonal")).distinct())
    known = items.select("item", "item_id", words(F.col("text")).alias("w_item"))
    known = F.broadcast(known) if n <= max_broadcast else known
    found = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hits"))
    near = texts.join(found.drop("n_hits").withColumnRenamed("doc_id", "h_id"), F.col("doc_id").eqNullSafe(F.col("h_id")), "left_semi")
    near = near.select(F.col("doc_id").alias("n_id"), words(F.col("text")).alias("w_doc"))
    pairs = hits.join(near, F.col("doc_id").eqNullSafe(F.col("n_id"))).join(known, "item")
    size = F.size("w_item")
    equal = F.transform(F.sequence(F.lit(0), size - 1), lambda i: (F.when(i + F.col("diagonal") >= 0, F.get("w_doc", i + F.col("diagonal"))) == F.get("w_item", i)).cast("int"))
    equal = F.transform(equal, lambda x: F.coalesce(x, F.lit(0)))
    width = F.least(size, F.lit(span))
    sums = F.transform(F.sequence(F.lit(0), size - F.col("width")), lambda i: F.aggregate(F.slice("equal", i + 1, F.col("width")), F.lit(0), lambda a, x: a + x))
    judged = pairs.withColumn("equal", equal).withColumn("width", width)
    judged = judged.withColumn("best", F.array_max(sums) / F.col("width")).withColumn("n_equal", F.aggregate("equal", F.lit(0), lambda a, x: a + x)).withColumn("n_words", size)
    judged = judged.filter(F.col("best") >= least)
    return judged.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.max("n_equal").alias("n_equal"), F.max("best").alias("best"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the documents that share a passage with the benchmark, with all their columns, whatever the names."""
    bad = leaks(docs, benchmark, **options).select(F.col("doc_id").alias("leaked_id")).distinct()
    rows = docs.select(packed(docs.columns), F.col("doc_id").cast("long").alias("own_id"))
    return rows.join(bad, F.col("own_id").eqNullSafe(F.col("leaked_id")), "left_anti").select(*unpacked(docs.columns))
