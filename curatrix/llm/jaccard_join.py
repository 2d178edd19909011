"""N-gram Jaccard join: size-aware heavy-light join of documents by their word shingles.

Two sets of sizes m <= n with similarity t share at least ceil(t * n) members, so
in any one order of all shingles their first n - ceil(t * n) + l members share at
least l. Small sets use l = 2 and enumerate the subsets of two of that prefix
(light: two members seldom meet by chance). Large sets post the members of the
prefix for l = 1 to inverted lists, which are scanned (heavy). Small sets that
may match a large one by size do both. The boundary between small and large is
the largest size for which enumerating subsets costs no more than scanning lists,
by counted sizes and the measured length of lists. Shingles that are frequent
come last in the order.

Defined results: null texts and texts without words have no set and link to
nothing; a text of fewer words than a shingle is one shingle; documents of equal
sets are linked; rows are told apart by doc_id and text, equal rows are one
document and come out as often as they come in; an empty table gives an empty
table; other columns are kept whatever their names. A set is compared through
64-bit hashes of its shingles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import GOLD, fresh, materialize, splitmix
from curatrix.llm.setlinks import Rule, linked

#: Cost of comparing a candidate, in posted keys.
COMPARE = 4.0


def prefix(n: int, num: int, l: int) -> int:
    """Members of a set of n that must share l with any similar set."""
    return min(n, n - -(-num * n // 100) + l)


def in_order(s: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Members with the frequent ones last, by count; others by hash."""
    if not len(often):
        return s
    at = np.minimum(np.searchsorted(often[:, 0], s), len(often) - 1)
    count = np.where(often[at, 0] == s, often[at, 1], np.uint64(0))
    return s[np.lexsort((s, count))] if count.any() else s


def join_keys(sets: list[np.ndarray], context: dict) -> list[np.ndarray]:
    return [_keys(s, context) for s in sets]


def _keys(s: np.ndarray, context: dict) -> np.ndarray:
    n, num, limit = len(s), context["num"], context["boundary"]
    s = in_order(s, context["often"])
    keys = []
    if n <= limit:
        p = s[: prefix(n, num, 2)]
        i, j = np.triu_indices(len(p), 1)
        keys.append(splitmix(splitmix(np.minimum(p[i], p[j])) * GOLD + np.maximum(p[i], p[j])))
    if n > limit or 100 * n >= num * (limit + 1):
        keys.append(s[: prefix(n, num, 1)])
    return np.unique(np.concatenate(keys))


def boundary(sizes: list[tuple[int, int]], num: int, mates: float) -> int:
    """The largest size up to which subsets of two are the cheaper way; sizes: (size, number of sets), ascending."""
    best = 0
    for n, _ in sizes:
        p1, p2 = prefix(n, num, 1), prefix(n, num, 2)
        if p2 * (p2 - 1) / 2 <= p1 * (1 + COMPARE * mates):
            best = n
        elif n > 200:
            break
    return best


def jaccard_rule(k: int = 4, num: int = 85) -> Rule:
    return Rule(k=k, num=num, paragraphs=False, least_words=1, cells=1024, keys=join_keys)


def join(docs: DataFrame, k: int = 4, num: int = 85) -> tuple[DataFrame, DataFrame]:
    """(items, components): see setlinks.linked."""

    def context_of(table: DataFrame, often: np.ndarray) -> dict:
        small = table.filter(F.col("n") <= 1000).groupBy("n").count().orderBy("n").collect()
        total = table.agg(F.sum("n")).collect()[0][0]
        mates = float(often[:, 1].sum()) / max(1, total) if len(often) else 0.0
        share = (100 - num) / 100
        return {"num": num, "often": often, "boundary": boundary([(r["n"], r["count"]) for r in small], num, mates), "keys": lambda s, c: share * s + 2 * c}

    return linked(docs, jaccard_rule(k, num), lambda n, o: _plain(context_of(n, o)), True)


class _plain(dict):
    """A context whose counting rule stays on the driver."""

    def __reduce__(self):
        return (dict, ({k: v for k, v in self.items() if not callable(v)},))


def row_name():
    """A hash of doc_id and text, nulls included: what tells rows apart."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), "text", F.col("text").isNull())


def linked_documents(docs: DataFrame, k: int = 4, num: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; rows of one doc_id with different texts are linked by their own texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_name().alias("row"), "text")
    table, comps = join(rows.select(F.col("row").alias("doc_id"), "text"), k, num)
    ids = materialize(rows.select("doc_id", "row"))
    table = table.join(comps.withColumnRenamed("node", "sid"), "sid", "left")
    table = table.select(F.col("doc_id").alias("i_row"), F.col("n").cast("long").alias("n"), F.coalesce("comp", "sid").alias("comp")).distinct()
    named = table.join(ids.distinct(), F.col("row") == F.col("i_row"))
    # Rows of a component are as many as its documents: the least is taken by partial sums and goes back by a join that splits large keys.
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    found = table.join(least, "comp").select("i_row", F.col("n").alias("n_shingles"), "component_id")
    out = ids.join(found, F.col("row") == F.col("i_row"), "left")
    return out.select("doc_id", F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 4, num: int = 85) -> DataFrame:
    """docs with one row of each component: the smallest doc_id, null last.

    Rows are told apart by doc_id and text here, so that rows without an id, or of
    the same id, are linked like others. Texts without words are one document for
    each id; without an id only equal rows are.
    """
    ident, tag = fresh(["row", "tag"], docs.columns)
    rows = docs.withColumn(ident, row_name())
    rows = rows.withColumn(tag, F.xxhash64(ident, *[x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]))
    table, comps = join(rows.select(F.col(ident).alias("doc_id"), "text"), k, num)
    table = table.join(comps.withColumnRenamed("node", "sid"), "sid", "left").select(F.col("doc_id").alias("i_row"), F.coalesce("comp", "sid").alias("comp")).distinct()
    all_ = rows.select(F.col(ident).alias("row"), F.col(tag).alias("tag"), F.col("doc_id").cast("long").alias("id")).distinct()
    # Rows without a set: the component is the id, or the row itself.
    alone = F.col("comp").isNull()
    named = all_.join(table, F.col("row") == F.col("i_row"), "left").select("tag", "id", alone.alias("alone"), F.coalesce("comp", "id", "tag").alias("comp"), (alone & F.col("id").isNull()).alias("bare"))
    named = materialize(named)
    # Partial sums first; the join back splits a component that many rows have.
    first = named.groupBy("comp", "alone", "bare").agg(F.min(F.struct(F.col("id").isNull(), "id", "tag")).alias("kept"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    gone = named.join(first, ["comp", "alone", "bare"]).filter(F.col("tag") != F.col("kept.tag")).select(F.col("tag").alias(tag))
    # Equal rows become one within a task before they are dealt out.
    return rows.dropDuplicates([tag]).join(gone, tag, "left_anti").select(*docs.columns)
