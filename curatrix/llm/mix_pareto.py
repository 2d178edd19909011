"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Every source has a target number of words. A source whose target is m times its
words gives every document floor(m) certain whole copies. What is left, R words of
the source's S, is a fixed-size sample with unequal probabilities, drawn by Pareto
order sampling: a document with the uniform number u and the inclusion probability
p gets the rank value (u / (1 - u)) / (p / (1 - p)), and the documents of the
smallest rank values are taken until the words of the source reach its target.

p is min(1, c * x), where x is the document's size, or its weight if a weight
column is given, to two digits, and c makes the expected words of the sample, the
sum of p * size, equal to R. Documents at p = 1 are certain and leave the draw; c
is then that of the others. As x has at most 90 values in each power of ten, c and
the least certain x follow from words counted by source and x.

The size of the sample is fixed in words: the document at the cut is taken if
that brings the source nearer to its target. The cut is found without sorting a
source in one task: rank values are counted in BINS bins (partial sums before the
shuffle), those of the bin of the cut in BINS finer ones, and only the documents
of that last bin, one of BINS * BINS, are sorted.

Defined results: null or blank texts have size 0 and are never taken; a null
source is a source of its own, last in order; a null, NaN or negative weight is
one of 0, and such documents are taken only where all others don't reach the
target; repeated rows are separate documents; ties in rank value break by doc_id,
size and text hash; very long texts are counted whole, and are taken whole or
not; an empty table gives an empty table; columns of the input keep their names,
and added ones get underscores where they clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.llm.common import fresh, materialize, packed, unpacked

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
WORDS = r"[^\x20\x09-\x0D]+"
#: Bins of the rank value for each source (BINS finer ones in each), and copies of its targets in joins.
BINS, SALTS = 4096, 64


def uniform(key, seed: str):
    """A number in (0, 1) that depends on the seed and the key only."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Targets of sources: (m_source, source_size) to which target is added.

    Weights repeat over the sources in code point order, null last. The target of
    a source is min(cap * size, level * weight); the level makes the targets add
    up to share * all sizes, which is what passing the excess on by weight until
    no source is above its cap ends at. One row for each source.
    """
    by_name = W.orderBy(F.col("m_source").asc_nulls_last())
    everything = W.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("m_w", w).withColumn("m_cap", F.col("source_size") * F.lit(float(cap)))
    t = t.withColumn("m_goal", F.sum("source_size").over(everything) * F.lit(float(share)))
    by_ratio = W.orderBy(F.col("m_cap") / F.col("m_w"), F.col("m_source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    full = F.coalesce(F.sum("m_cap").over(before), F.lit(0.0))
    level = (F.col("m_goal") - full) / F.sum("m_w").over(onward)
    # Sources in order of cap / weight fill up one after the other; the first that doesn't sets the level.
    t = t.withColumn("m_level", F.when(level * F.col("m_w") < F.col("m_cap"), level))
    t = t.withColumn("m_level", F.max("m_level").over(everything))
    target = F.when(F.col("m_level").isNull(), F.col("m_cap")).otherwise(F.least(F.col("m_cap"), F.col("m_level") * F.col("m_w")))
    return t.select("m_source", "source_size", target.alias("target"))


ADDED = ["m_size", "m_source_size", "m_target", "m_copies", "m_taken"]


def two_digits(size, weight=None):
    """What inclusion probabilities go with: the size, or the weight (0 if it is null, NaN or negative), to two digits."""
    if weight is None:
        return (size - size % F.pow(F.lit(10.0), F.greatest(F.length(size.cast("string")) - 2, F.lit(0))).cast("long")).cast("double")
    w = F.least(F.greatest(weight.cast("double"), F.lit(1e-100)), F.lit(1e100))
    step = F.pow(F.lit(10.0), F.floor(F.log10(w)) - 1)
    return F.when(weight.isNull() | F.isnan(weight.cast("double")) | (weight <= 0), 0.0).otherwise(F.round(w / step) * step)


def measured(docs: DataFrame, seed: str, weight_col: str | None) -> DataFrame:
    """(d: all columns of docs; doc_id, m_source, m_size, m_u, m_h, m_x)."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORDS)).cast("long")
    weight = F.col(f"`{weight_col}`").alias("m_w") if weight_col else F.lit(None).alias("m_w")
    out = docs.select(packed(docs.columns), "doc_id", F.col("source").alias("m_source"), size.alias("m_size"), uniform(F.col("doc_id"), seed).alias("m_u"), F.xxhash64("text").alias("m_h"), weight)
    return out.withColumn("m_x", two_digits(F.col("m_size"), F.col("m_w") if weight_col else None)).drop("m_w")


def odds(light: DataFrame, targets: DataFrame) -> DataFrame:
    """targets plus m_c, m_top and m_sure: p is m_c * x up to x = m_top, documents above are certain and hold m_sure words.

    Classes of x are taken from the largest down: the first whose p stays under 1,
    with all larger ones certain, sets c.
    """
    classes = light.filter((F.col("m_size") > 0) & (F.col("m_x") > 0)).groupBy("m_source", "m_x").agg(F.sum("m_size").alias("words"))
    goal = targets.select(F.col("m_source").alias("g_source"), "m_rest")
    classes = classes.join(goal, classes["m_source"].eqNullSafe(goal["g_source"])).drop("g_source")
    upto = W.partitionBy("m_source").orderBy("m_x").rowsBetween(W.unboundedPreceding, W.currentRow)
    above = F.sum("words").over(W.partitionBy("m_source")) - F.sum("words").over(upto)
    classes = classes.withColumn("above", above).withColumn("c", (F.col("m_rest") - F.col("above")) / F.sum(F.col("m_x") * F.col("words")).over(upto))
    fits = F.col("c") * F.col("m_x") < 1
    pick = lambda v: F.max_by(v, F.when(fits, F.col("m_x")))
    none = F.count(F.when(fits, 1)) == 0
    fit = classes.groupBy(F.col("m_source").alias("g_source")).agg(
        F.when(none, 0.0).otherwise(pick("c")).alias("m_c"),
        F.when(none, 0.0).otherwise(pick("m_x")).alias("m_top"),
        F.when(none, F.sum("words")).otherwise(pick("above")).alias("m_sure"),
    )
    return targets.join(fit, targets["m_source"].eqNullSafe(fit["g_source"]), "left").drop("g_source").fillna(0, ["m_c", "m_top", "m_sure"])


def ranked(d: DataFrame) -> DataFrame:
    p = F.least(F.greatest(F.col("m_c") * F.col("m_x"), F.lit(1e-12)), F.lit(1 - 1e-12))
    rank = (F.col("m_u") / (1 - F.col("m_u"))) / (p / (1 - p))
    binned = F.floor(rank / (1 + rank) * F.lit(float(BINS * BINS))).cast("long")
    return d.withColumn("m_certain", F.col("m_x") > F.col("m_top")).withColumn("m_rank", rank).withColumn("m_bin", F.least(binned, F.lit(BINS * BINS - 1)))


def cut_bin(rows: DataFrame, key) -> DataFrame:
    """(c_source, c_bin, c_left): for each source the bin (key) in which its words reach m_left, and what is left for that bin."""
    bins = rows.groupBy("m_source", key.alias("bin")).agg(F.sum("m_size").alias("words"), F.first("m_left").alias("m_left"))
    upto = W.partitionBy("m_source").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = bins.withColumn("upto", F.sum("words").over(upto))
    bins = bins.filter((F.col("upto") >= F.col("m_left")) & (F.col("upto") - F.col("words") < F.col("m_left")))
    return bins.select(F.col("m_source").alias("c_source"), F.col("bin").alias("c_bin"), (F.col("m_left") - F.col("upto") + F.col("words")).alias("c_left"))


def with_targets(d: DataFrame, t: DataFrame) -> DataFrame:
    # A source may hold a third of all rows: its row of targets is copied SALTS times, and its documents spread over the copies.
    t = t.withColumnRenamed("m_source", "t_source").withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = d.withColumn("m_salt", F.pmod(F.xxhash64("doc_id", "m_h"), F.lit(SALTS)).cast("int"))
    return d.join(t, d["m_source"].eqNullSafe(t["t_source"]) & (d["m_salt"] == t["t_salt"]), "left").drop("t_source", "t_salt", "m_salt")


def planned(light: DataFrame, share: float, cap: float, weights: tuple[float, ...]) -> DataFrame:
    """One row for each source: its target, whole copies, and where the sample ends (c_bin, l_key).

    Each step's row a source is written, as the steps after it read it several times:
    one plan of them all would hold each step as often as it is read.
    """
    sizes = light.groupBy("m_source").agg(F.sum("m_size").alias("source_size"))
    targets = source_targets(sizes, share, cap, weights)
    targets = targets.withColumn("m_m", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    targets = targets.withColumn("m_whole", F.floor("m_m").cast("long"))
    targets = targets.withColumn("m_rest", F.col("target") - F.col("m_whole") * F.col("source_size"))
    targets = materialize(odds(light, materialize(targets)).withColumn("m_left", F.col("m_rest") - F.col("m_sure")))
    drawn = ranked(with_targets(light, targets)).filter(~F.col("m_certain") & (F.col("m_size") > 0))
    wide = F.floor(F.col("m_bin") / BINS).cast("long")
    first = materialize(cut_bin(drawn, wide))
    inside = drawn.withColumn("m_wide", wide).join(first, F.col("m_source").eqNullSafe(F.col("c_source")) & (F.col("m_wide") == F.col("c_bin")))
    inside = inside.withColumn("m_left", F.col("c_left")).drop("c_source", "c_bin", "c_left", "m_wide")
    cut = materialize(cut_bin(inside, F.col("m_bin")))
    edge = inside.join(cut, inside["m_source"].eqNullSafe(cut["c_source"]) & (F.col("m_bin") == F.col("c_bin")))
    order = [F.col("m_rank"), F.col("doc_id"), F.col("m_size"), F.col("m_h")]
    run = F.sum("m_size").over(W.partitionBy("c_source").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    edge = edge.withColumn("before", F.coalesce(run, F.lit(0)))
    # The last document taken is the last that brings the words nearer to the target.
    edge = edge.filter(2 * (F.col("c_left") - F.col("before")) >= F.col("m_size")).filter(F.col("before") < F.col("c_left"))
    last = edge.groupBy(F.col("c_source").alias("l_source")).agg(F.max(F.struct("m_rank", "doc_id", "m_size", "m_h")).alias("l_key"))
    plan = targets.join(cut, targets["m_source"].eqNullSafe(cut["c_source"]), "left").drop("c_source")
    return materialize(plan.join(last, plan["m_source"].eqNullSafe(last["l_source"]), "left").drop("l_source"))


def applied(table: DataFrame, plan: DataFrame, keep: list) -> DataFrame:
    """The columns `keep` and those of ADDED, for a table of `measured`."""
    out = ranked(with_targets(table, plan))
    key = F.struct("m_rank", "doc_id", "m_size", "m_h")
    taken = F.when(F.col("m_certain"), True).when(F.col("c_bin").isNull(), False).when(F.col("m_bin") < F.col("c_bin"), True)
    taken = taken.when(F.col("m_bin") > F.col("c_bin"), False).otherwise(F.coalesce(key <= F.col("l_key"), F.lit(False)))
    copies = F.when(F.col("m_size") == 0, 0).otherwise(F.coalesce(F.col("m_whole"), F.lit(0)) + taken.cast("long")).cast("long")
    out = out.withColumn("m_copies", copies)
    return out.select(*keep, "m_size", F.coalesce("source_size", F.lit(0)).cast("long").alias("m_source_size"), F.col("target").alias("m_target"), "m_copies", (F.col("m_copies") * F.col("m_size")).alias("m_taken"))


def pareto_mix(docs: DataFrame, seed: str = "mix", share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, weight_col: str | None = None) -> DataFrame:
    """docs plus m_size, m_source_size, m_target, m_copies (whole copies taken) and m_taken (words taken); a name that docs has already gets underscores added.

    Sizes are counted once and written; only the last step reads the texts again.
    """
    rows = measured(docs, seed, weight_col)
    plan = planned(materialize(rows.drop("d")), share, cap, weights)
    out = applied(rows, plan, ["d"])
    return out.select(*unpacked(docs.columns), *[F.col(n).alias(new) for n, new in zip(ADDED, fresh(ADDED, docs.columns))])


def mix_report(docs: DataFrame, seed: str = "mix", share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    light = materialize(measured(docs, seed, None).drop("d"))
    out = applied(light, planned(light, share, cap, weights), ["doc_id"])
    return out.select(F.col("doc_id").cast("long"), F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"), F.col("m_target").alias("target"), F.col("m_taken").alias("taken"))
