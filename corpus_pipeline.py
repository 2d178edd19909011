"""Corpus pipeline: five stages over documents, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. Null and empty texts, repeated rows and empty tables pass through every
stage as its operator states. Further columns of docs are kept, whatever their
names and types; a column that a stage adds gets underscores added where docs has
its name.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm import decontam, jaccard_join, mix_pareto, nbsvm, pii_crf
from curatrix.llm.common import fresh, materialize, read

#: A document goes if its toxicity score is at least this.
TOXIC = 0.7


def recast(x: Column, kind: T.DataType, back: bool) -> Column:
    """A value with its maps as arrays of entries, at any depth, or back again; Spark neither hashes nor compares maps."""
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(e["key"].alias("key"), recast(e["value"], kind.valueType, back).alias("value"))
        return F.map_from_entries(F.transform(x, entry)) if back else F.transform(F.map_entries(x), entry)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: recast(e, kind.elementType, back))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[recast(x.getField(f.name), f.dataType, back).alias(f.name) for f in kind.fields]))
    return x


def any_columns(stage: Callable) -> Callable:
    """The stage for docs of any columns: those whose names are no plain words or whose types hold maps pass through it under other names and types."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        maps = {f.name: f.dataType for f in docs.schema.fields if "map<" in f.dataType.simpleString()}
        odd = [c for c in docs.columns if c in maps or not re.fullmatch(r"\w+", c)]
        if not odd:
            return stage(spark, docs, sf_dir)
        names = dict(zip(odd, fresh([f"column_{i}" for i in range(len(odd))], docs.columns)))
        col = lambda c: F.col(f"`{c.replace('`', '``')}`")
        plain = docs.select(*[(recast(col(c), maps[c], False) if c in maps else col(c)).alias(names.get(c, c)) for c in docs.columns])
        out, real = stage(spark, plain, sf_dir), {v: k for k, v in names.items()}
        return out.select(*[(recast(F.col(c), maps[real[c]], True) if real.get(c) in maps else F.col(c)).alias(real.get(c, c)) for c in out.columns])

    return run


@any_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under TOXIC."""
    model = nbsvm.train(docs, read(spark, sf_dir, "labels"))
    (name,) = fresh(["toxicity_score"], docs.columns)
    return nbsvm.score(docs, model, name).filter(F.col(name) < TOXIC).select(*docs.columns)


@any_columns
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more)."""
    return jaccard_join.one_of_each(docs, k=5, num=80)


@any_columns
def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


@any_columns
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    return pii_crf.redact(docs)


@any_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies, taken and source_target: the number of copies, the words they give and the words of the source's target."""
    copies, taken, target = fresh(["copies", "taken", "source_target"], docs.columns)
    size, source_size, m_target, m_copies, m_taken = fresh(mix_pareto.ADDED, docs.columns)
    mixed = mix_pareto.pareto_mix(docs).filter(F.col(m_copies) > 0)
    return mixed.select(*docs.columns, F.col(m_copies).alias(copies), F.col(m_taken).alias(taken), F.col(m_target).alias(target))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaked),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

#: The classifier and the random field have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, one after the other."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
