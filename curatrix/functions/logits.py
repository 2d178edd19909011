"""Expressions on arrays of logits and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OOD = "拒识（OOD）"


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def softmax(z: Column) -> Column:
    top = F.array_max(z)
    return F.transform(z, lambda x: F.exp(x - top) / F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def argmax(z: Column) -> Column:
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def energy(z: Column, temperature: float = 1.0) -> Column:
    """-T * log sum exp(z / T)."""
    t = F.lit(float(temperature))
    top = F.array_max(z) / t
    return -t * (top + F.ln(F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v / t - top))))


def energy_decision(e: Column, label: Column, low: float, high: float) -> tuple[Column, Column]:
    """(label, confidence): above high out of distribution, below low certain, else medium."""
    return F.when(e > high, OOD).otherwise(label), F.when(e > high, "low").when(e < low, "high").otherwise("medium")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def square_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column) -> Column:
    """The vector over its length; zero vectors stay."""
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))
