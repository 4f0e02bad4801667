"""Distances between array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def mahalanobis(x: Column, centre: Column, variance: Column) -> Column:
    """Diagonal Mahalanobis distance; dimensions without variance are passed over."""
    terms = F.zip_with(F.zip_with(x, centre, lambda p, q: (p - q) * (p - q)), variance, lambda d, v: F.when(v != 0, d / v).otherwise(F.lit(0.0)))
    return F.sqrt(total(terms))
