"""Arithmetic on array columns, in Spark's own higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: str | Column, right: str | Column) -> Column:
    """Dot product of two arrays of numbers of one length."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
