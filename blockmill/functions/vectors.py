"""Vectors as arrays of doubles, and the forms pyspark.ml wants."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "array_to_vector",
    "euclidean_distance",
    "features_of",
    "label_of",
    "majority",
    "vector_to_array",
]


def euclidean_distance(a: Column, b: Column) -> Column:
    """Root of the summed squared differences, position by position."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def _numbers(text: Column) -> Column:
    return F.split(F.trim(text), ",")


def label_of(text: Column) -> Column:
    """The last number of a comma-separated line."""
    return F.element_at(_numbers(text), -1).cast("double").cast("int")


def features_of(text: Column) -> Column:
    """All numbers of a comma-separated line but the last, as an array."""
    numbers = _numbers(text)
    return F.slice(numbers, 1, F.size(numbers) - 1).cast("array<double>")


def majority(labels: Column) -> Column:
    """Most frequent value of an array of numbers, the lowest one on a tie."""
    votes = F.transform(
        F.array_distinct(labels),
        lambda x: F.struct(
            F.size(F.filter(labels, lambda y: y == x)).alias("n"), (-x).alias("negated")
        ),
    )
    return -F.array_max(votes).getField("negated")
