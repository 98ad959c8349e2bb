"""Joins on overlapping intervals: an equi-join on the bands that an interval covers, each pair from one band only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_bands(df: DataFrame, low: Column, high: Column, step: int, name: str = "band") -> DataFrame:
    """A row for each band of `step` that [low, high) touches; rows with an empty interval are in the band of low."""
    first = F.floor(low / step)
    last = F.greatest(F.floor((high - 1) / step), first)
    return df.withColumn(name, F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], step: int = 64, how: str = "inner") -> DataFrame:
    """Pairs of rows with equal keys whose intervals [a0, a1) and [b0, b1) overlap, each pair once.

    Column names of the sides must differ but for the keys. A pair that shares several bands is kept in its first one
    only, so that nothing has to be made distinct.
    """
    one = with_bands(left, F.col(a[0]), F.col(a[1]), step)
    two = with_bands(right, F.col(b[0]), F.col(b[1]), step)
    meets = (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1]))
    first = F.col("band") == F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / step)
    return one.join(two, [*keys, "band"], how).where(meets & first).drop("band")
