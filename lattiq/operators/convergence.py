"""Monitoring an iterative layout: displacements, their moving averages and the points where they settle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.functions.rng import sample_ids


def watched(layout: DataFrame, seed: int = 41) -> DataFrame:
    """The ids whose displacement is watched: the square root of nine times their number."""
    return sample_ids(layout.select("id"), "id", int(math.sqrt(9 * layout.count())), seed)


def displacement(before: DataFrame, after: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row: the sum of how far positions moved."""
    both = before.select("id", F.col("x").alias("x0"), F.col("y").alias("y0")).join(after, "id")
    both = both if ids is None else both.join(ids, "id", "left_semi")
    return both.agg(F.sum(F.sqrt((F.col("x") - F.col("x0")) ** 2 + (F.col("y") - F.col("y0")) ** 2)).alias("moved"))


def moving_average(series: DataFrame, order: str, value: str, by: list[str] | None = None, width: int = 5) -> DataFrame:
    """Adds ``average`` over the last ``width`` values, ``ratio`` to the average before, and ``settled``: 0.96 < ratio < 0.99.

    A series is one row a step of an iteration (for each of ``by``), so one task can hold it."""
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order)
    average: Column = F.avg(value).over(window.rowsBetween(1 - width, 0))
    out = series.withColumn("average", average).withColumn("_before", F.lag("average").over(window))
    ratio = F.when(F.col("_before") != 0, F.col("average") / F.col("_before"))
    return out.withColumn("ratio", ratio).withColumn("settled", F.coalesce((F.col("ratio") > 0.96) & (F.col("ratio") < 0.99), F.lit(False))).drop("_before")


def running(series: DataFrame, order: str, gain: str) -> DataFrame:
    """Adds ``total``: the sum of gains up to each step."""
    return series.withColumn("total", F.sum(gain).over(Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
