"""Reproducible uniform numbers by id and seed, in integer arithmetic that any SQL engine repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

M = 2147483647


def uniform(key: Column | str, seed: int) -> Column:
    """A number in [0, 1) for each integer key, however large."""
    key = F.col(key) if isinstance(key, str) else key
    first = F.pmod((F.pmod(key.cast("long"), F.lit(M)) + F.lit(seed * 7919 + 1)) * F.lit(48271), F.lit(M))
    return F.pmod(F.pmod(first * first, F.lit(M)) * F.lit(16807) + F.lit(seed), F.lit(M)) / F.lit(float(M))


def pair_key(a: Column | str, b: Column | str) -> Column:
    """One key of two integers that no pair of them overflows."""
    a, b = (F.pmod((F.col(x) if isinstance(x, str) else x).cast("long"), F.lit(M)) for x in (a, b))
    return a * F.lit(1000003) + b


def uniform_sql(key: str, seed: int) -> str:
    """The same as SQL text."""
    first = f"(((({key}) % {M} + {M}) % {M} + {seed * 7919 + 1}) * 48271) % {M}"
    return f"((((({first}) * ({first})) % {M}) * 16807 + {seed}) % {M}) / {float(M)}"


def sample_ids(df: DataFrame, id_column: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement: those first in the order of ``uniform``."""
    return df.orderBy(uniform(id_column, seed), id_column).limit(n)


def bernoulli(df: DataFrame, key: Column, fraction: Column | float, seed: int) -> DataFrame:
    return df.where(uniform(key, seed) < fraction)


def ordered_rank(id_column: str, seed: int) -> Column:
    return F.row_number().over(Window.orderBy(uniform(id_column, seed), id_column))
