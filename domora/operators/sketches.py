"""Approximate quantiles from mergeable sketches, which can be kept by slice and day and merged later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that a sketch keeps on each of its levels, and how far a quantile's rank is off, as a share of the values: for this size a single query errs by less with 99 %.
SIZE, RANK_ERROR = 1600, 0.005


def sketched(rows: DataFrame, keys: list[str], wanted: dict[str, Column]) -> DataFrame:
    """keys and, by name, a sketch of a value in each group (binary); null where a group has no value.

    Nulls, NaN and infinities are left out. A sketch has a few kilobytes, whatever the group.
    """
    fine = {n: F.when(F.abs(c.cast("double")) < float("inf"), c.cast("double")) for n, c in wanted.items()}
    return rows.groupBy(*keys).agg(*[F.when(F.count(c) > 0, F.kll_sketch_agg_double(c, SIZE)).alias(n) for n, c in fine.items()])


def merged(kept: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Sketches of finer groups (such as a slice's days), merged to the keys."""
    return kept.groupBy(*keys).agg(*[F.when(F.count(n) > 0, F.kll_merge_agg_double(F.col(n), SIZE)).alias(n) for n in names])


def medians(sketches: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys and the approximate median of each sketch, by name."""
    return at(sketches, keys, names, 0.5)


def at(sketches: DataFrame, keys: list[str], names: list[str], share: float) -> DataFrame:
    """keys and an approximate quantile of each sketch, by name."""
    return sketches.select(*keys, *[F.kll_sketch_get_quantile_double(F.col(n), F.lit(share)).alias(n) for n in names])
