"""Group-isolated temporal split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domora.functions import config as C
from domora.operators.ranks import with_rank

NAMES = ("train", "validation", "calibration", "test")


def cut_points(n: int, shares: tuple[float, ...] = C.SPLIT_SHARES) -> list[int]:
    """Ranks at which the next part starts; every part gets one group at least."""
    if n < 7:
        raise ValueError(f"{n} groups are too few to split")
    if len(shares) != 4 or any(s <= 0 for s in shares) or abs(sum(shares) - 1) > 1e-9:
        raise ValueError("shares must be four positive numbers that sum to 1")
    cuts = [int(n * shares[0]), int(n * (shares[0] + shares[1])), int(n * (shares[0] + shares[1] + shares[2]))]
    cuts[0] = max(1, min(cuts[0], n - 3))
    cuts[1] = max(cuts[0] + 1, min(cuts[1], n - 2))
    cuts[2] = max(cuts[1] + 1, min(cuts[2], n - 1))
    return cuts


def group_splits(rows: DataFrame, group: str = "property_group_id", date: str = "listing_date", shares: tuple[float, ...] = C.SPLIT_SHARES) -> DataFrame:
    """group, latest, split: groups ordered by latest date, then by name; rows without a date are out.

    Groups are dealt out by ranges of that order, and a rank is the place in the range and the groups of earlier
    ranges, so that no task orders all groups.
    """
    missing = {group, date} - set(rows.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    latest = rows.where(F.col(date).isNotNull()).groupBy(group).agg(F.max(date).alias("latest"))
    ranked = with_rank(latest, [F.asc("latest"), F.asc(group)], "_rank")
    cuts = cut_points(ranked.count(), shares)
    part = F.when(F.col("_rank") <= cuts[0], NAMES[0]).when(F.col("_rank") <= cuts[1], NAMES[1]).when(F.col("_rank") <= cuts[2], NAMES[2]).otherwise(NAMES[3])
    return ranked.select(group, "latest", part.alias("split"))


def with_split(rows: DataFrame, group: str = "property_group_id", date: str = "listing_date") -> DataFrame:
    """Dated rows with the split of their group."""
    return rows.where(F.col(date).isNotNull()).join(group_splits(rows, group, date).select(group, "split"), group)


def summary(split: DataFrame, group: str = "property_group_id", date: str = "listing_date") -> DataFrame:
    return split.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct(group).alias("n_groups"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
