"""Joins whose small side is counted before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domora.session import materialise

#: Rows of a table that may be broadcast, and shares that a hot key is dealt into where it may not.
BROADCAST_ROWS, SHARES = 100_000, 16


def looked_up_side(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """small, written once; to be broadcast if it has at most so many rows, else as it is."""
    small = materialise(small)
    return F.broadcast(small) if small.count() <= limit else small


def looked_up(rows: DataFrame, small: DataFrame, keys: list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows with the columns of small, a row for each of the keys at most; nulls where it has none.

    small is counted: up to the limit it is broadcast; beyond, both sides are shuffled by the keys and a share of
    each row's hash, with small repeated for every share, so that a hot key is spread over SHARES tasks.
    """
    small = materialise(small)
    if small.count() <= limit:
        return rows.join(F.broadcast(small), keys, "left")
    dealt = rows.withColumn("_share", F.pmod(F.xxhash64(*rows.columns), F.lit(SHARES)).cast("int"))
    spread = small.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return dealt.join(spread, [*keys, "_share"], "left").drop("_share")
