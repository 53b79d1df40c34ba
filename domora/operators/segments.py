"""Baselines and profile aggregates: medians by segment, percentiles, missing rates, comparable context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domora.operators import sketches
from domora.operators.joins import looked_up
from domora.operators.ranks import beside, medians, quantiles

SEGMENT = ["property_type", "location_area"]


def naive_median(train: DataFrame, target: str = "price", approximate: bool = False) -> DataFrame:
    """One row: global_median (null without a value)."""
    return _middle(train.withColumn("_all", F.lit(1)), ["_all"], {"global_median": F.col(target)}, approximate).select("global_median").unionByName(
        train.sparkSession.createDataFrame([(None,)], "global_median double")
    ).agg(F.max("global_median").alias("global_median"))


def _middle(rows: DataFrame, keys: list[str], wanted: dict[str, Column], approximate: bool) -> DataFrame:
    return sketches.medians(sketches.sketched(rows, keys, wanted), keys, list(wanted)) if approximate else medians(rows, keys, wanted)


def segment_medians(train: DataFrame, target: str | Column = "price", approximate: bool = False) -> DataFrame:
    """Median by type and district; approximate: from quantile sketches, in one pass."""
    value = F.col(target) if isinstance(target, str) else target
    counts = train.groupBy(*SEGMENT).agg(F.count(value).alias("n"))
    return beside(counts, _middle(train, SEGMENT, {"segment_median": value}, approximate), SEGMENT).select(*SEGMENT, "segment_median", "n")


def segment_unit_prices(train: DataFrame) -> DataFrame:
    return segment_medians(train, F.try_divide(F.col("price"), F.col("area"))).withColumnRenamed("segment_median", "unit_price_median")


def predict_segment(rows: DataFrame, train: DataFrame) -> DataFrame:
    """rows with prediction: the segment's median, else the global one."""
    seg = segment_medians(train).drop("n")
    # the global median is one row
    return looked_up(rows, seg, SEGMENT).crossJoin(F.broadcast(naive_median(train))).withColumn("prediction", F.coalesce("segment_median", "global_median")).drop("segment_median")


def percentiles(rows: DataFrame, columns: tuple[str, ...] = ("price", "area"), at: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """column and its exact quantiles as p10 and so on; a column without values has nulls."""
    found = quantiles(rows.withColumn("_all", F.lit(1)), ["_all"], {c: (F.col(c), list(at)) for c in columns})
    long = found.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns])).alias("x"))
    return long.select("x.column", *[F.round(F.col("x.v")[i], 1).alias(f"p{round(p * 100)}") for i, p in enumerate(at)])


def missing_rates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Percent of nulls of each column, in one aggregate."""
    found = rows.agg(*[F.round(F.avg(F.col(c).isNull().cast("int")) * 100, 2).alias(c) for c in columns])
    return found.unpivot([], columns, "column", "missing_percent")


def comparable_context(train: DataFrame) -> DataFrame:
    """One row: scales, known types and districts, and rows by segment."""
    q = quantiles(train.withColumn("_all", F.lit(1)), ["_all"], {"q": (F.col("area"), [0.25, 0.5, 0.75])})
    cbd = "distance_to_cbd_km" in train.columns
    one = train.agg(
        F.round(F.coalesce(F.stddev_samp("distance_to_cbd_km") if cbd else F.lit(None).cast("double"), F.lit(8.0)), 1).alias("cbd_scale"),
        F.array_sort(F.collect_set("property_type")).alias("property_types"),
        F.array_sort(F.collect_set("location_area")).alias("location_areas"),
    ).withColumn("_all", F.lit(1))
    one = beside(one, q, ["_all"]).select(
        F.round(F.col("q")[1], 1).alias("median_area"), F.round(F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(15.0)), 1).alias("area_scale"), "cbd_scale", "property_types", "location_areas",
    )
    counts = train.groupBy(*SEGMENT).agg(F.count("*").alias("n"))
    pairs = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(" | ", *SEGMENT), "n")))).alias("segment_counts"))
    return one.crossJoin(pairs)


def training_ranges(train: DataFrame, columns: list[str]) -> DataFrame:
    """feature, lo, hi of each column that has a value."""
    found = train.agg(*[F.struct(F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi")).alias(c) for c in columns])
    long = found.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in columns])).alias("x"))
    return long.select("x.feature", "x.v.lo", "x.v.hi").where("lo is not null")
