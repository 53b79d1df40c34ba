"""Regression and interval metrics, whole and by slice, and split-conformal quantiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domora.functions.numeric import bins
from domora.operators import sketches
from domora.operators.ranks import beside, medians, quantiles
from domora.session import materialise

SLICES = {
    "price": ([0.0, 5000.0, 10000.0, 15000.0, float("inf")], ["<5000", "5000-10000", "10000-15000", ">15000"]),
    "completeness": ([0.0, 60.0, 80.0, 100.1], ["<60", "60-80", ">=80"]),
    "cbd": ([0.0, 5.0, 10.0, float("inf")], ["<5", "5-10", ">10"]),
}


def _middle(rows: DataFrame, keys: list[str], wanted: dict[str, Column], approximate: bool) -> DataFrame:
    """Medians by name: exact by selection, or from quantile sketches in one pass."""
    return sketches.medians(sketches.sketched(rows, keys, wanted), keys, list(wanted)) if approximate else medians(rows, keys, wanted)


def regression_metrics(rows: DataFrame, actual: str = "price", predicted: str = "prediction", approximate: bool = False) -> DataFrame:
    """One row of errors. approximate: the median comes from a sketch, within sketches.RANK_ERROR of its rank."""
    y, p = F.col(actual), F.col(predicted)
    held = materialise(rows.where(y.isNotNull() & p.isNotNull()).select(y.cast("double").alias("y"), p.cast("double").alias("p"), F.lit(1).alias("_all")))
    y, p = F.col("y"), F.col("p")
    e = F.abs(y - p)
    one = held.agg(
        F.count("*").alias("n"),
        F.round(F.avg(e), 4).alias("mae"),
        F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"),
        F.round(1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count("*")), 6).alias("r2"),
        F.round(F.avg(e / F.greatest(F.abs(y), F.lit(1.0))) * 100, 2).alias("mape"),
        F.round(F.try_divide(F.sum(e), F.sum(F.abs(y))) * 100, 2).alias("wape"),
        F.round(F.avg(2 * e / F.greatest(F.abs(y) + F.abs(p), F.lit(1.0))) * 100, 2).alias("smape"),
    )
    out = beside(one.withColumn("_all", F.lit(1)), _middle(held, ["_all"], {"m": e}, approximate), ["_all"])
    return out.select("n", "mae", F.round("m", 4).alias("median_ae"), "rmse", "r2", "mape", "wape", "smape")


def interval_metrics(rows: DataFrame, coverage: float, actual: str = "price", lower: str = "lower", upper: str = "upper", approximate: bool = False) -> DataFrame:
    held = materialise(rows.select(F.col(actual).alias("y"), F.col(lower).alias("lo"), F.col(upper).alias("hi"), F.lit(1).alias("_all")))
    y, lo, hi = F.col("y"), F.col("lo"), F.col("hi")
    hit = F.avg(y.between(lo, hi).cast("int"))
    one = held.agg(
        F.round(hit, 6).alias("coverage"), F.round(hit - coverage, 6).alias("coverage_gap"), F.round(F.avg(hi - lo), 4).alias("mean_width"),
        F.round(F.try_divide(F.avg(hi - lo), F.avg(y)) * 100, 4).alias("relative_width"),
    )
    out = beside(one.withColumn("_all", F.lit(1)), _middle(held, ["_all"], {"m": hi - lo}, approximate), ["_all"])
    return out.select("coverage", "coverage_gap", "mean_width", F.round("m", 4).alias("median_width"), "relative_width")


def sliced(rows: DataFrame, coverage_columns: tuple[str, str] = ("lower", "upper")) -> DataFrame:
    """dimension, value, and the row's price, prediction and interval, once for each of five dimensions."""
    dims: dict[str, Column] = {"property_type": F.col("property_type"), "location_area": F.col("location_area")}
    for name, column in (("price", "price"), ("completeness", "input_completeness_score"), ("cbd", "distance_to_cbd_km")):
        dims[name] = bins(F.col(column), *SLICES[name])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), c.alias("value")) for n, c in dims.items()]))
    return rows.select("price", "prediction", *coverage_columns, each.alias("d")).where("d.value is not null").select("d.dimension", "d.value", "price", "prediction", *coverage_columns)


def slice_metrics(rows: DataFrame, coverage_columns: tuple[str, str] = ("lower", "upper"), approximate: bool = False) -> DataFrame:
    """dimension, value and metrics over five dimensions; bins without rows are listed with 0."""
    keys = ["dimension", "value"]
    e, w = F.abs(F.col("price") - F.col("prediction")), F.col(coverage_columns[1]) - F.col(coverage_columns[0])
    long = materialise(sliced(rows, coverage_columns))
    found = long.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg(e), 4).alias("mae"), F.round(F.try_divide(F.sum(e), F.sum(F.abs("price"))) * 100, 2).alias("wape"),
        F.round(F.avg(F.col("price").between(*map(F.col, coverage_columns)).cast("int")) * 100, 4).alias("coverage_percent"), F.round(F.avg(w), 4).alias("mean_width"),
    )
    middle = _middle(long, keys, {"e": e, "w": w, "r": w / F.greatest("price", F.lit(100.0))}, approximate)
    found = beside(found, middle, keys).select(
        *keys, "n", "mae", F.round("e", 4).alias("median_ae"), "wape", "coverage_percent", "mean_width", F.round("w", 4).alias("median_width"), F.round(F.col("r") * 100, 4).alias("median_relative_width"),
    )
    labels = [(n, x) for n, (_, names) in SLICES.items() for x in names]
    listed = rows.sparkSession.sql("select * from values " + ", ".join(f"('{d}', '{v}')" for d, v in labels) + " as t(dimension, value)")
    empty = listed.join(found.select(*keys), keys, "left_anti").select(*keys, F.lit(0).cast("long").alias("n"))
    return found.unionByName(empty, allowMissingColumns=True)


def conformal_rank(n: int, coverage: float) -> int:
    """ceil((n + 1) coverage), or ValueError where no residual has that rank."""
    if not 0 < coverage < 1:
        raise ValueError("coverage must lie between 0 and 1")
    rank = math.ceil((n + 1) * coverage)
    if n < 1 or rank > n:
        raise ValueError(f"{n} residuals are too few for coverage {coverage}")
    return rank


def conformal_quantile(rows: DataFrame, residual: str = "residual", coverage: float = 0.8) -> DataFrame:
    """One row: n, rank, quantile (the residual of that rank), mean and median residual."""
    held = materialise(rows.select(F.col(residual).cast("double").alias("r"), F.lit(1).alias("_all")))
    bad = F.col("r").isNull() | F.isnan("r") | (F.col("r") < 0) | (F.col("r") == float("inf"))
    check = held.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).first()
    if check["bad"]:
        raise ValueError(f"{check['bad']} residuals are negative or not finite")
    rank = conformal_rank(check["n"], coverage)
    at = quantiles(held, ["_all"], {"q": (F.col("r"), [(rank - 0.5) / check["n"]])}, between=False)
    one = held.agg(F.lit(check["n"]).cast("long").alias("n"), F.lit(rank).alias("rank"), F.avg("r").alias("mean_residual")).withColumn("_all", F.lit(1))
    out = beside(beside(one, at, ["_all"]), medians(held, ["_all"], {"m": F.col("r")}), ["_all"])
    return out.select("n", "rank", F.col("q")[0].alias("quantile"), "mean_residual", F.col("m").alias("median_residual"))


def log_intervals(rows: DataFrame, quantile: float, predicted: str = "prediction") -> DataFrame:
    """lower and upper from a quantile in log space; asymmetric in price."""
    p = F.log1p(predicted)
    return rows.withColumns({"lower": F.greatest(F.expm1(p - quantile), F.lit(0.0)), "upper": F.expm1(p + quantile)})
