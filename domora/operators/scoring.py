"""Batch scoring of requests: validation, intervals, warnings, comparables, one nested row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domora.functions import config as C
from domora.functions.geo import floor_days
from domora.operators import comparables, metrics

STALE_DAYS, WIDE_INTERVAL, LEAST_COMPLETENESS = 180, 0.8, 60


def dated(requests: DataFrame) -> DataFrame:
    """as_of as a timestamp and bad_as_of; a request without a date is of today in the city, text that is no date is bad."""
    c = F.col("as_of")
    given = F.try_to_timestamp(c) if dict(requests.dtypes)["as_of"] == "string" else c.cast("timestamp")
    today = F.expr("cast(to_date(convert_timezone(current_timezone(), 'Asia/Ho_Chi_Minh', cast(now() as timestamp_ntz))) as timestamp)")
    return requests.withColumns({"bad_as_of": c.isNotNull() & given.isNull(), "as_of": F.when(c.isNull(), today).otherwise(given)})


def rejections(requests: DataFrame, types: list[str], areas: list[str]) -> DataFrame:
    """requests with reasons (why a request is not scored; empty if it is) and as_of as a timestamp."""
    checks = [
        F.when(F.col("property_type").isNull() | ~F.col("property_type").isin(types), "unsupported_property_type"),
        F.when(F.col("location_area").isNull() | ~F.col("location_area").isin(areas), "unsupported_area"),
        F.when(F.col("area").isNull() | F.isnan("area") | ~F.col("area").between(*C.AREA_RANGE), "area_out_of_range"),
        F.when(F.col("bad_as_of"), "bad_as_of"),
    ]
    for c, (lo, hi) in C.OPTIONAL_RANGES.items():
        strict = F.col(c) <= 0 if c in ("width", "length") else F.lit(False)
        checks.append(F.when(F.isnan(c) | (~F.col(c).between(0 if c in ("width", "length") else lo, hi)) | strict, f"{c}_out_of_range"))
    return dated(requests).withColumn("reasons", F.array_compact(F.array(*checks))).drop("bad_as_of")


def rejected(requests: DataFrame, types: list[str], areas: list[str]) -> DataFrame:
    """query_id, as_of as it was asked and reasons of every request that `score` leaves out."""
    asked = requests.withColumn("asked_as_of", F.col("as_of").cast("string"))
    return rejections(asked, types, areas).where(F.size("reasons") > 0).select("query_id", F.col("asked_as_of").alias("as_of"), "reasons")


def rejection_reasons(requests: DataFrame, types: list[str], areas: list[str]) -> DataFrame:
    """query_id, place (from 0) and reason of every reason of `rejected`.

    Reasons are laid out with a row for those without one, which goes afterwards: a condition on the list of reasons
    would move below the columns it is made of, and these, addresses too, would be worked out twice.
    """
    found = rejections(requests, types, areas).select("query_id", F.posexplode_outer("reasons").alias("place", "reason"))
    return found.where("reason is not null")


def missing_fields() -> Column:
    """Quality columns that are null, blank or unknown."""
    out = []
    for c in C.QUALITY_COLUMNS:
        gone = F.col(c).isNull()
        if c in ("direction", "position"):
            gone = gone | (F.col(c) == C.UNKNOWN_VALUE) | (F.trim(c) == "")
        out.append(F.when(gone, c))
    return F.array_compact(F.array(*out))


def warnings(ranges: dict[str, tuple[float, float]], reference_date: str, as_of: str = "as_of", price: str = "prediction") -> Column:
    """Codes of what makes a prediction doubtful, in a fixed order."""
    out = [F.when(~F.col(f).cast("double").between(lo, hi), F.concat(F.lit(f"INPUT_OUTSIDE_TRAINING_RANGE: {f}="), F.round(F.col(f).cast("double"), 2).cast("decimal(20,2)").cast("string"))) for f, (lo, hi) in ranges.items()]
    out.append(F.when(F.col("latitude").isNull() | F.col("longitude").isNull(), "MISSING_GPS"))
    out.append(F.when(F.col("input_completeness_score") < LEAST_COMPLETENESS, "MISSING_INPUTS"))
    age = floor_days(F.col(as_of), F.lit(reference_date).cast("timestamp"))
    out.append(F.when(age > STALE_DAYS, F.concat(F.lit("STALE_MARKET_REFERENCE: "), age.cast("string"))))
    out.append(F.when((F.col("upper") - F.col("lower")) / F.greatest(F.col(price), F.lit(1.0)) > WIDE_INTERVAL, "WIDE_PREDICTION_INTERVAL"))
    return F.array_compact(F.array(*out))


# Display labels of features.
FRIENDLY = {
    "area": "Diện tích đất (Area)", "bedrooms": "Số phòng ngủ", "bathrooms": "Số phòng vệ sinh", "floors": "Số tầng", "width": "Chiều rộng mặt tiền", "length": "Chiều dài",
    "alley_width": "Độ rộng hẻm", "distance_to_cbd_km": "Khoảng cách tới Quận 1 (CBD)", "days_from_train_reference": "Thời gian đăng tin", "input_completeness_score": "Độ đầy đủ thông tin",
    "has_furniture": "Nội thất", "car_alley": "Hẻm xe hơi", "near_market": "Gần chợ", "near_school": "Gần trường học", "is_urgent_sale": "Cần bán gấp",
}
_GROUPS = {"property_type=": "Loại hình: ", "location_area=": "Khu vực: ", "direction=": "Hướng nhà: ", "position=": "Vị trí: "}


def friendly_name(feature: Column) -> Column:
    """Display label of a model feature."""
    out = None
    for k, v in FRIENDLY.items():
        out = F.when(feature == k, v) if out is None else out.when(feature == k, v)
    for k, v in _GROUPS.items():
        out = out.when(feature.startswith(k), F.concat(F.lit(v), F.substr(feature, F.lit(len(k) + 1))))
    return out.otherwise(feature)


def score(requests: DataFrame, model, quantile: float, references: DataFrame, ranges: dict[str, tuple[float, float]], types: list[str], areas: list[str], n: int = 4) -> DataFrame:
    """query_id, rounded price and interval, warnings, missing fields, comparables; `rejected` has the requests that are left out.

    A price is that of the day the request asks for, as the comparables are, not of its listing's day.
    """
    good = rejections(requests, types, areas).where(F.size("reasons") == 0)
    scored = metrics.log_intervals(model.predict(good, ["query_id", "as_of"], "as_of"), quantile)
    out = scored.withColumn("warnings", warnings(ranges, model.context.reference_date)).withColumn("missing_fields", missing_fields())
    met = comparables.find(good.drop("property_group_id", "distance_to_cbd_km"), references, n)
    by = met.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ref_id", "similarity", "price", "unit_price"))).alias("comparables"))
    full = out.join(by, "query_id", "left").join(comparables.summary(met).drop("n"), "query_id", "left")
    interval = F.struct(F.round("lower", 1).alias("lower_million"), F.round("upper", 1).alias("upper_million"), F.lit(C.COVERAGE).alias("coverage"))
    against = F.round(F.try_divide(F.col("prediction") - F.col("median_price"), F.col("median_price")) * 100, 1)
    return full.select(
        "query_id", F.round("prediction", 1).alias("predicted_price_million"), interval.alias("prediction_interval"), "warnings", "missing_fields", "comparables", "median_price",
        F.round(F.col("prediction") / F.greatest("area", F.lit(1.0)), 1).alias("unit_price"), against.alias("percent_above_comparables"),
    )
