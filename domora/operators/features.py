"""Model features as column expressions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domora.functions import config as C
from domora.functions.geo import floor_days, haversine
from domora.functions.text import text_flags


@dataclass(frozen=True)
class FeatureContext:
    reference_date: str
    centre: tuple[float, float] = C.CENTRE
    schema_version: int = 3

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"features": C.MODEL_FEATURES})

    @staticmethod
    def fit(train: DataFrame) -> FeatureContext:
        last = train.agg(F.max("listing_date")).first()[0]
        return FeatureContext((last or datetime(1970, 1, 1)).strftime("%Y-%m-%d %H:%M:%S"))


def _known(c: str, text: bool) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != C.UNKNOWN_VALUE) if text else F.col(c).isNotNull()


def completeness() -> Column:
    """Percent of the quality columns that are known, one digit, half to even."""
    share = sum((F.coalesce(_known(c, c in ("direction", "position")), F.lit(False)).cast("int") for c in C.QUALITY_COLUMNS), F.lit(0)) / len(C.QUALITY_COLUMNS)
    return F.rint(share * 100 * 10) / 10


def missing_flags() -> dict[str, Column]:
    out = {"gps_missing": (F.col("latitude").isNull() | F.col("longitude").isNull()).cast("int")}
    return out | {f"{c}_missing": F.col(c).isNull().cast("int") for c in ("width", "length", "bedrooms", "bathrooms", "floors", "road_type", "alley_width")}


def days_from(reference: Column, day: Column) -> Column:
    return F.coalesce(floor_days(day, reference), F.lit(0))


def distance_to_centre(centre: tuple[float, float] = C.CENTRE) -> Column:
    return haversine(F.col("latitude"), F.col("longitude"), F.lit(centre[0]), F.lit(centre[1]))


def feature_frame(rows: DataFrame, context: FeatureContext, as_of: str | None = None, keep: list[str] = ()) -> DataFrame:
    """The kept columns and the model features in order; absent columns are null, absent flags 0.

    as_of: a date column that replaces listing_date for the whole frame.
    """
    plain = C.NUMERIC_FEATURES[:9] + C.CATEGORICAL_FEATURES + ["title", "description", "road_type", "listing_date"]
    kinds = dict.fromkeys(C.CATEGORICAL_FEATURES + ["title", "description", "road_type"], "string") | {"listing_date": "timestamp"}
    full = rows.withColumns({c: F.lit(None).cast(kinds.get(c, "double")) for c in plain if c not in rows.columns})
    supplied = {f: F.col(f) for f in C.FLAG_FEATURES if f in rows.columns}
    found = text_flags(F.col("title"), F.col("description"), supplied) | missing_flags()
    found["input_completeness_score"] = completeness()
    found["days_from_train_reference"] = days_from(F.lit(context.reference_date).cast("timestamp"), F.col(as_of or "listing_date"))
    found["distance_to_cbd_km"] = distance_to_centre(context.centre)
    cols = [found.get(c, F.col(c)) for c in C.MODEL_FEATURES]
    clean = [F.when(F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")), None).otherwise(c) if n in C.NUMERIC_FEATURES else c for n, c in zip(C.MODEL_FEATURES, cols, strict=True)]
    return full.select(*keep, *(c.alias(n) for n, c in zip(C.MODEL_FEATURES, clean, strict=True)))
