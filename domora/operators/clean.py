"""Cleaning: scope, coercion, ranges, coordinates, dates, event ids and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domora.functions import config as C
from domora.functions.numeric import number, plain
from domora.functions.text import area_in, composed, normalised

NUMERIC = ["price", "area", *C.OPTIONAL_RANGES, "latitude", "longitude"]
DATE_FORMAT = "d/M/yyyy H:m"


def in_scope(df: DataFrame) -> DataFrame:
    return df.where(F.col("property_type").isin(C.RESIDENTIAL_TYPES))


def coerce(df: DataFrame) -> DataFrame:
    """The numeric columns as finite doubles; absent ones as nulls."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: number(F.col(c), kinds[c]) if c in kinds else F.lit(None).cast("double") for c in NUMERIC})


def _checks() -> list[Column]:
    """What a coerced row of a supported type has to meet, one condition for each item; nulls do not meet it."""
    unit = F.try_divide(F.col("price"), F.col("area"))
    price, area = (F.col(c) >= lo for c, (lo, _) in (("price", C.PRICE_RANGE), ("area", C.AREA_RANGE)))
    optional = [F.col(c).isNull() | F.col(c).between(lo, hi) for c, (lo, hi) in C.OPTIONAL_RANGES.items()]
    return [price, F.col("price") < C.PRICE_RANGE[1], area, F.col("area") < C.AREA_RANGE[1], unit >= C.MIN_UNIT_PRICE, *optional]


def reject_reason() -> Column:
    """Why a coerced row goes, else null."""
    good = F.lit(True)
    for c in _checks():
        good = good & c
    return F.when(~F.col("property_type").isin(C.RESIDENTIAL_TYPES) | F.col("property_type").isNull(), "unsupported_property_type").when(~F.coalesce(good, F.lit(False)), "numeric_or_price_outliers")


def accepted(rows: DataFrame) -> DataFrame:
    """The rows, coerced or not, without a reject_reason. Each condition is a filter of its own, which Spark moves to the table it reads, ahead of joins.

    Conditions look at plain values: ranges leave out what is not finite, and a value that is not finite is a missing
    one, so that no condition holds the whole coercion of its column.
    """
    kinds = dict(rows.dtypes)
    value = {c: plain(F.col(c), kinds[c]) if c in kinds else F.lit(None).cast("double") for c in ("price", "area", *C.OPTIONAL_RANGES)}
    price, area = value["price"], value["area"]
    rows = in_scope(rows).where(price >= C.PRICE_RANGE[0]).where(price < C.PRICE_RANGE[1]).where(area >= C.AREA_RANGE[0]).where(area < C.AREA_RANGE[1]).where(F.try_divide(price, area) >= C.MIN_UNIT_PRICE)
    for c, (lo, hi) in C.OPTIONAL_RANGES.items():
        outside = ((value[c] < lo) & (value[c] > float("-inf"))) | ((value[c] > hi) & (value[c] < float("inf")))
        rows = rows.where(~F.coalesce(outside, F.lit(False)))
    return rows


def valid_coordinates(df: DataFrame) -> DataFrame:
    """Both coordinates, or neither where one is missing or outside the city."""
    ok = F.coalesce(F.col("latitude").between(*C.LATITUDE_RANGE) & F.col("longitude").between(*C.LONGITUDE_RANGE), F.lit(False))
    return df.withColumns({c: F.when(ok, F.col(c)) for c in ("latitude", "longitude")})


def _timestamp(df: DataFrame, column: str) -> Column:
    c = F.col(column)
    return c.cast("timestamp") if dict(df.dtypes)[column] in ("timestamp", "timestamp_ntz", "date") else F.coalesce(F.try_to_timestamp(c, F.lit(DATE_FORMAT)), F.try_to_timestamp(c))


def dates(df: DataFrame) -> DataFrame:
    """listing_date, observed_at and where they come from; a date is never invented."""
    first = next((c for c in ("last_updated_date", "updated_at", "listing_date") if c in df.columns), None)
    proxy = next((c for c in ("scraped_at", "observed_at") if c in df.columns), None)
    own = _timestamp(df, first) if first else F.lit(None).cast("timestamp")
    seen = _timestamp(df, proxy) if proxy else F.lit(None).cast("timestamp")
    out = df.withColumns({"_own": own, "observed_at": seen})
    source = F.when(F.col("_own").isNotNull(), "listing_date").when(F.col("observed_at").isNotNull(), "scrape_time_proxy").otherwise("unknown")
    out = out.withColumns({"listing_date": F.coalesce("_own", "observed_at"), "listing_date_missing": F.col("_own").isNull().cast("int"), "date_source": source})
    status = F.when(F.col("date_source") == "listing_date", "known").when(F.col("date_source") == "scrape_time_proxy", "proxy").otherwise("unknown")
    return out.withColumn("temporal_status", status).drop("_own")


def sourced(raw: DataFrame) -> DataFrame:
    """source and listing_id: a source_id or source_listing_id column goes before them, absent ones are null."""
    out = {}
    for c, first in (("source", "source_id"), ("listing_id", "source_listing_id")):
        own = next((x for x in (first, c) if x in raw.columns), None)
        out[c] = F.col(own).cast("string") if own else F.lit(None).cast("string")
    return raw.withColumns(out).drop("source_id", "source_listing_id")


def with_composed(rows: DataFrame) -> DataFrame:
    """Addresses and sources in composed Unicode, so that equal ones are equal strings."""
    return rows.withColumns({c: composed(F.col(c)) for c in ("location", "source") if c in rows.columns})


def with_area(rows: DataFrame) -> DataFrame:
    """rows with location_area; the address is normalised once, in a projection of its own."""
    return rows.withColumn("_address", normalised(F.col("location"))).withColumn("location_area", area_in(F.col("_address"))).drop("_address")


def tagged(raw: DataFrame) -> DataFrame:
    """All rows with reject_reason, coerced numbers, district and dates, in one pass."""
    return _dressed(coerce(raw).withColumn("reject_reason", reject_reason()))


def _dressed(coerced: DataFrame) -> DataFrame:
    return dates(valid_coordinates(with_area(with_composed(sourced(coerced)))))


def valid(raw: DataFrame) -> DataFrame:
    """The rows of `tagged` without a reason; the others go before their texts are looked at."""
    return _dressed(coerce(accepted(raw)))


def funnel(raw: DataFrame) -> DataFrame:
    """Rows by stage and by reason, in one aggregate."""
    return tagged(raw).agg(
        F.count("*").alias("rows_raw"),
        F.count_if(F.col("reject_reason").isNull()).alias("rows_valid"),
        F.count_if(F.col("reject_reason") == "unsupported_property_type").alias("unsupported_property_type"),
        F.count_if(F.col("reject_reason") == "numeric_or_price_outliers").alias("numeric_or_price_outliers"),
        F.count_if(F.col("reject_reason").isNull() & (F.col("temporal_status") == "unknown")).alias("unknown_temporal_rows"),
    )


def event_id() -> Column:
    """source:listing id, or source:group:date:price where the listing has no id; a null source reads as "sample"."""
    own = F.nullif(F.trim("listing_id"), F.lit(""))
    fallback = F.concat_ws(":", "property_group_id", F.coalesce(F.date_format("listing_date", "yyyy-MM-dd HH:mm:ss"), F.lit("NaT")), F.col("price").cast("string"))
    return F.concat_ws(":", F.coalesce("source", F.lit("sample")), F.coalesce(own, fallback))


def fingerprinted(rows: DataFrame, order: str = "ingest_key") -> DataFrame:
    """rows with _h and _g, two hashes of all their columns that tell copies."""
    same = [c for c in rows.columns if c not in (order, "property_group_id", "identity_confidence", "possible_duplicate")]
    return rows.withColumns({"_h": F.xxhash64(*same), "_g": F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in reversed(same)], F.lit(1))})


#: What `event_id` reads, beside the property group.
EVENT = ["source", "listing_id", "listing_date", "price"]


def with_event(rows: DataFrame) -> DataFrame:
    """rows with _e and _f, two hashes of their event_id."""
    return rows.withColumn("_event", event_id()).withColumns({"_e": F.xxhash64("_event"), "_f": F.xxhash64(F.lit(1), "_event")}).drop("_event")


def first_events(rows: DataFrame, order: str = "ingest_key") -> DataFrame:
    """First of equal _h and _g, then first of equal _e and _f: aggregates that tasks begin before the shuffle."""

    def first(rows: DataFrame, *by: str) -> DataFrame:
        whole = F.struct(*[c for c in rows.columns if c not in by])
        return rows.groupBy(*by).agg(F.min_by(whole, F.col(order)).alias("_row")).select("_row.*")

    return first(first(rows, "_h", "_g"), "_e", "_f")


def without_copies(grouped: DataFrame, order: str = "ingest_key") -> DataFrame:
    """First of equal rows, then first of each listing event; re-posts with another date or price stay.

    Rows and events are told apart by two 64-bit hashes each: a row that stands very often makes no large task, and
    nothing is sorted by all columns.
    """
    return first_events(with_event(fingerprinted(grouped, order)), order).withColumn("listing_event_id", event_id())
