"""The registered queries of the listing engine; domora.plans.oracle has their DuckDB forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domora.functions import config as C
from domora.functions.geo import floor_days
from domora.functions.text import area_of, street_of, text_flags, ward_of
from domora.operators import clean, comparables, features, identity, metrics, model, scoring, segments, split
from domora.plans import oracle, training
from domora.session import materialise, shared_dir
from domora.sources.listings import adapted_listings, reference_export
from domora.streaming import jobs

CONTEXT = features.FeatureContext("1997-01-01 00:00:00")
QUANTILE = 0.5


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return clean.valid(adapted_listings(spark, sf))


#: What features, labels and intervals are made of; what segment medians are.
_FEATURED = [
    "ingest_key", "listing_date", "price", *C.NUMERIC_FEATURES[:9], *C.CATEGORICAL_FEATURES, "title", "description", "road_type",
]
_SEGMENTED = ["ingest_key", "listing_date", "price", *segments.SEGMENT]
_COMPARED = [*_SEGMENTED, "location", "area", "bedrooms", "bathrooms", "latitude", "longitude"]


def _held(spark: SparkSession, sf: str, columns: list[str] | None = None) -> DataFrame:
    """The valid rows, written once for queries that read them more than once, with the columns that these read."""
    rows = _valid(spark, sf)
    return materialise(rows.select(*columns) if columns else rows)


def _between(rows: DataFrame, lo: str | None, hi: str | None) -> DataFrame:
    """Parts of the history by date: train before 1996, then a year each, test from 1998 on."""
    if lo:
        rows = rows.where(F.col("listing_date") >= F.lit(lo).cast("timestamp"))
    return rows.where(F.col("listing_date") < F.lit(hi).cast("timestamp")) if hi else rows


def _train(rows: DataFrame) -> DataFrame:
    return _between(rows, None, oracle.CUTS[0])


def _validation(rows: DataFrame) -> DataFrame:
    return _between(rows, oracle.CUTS[0], oracle.CUTS[1])


def _predicted(spark: SparkSession, sf: str, columns: list[str] = ()) -> DataFrame:
    """Test rows with the segment baseline's prediction and interval, and the columns asked for."""
    rows = _held(spark, sf, list(dict.fromkeys([*_SEGMENTED, *columns])))
    test = _between(rows, oracle.CUTS[2], None)
    return metrics.log_intervals(segments.predict_segment(test, _train(rows)), QUANTILE)


def market_scope_filter(spark, sf):
    raw = adapted_listings(spark, sf)
    return clean.in_scope(raw).groupBy("property_type").agg(F.count("*").alias("n"), F.round(F.avg("price"), 2).alias("mean_price"))


def date_provenance(spark, sf):
    return _valid(spark, sf).groupBy("date_source", "temporal_status", "listing_date_missing").agg(F.count("*").alias("n"), F.min("listing_date").alias("first_date"))


def gps_validation(spark, sf):
    return _valid(spark, sf).groupBy("location_area").agg(F.count("latitude").alias("with_gps"), F.count("*").alias("n"), F.round(F.avg("longitude"), 4).alias("mean_longitude"))


def quality_funnel(spark, sf):
    return clean.funnel(adapted_listings(spark, sf))


def missing_rates(spark, sf):
    return segments.missing_rates(_valid(spark, sf), oracle.MISSING_COLUMNS)


def area_extraction(spark, sf):
    return clean.with_area(clean.with_composed(adapted_listings(spark, sf))).groupBy("location_area").agg(F.count("*").alias("n"))


def location_components(spark, sf):
    rows = clean.with_composed(adapted_listings(spark, sf)).select(area_of(F.col("location")).alias("area_key"), ward_of(F.col("location")).alias("ward"), street_of(F.col("location")).alias("street"))
    return rows.groupBy("area_key", "ward").agg(F.count("*").alias("n"), F.count_distinct("street").alias("streets"), F.max("street").alias("last_street"))


def property_signature(spark, sf):
    rows = _valid(spark, sf)
    return rows.groupBy(identity.property_signature(rows).alias("signature")).agg(F.count("*").alias("n"), F.min("ingest_key").alias("first_key"))


def flags(spark, sf):
    rows = adapted_listings(spark, sf)
    found = text_flags(F.col("title"), F.col("description"), {"has_furniture": F.col("supplied_furniture")})
    return rows.select("property_type", *[c.alias(n) for n, c in found.items()]).groupBy("property_type").agg(*[F.sum(n).alias(n) for n in found])


def document_flags(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = text_flags(F.lit(""), F.col("text"), None, oracle.LEXICON, oracle.NEGATION)
    return docs.select("lang", *[c.alias(n) for n, c in found.items()]).groupBy("lang").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in found])


def completeness_flags(spark, sf):
    found = features.missing_flags()
    rows = _valid(spark, sf).select(features.completeness().alias("score"), *[c.alias(n) for n, c in found.items()])
    return rows.groupBy("score").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in found])


def time_offset(spark, sf):
    days = features.days_from(F.lit(CONTEXT.reference_date).cast("timestamp"), F.col("listing_date"))
    return _valid(spark, sf).groupBy("property_type").agg(F.min(days).alias("least"), F.max(days).alias("most"), F.sum(days).alias("total"))


def cbd_distance(spark, sf):
    d = features.distance_to_centre()
    return _valid(spark, sf).groupBy("location_area").agg(F.count(d).alias("n"), F.round(F.min(d), 4).alias("least"), F.round(F.avg(d), 4).alias("mean"), F.round(F.max(d), 4).alias("most"))


def feature_frame(spark, sf):
    frame = features.feature_frame(_valid(spark, sf), CONTEXT, keep=["ingest_key"])
    return frame.withColumn("distance_to_cbd_km", F.round("distance_to_cbd_km", 4))


def identity_pairs(spark, sf):
    rows = identity.prepared(_valid(spark, sf))
    return identity.strong_pairs(rows)


def identity_groups(spark, sf):
    return identity.resolve(_valid(spark, sf))


def identity_audit(spark, sf):
    return identity.audit(_valid(spark, sf))


def event_dedup(spark, sf):
    return training.cleaned(adapted_listings(spark, sf), ["property_type", "listing_date", "price"]).select("ingest_key", "property_type", "listing_date", "price")


def dedup_funnel(spark, sf):
    raw = adapted_listings(spark, sf)
    return training.data_summary(raw, training.cleaned(raw, ["temporal_status"]))


def _grouped_rows(spark, sf):
    found = identity.resolve(_valid(spark, sf)).select("ingest_key", "group_key")
    return _valid(spark, sf).select("ingest_key", "listing_date").join(found, "ingest_key")


def temporal_split(spark, sf):
    return split.group_splits(_grouped_rows(spark, sf), "group_key")


def split_summary(spark, sf):
    return split.summary(split.with_split(materialise(_grouped_rows(spark, sf).drop("ingest_key")), "group_key"), "group_key")


def event_split(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return split.summary(split.with_split(events, "user_id", "ts"), "user_id", "ts")


def naive_baseline(spark, sf):
    return segments.naive_median(_train(_valid(spark, sf)))


def segment_medians(spark, sf):
    return segments.segment_medians(_train(_valid(spark, sf)))


def segment_unit_prices(spark, sf):
    return segments.segment_unit_prices(_train(_valid(spark, sf))).withColumn("unit_price_median", F.round("unit_price_median", 6))


def segment_predictions(spark, sf):
    rows = _held(spark, sf, _SEGMENTED)
    return segments.predict_segment(_between(rows, oracle.CUTS[2], None), _train(rows)).select("ingest_key", "price", "prediction")


def percentiles(spark, sf):
    return segments.percentiles(_valid(spark, sf))


def comparable_context(spark, sf):
    rows = _train(_valid(spark, sf))
    found = segments.comparable_context(rows.withColumn("distance_to_cbd_km", features.distance_to_centre()))
    return found.select("median_area", "area_scale", "cbd_scale", F.array_join("property_types", ";").alias("property_types"), F.array_join("location_areas", ";").alias("location_areas"), F.size("segment_counts").alias("segments"))


def training_ranges(spark, sf):
    return segments.training_ranges(_between(_valid(spark, sf), None, oracle.CUTS[1]), oracle.RANGE_COLUMNS)


def regression_metrics(spark, sf):
    return metrics.regression_metrics(_predicted(spark, sf))


def interval_metrics(spark, sf):
    return metrics.interval_metrics(_predicted(spark, sf), C.COVERAGE)


def slice_analysis(spark, sf):
    rows = _predicted(spark, sf, C.QUALITY_COLUMNS).withColumns({"input_completeness_score": features.completeness(), "distance_to_cbd_km": features.distance_to_centre()})
    return metrics.slice_metrics(rows)


def conformal_quantile(spark, sf):
    rows = _held(spark, sf, _SEGMENTED)
    calibration = segments.predict_segment(_between(rows, oracle.CUTS[1], oracle.CUTS[2]), _train(rows))
    residual = calibration.select(F.abs(F.log1p("price") - F.log1p("prediction")).alias("residual"))
    found = metrics.conformal_quantile(residual, coverage=C.COVERAGE)
    return found.select("n", "rank", *[F.round(c, 8).alias(c) for c in ("quantile", "mean_residual", "median_residual")])


def _asked(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Validation rows as queries, training rows as references: what the benchmark holds out."""
    rows = _held(spark, sf, _COMPARED).where("listing_date is not null").withColumn("property_group_id", F.col("location"))
    queries = _validation(rows).withColumns({"query_id": F.col("ingest_key"), "as_of": F.col("listing_date")})
    return queries, _train(rows).withColumn("ref_id", F.col("ingest_key"))


def _all_asked(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Every valid row as a query, and every one as a reference."""
    rows = _held(spark, sf, _COMPARED).withColumn("property_group_id", F.col("location"))
    return rows.withColumns({"query_id": F.col("ingest_key"), "as_of": F.col("listing_date")}), rows.withColumn("ref_id", F.col("ingest_key"))


def comparables_topk(spark, sf):
    return comparables.find(*_all_asked(spark, sf), 4)


def comparable_summary(spark, sf):
    return comparables.summary(comparables.find(*_all_asked(spark, sf), 4))


def comparable_benchmark(spark, sf):
    return comparables.benchmark(*_asked(spark, sf))


def _listed(spark, sf) -> DataFrame:
    """All listings, valid or not, with numbers, dates and districts."""
    return clean.with_area(clean.dates(clean.coerce(clean.with_composed(adapted_listings(spark, sf)))))


def _requests(spark, sf) -> DataFrame:
    """All listings as scoring requests, dated by their listing; some dates are missing, some are no dates."""
    rows = _listed(spark, sf)
    day = F.when(F.col("bedrooms") == 3, "2025-02-30").otherwise(F.date_format("listing_date", "yyyy-MM-dd"))
    return rows.withColumns({"query_id": F.col("ingest_key"), "as_of": day})


def request_validation(spark, sf):
    found = scoring.rejections(_requests(spark, sf), C.RESIDENTIAL_TYPES, oracle.REQUEST_AREAS)
    return found.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


def rejected_requests(spark, sf):
    return scoring.rejection_reasons(_requests(spark, sf), C.RESIDENTIAL_TYPES, oracle.REQUEST_AREAS)


def prediction_warnings(spark, sf):
    rows = _predicted(spark, sf, ["area", *C.QUALITY_COLUMNS]).withColumns({"input_completeness_score": features.completeness(), "as_of": F.col("listing_date")})
    found = scoring.warnings({"area": (20.0, 250.0), "bedrooms": (1.0, 8.0)}, CONTEXT.reference_date)
    return rows.select("ingest_key", F.array_join(found, "; ").alias("warnings"))


def missing_fields(spark, sf):
    return _valid(spark, sf).groupBy(F.array_join(scoring.missing_fields(), ",").alias("fields")).agg(F.count("*").alias("n"))


def export_reference(spark, sf):
    rows = _valid(spark, sf).withColumns({"property_group_id": F.col("ingest_key"), "distance_to_cbd_km": features.distance_to_centre()})
    return reference_export(rows).withColumn("market_age", floor_days(F.lit(CONTEXT.reference_date).cast("timestamp"), F.col("listing_date").cast("timestamp")))


def refit_rows(spark, sf):
    """Train and validation together, duplicates kept, as the refit reads them. Decimals add up to the same sum in any order, and are rounded before they are doubles."""
    rows = _valid(spark, sf)
    return _train(rows).unionByName(_validation(rows)).groupBy("property_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("price").cast("decimal(28,6)")), 2).cast("double").alias("total_price"))


# -- models: no SQL form -------------------------------------------------------------------


def model_selection(spark, sf):
    rows = _held(spark, sf, _FEATURED)
    return model.select(_train(rows), _validation(rows), trees=20)[1]


def _scores(name: str):
    def run(spark, sf):
        rows = _held(spark, sf, _FEATURED)
        fitted = model.fit(name, _between(rows, None, oracle.CUTS[1]), trees=20)
        q = metrics.conformal_quantile(model.residuals(fitted, _between(rows, oracle.CUTS[1], oracle.CUTS[2]))).first()["quantile"]
        return metrics.log_intervals(fitted.predict(_between(rows, oracle.CUTS[2], None), ["ingest_key", "price"]).select("ingest_key", "price", "prediction"), q)

    return run


def _scorer(rows: DataFrame):
    """A function that scores requests with the ridge model learned from rows."""
    past = _between(rows, None, oracle.CUTS[1])
    fitted = model.fit("ridge_linear", past)
    q = metrics.conformal_quantile(model.residuals(fitted, _between(rows, oracle.CUTS[1], oracle.CUTS[2]))).first()["quantile"]
    known = past.agg(F.array_sort(F.collect_set("property_type")).alias("t"), F.array_sort(F.collect_set("location_area")).alias("a")).first()
    ranges = {r["feature"]: (r["lo"], r["hi"]) for r in segments.training_ranges(past, C.NUMERIC_FEATURES[:9]).collect()}
    refs = past.where("listing_date is not null").withColumn("ref_id", F.col("ingest_key"))

    def run(requests: DataFrame) -> DataFrame:
        """A row for each request: what it is scored with, or the reasons why it is not."""
        scored = scoring.score(requests, fitted, q, refs, ranges, known["t"], known["a"])
        return scored.unionByName(scoring.rejected(requests, known["t"], known["a"]).select("query_id", "reasons"), allowMissingColumns=True)

    return run


def _open_requests(spark, sf) -> DataFrame:
    """All listings of the last part, valid or not, as requests of their day; written, as they are scored and rejected."""
    rows = clean.valid_coordinates(_between(_listed(spark, sf), oracle.CUTS[2], None))
    return materialise(rows.withColumns({"query_id": F.col("ingest_key"), "as_of": F.date_format("listing_date", "yyyy-MM-dd")}))


def training_run(spark, sf):
    """The whole job from raw listings to the test report of the selected model and both baselines."""
    return training.run(adapted_listings(spark, sf), trees=20)


def batch_scoring(spark, sf):
    return _scorer(_held(spark, sf))(_open_requests(spark, sf))


def contributions(spark, sf):
    rows = _held(spark, sf, _FEATURED)
    fitted = model.fit("ridge_linear", _between(rows, None, oracle.CUTS[1]))
    found = model.contributions(fitted, _between(rows, oracle.CUTS[2], None), ["ingest_key"])
    return found.select("ingest_key", F.posexplode("contributions").alias("place", "c")).select("ingest_key", "place", "c.feature", scoring.friendly_name(F.col("c.feature")).alias("label"), "c.contribution")


def stream_dedup(spark, sf):
    rows = materialise(adapted_listings(spark, sf))
    stream = jobs.dedup_stream(spark, rows.schema, rows.inputFiles()[0].rsplit("/", 1)[0])
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = jobs.run_to_files(stream.select("listing_event_id", "property_type"), f"{base}/out", f"{base}/log")
    return events.groupBy("property_type").agg(F.count("*").alias("n"))


def stream_scoring(spark, sf):
    asked = _open_requests(spark, sf)
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    requests = spark.readStream.schema(asked.schema).parquet(asked.inputFiles()[0].rsplit("/", 1)[0])
    jobs.score_stream(requests, _scorer(_held(spark, sf)), f"{base}/out", f"{base}/log").awaitTermination()
    return jobs.read_batches(spark, f"{base}/out")


QUERIES = {
    f.__name__: f
    for f in (
        market_scope_filter, date_provenance, gps_validation, quality_funnel, missing_rates, area_extraction, location_components, property_signature, document_flags,
        completeness_flags, time_offset, cbd_distance, feature_frame, identity_pairs, identity_groups, identity_audit, event_dedup, dedup_funnel, temporal_split, split_summary, event_split,
        naive_baseline, segment_medians, segment_unit_prices, segment_predictions, percentiles, comparable_context, training_ranges, regression_metrics, interval_metrics,
        slice_analysis, conformal_quantile, comparables_topk, comparable_summary, comparable_benchmark, request_validation, rejected_requests, prediction_warnings, missing_fields, export_reference,
        refit_rows, model_selection, training_run, batch_scoring, contributions, stream_dedup, stream_scoring,
    )
} | {"text_flags": flags, "ridge_scores": _scores("ridge_linear"), "forest_scores": _scores("forest")}
ORACLE_SQL = oracle.SQL
