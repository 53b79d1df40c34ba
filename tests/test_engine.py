"""The listing engine on small frames."""

import math
import os
import shutil
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from domora.functions import text
from domora.functions.geo import haversine
from domora.functions.numeric import bins, number
from domora.operators import clean, comparables, features, identity, metrics, split
from domora.operators.graph import components
from domora.sources import listings

BASE = {"ingest_key": "1", "price": "5000", "area": "60", "property_type": "Nhà riêng", "location": "12 Nguyễn Huệ, Quận 1, TP.HCM", "last_updated_date": "01/01/2025 10:00", "listing_id": None, "source": None}


def frame(spark, *changes):
    rows = [{**BASE, "ingest_key": str(i), **c} for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} string" for k in rows[0]))


def test_areas_and_chunks(spark):
    cases = {"12 Lê Lợi, QUẬN  3, TP": "Quận 3", "a, Quận 2": "TP. Thủ Đức", "a, quận 20": "TP. Thủ Đức", "x, Quận 12": "Quận 12", "Gò Vấp": "Quận Gò Vấp", "Long An": "Unknown", None: "Unknown"}
    rows = spark.createDataFrame([(k,) for k in cases], "l string")
    assert [r[0] for r in rows.select(text.area_of(F.col("l"))).collect()] == list(cases.values())
    one = spark.createDataFrame([("5 Đường A, Phường 7, Quận 1",)], "l string").select(text.ward_of(F.col("l")), text.street_of(F.col("l"))).first()
    assert tuple(one) == ("phường 7", "5 đường a")


def test_text_flags_negation(spark):
    rows = spark.createDataFrame([("nhà không có nội thất, hẻm xe hơi", 1), ("full nội thất gỗ", 0), (None, 1)], "d string, s int")
    found = text.text_flags(F.lit(""), F.col("d"), {"has_furniture": F.col("s")})
    got = rows.select(found["has_furniture"], found["car_alley"]).collect()
    assert [tuple(r) for r in got] == [(0, 1), (1, 0), (1, 0)]


def test_numbers_and_bins(spark):
    rows = spark.createDataFrame([("5d",), (" 3.5 ",), ("1e3",), ("abc",), ("NaN",), (None,)], "x string")
    assert [r[0] for r in rows.select(number(F.col("x"))).collect()] == [None, 3.5, 1000.0, None, None, None]
    edges = spark.createDataFrame([(0.0,), (60.0,), (100.0,)], "x double")
    assert [r[0] for r in edges.select(bins(F.col("x"), *metrics.SLICES["completeness"])).collect()] == [None, "<60", ">=80"]


def test_distance_is_null_safe(spark):
    row = spark.sql("select cast(null as double) as a, 10.7769D as b, 106.7009D as c")
    d, n = row.select(haversine(F.col("b"), F.col("c"), F.lit(10.7769), F.lit(106.7009)), haversine(F.col("a"), F.col("c"), F.col("b"), F.col("c"))).first()
    assert d < 0.01 and n is None


def test_copies_go_and_reposts_stay(spark):
    rows = frame(spark, {}, {}, {"price": "5500", "last_updated_date": "15/06/2025 14:00"})
    kept = clean.without_copies(identity.grouped(clean.valid(rows))).collect()
    assert {r["ingest_key"] for r in kept} == {"0", "2"} and len({r["property_group_id"] for r in kept}) == 1
    two = frame(spark, {"listing_id": "source-1"}, {"listing_id": "source-2"})
    assert clean.without_copies(identity.grouped(clean.valid(two))).count() == 2


def test_funnel_and_missing_columns(spark):
    rows = frame(spark, {}, {"property_type": "Đất nền"}, {"price": "50000"}, {"area": "500"}, {"price": "x"})
    assert tuple(clean.funnel(rows).first())[:4] == (5, 1, 1, 3)
    with pytest.raises(ValueError, match="location"):
        listings.require_columns(rows.drop("location"))


def test_identity_levels(spark):
    def sizes(*changes):
        return sorted((r["ingest_key"], r["group_size"], r["identity_confidence"], r["possible_duplicate"]) for r in identity.resolve(clean.valid(frame(spark, *changes))).collect())

    assert sizes({}) == [("0", 1, "singleton", False)]
    assert sizes({}, {}, {"location": "12 Nguyễn Huệ, Quận 3"}) == [("0", 2, "strong", False), ("1", 2, "strong", False), ("2", 1, "singleton", False)]
    assert sizes({"location": "Quận 7, TP.HCM"}, {"location": "Quận 7, TP.HCM"}) == [("0", 1, "weak", True), ("1", 1, "weak", True)]
    ids = sizes(*({"listing_id": "42", "source": s, "location": f"{i} Phố X, Quận {i + 3}"} for i, s in enumerate("aab")))
    assert [r[1] for r in ids] == [2, 2, 1]
    houses = clean.valid(frame(spark, *({"location": f"{n} Phố, Phường 1, Quận 3"} for n in (12, 14, 16))))
    assert identity.audit(houses).first()["medium_pairs"] == 3


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 43


def test_split_keeps_groups_whole(spark):
    assert split.cut_points(727) == [436, 545, 617]
    rows = spark.range(100).selectExpr("cast(id as string) as property_group_id", "timestamp'2025-01-01' + make_interval(0, 0, 0, cast(id as int)) as listing_date")
    late = spark.createDataFrame([("1", datetime(2025, 10, 15))], "property_group_id string, listing_date timestamp")
    got = split.with_split(rows.unionByName(late), "property_group_id").groupBy("property_group_id").agg(F.collect_set("split").alias("s")).collect()
    assert all(len(r["s"]) == 1 for r in got) and {r["s"][0] for r in got if r["property_group_id"] == "1"} == {"test"}
    with pytest.raises(ValueError, match="few"):
        split.group_splits(rows.limit(5))
    with pytest.raises(ValueError, match="shares"):
        split.cut_points(100, (0.8, 0.15, 0.1, 0.1))


def test_metrics_and_conformal(spark):
    rows = spark.createDataFrame([(100.0, 110.0, 90.0, 110.0), (200.0, 190.0, 180.0, 220.0), (300.0, 310.0, 290.0, 310.0)], "price double, prediction double, lower double, upper double")
    got = metrics.regression_metrics(rows).first()
    assert (got["mae"], got["median_ae"], got["wape"]) == (10.0, 10.0, 5.0)
    assert tuple(metrics.interval_metrics(rows, 0.8).first())[:2] == (1.0, 0.2)
    res = spark.createDataFrame([(i / 10,) for i in range(1, 11)], "residual double")
    assert metrics.conformal_quantile(res).first()["quantile"] == 0.9
    for n in range(5, 60, 7):
        sized = spark.range(1, n + 1).selectExpr("cast(id as double) as residual")
        assert metrics.conformal_quantile(sized).first()["quantile"] == math.ceil((n + 1) * 0.8)
    for bad in ([-1.0], [float("nan")], [0.1]):
        with pytest.raises(ValueError):
            metrics.conformal_quantile(spark.createDataFrame([(x,) for x in bad], "residual double"))


def test_nearest_comparables(spark):
    refs = [(f"r{i}", "Nhà riêng", "Quận 1", a, 8000.0, 3.0, 2.0, datetime(2025, 1, 1), f"g{i}") for i, a in enumerate((82.0, 78.0, 250.0))]
    r = spark.createDataFrame(refs, "ref_id string, property_type string, location_area string, area double, price double, bedrooms double, bathrooms double, listing_date timestamp, property_group_id string")
    r = r.withColumns({"latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double")})
    q = spark.createDataFrame([("q", "Nhà riêng", "Quận 1", 80.0, datetime(2025, 3, 1)), ("old", "Nhà riêng", "Quận 1", 80.0, datetime(2024, 3, 1)), ("far", "Nhà riêng", "Quận 9", 400.0, None)], "query_id string, property_type string, location_area string, area double, as_of timestamp")
    q = q.withColumns({c: F.lit(None).cast("double") for c in ("bedrooms", "bathrooms", "latitude", "longitude")})
    got = {}
    for x in comparables.find(q, r, 2).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["ref_id"], x["tier"]))
    assert got == {"q": [("r0", "local"), ("r1", "local")], "far": [("r2", "date"), ("r0", "date")]}


def test_feature_frame(spark):
    context = features.FeatureContext("2025-01-01 00:00:00")
    row = spark.createDataFrame([(60.0, datetime(2025, 4, 11), 5000.0)], "area double, as_of timestamp, price double")
    got = features.feature_frame(row, context, as_of="as_of")
    one = got.first()
    assert len(got.columns) == 29 and "price" not in got.columns and one["days_from_train_reference"] == 100
    assert all(one[f"{c}_missing"] == 1 for c in ("gps", "width", "length", "bedrooms", "bathrooms"))


def test_package_checks():
    good = '{"target": "total_price", "quantile": 0.5, "coverage": 0.8, "segment_counts": {"a | b": 2}, "reference_date": "x"}'
    assert listings.check_package(good)["segments"] == {("a", "b"): 2}
    for bad in ("[]", "{", good.replace("0.5", "-1"), good.replace("total_price", "unit"), '{"target": 1}'):
        with pytest.raises(ValueError):
            listings.check_package(bad)


def test_entry_and_catalog(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["property_type", "location_area", "segment_median", "n"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stream_dedup_equals_batch(spark):
    from domora.plans import catalog

    got = {r["property_type"]: r["n"] for r in catalog.stream_dedup(spark, "/root/testdata/sf0.001").collect()}
    rows = clean.valid(listings.adapted_listings(spark, "/root/testdata/sf0.001")).where("listing_id is not null and listing_date is not null")
    want = rows.withColumn("e", F.concat_ws(":", "source", "listing_id")).groupBy("property_type").agg(F.count_distinct("e").alias("n"))
    assert got == {r["property_type"]: r["n"] for r in want.collect()}


def test_stream_dedup_leaves_no_rows_on_the_driver(spark):
    from domora.plans import catalog

    found = catalog.stream_dedup(spark, "/root/testdata/sf0.001")
    assert found.inputFiles() and all(f.endswith(".parquet") for f in found.inputFiles())  # a memory table has no files
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("events_")]


def test_entry_without_the_training_data_operators(tmp_path):
    """A copy of the repository without domora/llm, its tests and the pipeline's file, then with that file."""
    root = Path(entry.__file__).parent
    for name in ("domora", "__spark_entry__.py", "corpus_pipeline.py"):
        source = root / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    for _ in range(2):
        code = "import __spark_entry__ as e; q = e.queries(); assert 'segment_medians' in q and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') for k in q)"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
