"""Models, the training job and what cleaning does before them."""

import unicodedata
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from domora.functions import config as C
from domora.functions import text
from domora.operators import clean, features, identity, metrics, scoring, segments
from domora.operators import model as M
from domora.plans import training
from domora.session import materialise
from domora.sources import listings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark):
    return materialise(listings.adapted_listings(spark, SF))


@pytest.fixture(scope="module")
def rows(raw):
    return training.cleaned(raw)


@pytest.fixture(scope="module")
def trained(rows):
    return training.train(rows, ("naive_median", "ridge_linear"))


def test_composed_and_decomposed_addresses_are_equal(spark):
    place = "12 Đường Số 3, Phường 5, Quận Gò Vấp"
    two = spark.createDataFrame([(unicodedata.normalize(f, place), "n") for f in ("NFC", "NFD")] + [(None, None)], "location string, source string")
    got = [r[0] for r in clean.with_composed(two).select(text.area_of(F.col("location"))).collect()]
    assert got == ["Quận Gò Vấp", "Quận Gò Vấp", "Unknown"]
    assert {r[0] for r in clean.with_composed(two).where("location is not null").select("location").collect()} == {place}


def test_source_columns_by_precedence(spark):
    one = spark.createDataFrame([("a", "b", "1", "2")], "source string, source_id string, listing_id string, source_listing_id string")
    assert tuple(clean.sourced(one).select("source", "listing_id").first()) == ("b", "2")
    assert tuple(clean.sourced(one.select("source")).select("source", "listing_id").first()) == ("a", None)


def test_requests_without_a_date_are_of_today(spark):
    asked = spark.createDataFrame([(None,), ("2025-02-30",), ("2025-03-01",)], "as_of string")
    got = [(r["as_of"], r["bad_as_of"]) for r in scoring.dated(asked).collect()]
    today = datetime.now(timezone.utc) + timedelta(hours=7)
    assert abs((got[0][0].date() - today.date()).days) <= 1 and not got[0][1]
    assert got[1] == (None, True) and got[2] == (datetime(2025, 3, 1), False)


def test_imputation(spark, raw):
    frame = features.feature_frame(clean.valid(raw), features.FeatureContext("1997-01-01 00:00:00"))
    got, table = M.Imputation.fit(frame), frame.toPandas()
    for c in ("area", "bedrooms", "alley_width"):
        filled = table[c].fillna(table[c].median())
        assert got.medians[c] == table[c].median() and np.isclose(got.means[c], filled.mean()) and np.isclose(got.deviations[c], filled.std(ddof=0))
    assert got.modes["property_type"] == sorted(table["property_type"].mode())[0]
    assert "bedrooms" in got.with_indicator and "area" not in got.with_indicator


def _vectors(model, part):
    frame = features.feature_frame(part, model.context, keep=["ingest_key", "price"])
    made = model.stages.transform(model.imputation.apply(frame, True)).select("ingest_key", "price", "log_prediction", vector_to_array("vector").alias("v")).toPandas().sort_values("ingest_key")
    return made, np.stack(made["v"])


def test_ridge_is_the_closed_form(rows):
    """Squared errors plus RIDGE_ALPHA times the squared coefficients, the constant left free."""
    fitted = M.fit("ridge_linear", rows)
    made, x = _vectors(fitted, rows)
    y = np.log1p(made["price"].to_numpy(float))
    centred = x - x.mean(0)
    want = np.linalg.solve(centred.T @ centred + M.RIDGE_ALPHA * np.eye(x.shape[1]), centred.T @ (y - y.mean()))
    got = fitted.stages.stages[-1].coefficients.toArray()
    assert np.allclose(got, want, atol=1e-6), np.abs(got - want).max()


def test_forest_leaves_and_predictions(spark, trained, tmp_path):
    """Leaves hold LEAST_IN_LEAF rows, predictions are means of leaf means and lie within the prices; the same seed gives the same trees."""
    part, test = trained.parts["train"], trained.parts["test"]
    fitted = M.fit("forest", part, trees=5, depth=M.MOST_DEPTH)
    forest = fitted.stages.stages[-1]
    nodes = [forest._java_obj.trees()[i].rootNode() for i in range(5)]
    assert max(forest._java_obj.trees()[i].depth() for i in range(5)) > M.DEPTH

    def leaves(node):
        if node.subtreeDepth() == 0:
            return [(node.impurityStats().count(), node.prediction())]
        return leaves(node.leftChild()) + leaves(node.rightChild())

    y = np.log1p(np.array([r[0] for r in part.select("price").collect()], float))
    for node in nodes:
        held = leaves(node)
        assert min(n for n, _ in held) >= M.LEAST_IN_LEAF and sum(n for n, _ in held) == len(y)
        assert np.isclose(sum(n * p for n, p in held), y.sum())
    by = lambda m: m.predict(test, ["ingest_key"]).select("ingest_key", "prediction").toPandas().sort_values("ingest_key")["prediction"].to_numpy()
    got = by(fitted)
    assert np.expm1(y.min()) - 1e-6 <= got.min() and got.max() <= np.expm1(y.max()) + 1e-6
    assert np.allclose(got, by(M.fit("forest", part, trees=5, depth=M.MOST_DEPTH)))
    fitted.save(str(tmp_path))
    assert np.allclose(got, by(M.PriceModel.load(spark, str(tmp_path))))


def test_training_run_weighs_all_candidates(rows):
    """The forest is among the candidates, and the one with the least error is fitted again."""
    done = training.train(rows, trees=3, depth=4)
    errors = {r["candidate"]: r["mae"] for r in done.selection.collect()}
    assert set(errors) == set(M.CANDIDATES) and done.model.name == min(M.CANDIDATES, key=errors.get)
    forest = training.train(rows, ("forest",), trees=3, depth=4)
    report = {r["predictor"]: r for r in training.evaluation(forest).collect()}
    assert report["forest"]["mae"] > 0 and 0 <= report["forest"]["coverage"] <= 1 and forest.quantile > 0


def test_contributions_add_up_to_the_prediction(trained):
    fitted = M.fit("ridge_linear", trained.parts["train"])
    made, _ = _vectors(fitted, trained.parts["test"])
    every = M.contributions(fitted, trained.parts["test"], ["ingest_key"], top=1000)
    total = every.select("ingest_key", F.aggregate("contributions", F.lit(0.0), lambda a, z: a + z["contribution"]).alias("s")).toPandas().sort_values("ingest_key")
    assert np.allclose(total["s"].to_numpy() + fitted.stages.stages[-1].intercept, made["log_prediction"].to_numpy())
    some = M.contributions(fitted, trained.parts["test"], ["ingest_key"], top=3).first()["contributions"]
    sizes = [abs(z["contribution"]) for z in some]
    assert len(some) == 3 and sizes == sorted(sizes, reverse=True)


def test_selection_takes_the_least_error(trained):
    errors = {r["candidate"]: r["mae"] for r in trained.selection.collect()}
    assert trained.model.name == min(errors, key=errors.get)
    name, _ = M.select(trained.parts["train"], trained.parts["validation"], ("naive_median", "naive_median"))
    assert name == "naive_median"  # the first of equals
    with pytest.raises(ValueError, match="unknown"):
        M.fit("other", trained.parts["train"])


def test_refit_reads_train_and_validation(trained):
    """The context's last date, the rows and the quantile follow from the right parts."""
    parts = trained.parts
    last = parts["dev"].agg(F.max("listing_date")).first()[0]
    assert trained.model.context.reference_date == last.strftime("%Y-%m-%d %H:%M:%S")
    assert parts["dev"].count() == parts["train"].count() + parts["validation"].count()
    residual = np.sort(M.residuals(trained.model, parts["calibration"]).toPandas()["residual"].to_numpy())
    assert np.isclose(trained.quantile, residual[metrics.conformal_rank(len(residual), C.COVERAGE) - 1])
    groups = [{r[0] for r in parts[n].select("property_group_id").distinct().collect()} for n in ("dev", "calibration", "test")]
    assert not (groups[0] & groups[1] or groups[0] & groups[2] or groups[1] & groups[2])


def test_report_against_baselines(trained):
    got = {r["predictor"]: r for r in training.evaluation(trained).collect()}
    test, dev = trained.parts["test"].toPandas(), trained.parts["dev"].toPandas()
    assert set(got) == {trained.model.name, "baseline_naive", "baseline_segment"}
    assert np.isclose(got["baseline_naive"]["mae"], np.abs(test["price"] - dev["price"].median()).mean(), atol=1e-3)
    by = dev.groupby(["property_type", "location_area"])["price"].median()
    guess = [by.get((t, a), dev["price"].median()) for t, a in zip(test["property_type"], test["location_area"], strict=True)]
    assert np.isclose(got["baseline_segment"]["mae"], np.abs(test["price"] - guess).mean(), atol=1e-3)
    assert 0 <= got[trained.model.name]["coverage"] <= 1 and got["baseline_naive"]["coverage"] is None


def test_saved_models_predict_alike(spark, trained, rows, raw, tmp_path):
    at = training.save(trained, rows, raw, str(tmp_path))
    assert listings.current_version(spark, str(tmp_path)) == at
    loaded, package = training.load(spark, str(tmp_path))
    one, two = (m.predict(trained.parts["test"], ["ingest_key"]).select("ingest_key", "prediction").toPandas().sort_values("ingest_key") for m in (trained.model, loaded))
    assert np.allclose(one["prediction"], two["prediction"]) and loaded.context == trained.model.context and loaded.imputation == trained.model.imputation
    assert package["quantile"] == trained.quantile and ("Nhà riêng", "Quận 1") in package["segments"]
    assert listings.read_reference(spark, f"{at}/reference").count() == rows.count()
    assert spark.read.json(f"{at}/reports/metrics").count() == 3
    summary = spark.read.json(f"{at}/reports/data_summary").first()
    assert summary["rows_clean"] == rows.count() and summary["rows_valid"] - summary["rows_clean"] == summary["exact_duplicate_listings"] > 0
    assert spark.read.json(f"{at}/reports/error_analysis").where("dimension = 'property_type'").count() > 1


def test_constant_model_is_saved_too(spark, trained, tmp_path):
    fitted = M.fit("naive_median", trained.parts["train"])
    fitted.save(str(tmp_path))
    again = M.PriceModel.load(spark, str(tmp_path))
    assert again == fitted
    price = again.predict(trained.parts["test"], []).first()["prediction"]
    assert np.isclose(price, segments.naive_median(trained.parts["train"]).first()[0], rtol=1e-3)


def test_too_few_rows(rows):
    with pytest.raises(ValueError, match="50"):
        training.train(rows.limit(20))


def test_batch_scoring(trained):
    dev = trained.parts["dev"]
    asked = trained.parts["test"].limit(6).withColumns({"query_id": F.col("ingest_key"), "as_of": F.col("listing_date")})
    bad = asked.limit(1).withColumns({"query_id": F.lit("bad"), "area": F.lit(9999.0)})
    known = segments.comparable_context(dev).first()
    ranges = {r["feature"]: (r["lo"], r["hi"]) for r in segments.training_ranges(dev, C.NUMERIC_FEATURES[:9]).collect()}
    refs = dev.withColumn("ref_id", F.col("ingest_key"))
    got = scoring.score(asked.unionByName(bad), trained.model, trained.quantile, refs, ranges, known["property_types"], known["location_areas"]).collect()
    assert len(got) == asked.count() and "bad" not in {r["query_id"] for r in got}
    for r in got:
        assert r["prediction_interval"]["lower_million"] <= r["predicted_price_million"] <= r["prediction_interval"]["upper_million"]
        assert len(r["comparables"] or []) <= 4


def test_rejected_requests_have_reasons(trained):
    """Every request is scored or rejected; reasons come in the order of the checks, as_of as it was asked."""
    asked = trained.parts["test"].limit(4).withColumns({"query_id": F.col("ingest_key"), "as_of": F.lit("1998-05-01")})
    odd = asked.limit(1).withColumns({"query_id": F.lit("odd"), "as_of": F.lit("1998-02-30"), "area": F.lit(None).cast("double"), "property_type": F.lit(None).cast("string"), "bedrooms": F.lit(float("nan"))})
    types, areas = C.RESIDENTIAL_TYPES, [r[0] for r in asked.select("location_area").distinct().collect()]
    got = {r["query_id"]: r for r in scoring.rejected(asked.unionByName(odd), types, areas).collect()}
    assert set(got) == {"odd"} and got["odd"]["as_of"] == "1998-02-30"
    assert got["odd"]["reasons"] == ["unsupported_property_type", "area_out_of_range", "bad_as_of", "bedrooms_out_of_range"]
    assert scoring.rejected(asked.limit(0), types, areas).count() == 0


def test_labels_of_features(spark):
    rows = spark.createDataFrame([("area",), ("property_type=Nhà riêng",), ("other",)], "f string")
    assert [r[0] for r in rows.select(scoring.friendly_name(F.col("f"))).collect()] == ["Diện tích đất (Area)", "Loại hình: Nhà riêng", "other"]


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    file = tmp_path / "listings.csv"
    file.write_text('Price,Area,Property Type,Location,Title\n5000,60,Nhà riêng,"12 A, Quận 1","hai ""dòng""\nnối"\n', encoding="utf-8")
    got = listings.load_listings(spark, str(file))
    assert got.count() == 1 and got.first()["title"] == 'hai "dòng"\nnối' and got.first()["location"] == "12 A, Quận 1"
    assert identity.grouped(clean.valid(training.keyed(listings.require_columns(got)))).count() == 1
    got.write.parquet(f"{tmp_path}/listings.parquet")
    assert listings.load_listings(spark, f"{tmp_path}/listings.parquet").count() == 1
