"""Tests of the findings of round 4."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from domora import session
from domora.functions import config as C
from domora.llm import alignment, topk
from domora.llm.bpe import public_path
from domora.operators import clean, comparables, identity, model, scoring
from domora.plans import catalog, oracle, training
from domora.sources.listings import adapted_listings

SF = "/root/testdata/sf0.001"


def test_every_open_request_is_scored_or_rejected(spark):
    """requests are all listings of the last part, so that their checks have something to reject."""
    asked = catalog._between(catalog._listed(spark, SF), oracle.CUTS[2], None)
    got = entry.queries()["batch_scoring"](spark, SF).select("query_id", "predicted_price_million", "reasons").collect()
    assert sorted(r["query_id"] for r in got) == sorted(r[0] for r in asked.select("ingest_key").collect())
    rejected = {r["query_id"]: r["reasons"] for r in got if r["reasons"]}
    unsupported = {r[0] for r in asked.where(~F.col("property_type").isin(C.RESIDENTIAL_TYPES)).select("ingest_key").collect()}
    assert unsupported and unsupported == {k for k, v in rejected.items() if "unsupported_property_type" in v}
    assert all((r["predicted_price_million"] is None) == (r["query_id"] in rejected) for r in got)
    # a request has no price, so that a listing whose price is out of range is scored
    dear = {r[0] for r in asked.where("price >= 50000 and area between 5 and 400").select("ingest_key").collect()}
    assert not dear or dear - set(rejected)


def test_a_request_is_priced_at_the_day_it_asks_for(spark):
    """as_of goes into the features, not only into comparables and warnings."""
    rows = catalog._held(spark, SF)
    fitted = model.fit("ridge_linear", catalog._train(rows))
    one = catalog._between(rows, oracle.CUTS[2], None).orderBy("ingest_key").limit(1)
    types, areas = C.RESIDENTIAL_TYPES, [r[0] for r in one.select("location_area").collect()]
    asked = [one.withColumns({"query_id": F.lit(d), "as_of": F.lit(d)}) for d in ("1998-03-01", "1999-03-01")]
    got = scoring.score(asked[0].unionByName(asked[1]), fitted, 0.5, catalog._train(rows).withColumn("ref_id", F.col("ingest_key")), {}, types, areas).collect()
    assert len({r["predicted_price_million"] for r in got}) == 2


@pytest.mark.parametrize("name", ["comparables_topk", "comparable_summary"])
def test_every_valid_listing_is_asked_for_and_may_be_a_comparable(spark, name):
    """F15, F16: no part of the history is left out, undated listings neither."""
    rows = catalog._valid(spark, SF).select("ingest_key", "listing_date").toPandas().set_index("ingest_key")["listing_date"]
    got = entry.queries()[name](spark, SF).toPandas()
    asked = rows[got["query_id"].unique()]
    assert asked.isna().sum() == rows.isna().sum() > 0
    assert set(asked.dropna().dt.year) == set(rows.dropna().dt.year)
    if name == "comparables_topk":
        pairs = got.assign(asked=rows[got["query_id"]].to_numpy(), found=rows[got["ref_id"]].to_numpy())
        assert set(rows[got["ref_id"]].dropna().dt.year) == set(rows.dropna().dt.year)
        dated = pairs[pairs["asked"].notna()]
        assert ((dated["asked"] - dated["found"]).dt.days.between(0, 365)).all()
    assert "from valid q join valid r" in oracle.SQL[name] and "from validation q join train r" in oracle.SQL["comparable_benchmark"]


@pytest.mark.parametrize("name", ["event_dedup", "identity_groups", "identity_audit", "temporal_split"])
def test_tables_between_steps_go(spark, monkeypatch, tmp_path, name):
    """F7, F10-F12: what a step wrote for the next one is not kept for the whole query, nor are its shuffles."""
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    found = entry.queries()[name](spark, SF)
    assert spark.conf.get(session.SHUFFLES_REMOVED) == "true"
    assert len(list(tmp_path.glob("domora-*"))) <= (2 if name == "temporal_split" else 1)
    assert found.count() > 0


def test_copies_are_found_among_narrow_rows(spark):
    """F7, F8, F10: the columns asked for are those of the whole rows."""
    raw = adapted_listings(spark, SF)
    whole, few, many = training.cleaned(raw), training.cleaned(raw, ["price"]), training.cleaned(raw, training.LEARNED)
    names = ["ingest_key", "price", "property_group_id", "possible_duplicate"]
    assert few.columns == ["ingest_key", "price", "property_group_id", "identity_confidence", "possible_duplicate"]
    assert whole.select(names).exceptAll(few.select(names)).count() == few.select(names).exceptAll(whole.select(names)).count() == 0
    assert many.exceptAll(whole.select(many.columns)).count() == 0 and many.count() == whole.count()
    grouped = clean.without_copies(identity.grouped(clean.valid(raw)))
    assert set(grouped.columns) == set(whole.columns) and grouped.select(whole.columns).exceptAll(whole).count() == 0


def test_pivots_come_from_a_sample_without_an_order(spark):
    """a limit over an order has every task send the driver as many vectors as it takes in all."""
    rows = spark.range(50_000).withColumnRenamed("id", "vec_id")
    sample = topk.pivot_sample(rows, 50_000)
    assert 3_500 < sample.count() < 4_700 and topk.pivot_sample(rows.limit(100), 100).count() == 100
    plan = sample._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan


def test_counts_of_pairs_are_not_collected_into_lists(spark):
    """lists of the pairs of many blocks at once were held by a task's hash aggregate."""
    docs = spark.createDataFrame([(i, f"one two {i} three") for i in range(40)], "doc_id long, text string")
    found = alignment.align(docs, public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))
    plan = found._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan
    assert sorted(r["n_links"] > 0 for r in found.collect()) == [True] * 40


def test_the_closest_are_those_of_all_distances():
    """quick distances leave pairs out, and never one of the n best or a tie with the last of them."""
    r = np.random.default_rng(5)

    def made(m: int, holes: float) -> dict[str, np.ndarray]:
        gone = lambda x: np.where(r.random(m) < holes, np.nan, x)
        out = {"kind": r.integers(0, 2, m), "grp": r.integers(0, 50, m), "district": r.integers(0, 3, m), "day": gone(r.integers(0, 500, m) * comparables.DAY), "area": gone(r.integers(0, 9, m) * 10.0)}
        out |= {"bedrooms": gone(r.integers(0, 4, m)), "bathrooms": gone(r.integers(0, 4, m)), "latitude": gone(10.7 + r.integers(0, 5, m) / 100), "longitude": 106.6 + r.integers(0, 5, m) / 100, "cbd": gone(r.integers(0, 9, m) * 1.0)}
        return out | {"size": np.where(out["area"] > 0, out["area"], 75.0)}

    for m, k, holes in ((70, 300, 0.1), (33, 3, 0.5), (5, 40, 0.0), (1, 1, 0.9)):
        q, refs = made(m, holes), made(k, holes)
        for tier in comparables.TIERS:
            d = comparables.distances(q, refs, tier, 75.0, 8.0)
            quick, fine = comparables._quick(q, refs, tier, 8.0), np.isfinite(d)
            assert (np.isfinite(quick) == fine).all() and (np.abs(quick[fine] - d[fine]) < comparables.OFF).all()
            best = np.sort(d, axis=1)[:, min(4, k) - 1 : min(4, k)]
            want = {(i, j, d[i, j]) for i, j in zip(*np.nonzero(fine & (d <= best)), strict=True)}
            assert set(zip(*[x.tolist() for x in comparables.closest(q, refs, tier, 75.0, 8.0, 4)], strict=True)) == want


def test_a_search_leaves_one_table(spark, monkeypatch, tmp_path):
    """blocks, batches and rounds go when the search has its result."""
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    rows = spark.range(300).select(F.col("id").cast("string").alias("query_id"), F.lit("t").alias("property_type"), F.lit("d").alias("location_area"), (F.col("id") + 20.0).alias("area"), F.lit(100.0).alias("price"), F.lit("1996-01-01").cast("timestamp").alias("listing_date"))
    found = comparables.find(rows.withColumn("as_of", F.col("listing_date")).where("query_id % 3 = 0"), rows.withColumnRenamed("query_id", "ref_id"), 4)
    assert len(list(tmp_path.glob("domora-*"))) == 1 and found.count() == 400


def test_a_training_run_leaves_its_report(spark, monkeypatch, tmp_path):
    """F8: rows, splits and features go when the report is there."""
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    report = training.run(adapted_listings(spark, SF), candidates=("naive_median",))
    assert len(list(tmp_path.glob("domora-*"))) == 1
    assert sorted(r["predictor"] for r in report.collect()) == ["baseline_naive", "baseline_segment", "naive_median"]
