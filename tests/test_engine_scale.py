"""Selection, ranks, search, identity blocks, sinks and saved packages, and every SQL form on the smallest tables."""

import math
import os
import random
import statistics
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from domora.operators import clean, comparables, identity, joins, ranks, sketches
from domora.operators.graph import components
from domora.plans import catalog
from domora.sources import listings
from domora.streaming import jobs

SF = "/root/testdata/sf0.001"


# -- ranks and quantiles -------------------------------------------------------------------------


def test_ranks_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 5), f"k{i}") for i in range(500)]
    got = ranks.with_rank(spark.createDataFrame(rows, "x int, k string"), [F.desc("x"), F.asc("k")]).collect()
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [(r["x"], r["k"]) for r in sorted(got, key=lambda r: r["rank"])] == want and {r["rank"] for r in got} == set(range(1, 501))
    assert ranks.with_rank(spark.createDataFrame([], "x int, k string"), [F.asc("x"), F.asc("k")]).count() == 0


@pytest.mark.parametrize("small", [1 << 16, 3])
def test_quantiles_by_selection(spark, monkeypatch, small):
    monkeypatch.setattr(ranks, "SMALL_RANGE", small)
    monkeypatch.setattr(ranks, "CELLS", 4)
    rng = random.Random(2)
    groups = {"a": [rng.gauss(0, 1) for _ in range(301)], "b": [7.0] * 200 + [1e12, -3.0], "c": [1.5], None: [1.0, 2.0], "d": [10.0**k for k in range(-20, 20)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("c", float("inf")), ("none", None)]
    frame = spark.createDataFrame(rows, "value string, v double")
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r["value"]: r for r in ranks.quantiles(frame, ["value"], {"q": (F.col("v"), shares), "m": (-F.col("v"), [0.5])}).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.allclose(got[g]["q"], np.quantile(vs, shares), rtol=1e-12) and math.isclose(got[g]["m"][0], -statistics.median(vs), rel_tol=1e-12, abs_tol=1e-300)
    low = {r["value"]: r["q"] for r in ranks.quantiles(frame, ["value"], {"q": (F.col("v"), [0.5, 0.01])}, between=False).collect()}
    for g, vs in groups.items():
        assert low[g] == [sorted(vs)[max(0, math.ceil(p * len(vs)) - 1)] for p in (0.5, 0.01)]


def test_sketches_merge_over_days(spark):
    rng = random.Random(3)
    rows = [(s, d, rng.lognormvariate(0, 2)) for s in ("x", "y") for d in range(5) for _ in range(2000)] + [("z", 0, None)]
    frame = spark.createDataFrame(rows, "slice string, day int, v double")
    kept = sketches.sketched(frame, ["slice", "day"], {"v": F.col("v")})
    got = {r["slice"]: r["v"] for r in sketches.medians(sketches.merged(kept, ["slice"], ["v"]), ["slice"], ["v"]).collect()}
    for s in ("x", "y"):
        vs = sorted(v for t, _, v in rows if t == s)
        assert abs(np.searchsorted(vs, got[s]) / len(vs) - 0.5) <= sketches.RANK_ERROR
    assert got["z"] is None


def test_lookups_beyond_the_bound(spark):
    rows, small = spark.range(200).withColumn("k", F.col("id") % 7), spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = sorted((i, i % 7, i % 7 * 10 if i % 7 < 5 else None) for i in range(200))
    for limit in (100, 2):
        got = sorted((r["id"], r["k"], r["v"]) for r in joins.looked_up(rows, small, ["k"], limit).collect())
        assert got == want


# -- comparables ---------------------------------------------------------------------------------


def test_search_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(comparables, "BLOCK", 16)
    monkeypatch.setattr(comparables, "BATCH", 4)
    monkeypatch.setattr(comparables, "FIRST", 16)
    rng = random.Random(4)

    def made(n, key):
        pick = lambda xs: rng.choice(xs)
        return [
            (f"{key}{i:04d}", pick(["t1", "t2", None]), pick(["d1", "d2", "d3", None]), pick([None, 0.0, *[float(x) for x in range(20, 120, 7)]]), pick([None, 0.0, 2.0, 5.0]), pick([None, 1.0, 3.0]),
             pick([None, 10.75, 10.8, 10.9]), pick([None, 106.6, 106.7]), pick([None, 3.0, 9.0]), pick([None, "g1", "g2", "g3"]), pick([None, *[datetime(2024, 1, 1) + timedelta(days=40 * k) for k in range(14)]]), 100.0 + i)
            for i in range(n)
        ]

    names = ["property_type", "location_area", "area", "bedrooms", "bathrooms", "latitude", "longitude", "distance_to_cbd_km", "property_group_id"]
    kinds = "property_type string, location_area string, area double, bedrooms double, bathrooms double, latitude double, longitude double, distance_to_cbd_km double, property_group_id string"
    qs, rs = made(60, "q"), made(300, "r")
    q = spark.createDataFrame([x[:11] for x in qs], f"query_id string, {kinds}, as_of timestamp")
    r = spark.createDataFrame(rs, f"ref_id string, {kinds}, listing_date timestamp, price double")
    got = {}
    for x in comparables.find(q, r, 3).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["ref_id"], x["tier"], x["distance"]))
    number = lambda v: np.array([np.nan if v is None else v], float)
    text = lambda v, other: np.array([hash(v) if v is not None else other])

    def side(x, other):
        own = dict(zip(names, x[1:10]))
        out = {c: number(own["distance_to_cbd_km" if c == "cbd" else c]) for c in comparables._NUMBERS}
        day = None if x[10] is None else (x[10] - datetime(1970, 1, 1)).total_seconds() * 1e6
        out |= {"kind": text(own["property_type"], other), "district": text(own["location_area"], other), "grp": text(own["property_group_id"], other), "day": number(day)}
        out["size"] = np.where(out["area"] > 0, out["area"], 75.0)
        return out

    refs = [(x[0], side(x, 2)) for x in rs if x[1] is not None]
    for x in qs:
        if x[1] is None:
            assert x[0] not in got
            continue
        own, want = side(x, 1), []
        for tier in comparables.TIERS:
            met = sorted((float(d), i, tier) for i, y in refs if math.isfinite(d := comparables.distances(own, y, tier, 75.0, 8.0)[0, 0]))
            want = met[:3]
            if len(met) >= 3:
                break
        assert [(k, i, t) for k, i, t, _ in sorted(got.get(x[0], []))] == [(k + 1, i, t) for k, (_, i, t) in enumerate(want)]
    assert comparables.find(q, r.limit(0), 3).count() == 0 and comparables.find(q.limit(0), r, 3).count() == 0


# -- identity ------------------------------------------------------------------------------------


def test_large_address_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [
        (f"k{i:04d}", "t", "12 a street", "area", "", "", True, rng.choice([50.0, 51.0, 80.0, 81.0, 90.0, 130.5]) + rng.random(), 5, None, None, rng.choice([None, 1.0, 2.0, 5.0]), rng.choice([None, 1.0]), None, rng.choice([None, 4.0, 4.2, 6.0]), None, rng.choice([None, 10.7, 10.7001, 10.9]), 106.7)
        for i in range(260)
    ]
    rows += [(f"z{i}", *rows[i][1:]) for i in range(40)]
    schema = "ingest_key string, property_type string, loc string, area_key string, ward string, street string, numbered boolean, area double, bucket int, source string, listing_id string, bedrooms double, bathrooms double, floors double, width double, length double, latitude double, longitude double"
    frame = spark.createDataFrame(rows, schema)
    pairs = [(r["a"], r["b"]) for r in identity.strong_pairs(frame).collect()]
    degree = {}
    for p in pairs:
        for x in p:
            degree[x] = degree.get(x, 0) + 1
    want = {(r["node"], r["root"]) for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    for few, tile in ((1000, 1024), (3, 16)):
        monkeypatch.setattr(identity, "FEW", few)
        monkeypatch.setattr(identity, "TILE", tile)
        edges, counts = identity.strong_ties(frame)
        assert {r["ingest_key"]: r["n_strong"] for r in counts.collect()} == degree
        assert {(r["node"], r["root"]) for r in components(edges).collect()} == want
    monkeypatch.setattr(identity, "TILE", 1024)
    assert identity.strong_ties(frame)[0].count() < 4 * len(rows) < len(pairs)


def test_event_ids_carry_their_source(spark):
    kinds = "ingest_key string, price double, area double, property_type string, location string, last_updated_date string, listing_id string, source string"
    rows = [(str(i), 5000.0, 60.0, "Nhà riêng", "12 Nguyễn Huệ, Quận 1", "01/01/2025 10:00", None, s) for i, s in enumerate(["a", "b", "a", None, "sample"])]
    kept = clean.without_copies(identity.grouped(clean.valid(spark.createDataFrame(rows, kinds)))).collect()
    assert sorted(r["ingest_key"] for r in kept) == ["0", "1", "3"]


# -- sinks ---------------------------------------------------------------------------------------


def test_replayed_batches_are_there_once(spark, tmp_path):
    out = str(tmp_path / "scores")
    first, again = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(3,)], "id int")
    jobs.put_batch(first, out, 0)
    jobs.put_batch(again, out, 1)
    jobs.put_batch(first, out, 0)
    assert sorted(r["id"] for r in jobs.read_batches(spark, out).collect()) == [1, 2, 3] and "batch" not in jobs.read_batches(spark, out).columns


def test_reports_are_strict_json(spark, tmp_path):
    import json

    row = spark.sql("select double('nan') as a, array(1.0D, double('inf')) as b, named_struct('x', double('-inf'), 'y', array(named_struct('z', float('nan')))) as c, map('k', double('nan'), 'l', 2.0D) as d, 'NaN' as e")
    listings.write_report(row, str(tmp_path / "r"))
    strict = lambda x: pytest.fail(f"not strict: {x}")
    got = json.loads(spark.read.text(str(tmp_path / "r")).first()[0], parse_constant=strict)
    assert got == {"a": None, "b": [1.0, None], "c": {"x": None, "y": [{"z": None}]}, "d": {"k": None, "l": 2.0}, "e": "NaN"}


def test_a_package_is_published_whole_or_not_at_all(spark, tmp_path):
    base = str(tmp_path / "model")

    def writer(text):
        return lambda path: spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/package")

    def broken(path):
        writer("half")(path)
        raise RuntimeError("broke off")

    with pytest.raises(FileNotFoundError):
        listings.current_version(spark, base)
    listings.publish(spark, base, writer("one"))
    with pytest.raises(RuntimeError):
        listings.publish(spark, base, broken)
    read = lambda: spark.read.text(f"{listings.current_version(spark, base)}/package").first()[0]
    assert read() == "one"
    listings.publish(spark, base, writer("two"))
    assert read() == "two"


# -- every SQL form ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return con


def _plain(frame):
    def cell(v):
        if v is None or v != v:
            return ""
        return f"{float(v):.9g}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_queries_as_their_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and _plain(got) == _plain(want)
