"""Which listings describe the same property."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domora.functions.geo import METRES, haversine
from domora.functions.numeric import relative_difference
from domora.functions.text import chunks_of, normalised, signature, street_in, ward_in
from domora.operators.graph import components
from domora.operators.joins import looked_up_side
from domora.session import materialise, temporary

AREA_STEP, REACH = 10, 2
STRONG_AREA, MEDIUM_AREA, WEAK_AREA, STRONG_METRES = 0.03, 0.05, 0.10, 50
#: Of an address as it is given; on the normalised one it finds the same.
HOUSE_NUMBER = r"(?U)^\s*\d+[\w/.-]*\s+[^\d\s]"
_STRUCTURE = ["bedrooms", "bathrooms", "floors", "width", "length", "latitude", "longitude"]

#: What `resolve`, `group_parts` and `audit` read of listings.
READ = ["ingest_key", "property_type", "location", "location_area", "area", "source", "listing_id", *_STRUCTURE]


def prepared(listings: DataFrame) -> DataFrame:
    """Keys of the comparison beside the columns it needs."""
    # the address is normalised and cut once, in projections of their own
    rows = listings.withColumn("_loc", normalised(F.col("location"))).withColumn("_parts", chunks_of(F.col("_loc")))
    return rows.select(
        "ingest_key", "property_type", F.col("_loc").alias("loc"), F.col("location_area").alias("area_key"), ward_in(F.col("_parts")).alias("ward"), street_in(F.col("_parts")).alias("street"),
        F.coalesce(F.col("location").rlike(HOUSE_NUMBER), F.lit(False)).alias("numbered"), "area", F.floor(F.col("area") / AREA_STEP).cast("int").alias("bucket"), "source", "listing_id", *_STRUCTURE,
    )


def _structure() -> Column:
    ok = F.lit(True)
    for c in ("bedrooms", "bathrooms", "floors"):
        ok = ok & F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= 1, F.lit(True))
    for c in ("width", "length"):
        ok = ok & F.coalesce(relative_difference(F.col(f"a.{c}"), F.col(f"b.{c}")) <= 0.08, F.lit(True))
    return ok


def _metres() -> Column:
    return haversine(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude"), METRES)


def strong_pairs(rows: DataFrame) -> DataFrame:
    """a, b (a < b): equal type and numbered address, similar area and structure. An equi-join on the address.

    Both sides are the same rows, so that they are cleaned, shuffled and sorted once, by a hash of the address first.
    """
    keyed = rows.where("numbered and property_type <> ''").select("ingest_key", *_SHAPE, F.xxhash64("property_type", "loc").alias("address"))
    a, b = keyed.alias("a"), keyed.alias("b")
    near = relative_difference(F.col("a.area"), F.col("b.area")) <= STRONG_AREA
    on = (F.col("a.address") == F.col("b.address")) & (F.col("a.loc") == F.col("b.loc")) & (F.col("a.property_type") == F.col("b.property_type")) & (F.col("a.ingest_key") < F.col("b.ingest_key"))
    return a.join(b, on & near & _structure() & F.coalesce(_metres() <= STRONG_METRES, F.lit(True))).select(F.col("a.ingest_key").alias("a"), F.col("b.ingest_key").alias("b"))


#: Shapes of an address that are compared in one block, and shapes of a band above which blocks take the place of a join.
TILE, FEW = 1024, 64
_SHAPE = ["property_type", "loc", "area", *_STRUCTURE]


def shapes(rows: DataFrame) -> DataFrame:
    """Distinct listings of numbered addresses by what strong pairs compare: first (least ingest_key), n, band.

    Listings of one shape are all strong pairs of each other. Areas within reach of a strong pair lie in one band or
    in neighbouring ones.
    """
    found = rows.where("numbered and property_type <> ''").groupBy(*_SHAPE).agg(F.min("ingest_key").alias("first"), F.count("*").alias("n"))
    step = F.log(F.lit(1 / (1 - STRONG_AREA)))
    return found.withColumn("band", F.floor(F.log(F.greatest("area", F.lit(1.0))) / step).cast("int"))


def _compatible(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> np.ndarray:
    """Which shapes of two blocks are strong pairs, as a matrix; nulls are NaN and compatible with anything."""
    col = {k: v[:, None] for k, v in x.items()}

    def relative(c: str) -> np.ndarray:
        return np.abs(col[c] - y[c]) / np.maximum(np.maximum(np.abs(col[c]), np.abs(y[c])), 1.0)

    ok = relative("area") <= STRONG_AREA
    for c in ("bedrooms", "bathrooms", "floors"):
        ok &= ~(np.abs(col[c] - y[c]) > 1)
    for c in ("width", "length"):
        ok &= ~(relative(c) > 0.08)
    lat, lon = np.radians(col["latitude"]), np.radians(col["longitude"])
    h = np.sin((np.radians(y["latitude"]) - lat) / 2) ** 2 + np.cos(lat) * np.cos(np.radians(y["latitude"])) * np.sin((np.radians(y["longitude"]) - lon) / 2) ** 2
    return ok & ~(2 * METRES * np.arcsin(np.sqrt(np.clip(h, 0, 1))) > STRONG_METRES)


def _forest(ok: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that connect whatever the matrix connects: fewer than rows and columns."""
    rows_left, columns_left, out = np.ones(len(ok), bool), np.ones(ok.shape[1], bool), []
    for start in range(len(ok)):
        if not rows_left[start]:
            continue
        rows_left[start] = False
        queue = [start]
        while queue:
            i = queue.pop()
            fresh = np.flatnonzero(ok[i] & columns_left)
            columns_left[fresh] = False
            out += [(i, j) for j in fresh.tolist()]
            for j in fresh.tolist():
                more = np.flatnonzero(ok[:, j] & rows_left)
                rows_left[more] = False
                out += [(k, j) for k in more.tolist()]
                queue += more.tolist()
    return out


def _tiles(found: DataFrame, large: DataFrame) -> DataFrame:
    """first, other, near: tied shapes and listings near a shape, for addresses with a large band. A row has other or near."""
    address = ["property_type", "loc"]
    rows = found.join(large.select(*address, "blocks"), address)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("first"), "blocks").cast("int"))
    held = materialise(rows.groupBy(*address, "band", "salt").agg(F.collect_list(F.struct("first", "n", "area", *_STRUCTURE)).alias("all")))  # about TILE shapes each
    a = held.select(*address, F.col("band").alias("band_a"), F.col("salt").alias("salt_a"), F.col("all").alias("x"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    met = a.join(held.withColumnRenamed("all", "y"), [*address, "band"]).where("band > band_a or salt >= salt_a").select((F.expr("band = band_a and salt = salt_a")).alias("same"), "x", "y")

    def side(column: pa.ListArray, k: int) -> tuple[pa.Array, np.ndarray, dict[str, np.ndarray]]:
        rows = column.values[column.offsets[k].as_py() : column.offsets[k + 1].as_py()]
        return rows.field("first"), rows.field("n").to_numpy(), {c: rows.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("area", *_STRUCTURE)}

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                (first, n, x), (other, m, y) = side(batch.column("x"), k), side(batch.column("y"), k)
                ok = _compatible(x, y)
                same = batch.column("same")[k].as_py()
                if same:
                    np.fill_diagonal(ok, False)
                edges = np.array(_forest(ok), np.int64).reshape(-1, 2)
                near_x, near_y = ok @ m, ok.T @ n
                i, j = np.flatnonzero(near_x), np.zeros(0, np.int64) if same else np.flatnonzero(near_y)
                names = pa.chunked_array([first.take(pa.array(edges[:, 0])), first.take(pa.array(i)), other.take(pa.array(j))]).combine_chunks()
                ties = pa.chunked_array([other.take(pa.array(edges[:, 1])), pa.nulls(len(i) + len(j), other.type)]).combine_chunks()
                near = pa.array([None] * len(edges) + near_x[i].tolist() + near_y[j].tolist(), pa.int64())
                yield pa.RecordBatch.from_arrays([names, ties, near], names=["first", "other", "near"])

    kind = found.schema["first"].dataType.simpleString()
    return met.mapInArrow(run, f"first {kind}, other {kind}, near long")


def repeated(rows: DataFrame) -> DataFrame:
    """Listings of numbered addresses that more than one listing has, written once; a few others may be among them.

    Addresses are counted by 64-bit hashes, so that only short keys of the single ones, which are most, are shuffled.
    What has equal hashes and differs is told apart by whoever compares the listings.
    """
    known = rows.where("numbered and property_type <> ''").select("ingest_key", *_SHAPE, F.xxhash64("property_type", "loc").alias("_address"))
    more = known.groupBy("_address").agg(F.count("*").alias("n")).where("n > 1").select("_address")
    return materialise(known.join(looked_up_side(more), "_address", "left_semi").drop("_address").withColumn("numbered", F.lit(True)))


def strong_ties(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges a, b that connect what strong pairs connect, ingest_key and n_strong of each listing with strong pairs).

    Listings become shapes. Where no band of an address has more than FEW of them, shapes meet in a join of bounded
    fan-out; where one has, blocks of neighbouring bands meet in numpy and give a forest and counts, so that edges
    stay in proportion to shapes, not to their pairs.
    """
    rows = repeated(rows)
    found = materialise(shapes(rows))
    address = ["property_type", "loc"]
    bands = found.groupBy(*address, "band").agg(F.count("*").alias("m"))
    many = bands.groupBy(*address).agg(F.max("m").alias("m"), F.sum("m").alias("all")).where("all > 1")
    many = materialise(many.withColumn("blocks", F.ceil(F.col("m") / TILE).cast("int")))
    small = found.join(many.where(F.col("m") <= FEW).select(*address), address, "left_semi")
    a = small.withColumn("near_band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1))).alias("a")
    b = small.alias("b")
    on = (F.col("a.property_type") == F.col("b.property_type")) & (F.col("a.loc") == F.col("b.loc")) & (F.col("a.near_band") == F.col("b.band")) & (F.col("a.first") != F.col("b.first"))
    strong = (relative_difference(F.col("a.area"), F.col("b.area")) <= STRONG_AREA) & _structure() & F.coalesce(_metres() <= STRONG_METRES, F.lit(True))
    # both directions, so that a shape's row counts all that is near
    joined = a.join(b, on & strong).select(F.col("a.first").alias("first"), F.when(F.col("a.first") < F.col("b.first"), F.col("b.first")).alias("other"), F.col("b.n").alias("near"))
    ties = materialise(joined.unionByName(_tiles(found, many.where(F.col("m") > FEW))))
    near = ties.groupBy("first").agg(F.coalesce(F.sum("near"), F.lit(0)).alias("near"))
    counts = found.select("first", (F.col("n") - 1).alias("own")).join(near, "first", "left").select("first", (F.col("own") + F.coalesce("near", F.lit(0))).alias("n_strong")).where("n_strong > 0")
    on = F.lit(True)
    for c in _SHAPE:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    members = materialise(rows.where("numbered and property_type <> ''").alias("r").join(found.alias("s"), on).select("r.ingest_key", "s.first"))
    edges = ties.where("other is not null").select(F.col("first").alias("a"), F.col("other").alias("b")).unionByName(members.where("ingest_key <> first").select(F.col("first").alias("a"), F.col("ingest_key").alias("b")))
    return edges, members.join(counts, "first").select("ingest_key", "n_strong")


def medium_pairs(rows: DataFrame) -> DataFrame:
    """a, b (a < b): same ward, no distance known, streets equal or one missing; strong pairs excluded."""
    spread = rows.where("ward <> '' and property_type <> ''").withColumn("near_bucket", F.explode(F.sequence(F.col("bucket") - REACH, F.col("bucket") + REACH)))
    a, b = rows.where("ward <> ''").alias("a"), spread.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("property_type", "area_key", "ward")]
    streets = (F.col("a.street") == F.col("b.street")) | (F.col("a.street") == "") | (F.col("b.street") == "")
    area = relative_difference(F.col("a.area"), F.col("b.area"))
    strong = (F.col("a.loc") == F.col("b.loc")) & F.col("a.numbered") & (area <= STRONG_AREA)
    cond = on[0] & on[1] & on[2] & (F.col("a.bucket") == F.col("b.near_bucket")) & (F.col("a.ingest_key") < F.col("b.ingest_key")) & streets & (area <= MEDIUM_AREA) & _structure() & _metres().isNull() & ~strong
    return a.join(b, cond).select(F.col("a.ingest_key").alias("a"), F.col("b.ingest_key").alias("b"))


#: Shapes of a ward that meet in one group, and rows of a block that are compared at once.
WARD_TILE, WARD_ROWS = 16384, 256


def _medium_between(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> int:
    """Sum of n_i * n_j over the rows i of x and j of y that make medium pairs; x and y are one ward's, sorted by area.

    What is compatible with each distinct value of a column is a row of bits; a pair needs a bit in the rows of all
    columns. Counts go as planes of binary digits. Only areas within reach of a block of x are looked at.
    """
    total = 0
    for start in range(0, len(x["area"]), WARD_ROWS):
        a = {c: v[start : start + WARD_ROWS] for c, v in x.items()}
        slack = MEDIUM_AREA / (1 - MEDIUM_AREA) * np.maximum(np.abs(a["area"]), 1.0) + 1e-6
        lo, hi = np.searchsorted(y["area"], (a["area"] - slack).min(), "left"), np.searchsorted(y["area"], (a["area"] + slack).max(), "right")
        if lo == hi:
            continue
        b = {c: v[lo:hi] for c, v in y.items()}

        def bits(ok: np.ndarray) -> np.ndarray:
            packed = np.packbits(ok, axis=1)
            return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)

        def rows_of(column: str, test) -> np.ndarray:
            values, at = np.unique(a[column], return_inverse=True)
            return bits(test(values[:, None], b[column]))[at]

        def relative(v: np.ndarray, w: np.ndarray) -> np.ndarray:
            return np.abs(v - w) / np.maximum(np.maximum(np.abs(v), np.abs(w)), 1.0)

        mask = rows_of("area", lambda v, w: (relative(v, w) <= MEDIUM_AREA) & (np.abs(np.floor(v / AREA_STEP) - np.floor(w / AREA_STEP)) <= REACH))
        mask &= rows_of("street", lambda v, w: (v == w) | (v == 0) | (w == 0))
        for c in ("bedrooms", "bathrooms", "floors"):
            mask &= rows_of(c, lambda v, w: ~(np.abs(v - w) > 1))
        for c in ("width", "length"):
            mask &= rows_of(c, lambda v, w: ~(relative(v, w) > 0.08))
        mask &= rows_of("located", lambda v, w: ~(v & w))
        if np.isin(a["address"], b["address"][b["address"] != 0]).any():
            same = rows_of("address", lambda v, w: (v == w) & (v != 0))
            mask &= ~(same & rows_of("area", lambda v, w: relative(v, w) <= STRONG_AREA))
        near, digit = np.zeros(len(mask), np.int64), 0
        while (b["n"] >> digit).any():
            plane = bits(((b["n"] >> digit) & 1).astype(bool)[None, :])
            near += np.bitwise_count(mask & plane).sum(axis=1, dtype=np.int64) << digit
            digit += 1
        total += sum((near.astype(object) * a["n"]).tolist()) if near.max() > 1 << 30 else int(near @ a["n"])
    return total


def count_medium(rows: DataFrame) -> DataFrame:
    """medium_pairs: how many `medium_pairs` there are, without listing them.

    Listings of a ward become shapes with counts, told apart by what medium pairs compare; streets and numbered
    addresses by 64-bit hashes. Shapes meet as bits, a few for each word of a bitmap. A ward with more than WARD_TILE
    of them is dealt into parts, and each two parts are a group, so that no task holds a ward of any size.
    """
    ward = ["property_type", "area_key", "ward"]
    hashed = {"street": F.when(F.col("street") == "", F.lit(0)).otherwise(F.xxhash64("street")), "address": F.when(F.col("numbered"), F.xxhash64("loc")).otherwise(F.lit(0))}
    located = (F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("located")
    compared = ["street", "address", "area", *_STRUCTURE[:5], "located"]
    known = rows.where("ward <> '' and property_type <> '' and area_key is not null and area is not null").withColumns(hashed)
    found = materialise(known.select(*ward, *compared[:-1], located).groupBy(*ward, *compared).agg(F.count("*").alias("n")))
    wards = found.groupBy(*ward).agg(F.count("*").alias("m")).where(F.col("m") > WARD_TILE)
    blocks = looked_up_side(wards.select(*ward, F.ceil(F.col("m") / WARD_TILE).cast("int").alias("blocks")))
    dealt = found.join(blocks, ward, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64(*compared), "blocks").cast("int")).withColumn("t", F.explode(F.expr("sequence(0, blocks - 1)")))
    met = dealt.withColumns({"lower": F.least("salt", "t"), "upper": F.greatest("salt", "t")}).drop("t", "blocks")
    floats = {"area", *_STRUCTURE[:5]}

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("area")
        columns = {c: group.column(c).to_numpy().astype(float) if c in floats else group.column(c).to_numpy() for c in (*compared, "n")}
        salt, lower, upper = group.column("salt").to_numpy(), group.column("lower")[0].as_py(), group.column("upper")[0].as_py()
        if lower == upper:
            # a listing is no pair with itself, and each pair is counted from both sides
            n, unlocated = columns["n"], ~columns["located"] & (columns["address"] == 0)
            pairs = (_medium_between(columns, columns) - int(n[unlocated].sum())) // 2
        else:
            x, y = ({c: v[salt == k] for c, v in columns.items()} for k in (lower, upper))
            pairs = _medium_between(x, y)
        return pa.table({"pairs": pa.array([pairs], pa.int64())})

    return met.groupBy(*ward, "lower", "upper").applyInArrow(run, "pairs long").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("medium_pairs"))


def weak_reach(rows: DataFrame) -> DataFrame:
    """property_type, area_key, area, n, reach: listings of each area, and how many (itself too) lie within weak reach.

    Counts of equal areas are joined instead of listings, so the work grows with distinct areas.
    """
    counts = rows.where("property_type <> ''").groupBy("property_type", "area_key", "area", "bucket").agg(F.count("*").alias("n"))
    spread = counts.withColumn("near_bucket", F.explode(F.sequence(F.col("bucket") - REACH, F.col("bucket") + REACH))).alias("b")
    a, b = counts.alias("a"), spread
    cond = (F.col("a.property_type") == F.col("b.property_type")) & (F.col("a.area_key") == F.col("b.area_key")) & (F.col("a.bucket") == F.col("b.near_bucket"))
    near = relative_difference(F.col("a.area"), F.col("b.area")) <= WEAK_AREA
    return a.join(b, cond & near).groupBy("a.property_type", "a.area_key", "a.area").agg(F.max("a.n").alias("n"), F.sum("b.n").alias("reach"))


def key_links(rows: DataFrame) -> DataFrame:
    """a, b: each listing with a source id tied to the first of its id."""
    own = F.nullif(F.trim("listing_id"), F.lit(""))
    keyed = rows.select("ingest_key", F.coalesce(F.nullif(normalised(F.col("source")), F.lit("")), F.lit("default")).alias("s"), own.alias("i")).where("i is not null")
    return keyed.withColumn("b", F.min("ingest_key").over(Window.partitionBy("s", "i"))).where("ingest_key <> b").select(F.col("b").alias("a"), F.col("ingest_key").alias("b"))


def resolve(listings: DataFrame) -> DataFrame:
    """ingest_key, group_key (first ingest_key of the group), group_size, identity_confidence, possible_duplicate."""
    with temporary(listings.sparkSession) as kept:
        # wards and streets are for medium pairs
        return kept(_resolved(materialise(prepared(listings).drop("ward", "street")))[0])


def _resolved(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolve's rows, strong pairs of each listing) of prepared rows."""
    with temporary(rows.sparkSession) as kept:
        edges, degree = strong_ties(rows)
        degree = kept(degree)
        roots = kept(components(edges.unionByName(key_links(rows))))
    # groups of one are in none of these tables; a group of any size is counted in parts
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    tied = roots.join(sizes, "root").withColumnRenamed("node", "ingest_key").join(degree, "ingest_key", "full")
    # as many rows as there are distinct areas
    near = looked_up_side(weak_reach(rows).drop("n"))
    out = rows.select("ingest_key", "property_type", "area_key", "area").join(near, ["property_type", "area_key", "area"], "left")
    review = F.coalesce(F.col("reach"), F.lit(1)) - 1
    out = out.select("ingest_key", review.alias("near")).join(looked_up_side(tied), "ingest_key", "left")
    out = out.select(
        "ingest_key", F.coalesce("root", "ingest_key").alias("group_key"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), (F.col("near") - F.coalesce(F.col("n_strong"), F.lit(0)) > 0).alias("possible_duplicate"),
    )
    level = F.when(F.col("group_size") > 1, "strong").when(F.col("possible_duplicate"), "weak").otherwise("singleton")
    return out.select("ingest_key", "group_key", "group_size", level.alias("identity_confidence"), "possible_duplicate"), degree


def property_signature(df: DataFrame) -> Column:
    parts = [(normalised(F.col("location")), None), (F.col("property_type"), None), (F.col("area"), 0), (F.col("width"), 1), (F.col("length"), 1), (F.col("bedrooms"), 0), (F.col("bathrooms"), 0), (F.col("latitude"), 4), (F.col("longitude"), 4)]
    return signature(parts)


def group_id() -> Column:
    """property_group_id of the rows of `group_parts`."""
    return F.concat_ws("_", F.lit("property"), F.lower(F.hex("_sig")), F.coalesce("_root", "ingest_key"))


def group_parts(listings: DataFrame, columns: list[str]) -> DataFrame:
    """The columns (ingest_key too) with _sig and _root, which make the group's id, identity_confidence and possible_duplicate.

    _sig: the signature of the group's first listing, as 16 bytes; _root: that listing, null where it is the row itself.
    """
    found = resolve(listings)
    # a group of one has its own signature; those of other groups are read for their first listings only
    sig = F.unhex(property_signature(listings))
    roots = looked_up_side(found.where("group_size > 1 and ingest_key = group_key").select("ingest_key"))
    first = listings.join(roots, "ingest_key", "left_semi").select(F.col("ingest_key").alias("group_key"), sig.alias("sig"))
    several = found.where("group_size > 1").join(first, "group_key")
    ids = found.where("group_size = 1").withColumn("sig", F.lit(None).cast("binary")).unionByName(several)
    # signatures go with the rows, not what they are made of
    own = listings.select(*columns, sig.alias("_own"))
    root = F.when(F.col("group_key") != F.col("ingest_key"), F.col("group_key"))
    rows = own.join(ids.select("ingest_key", root.alias("_root"), "sig", "identity_confidence", "possible_duplicate"), "ingest_key")
    return rows.select(*columns, F.coalesce("sig", "_own").alias("_sig"), "_root", "identity_confidence", "possible_duplicate")


def grouped(listings: DataFrame) -> DataFrame:
    """listings with property_group_id, identity_confidence and possible_duplicate."""
    rows = group_parts(listings, listings.columns)
    return rows.select(*listings.columns, group_id().alias("property_group_id"), "identity_confidence", "possible_duplicate")


def audit(listings: DataFrame) -> DataFrame:
    """Groups, their sizes and pairs by level, which are counted without listing them."""
    with temporary(listings.sparkSession) as kept:
        return kept(_audited(materialise(prepared(listings))))


def _audited(rows: DataFrame) -> DataFrame:
    groups, degree = _resolved(rows)
    sizes = groups.groupBy("group_key").agg(F.count("*").alias("n"))
    out = sizes.agg(F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("multi_listing_groups"), F.max("n").alias("largest_group"))
    strong = degree.agg(F.coalesce(F.sum("n_strong") / 2, F.lit(0)).cast("long").alias("strong_pairs"))
    keys, medium = key_links(rows).agg(F.count("*").alias("key_links")), count_medium(rows)
    within = weak_reach(rows).agg(F.sum(F.col("n") * (F.col("reach") - 1) / 2).cast("long").alias("pairs_in_reach"))
    for one in (strong, keys, medium, within):
        out = out.crossJoin(F.broadcast(one))  # one row each
    return out.select("groups", "multi_listing_groups", "largest_group", "strong_pairs", "key_links", "medium_pairs", (F.col("pairs_in_reach") - F.col("strong_pairs") - F.col("medium_pairs")).alias("weak_pairs"))
