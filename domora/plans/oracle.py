"""DuckDB SQL of the registered queries, written apart from the DataFrame plans."""

from __future__ import annotations

import re

from domora.functions import config as C
from domora.sources.listings import ADAPTER, WITH_COPIES

CUTS = ("1996-01-01", "1997-01-01", "1998-01-01")
MISSING_COLUMNS = ["price", "area", "bedrooms", "bathrooms", "floors", "width", "length", "alley_width", "direction", "position", "road_type", "latitude", "longitude", "listing_date", "listing_id", "title"]
RANGE_COLUMNS = ["area", "bedrooms", "bathrooms", "floors", "width", "length", "alley_width", "latitude", "longitude"]
REQUEST_AREAS = ["Quận 1", "Quận 3", "Quận 12", "Quận Gò Vấp", "TP. Thủ Đức", "Unknown"]
LEXICON = {"reported": ["the", "der", "les"], "legal": ["license", "apache"], "english": ["this is", "of the"]}
NEGATION = r"(?:not|nicht|pas)\s+"
QUANTILE = 0.5

_TEXT = r"trim(regexp_replace(lower(nfc_normalize(coalesce(location, ''))), '\s+', ' ', 'g'))"
_AREA = (
    "case when contains(loc, 'quận 2') or contains(loc, 'quận 9') or contains(loc, 'thủ đức') then 'TP. Thủ Đức' "
    r"when regexp_extract(loc, 'quận\s+(1[0-2]|[1-8])(?:[^0-9]|$)', 1) <> '' then 'Quận ' || regexp_extract(loc, 'quận\s+(1[0-2]|[1-8])(?:[^0-9]|$)', 1) "
    + " ".join(f"when contains(loc, '{k}') then '{v}'" for k, v in C.NAMED_AREAS.items())
    + " else 'Unknown' end"
)
_TYPES = ", ".join(f"'{t}'" for t in C.RESIDENTIAL_TYPES)
_OPTIONAL = " and ".join(f"({c} is null or {c} between {lo} and {hi})" for c, (lo, hi) in C.OPTIONAL_RANGES.items())
_GPS = f"coalesce(latitude between {C.LATITUDE_RANGE[0]} and {C.LATITUDE_RANGE[1]} and longitude between {C.LONGITUDE_RANGE[0]} and {C.LONGITUDE_RANGE[1]}, false)"
_DUCK_ADAPTER = re.sub(r"\{(\w+)\}", r"\1", ADAPTER)

BASE = f"""with recursive adapted as (select * replace (nfc_normalize(location) as location, nfc_normalize(source) as source) from ({_DUCK_ADAPTER})), listings as ({WITH_COPIES}),
located as (select *, {_TEXT} as loc from listings),
tagged as (select * exclude (latitude, longitude, updated_at, scraped_at), {_AREA} as location_area,
  case when {_GPS} then latitude end as latitude, case when {_GPS} then longitude end as longitude,
  coalesce(updated_at, scraped_at) as listing_date, scraped_at as observed_at, (updated_at is null)::int as listing_date_missing,
  case when updated_at is not null then 'listing_date' when scraped_at is not null then 'scrape_time_proxy' else 'unknown' end as date_source,
  case when updated_at is not null then 'known' when scraped_at is not null then 'proxy' else 'unknown' end as temporal_status,
  case when property_type is null or property_type not in ({_TYPES}) then 'unsupported_property_type'
    when not coalesce(price >= 100 and price < 50000 and area >= 5 and area < 500 and price / area >= 10 and {_OPTIONAL}, false) then 'numeric_or_price_outliers' end as reject_reason
  from located),
valid as (select * from tagged where reject_reason is null),
train as (select * from valid where listing_date < '{CUTS[0]}'),
validation as (select * from valid where listing_date >= '{CUTS[0]}' and listing_date < '{CUTS[1]}'),
calibration as (select * from valid where listing_date >= '{CUTS[1]}' and listing_date < '{CUTS[2]}'),
test as (select * from valid where listing_date >= '{CUTS[2]}')"""


def _days(later: str, earlier: str) -> str:
    return f"floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0)::int"


def _km(a: str, b: str, c: str, d: str, radius: float = 6371.0) -> str:
    h = f"pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)"
    return f"case when {h} is not null then 2 * {radius} * asin(sqrt(least(greatest({h}, 0.0), 1.0))) end"


_CBD = _km("latitude", "longitude", str(C.CENTRE[0]), str(C.CENTRE[1]))
_KNOWN = " + ".join(f"({c} is not null{' and ' + c + chr(60) + chr(62) + repr(C.UNKNOWN_VALUE) if c in ('direction', 'position') else ''})::int" for c in C.QUALITY_COLUMNS)
_COMPLETE = f"round_even(({_KNOWN}) / 10.0 * 100, 1)"
_MISSING = {"gps_missing": "latitude is null or longitude is null"} | {f"{c}_missing": f"{c} is null" for c in ("width", "length", "bedrooms", "bathrooms", "floors", "road_type", "alley_width")}


def _flag(text: str, words: list[str], negation: str, supplied: str | None = None) -> str:
    any_word = "|".join(words)
    found = f"regexp_matches(regexp_replace({text}, '{negation}(?:{any_word})', '', 'g'), '{any_word}')::int"
    return f"case when trim({text}) = '' and {supplied} is not null then least(greatest({supplied}, 0), 1)::int else {found} end" if supplied else found


_LISTING_TEXT = "lower(coalesce(title, '') || ' ' || coalesce(description, ''))"
_FLAGS = {f: _flag(_LISTING_TEXT, w, C.NEGATION, "supplied_furniture" if f == "has_furniture" else None) for f, w in C.KEYWORDS.items()}
_PLAIN_FLAGS = {f: _flag(_LISTING_TEXT, w, C.NEGATION) for f, w in C.KEYWORDS.items()}
_CHUNKS = "list_transform(string_split(loc, ','), lambda x: trim(x))"
_WARD = f"coalesce(list_filter({_CHUNKS}, lambda x: contains(x, 'phường') or contains(x, 'xã'))[1], '')"
_STREET = f"coalesce(list_filter({_CHUNKS}, lambda x: contains(x, 'đường') or contains(x, 'hẻm'))[1], '')"


def _sig(c: str, digits: int | None = None) -> str:
    return f"coalesce({c}, 'missing')" if digits is None else f"coalesce(round_even({c} * {10**digits}, 0)::bigint::varchar, 'missing')"


_SIGNATURE = "md5(concat_ws('|', " + ", ".join([_sig("loc"), _sig("property_type"), _sig("area", 0), _sig("width", 1), _sig("length", 1), _sig("bedrooms", 0), _sig("bathrooms", 0), _sig("latitude", 4), _sig("longitude", 4)]) + "))"


def _rel(c: str) -> str:
    return f"abs(a.{c} - b.{c}) / greatest(abs(a.{c}), abs(b.{c}), 1.0)"


_STRUCT = " and ".join([f"coalesce(abs(a.{c} - b.{c}) <= 1, true)" for c in ("bedrooms", "bathrooms", "floors")] + [f"coalesce({_rel(c)} <= 0.08, true)" for c in ("width", "length")])
_METRES = _km("a.latitude", "a.longitude", "b.latitude", "b.longitude", 6371000.0)
_STRONG = f"(a.loc = b.loc and a.numbered and {_rel('area')} <= 0.03 and {_STRUCT} and coalesce({_METRES} <= 50, true))"
_MEDIUM = f"(({_METRES}) is null and a.location_area = b.location_area and a.ward <> '' and a.ward = b.ward and (a.street = b.street or a.street = '' or b.street = '') and {_rel('area')} <= 0.05 and {_STRUCT})"
IDENTITY = f"""{BASE},
ident as materialized (select *, {_WARD} as ward, {_STREET} as street, regexp_matches(loc, '^[0-9]+[0-9a-z/.-]*\\s+[^0-9]') as numbered, floor(area / 10)::int as bucket from valid),
pairs as materialized (select a.ingest_key as a, b.ingest_key as b, case when {_STRONG} then 'strong' when {_MEDIUM} then 'medium' when {_rel('area')} <= 0.10 then 'weak' end as level
  from ident a join ident b on a.property_type = b.property_type and a.location_area = b.location_area and a.ingest_key < b.ingest_key and abs(a.bucket - b.bucket) <= 2
  where {_rel('area')} <= 0.10),
firsts as (select min(ingest_key) over (partition by lower(source), trim(listing_id)) as a, ingest_key as b from ident where trim(listing_id) <> ''),
keys as (select * from firsts where a <> b),
links as materialized (select a, b from pairs where level = 'strong' union select b, a from pairs where level = 'strong' union select a, b from keys union select b, a from keys),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b),
roots as materialized (select a as ingest_key, least(a, min(b)) as root from reach group by a),
marked as (select distinct x from (select a as x from pairs where level <> 'strong' union all select b from pairs where level <> 'strong')),
groups as materialized (select i.ingest_key, coalesce(r.root, i.ingest_key) as group_key, count(*) over (partition by coalesce(r.root, i.ingest_key)) as group_size, m.x is not null as possible_duplicate
  from ident i left join roots r on r.ingest_key = i.ingest_key left join marked m on m.x = i.ingest_key)"""

_SEG = """seg as (select property_type, location_area, median(price) as m from train group by all), overall as (select median(price) as global_median from train)"""


def _pred(part: str) -> str:
    return f"pred as (select t.*, global_median, coalesce(m, global_median) as prediction from {part} t left join seg using (property_type, location_area) cross join overall)"


_INTERVAL = f"{_SEG}, {_pred('test')}, scored as (select *, greatest(exp(ln(1 + prediction) - {QUANTILE}) - 1, 0.0) as lower, exp(ln(1 + prediction) + {QUANTILE}) - 1 as upper from pred)"
_E = "abs(price - prediction)"


def _bins(c: str, edges: list, labels: list[str]) -> str:
    return "case " + " ".join(f"when {c} > {lo} and {c} <= {'1e300' if hi == float('inf') else hi} then '{x}'" for lo, hi, x in zip(edges[:-1], edges[1:], labels, strict=True)) + " end"


_PRICE_BINS = ([0.0, 5000.0, 10000.0, 15000.0, float("inf")], ["<5000", "5000-10000", "10000-15000", ">15000"])
_COMPLETE_BINS = ([0.0, 60.0, 80.0, 100.1], ["<60", "60-80", ">=80"])
_CBD_BINS = ([0.0, 5.0, 10.0, float("inf")], ["<5", "5-10", ">10"])
_SLICES = f"""{_INTERVAL}, sl as (select *, unnest([struct_pack(d := 'property_type', v := property_type), struct_pack(d := 'location_area', v := location_area), struct_pack(d := 'price', v := {_bins('price', *_PRICE_BINS)}),
  struct_pack(d := 'completeness', v := {_bins(_COMPLETE, *_COMPLETE_BINS)}), struct_pack(d := 'cbd', v := {_bins(_CBD, *_CBD_BINS)})]) as s from scored),
agg as (select s.d as dimension, s.v as value, count(*) as n, round(avg({_E}), 4) as mae, round(median({_E}), 4) as median_ae, round(sum({_E}) / sum(abs(price)) * 100, 2) as wape, round(avg((price between lower and upper)::int) * 100, 4) as coverage_percent,
  round(avg(upper - lower), 4) as mean_width, round(median(upper - lower), 4) as median_width, round(median((upper - lower) / greatest(price, 100.0)) * 100, 4) as median_relative_width from sl where s.v is not null group by all),
listed(dimension, value) as (values {', '.join(f"('{d}', '{x}')" for d, (_, ls) in (('price', _PRICE_BINS), ('completeness', _COMPLETE_BINS), ('cbd', _CBD_BINS)) for x in ls)})
select dimension, value, coalesce(n, 0)::bigint as n, mae, median_ae, wape, coverage_percent, mean_width, median_width, median_relative_width from agg full join listed using (dimension, value)"""

_GEO = _km("q.latitude", "q.longitude", "r.latitude", "r.longitude")
_DIST = f"""0.30 * least(abs(r.area - q.area) / greatest(q.area, 10.0), 2.0) + 0.25 * coalesce(case when ({_GEO}) is not null then least(({_GEO}) / 5, 2.0) end, case when q.location_area = r.location_area then 0.15 else 0.8 end)
  + 0.15 * least(abs(coalesce(r.bedrooms, coalesce(nullif(q.bedrooms, 0), 3.0)) - coalesce(nullif(q.bedrooms, 0), 3.0)) / 3, 2.0) + 0.10 * least(abs(coalesce(r.bathrooms, coalesce(nullif(q.bathrooms, 0), 2.0)) - coalesce(nullif(q.bathrooms, 0), 2.0)) / 3, 2.0)
  + 0.10 * 0.2 + 0.10 * least(greatest({_days('q.listing_date', 'r.listing_date')}, 0) / 180, 2.0)"""
_OTHER = "q.property_type = r.property_type and q.location <> r.location"
COMPARABLES = f"""{BASE},
met as materialized (select q.ingest_key as query_id, r.ingest_key as ref_id, r.price, r.area, abs(r.area - q.area) / greatest(q.area, 1.0) <= 0.25 as near, r.location_area = q.location_area as local, round_even({_DIST}, 9) as distance
  from validation q join train r on {_OTHER} and r.listing_date <= q.listing_date and {_days('q.listing_date', 'r.listing_date')} <= 365),
sizes as (select query_id, count(*) filter (near and local) as n1, count(*) filter (near) as n2 from met group by query_id),
tiered as (select m.*, case when n1 >= 4 then 'local' when n2 >= 4 then 'type' else 'date' end as tier from met m join sizes using (query_id) where (n1 >= 4 and near and local) or (n1 < 4 and n2 >= 4 and near) or n2 < 4),
ranked as (select *, row_number() over (partition by query_id order by distance, ref_id) as rank from tiered),
found as (select query_id, rank::int as rank, ref_id, tier, floor(distance * 1e6 + 0.5001) / 1e6 as distance, round(1 / (1 + distance), 2) as similarity, price, floor(price / area * 100 + 0.500000001) / 100 as unit_price from ranked where rank <= 4),
summary as (select query_id, count(*) as n, floor(median(price) * 10 + 0.500000001) / 10 as median_price, floor(median(unit_price) * 10 + 0.500000001) / 10 as median_unit_price from found group by query_id)"""


#: The same with every valid row as a query and every one as a reference; an undated query takes any.
_AGE_IN_DAYS = _days("q.listing_date", "r.listing_date")
COMPARABLES_OF_ALL = COMPARABLES
for _part, _whole in (
    ("from validation q join train r", "from valid q join valid r"),
    (f"r.listing_date <= q.listing_date and {_AGE_IN_DAYS} <= 365", f"(q.listing_date is null or r.listing_date <= q.listing_date and {_AGE_IN_DAYS} <= 365)"),
    (f"0.10 * least(greatest({_AGE_IN_DAYS}, 0) / 180, 2.0)", f"0.10 * case when q.listing_date is null then 0.2 else least(greatest({_AGE_IN_DAYS}, 0) / 180, 2.0) end"),
):
    COMPARABLES_OF_ALL = COMPARABLES_OF_ALL.replace(_part, _whole)


def _errors(m: str) -> str:
    return f"round(avg(abs(price - {m})), 4) as {m}_mae, round(median(abs(price - {m})), 4) as {m}_median_ae, round(sum(abs(price - {m})) / sum(price) * 100, 4) as {m}_wape"


def _out(column: str, lo: float, hi: float) -> str:
    return f"case when not ({column} between {lo} and {hi}) then '{column}_out_of_range' end"


def _split(rows: str, group: str, date: str) -> str:
    """Splits of the groups of a CTE, and their summary."""
    return f"""latest as (select {group} as g, max({date}) as latest from {rows} where {date} is not null group by 1),
nth as (select *, row_number() over (order by latest, g) - 1 as i, count(*) over () as n from latest),
parts as (select g, latest, case when i < greatest(1, floor(n * 0.6::double)) then 'train' when i < floor(n * 0.75::double) then 'validation' when i < floor(n * 0.85::double) then 'calibration' else 'test' end as split from nth),
sums as (select split, count(*) as n_rows, count(distinct g) as n_groups, min({date}) as first_date, max({date}) as last_date from {rows} r join parts on parts.g = r.{group} where r.{date} is not null group by split)"""


_LEX = {f: _flag("lower(' ' || coalesce(text, ''))", w, NEGATION) for f, w in LEXICON.items()}
_FEATURES = {
    "distance_to_cbd_km": f"round({_CBD}, 4)", "days_from_train_reference": f"coalesce({_days('listing_date', repr('1997-01-01') + '::timestamp')}, 0)", "input_completeness_score": _COMPLETE,
} | _PLAIN_FLAGS | {k: f"({v})::int" for k, v in _MISSING.items()}
_REQUEST = [
    f"case when property_type is null or property_type not in ({_TYPES}) then 'unsupported_property_type' end",
    f"case when location_area not in ({', '.join(repr(a) for a in REQUEST_AREAS)}) then 'unsupported_area' end",
    "case when area is null or not (area between 5 and 500) then 'area_out_of_range' end",
    "case when bedrooms = 3 then 'bad_as_of' end",
    *(f"case when not ({c} between {0 if c in ('width', 'length') else lo} and {hi}){f' or {c} <= 0' if c in ('width', 'length') else ''} then '{c}_out_of_range' end" for c, (lo, hi) in C.OPTIONAL_RANGES.items()),
]
_FIELDS = ", ".join(f"case when {c} is null{f' or {c} = {C.UNKNOWN_VALUE!r}' if c in ('direction', 'position') else ''} then '{c}' end" for c in C.QUALITY_COLUMNS)
_AGE = _days("listing_date", "'1997-01-01'::timestamp")
_WARN = ", ".join(
    [f"case when not ({f} between {lo} and {hi}) then 'INPUT_OUTSIDE_TRAINING_RANGE: {f}=' || round({f}, 2)::decimal(20, 2)::varchar end" for f, lo, hi in (("area", 20.0, 250.0), ("bedrooms", 1.0, 8.0))]
    + ["case when latitude is null or longitude is null then 'MISSING_GPS' end", f"case when {_COMPLETE} < 60 then 'MISSING_INPUTS' end", f"case when {_AGE} > 180 then 'STALE_MARKET_REFERENCE: ' || ({_AGE})::varchar end",
       "case when (upper - lower) / greatest(prediction, 1.0) > 0.8 then 'WIDE_PREDICTION_INTERVAL' end"]
)

#: Valid rows without copies, with their groups.
_KEPT = (
    f"{IDENTITY}, u as (select min(ingest_key) as ingest_key from valid group by property_type, location, price, area, bedrooms, bathrooms, floors, width, length, alley_width, direction, position, road_type, latitude, longitude, listing_date, observed_at, date_source, source, listing_id, title, description, supplied_furniture), "
    "e as (select v.*, g.group_key, g.possible_duplicate, coalesce(source, 'sample') || ':' || case when trim(listing_id) <> '' then trim(listing_id) else group_key || ':' || coalesce(strftime(listing_date, '%Y-%m-%d %H:%M:%S'), 'NaT') || ':' || price::varchar end as event from valid v join u using (ingest_key) join groups g on g.ingest_key = v.ingest_key), "
    "kept as (select * from (select *, row_number() over (partition by event order by ingest_key) as nth from e) where nth = 1)"
)

SQL = {
    "market_scope_filter": f"{BASE} select property_type, count(*) as n, round(avg(price), 2) as mean_price from listings where property_type in ({_TYPES}) group by 1",
    "date_provenance": f"{BASE} select date_source, temporal_status, listing_date_missing, count(*) as n, min(listing_date) as first_date from valid group by 1, 2, 3",
    "gps_validation": f"{BASE} select location_area, count(latitude) as with_gps, count(*) as n, round(avg(longitude), 4) as mean_longitude from valid group by 1",
    "quality_funnel": f"{BASE} select count(*) as rows_raw, count(*) filter (reject_reason is null) as rows_valid, count(*) filter (reject_reason = 'unsupported_property_type') as unsupported_property_type, count(*) filter (reject_reason = 'numeric_or_price_outliers') as numeric_or_price_outliers, count(*) filter (reject_reason is null and temporal_status = 'unknown') as unknown_temporal_rows from tagged",
    "missing_rates": f"{BASE} " + " union all ".join(f"select '{c}' as \"column\", round(avg(({c} is null)::int) * 100, 2) as missing_percent from valid" for c in MISSING_COLUMNS),
    "area_extraction": f"{BASE} select location_area, count(*) as n from tagged group by 1",
    "location_components": f"{BASE} select location_area as area_key, {_WARD} as ward, count(*) as n, count(distinct {_STREET}) as streets, max({_STREET}) as last_street from tagged group by 1, 2",
    "property_signature": f"{BASE} select {_SIGNATURE} as signature, count(*) as n, min(ingest_key) as first_key from valid group by 1",
    "text_flags": f"{BASE} select property_type, {', '.join(f'sum({v})::bigint as {k}' for k, v in _FLAGS.items())} from listings group by 1",
    "document_flags": f"select lang, count(*) as n, {', '.join(f'sum({v})::bigint as {k}' for k, v in _LEX.items())} from documents group by 1",
    "completeness_flags": f"{BASE} select {_COMPLETE} as score, count(*) as n, {', '.join(f'sum(({v})::int)::bigint as {k}' for k, v in _MISSING.items())} from valid group by 1",
    "time_offset": f"{BASE}, d as (select property_type, {_FEATURES['days_from_train_reference']} as d from valid) select property_type, min(d) as least, max(d) as most, sum(d)::bigint as total from d group by 1",
    "cbd_distance": f"{BASE}, d as (select location_area, {_CBD} as d from valid) select location_area, count(d) as n, round(min(d), 4) as least, round(avg(d), 4) as mean, round(max(d), 4) as most from d group by 1",
    "feature_frame": f"{BASE} select ingest_key, {', '.join(f'{_FEATURES.get(c, c)} as {c}' for c in C.MODEL_FEATURES)} from valid",
    "identity_pairs": f"{IDENTITY} select a, b from pairs where level = 'strong'",
    "identity_groups": f"{IDENTITY} select ingest_key, group_key, group_size, case when group_size > 1 then 'strong' when possible_duplicate then 'weak' else 'singleton' end as identity_confidence, possible_duplicate from groups",
    "identity_audit": f"{IDENTITY}, s as (select group_key, count(*) as n from groups group by 1) select (select count(*) from s) as groups, (select count(*) from s where n > 1) as multi_listing_groups, (select max(n) from s) as largest_group, (select count(*) from pairs where level = 'strong') as strong_pairs, (select count(*) from keys) as key_links, (select count(*) from pairs where level = 'medium') as medium_pairs, (select count(*) from pairs where level = 'weak') as weak_pairs",
    "event_dedup": f"{_KEPT} select ingest_key, property_type, listing_date, price from kept",
    "dedup_funnel": f"{_KEPT}, n as (select group_key, count(*) as n from kept group by 1), c as (select (select count(*) from tagged) as rows_raw, (select count(*) from valid) as rows_valid, (select count(*) from kept) as rows_clean) "
    "select rows_raw, rows_valid, (select count(*) from tagged where reject_reason = 'unsupported_property_type') as unsupported_property_type, (select count(*) from tagged where reject_reason = 'numeric_or_price_outliers') as numeric_or_price_outliers, "
    "rows_clean, (select count(*) from n) as unique_property_groups, (select count(*) from n where n > 1) as multi_listing_groups, (select count(*) from kept where temporal_status = 'unknown') as unknown_temporal_rows, "
    "(select count(*) from kept where possible_duplicate) as possible_duplicate_rows, rows_valid - rows_clean as exact_duplicate_listings, round((rows_valid - rows_clean) / greatest(rows_raw, 1) * 100, 2) as duplicate_listing_percent from c",
    "temporal_split": f"{IDENTITY}, dated as (select g.group_key, v.listing_date from valid v join groups g using (ingest_key)), {_split('dated', 'group_key', 'listing_date')} select g as group_key, latest, split from parts",
    "split_summary": f"{IDENTITY}, dated as (select g.group_key, v.listing_date from valid v join groups g using (ingest_key)), {_split('dated', 'group_key', 'listing_date')} select * from sums",
    "event_split": f"with {_split('events', 'user_id', 'ts')} select * from sums",
    "naive_baseline": f"{BASE} select median(price) as global_median from train",
    "segment_medians": f"{BASE} select property_type, location_area, median(price) as segment_median, count(price) as n from train group by 1, 2",
    "segment_unit_prices": f"{BASE} select property_type, location_area, round(median(price / area), 6) as unit_price_median, count(price / area) as n from train group by 1, 2",
    "segment_predictions": f"{BASE}, {_SEG}, {_pred('test')} select ingest_key, price, prediction from pred",
    "percentiles": f"{BASE} " + " union all ".join(f"select '{c}' as \"column\", {', '.join(f'round(quantile_cont({c}, {p / 100}), 1) as p{p}' for p in (10, 25, 50, 75, 90))} from valid" for c in ("price", "area")),
    "comparable_context": f"{BASE}, k as (select *, {_CBD} as cbd from train) select round(median(area), 1) as median_area, round(greatest(quantile_cont(area, 0.75) - quantile_cont(area, 0.25), 15.0), 1) as area_scale, round(coalesce(stddev_samp(cbd), 8.0), 1) as cbd_scale, string_agg(distinct property_type, ';' order by property_type) as property_types, string_agg(distinct location_area, ';' order by location_area) as location_areas, count(distinct (property_type, location_area))::int as segments from k",
    "training_ranges": f"{BASE}, past as (select * from valid where listing_date < '{CUTS[1]}') " + " union all ".join(f"select '{c}' as feature, min({c})::double as lo, max({c})::double as hi from past having min({c}) is not null" for c in RANGE_COLUMNS),
    "regression_metrics": f"{BASE}, {_INTERVAL} select count(*) as n, round(avg({_E}), 4) as mae, round(median({_E}), 4) as median_ae, round(sqrt(avg({_E} * {_E})), 4) as rmse, round(1 - sum({_E} * {_E}) / (var_pop(price) * count(*)), 6) as r2, round(avg({_E} / greatest(abs(price), 1.0)) * 100, 2) as mape, round(sum({_E}) / sum(abs(price)) * 100, 2) as wape, round(avg(2 * {_E} / greatest(abs(price) + abs(prediction), 1.0)) * 100, 2) as smape from scored",
    "interval_metrics": f"{BASE}, {_INTERVAL} select round(avg((price between lower and upper)::int), 6) as coverage, round(avg((price between lower and upper)::int) - {C.COVERAGE}, 6) as coverage_gap, round(avg(upper - lower), 4) as mean_width, round(median(upper - lower), 4) as median_width, round(avg(upper - lower) / avg(price) * 100, 4) as relative_width from scored",
    "slice_analysis": f"{BASE}, {_SLICES}",
    "conformal_quantile": f"{BASE}, {_SEG}, {_pred('calibration')}, r as (select abs(ln(1 + price) - ln(1 + prediction)) as residual from pred), o as (select residual, row_number() over (order by residual) as i, count(*) over () as n from r) select n, ceil((n + 1) * {C.COVERAGE}::double)::int as rank, round(residual, 8) as quantile, (select round(avg(residual), 8) from r) as mean_residual, (select round(median(residual), 8) from r) as median_residual from o where i = ceil((n + 1) * {C.COVERAGE}::double)",
    "comparables_topk": f"{COMPARABLES_OF_ALL} select * from found",
    "comparable_summary": f"{COMPARABLES_OF_ALL} select * from summary",
    "comparable_benchmark": f"{COMPARABLES}, su as (select property_type, location_area, median(price / area) as u from train group by all), g as (select median(price) as naive, median(price / area) as u from train), b as (select v.price, g.naive, coalesce(su.u, g.u) * v.area as segment, coalesce(s.median_unit_price * v.area, coalesce(su.u, g.u) * v.area) as comparable from validation v cross join g left join su using (property_type, location_area) left join summary s on s.query_id = v.ingest_key), t as (select count(*) as n, {', '.join(_errors(m) for m in ('comparable', 'naive', 'segment'))} from b) select *, round((naive_mae - comparable_mae) / naive_mae * 100, 2) as improvement_over_naive from t",
    "request_validation": f"{BASE} select array_to_string(list_filter([{', '.join(_REQUEST)}], lambda x: x is not null), ',') as reasons, count(*) as n from tagged group by 1",
    "rejected_requests": f"{BASE}, r as (select ingest_key as query_id, list_filter([{', '.join(_REQUEST)}], lambda x: x is not null) as l from tagged) select query_id, unnest(range(len(l)))::int as place, unnest(l) as reason from r",
    "prediction_warnings": f"{BASE}, {_INTERVAL} select ingest_key, array_to_string(list_filter([{_WARN}], lambda x: x is not null), '; ') as warnings from scored",
    "missing_fields": f"{BASE} select array_to_string(list_filter([{_FIELDS}], lambda x: x is not null), ',') as fields, count(*) as n from valid group by 1",
    "export_reference": f"{BASE} select ingest_key as property_group_id, property_type, location_area, area, price as price_million, floor(price / area * 10 + 0.500000001) / 10 as unit_price_million_m2, latitude, longitude, round({_CBD}, 2) as distance_to_cbd_km, bedrooms::int as bedrooms, bathrooms::int as bathrooms, floors::int as floors, strftime(listing_date, '%Y-%m-%d') as listing_date, 0 as has_furniture, 0 as car_alley, {_days(repr('1997-01-01') + '::timestamp', 'date_trunc(' + repr('day') + ', listing_date)')} as market_age from valid",
    "refit_rows": f"{BASE}, past as (select * from train union all select * from validation) select property_type, count(*) as n, round(sum(price), 2) as total_price from past group by 1",
}
