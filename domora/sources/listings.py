"""Listings: readers and writers, and the listing table derived from the order tables."""

from __future__ import annotations

import json
import time
import unicodedata
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from domora.functions.numeric import round_to


REQUIRED = {"price", "area", "property_type", "location"}
#: Original headings -> column names.
HEADINGS = {
    "Price": "price", "Area": "area", "Property Type": "property_type", "Location": "location", "Listing ID": "listing_id", "Bedrooms": "bedrooms", "Bathrooms": "bathrooms",
    "Floors": "floors", "Width": "width", "Length": "length", "Alley Width": "alley_width", "Direction": "direction", "Position": "position", "Road Type": "road_type", "Title": "title",
    "Description": "description", "Latitude": "latitude", "Longitude": "longitude", "Last Updated Date": "last_updated_date", "Scraped At": "scraped_at", "Source ID": "source",
}


def load_listings(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by suffix, else CSV with every column as text; original headings get column names."""
    if path.rstrip("/").endswith(".parquet"):
        raw = spark.read.parquet(path)
    else:
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return raw.withColumnsRenamed({k: v for k, v in HEADINGS.items() if k in raw.columns})


def require_columns(df: DataFrame) -> DataFrame:
    missing = sorted(REQUIRED - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


# One text for both engines: integer arithmetic over the order tables.
ADAPTER = """
select concat_ws('-', cast(l.l_orderkey as varchar(20)), cast(l.l_linenumber as varchar(20)), cast(l.l_partkey as varchar(20)), cast(l.l_suppkey as varchar(20))) as base_key,
  case p.p_type when 'ECONOMY' then 'Nhà riêng' when 'SMALL' then 'Nhà mặt tiền' when 'STANDARD' then 'Căn hộ chung cư' when 'MEDIUM' then 'Biệt thự liền kề' when 'LARGE' then 'Nhà biệt thự' else 'Đất nền' end as property_type,
  concat(cast(1 + l.l_partkey % 900 as varchar(20)), case when l.l_suppkey % 3 = 0 then ' Số ' else ' Đường Số ' end, cast(l.l_suppkey % 40 as varchar(20)), ', Phường ', cast(l.l_partkey % 97 as varchar(20)),
    case s.s_nationkey % 8 when 0 then ', Quận 1' when 1 then ', QUẬN  3' when 2 then ', Quận 9' when 3 then ', Quận 12' when 4 then case when l.l_linenumber = 3 then ', {decomposed}' else ', Gò Vấp' end when 5 then ', Củ Chi' when 6 then ', Thủ Đức' else ', Long An' end, ', TP.HCM') as location,
  l.l_extendedprice / 2 as price,
  cast(4 + p.p_size * 6 + l.l_partkey % 11 + l.l_orderkey % 3 as double) as area,
  case when l.l_partkey % 5 <> 0 then cast(1 + l.l_partkey % 11 as double) end as bedrooms,
  case when l.l_suppkey % 4 <> 0 then cast(l.l_suppkey % 8 as double) end as bathrooms,
  case when l.l_partkey % 3 <> 0 then cast(1 + l.l_suppkey % 5 as double) end as floors,
  case when l.l_partkey % 4 <> 1 then cast(3 + l.l_partkey % 7 as double) end as width,
  case when l.l_suppkey % 5 <> 2 then cast(8 + l.l_suppkey % 13 as double) end as length,
  case when l.l_partkey % 6 <> 0 then cast(l.l_partkey % 33 as double) end as alley_width,
  case l.l_partkey % 4 when 0 then 'Đông' when 1 then 'Tây' when 2 then 'Không rõ' end as direction,
  case l.l_suppkey % 3 when 0 then 'Mặt tiền' when 1 then 'Không rõ' end as position,
  case when l.l_suppkey % 2 = 0 then 'Nhựa' end as road_type,
  case when l.l_suppkey % 3 <> 0 then 10.25 + (l.l_suppkey % 97) / 100.0 end as latitude,
  case when l.l_suppkey % 3 <> 0 then 106.35 + (l.l_partkey % 60) / 100.0 end as longitude,
  case when l.l_orderkey % 9 <> 0 then o.o_orderdate end as updated_at,
  case when l.l_orderkey % 4 <> 0 then o.o_orderdate end as scraped_at,
  concat('nguồn ', cast(l.l_suppkey % 5 as varchar(20))) as source,
  case when l.l_orderkey % 7 = 0 then concat('L', cast(l.l_orderkey as varchar(20)), '.', cast(l.l_partkey as varchar(20))) end as listing_id,
  case l.l_partkey % 5 when 0 then 'Bán nhà hẻm xe hơi' when 1 then 'CHÍNH CHỦ cần bán gấp' when 2 then 'Nhà đẹp' when 3 then '' end as title,
  case l.l_orderkey % 6 when 0 then 'nhà không có nội thất, gần chợ' when 1 then 'full nội thất, gần trường' when 2 then 'chưa được ô tô vào' when 3 then 'ô tô vào tận nơi, sát chợ' when 4 then '' end as description,
  cast(l.l_orderkey % 2 as double) as supplied_furniture
from {lineitem} l join {orders} o on o.o_orderkey = l.l_orderkey join {part} p on p.p_partkey = l.l_partkey join {supplier} s on s.s_suppkey = l.l_suppkey
""".replace("{decomposed}", unicodedata.normalize("NFD", "Gò Vấp"))
#: Rows of some orders stand twice, to be found as exact copies, and once more under another source without an id.
WITH_COPIES = """select concat(base_key, '-', cast(copy as varchar(20))) as ingest_key, a.* exclude (source, listing_id), case when copy = 2 then 'nguồn khác' else source end as source, case when copy < 2 then listing_id end as listing_id
from (select x.*, c.copy from adapted x cross join (select unnest([0, 1, 2]) as copy) c where c.copy = 0 or x.base_key like '%50-1-%') a"""

#: Here coordinates are one division of whole numbers, whose double is that of the decimal; decimal arithmetic is slow row by row.
_SPARK_ADAPTER = ADAPTER.replace("varchar(20)", "string")
for _decimal, _double in (("10.25 + (l.l_suppkey % 97) / 100.0", "(1025 + l.l_suppkey % 97) / 100D"), ("106.35 + (l.l_partkey % 60) / 100.0", "(10635 + l.l_partkey % 60) / 100D")):
    _SPARK_ADAPTER = _SPARK_ADAPTER.replace(_decimal, _double)


def adapted_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings from lineitem, orders, part and supplier; ingest_key is a total order of the rows."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "part", "supplier")}
    base = spark.sql(_SPARK_ADAPTER, **tables)
    copies = F.explode(F.when(F.col("base_key").like("%50-1-%"), F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0))))
    out = base.withColumn("copy", copies).withColumn("ingest_key", F.concat_ws("-", "base_key", F.col("copy").cast("string")))
    elsewhere = {"source": F.when(F.col("copy") == 2, "nguồn khác").otherwise(F.col("source")), "listing_id": F.when(F.col("copy") < 2, F.col("listing_id"))}
    return out.withColumns(elsewhere).drop("copy", "base_key")


# -- sinks --------------------------------------------------------------------------------


def reference_export(clean: DataFrame) -> DataFrame:
    """Rows for retrieval: positive area and price, rounded numbers, whole counts, dates as text."""
    has = set(clean.columns)
    whole = [F.col(c).cast("int").alias(c) for c in ("bedrooms", "bathrooms", "floors")]
    flags = [(F.coalesce(F.col(c).cast("int"), F.lit(0)) if c in has else F.lit(0)).alias(c) for c in ("has_furniture", "car_alley")]
    area, price = (F.when(F.col(c) > 0, F.col(c)) for c in ("area", "price"))
    return clean.select(
        "property_group_id", "property_type", "location_area", area.alias("area"), price.alias("price_million"), round_to(F.try_divide(price, area), 1).alias("unit_price_million_m2"),
        "latitude", "longitude", (F.round("distance_to_cbd_km", 2) if "distance_to_cbd_km" in has else F.lit(None).cast("double")).alias("distance_to_cbd_km"),
        *whole, F.date_format("listing_date", "yyyy-MM-dd").alias("listing_date"), *flags,
    )


def write_reference(clean: DataFrame, path: str) -> None:
    reference_export(clean).write.mode("overwrite").partitionBy("property_type").parquet(path)


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def finite(c: Column, kind: DataType) -> Column:
    """c with null for NaN and infinities, wherever they stand inside structs, arrays and values of maps."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(F.abs(c) < float("inf"), c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: finite(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: finite(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[finite(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def strict_json(rows: DataFrame) -> DataFrame:
    """value: each row as a JSON object that any parser takes; what is no finite number is null."""
    return rows.select(F.to_json(F.struct(*[finite(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields]), {"ignoreNullFields": "false"}).alias("value"))


def write_report(report: DataFrame, path: str) -> None:
    """One JSON object a line; NaN and infinities as null."""
    strict_json(report).write.mode("overwrite").text(path)


# -- versions --------------------------------------------------------------------------------


def _folder(spark: SparkSession, path: str):
    """(file system, path) of the session's Hadoop configuration."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def publish(spark: SparkSession, base: str, write: Callable[[str], None]) -> str:
    """Let write fill a new folder under base, then name it the current one; the folder.

    The name is written beside the manifest and moved into place last, so that whoever loads in between, or after a
    job that broke off, gets the version before. Old versions stay; remove them once nobody reads them.
    """
    version = f"{base}/versions/{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:8]}"
    write(version)
    # manifests are numbered, and the highest counts: a move onto a name that is taken fails instead of losing a version
    files, manifests = _folder(spark, f"{base}/manifests")
    files.mkdirs(manifests)
    number = max((_number(f.getPath().getName()) for f in files.listStatus(manifests)), default=0) + 1
    at = spark._jvm.org.apache.hadoop.fs.Path
    draft = at(f"{base}/draft-{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    if not files.rename(draft, at(f"{base}/manifests/{number:09d}")):
        raise RuntimeError(f"another job published version {number} of {base}")
    return version


def _number(name: str) -> int:
    return int(name) if name.isdigit() else 0


def current_version(spark: SparkSession, base: str) -> str:
    """The folder that was published last, or FileNotFoundError."""
    files, manifests = _folder(spark, f"{base}/manifests")
    names = [f.getPath().getName() for f in files.listStatus(manifests)] if files.exists(manifests) else []
    if not any(map(_number, names)):
        raise FileNotFoundError(f"nothing is published under {base}")
    return spark.read.text(f"{base}/manifests/{max(names, key=_number)}").first()[0]


SUMMARY_FIELDS = ["target", "quantile", "coverage", "segment_counts", "reference_date"]


def check_package(text: str) -> dict:
    """A model summary from its JSON, or ValueError: fields, target, finite quantile, coverage and segment keys."""
    try:
        found = json.loads(text)
    except ValueError as e:
        raise ValueError(f"summary is no JSON: {e}") from e
    if not isinstance(found, dict):
        raise ValueError("summary is no object")
    missing = [k for k in SUMMARY_FIELDS if k not in found]
    if missing:
        raise ValueError(f"summary lacks {', '.join(missing)}")
    q = found["quantile"]
    if found["target"] != "total_price" or not isinstance(q, (int, float)) or not 0 <= q < float("inf") or not 0 < found["coverage"] < 1:
        raise ValueError("summary has a wrong target, quantile or coverage")
    found["segments"] = {tuple(k.split(" | ", 1)): n for k, n in found["segment_counts"].items()}
    return found


