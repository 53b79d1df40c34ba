"""Structured Streaming forms of deduplication and scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from domora.operators import clean


def dedup_stream(spark: SparkSession, schema: StructType, path: str, delay: str = "30 days", **options: str) -> DataFrame:
    """New listing files -> cleaned events, each source id once within the watermark.

    Listings without a source id have no stream key and are left out; rows later than the delay are dropped.
    """
    raw = spark.readStream.schema(schema).options(**options).parquet(path)
    rows = clean.valid(raw).where("listing_id is not null and listing_date is not null")
    keyed = rows.withColumn("listing_event_id", F.concat_ws(":", F.coalesce("source", F.lit("sample")), F.trim("listing_id")))
    return keyed.withWatermark("listing_date", delay).dropDuplicatesWithinWatermark(["listing_event_id"])


def run_to_files(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process what is there into Parquet files under out, written by the tasks, and read them."""
    stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint).start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_to_table(stream: DataFrame, name: str, checkpoint: str | None = None):
    """Process what is there into a memory table of that name, held by the driver; for tests."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def put_batch(rows: DataFrame, out: str, number: int) -> None:
    """Write a micro-batch into the folder of its number, in place of what an earlier try left there."""
    rows.write.mode("overwrite").parquet(f"{out}/batch={number}")


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all micro-batches."""
    return spark.read.parquet(out).drop("batch")


def score_stream(requests: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Score each micro-batch of requests with a static model, as Parquet in a folder for each batch.

    A batch that is replayed after a failure has the same number and requests, and overwrites its folder, so that a
    request is there once; `read_batches` reads them.
    """

    def each(batch: DataFrame, number: int) -> None:
        put_batch(score(batch), out, number)

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
