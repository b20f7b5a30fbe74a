"""Structured Streaming jobs over the request log and the event stream.

Each keeps keyed state behind a watermark, beyond which it is dropped. State and results lie in the shared checkpoint folder under the job's
name: a job of the same name goes on where the last one stopped. A batch writes to a folder of its own, so that one that is replayed after a
loss replaces what it wrote before, and nothing is written twice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import ensure_checkpoint_dir


def stream_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table as a stream of files."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def run(stream: DataFrame, mode: str, keys: list[str] | None = None, name: str | None = None) -> DataFrame:
    """Run to the end of what is there and give the result of all batches so far: every row (append), or the last row of each key (update)."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{name or uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{base}/result/part={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0).cast("long")).write.mode("overwrite").parquet(f"{base}/result/part=-1")
    schema = StructType([*stream.schema.fields, StructField("batch", LongType()), StructField("part", LongType())])
    written = spark.read.schema(schema).parquet(f"{base}/result")
    if mode != "update":
        return written.select(*stream.columns)
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "batch").alias("x"))
    return last.select(*keys, "x.*").select(*stream.columns)


def first_requests(requests: DataFrame, late: str = "60 days") -> DataFrame:
    """Each request once, however often it is logged within the watermark."""
    timed = requests.withColumn("at", F.col("asked_at").cast("timestamp")).where("at is not null")
    return timed.withWatermark("at", late).dropDuplicatesWithinWatermark(["request_id"])


def daily_usage(requests: DataFrame) -> DataFrame:
    """Requests and tokens by provider and day, over the table of requests that the stream has seen once."""
    counted = requests.where("provider_used is not null").groupBy(F.date_format("asked_at", "yyyy-MM-dd").alias("day"), F.col("provider_used").alias("provider"))
    return counted.agg(F.count("*").alias("requests"), F.sum(F.coalesce("estimated_tokens", F.lit(0))).cast("long").alias("tokens"))


def event_counts(events: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Events and mean value by type and window; rows later than the watermark are dropped with the window's state."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.avg("value"), 6).alias("mean_value")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "events", "mean_value")


def user_sessions(events: DataFrame, gap: str = "24 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each user: events no more than `gap` apart; of a stored table or a stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    s = timed.groupBy(F.session_window("at", gap).alias("s"), "user_id").agg(F.count("*").alias("events"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    return s.select("user_id", "events", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("first_at"), F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("last_at"))
