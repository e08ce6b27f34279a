"""Incremental ingestion, live value and alerts, win-back triggers.

Every job runs to the end of the available input and stops. Batches are written
below a partition named after the batch, so a batch that is replayed after a
failure replaces itself and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soukline.functions import numbers
from soukline.operators import learning
from soukline.operators.forest import Forest
from soukline.session import shared_dir

BATCH = "batch"


def file_stream(spark: SparkSession, root: str, schema: str, files: str = "*.parquet", per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(root)


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks need a zoned timestamp; the session zone is UTC."""
    return df.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", delay)


def write_batches(stream: DataFrame, path: str, mode: str = "append", by: list[str] | None = None) -> None:
    """Idempotent micro-batch log: each batch overwrites only its own partitions."""
    shared_dir(stream.sparkSession)

    def store(df: DataFrame, batch: int) -> None:
        # rows of a partition are gathered, and split again where they are many
        gathered = df.hint("rebalance", *[F.col(c) for c in by]) if by else df
        (
            gathered.withColumn(BATCH, F.lit(batch))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*(by or []), BATCH)
            .parquet(f"{path}/data")
        )

    query = (
        stream.writeStream.foreachBatch(store)
        .outputMode(mode)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_batches(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/data")


def latest_rows(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest version of each key; versions are compared map-side first."""
    others = [c for c in log.columns if c != key]
    newest = F.max_by(F.struct(*others), F.struct(*order))
    return log.groupBy(key).agg(newest.alias("row")).select(key, "row.*")


def ingest_daily(stream: DataFrame, path: str, ts: str) -> DataFrame:
    """Appends new records to day partitions; returns the change log so far."""
    dated = (
        stream.withColumn("year", F.year(ts)).withColumn("month", F.month(ts)).withColumn("day", F.dayofmonth(ts))
    )
    write_batches(dated, path, by=["year", "month", "day"])
    return read_batches(stream.sparkSession, path)


def daily_value(stream: DataFrame, ts: str, value: Column, delay: str = "1 day") -> DataFrame:
    """Streaming aggregate of value per calendar day."""
    return (
        event_time(stream, ts, delay)
        .groupBy(F.window("event_time", "1 day"))
        .agg(F.sum(value.cast(numbers.MONEY)).alias("value"), F.count(F.lit(1)).alias("events"))
        .select(F.col("window.start").cast("date").alias("day"), "value", "events")
    )


def latest_per_day(log: DataFrame) -> DataFrame:
    """Update mode writes a day once per change; the last batch holds its total."""
    return latest_rows(log, "day", [BATCH]).drop(BATCH)


def late_delivery_alerts(orders: DataFrame, places: DataFrame, risk: DataFrame, as_of: Column, threshold: Column) -> DataFrame:
    """Open orders, still inside their promise, from places with high late rates.

    ``places`` maps customer_id to customer_state and ``risk`` holds one rate per
    state. Both are static sides of the stream.
    """
    open_orders = orders.filter(F.col("order_status") == "shipped")
    return (
        open_orders.join(places, "customer_id")
        .join(risk, "customer_state")
        .filter((F.col("late_rate") >= threshold) & (F.col("order_estimated_delivery_date") > as_of))
        .select("order_id", "customer_state", "late_rate", "order_estimated_delivery_date")
    )


def scored_alerts(features: DataFrame, model: Forest, threshold: float = 0.5) -> DataFrame:
    """The delay classifier applied to a stream of order features."""
    filled = features.na.fill(0, subset=learning.DELAY_NUMBERS)
    return learning.score(model, filled).filter(F.col("score") >= threshold).select("order_id", "score")


def inactive_customers(orders: DataFrame, customer: str, ts: str, days: int = 90, delay: str = "1 day") -> DataFrame:
    """One row each time a customer has been silent for ``days`` days.

    A session with that gap closes exactly then, so the state is one open
    session per customer and no timer code is needed.
    """
    return (
        event_time(orders, ts, delay)
        .groupBy(F.session_window("event_time", f"{days} days").alias("session"), customer)
        .agg(F.max("event_time").alias("last_order"), F.count(F.lit(1)).alias("orders"))
        .select(
            customer,
            F.col("last_order").cast("timestamp_ntz").alias("last_order"),
            F.col("session.end").cast("timestamp_ntz").alias("inactive_since"),
            "orders",
        )
    )

