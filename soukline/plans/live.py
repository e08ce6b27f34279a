"""The streaming jobs run over the given files, to the end of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soukline.functions.numbers import ratio, rounded
from soukline.operators import learning, rollups
from soukline.operators.forest import Forest
from soukline.plans import lifecycle
from soukline.plans.growth import late_by_state
from soukline.session import scratch_path, shuffles_freed
from soukline.sources.marketplace import SOURCES, Marketplace
from soukline.streaming import jobs, stateful


def _stream(t: Marketplace, name: str) -> DataFrame:
    return jobs.file_stream(t.spark, t.root, SOURCES[name], f"{name}.parquet")


def ingested_state(t: Marketplace) -> DataFrame:
    """Events landed by day, and upserted into the newest event of each user."""
    path = scratch_path(t.spark, "ingest")
    jobs.ingest_daily(_stream(t, "events"), path, "ts")
    return stateful.merge_buckets(_stream(t, "events"), f"{path}/merged", "user_id", ["ts", "event_id"])


def deduplicated_events(t: Marketplace) -> DataFrame:
    """Events delivered once each, though the source sends its last day again."""
    path = scratch_path(t.spark, "repeats")
    events = t.scan("events")
    events.write.parquet(f"{path}/sent")
    last = events.select((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("x")).scalar()

    def deliver() -> None:
        stream = t.spark.readStream.schema(events.schema).parquet(f"{path}/sent")
        jobs.write_batches(stateful.first_seen(stream, ["event_id"], "ts", "2 days"), path)

    deliver()
    events.filter(F.col("ts") > last).write.mode("append").parquet(f"{path}/sent")
    deliver()
    return jobs.read_batches(t.spark, path).drop(jobs.BATCH)


def daily_purchases(t: Marketplace) -> DataFrame:
    path = scratch_path(t.spark, "daily")
    bought = _stream(t, "events").filter(F.col("event_type") == "purchase")
    jobs.write_batches(jobs.daily_value(bought, "ts", F.col("value")), path, mode="update")
    return jobs.latest_per_day(jobs.read_batches(t.spark, path))


def late_alerts(t: Marketplace) -> DataFrame:
    """Alerts where a state's late rate is at or above the overall rate."""
    path = scratch_path(t.spark, "alerts")
    history = late_by_state(t)
    risk = history.select("customer_state", rounded(ratio(F.col("late_orders"), F.col("delivered_orders")), 6).alias("late_rate"))
    overall = history.select(rounded(ratio(F.sum("late_orders"), F.sum("delivered_orders")), 6)).scalar()
    as_of = t.headers.select(F.max("order_purchase_timestamp")).scalar()
    stream = _stream(t, "orders").select(*t.header())
    places = rollups.people(t).select("customer_id", "customer_state")
    jobs.write_batches(jobs.late_delivery_alerts(stream, places, risk, as_of, overall), path)
    return jobs.read_batches(t.spark, path).drop(jobs.BATCH)


def _scored(t: Marketplace) -> tuple[Forest, DataFrame, DataFrame]:
    """The delay model of the delivered orders, the open orders' features, and the alerts of a stream of them."""
    path = scratch_path(t.spark, "scored")
    model = learning.fit_delay(lifecycle.delivery_risk_features(t)).model
    rows = lifecycle.delivery_risk_features(t, "shipped").drop("is_late")
    with shuffles_freed(t.spark):
        rows.write.parquet(f"{path}/open")
    stream = t.spark.readStream.schema(rows.schema).parquet(f"{path}/open")
    jobs.write_batches(jobs.scored_alerts(stream, model), path)
    alerts = jobs.read_batches(t.spark, path).drop(jobs.BATCH)
    return model, t.spark.read.schema(rows.schema).parquet(f"{path}/open"), alerts


def scored_alerts(t: Marketplace) -> DataFrame:
    """Open orders that the model expects to be late."""
    return _scored(t)[2]


def scored_alerts_check(t: Marketplace) -> DataFrame:
    """Open orders, alerts given twice, and alerts that only the stream or only a batch over the same rows gives."""
    model, rows, alerts = _scored(t)
    whole = jobs.scored_alerts(rows, model)
    both = alerts.select("order_id", F.lit(1).alias("streamed")).join(
        whole.select("order_id", F.lit(1).alias("batch")), "order_id", "full"
    )
    told = both.agg(
        F.count_if(F.col("batch").isNull()).alias("extra"), F.count_if(F.col("streamed").isNull()).alias("missing"),
        (F.count(F.lit(1)) - F.countDistinct("order_id")).alias("repeated"),
    )
    return told.withColumn("orders", rows.select(F.count(F.lit(1))).scalar())


def winback_triggers(t: Marketplace) -> DataFrame:
    """Customers entering the win-back band: ninety days after an order."""
    path = scratch_path(t.spark, "winback")
    stream = _stream(t, "orders").filter(F.col("o_orderstatus") == "F")
    orders = stream.select(F.col("o_custkey").cast("string").alias("customer_unique_id"), "o_orderdate")
    jobs.write_batches(jobs.inactive_customers(orders, "customer_unique_id", "o_orderdate"), path)
    return jobs.read_batches(t.spark, path).drop(jobs.BATCH)


def _clock(t: Marketplace, path: str, row: DataFrame) -> DataFrame:
    """A stream of one clock row, kept as a file as a scheduler would leave it."""
    row.write.parquet(path)
    return t.spark.readStream.schema(row.schema).parquet(path)


def _last_bought(t: Marketplace, days: int) -> DataFrame:
    """One row: the newest purchase time and some days."""
    return t.headers.select((F.max("order_purchase_timestamp") + F.expr(f"INTERVAL {days} DAYS")).alias("at"))


def overdue_orders(t: Marketplace) -> DataFrame:
    """Orders whose promise has passed, by the last purchase of the data set, without a delivery."""
    path = scratch_path(t.spark, "overdue")
    sides = ("order_id", "customer_id", "order_purchase_timestamp", "order_estimated_delivery_date")
    open_orders = _stream(t, "orders").select(*t.header()).filter(F.col("order_status") != "canceled").select(*sides)
    arrived = t.orders_in("delivered").select("order_id", F.col("order_delivered_customer_date").alias("arrived"))
    arrived.filter(F.col("arrived").isNotNull()).write.parquet(f"{path}/arrived")
    came = t.spark.readStream.schema("order_id string, arrived timestamp_ntz").parquet(f"{path}/arrived")
    came = came.filter(F.col("arrived") <= _last_bought(t, 0).scalar())
    # both clocks stand one delay and an hour behind the last purchase
    tick = _last_bought(t, 1).select((F.col("at") + F.expr("INTERVAL 1 HOUR")).alias("at"))
    none = F.lit(None)
    asked_clock = tick.select(
        F.lit("").alias("order_id"), none.cast("string").alias("customer_id"), none.cast("timestamp_ntz").alias("order_purchase_timestamp"),
        F.col("at").alias("order_estimated_delivery_date"),
    )
    came_clock = tick.select(F.lit("").alias("order_id"), F.col("at").alias("arrived"))
    alerts = stateful.overdue(
        open_orders.union(_clock(t, f"{path}/asked-clock", asked_clock)), came.union(_clock(t, f"{path}/came-clock", came_clock)),
        "order_id", "order_estimated_delivery_date", "arrived", "1 day",
    )
    jobs.write_batches(alerts, path)
    schema = "order_id string, customer_id string, order_purchase_timestamp timestamp_ntz, order_estimated_delivery_date timestamp_ntz"
    return jobs.read_batches(t.spark, path, schema).drop(jobs.BATCH)


def _band(t: Marketplace) -> DataFrame:
    """The changes of the win-back band up to one day after the last purchase."""
    path = scratch_path(t.spark, "band")
    orders = _stream(t, "orders").select(
        F.col("o_custkey").cast("string").alias("customer_unique_id"), F.col("o_orderdate").alias("bought"),
        (F.col("o_orderstatus") == "F").alias("delivered"),
    )
    tick = _last_bought(t, 2).select(
        F.lit(None).cast("string").alias("customer_unique_id"), F.col("at").alias("bought"), F.lit(False).alias("delivered")
    )
    stream = orders.union(_clock(t, f"{path}/clock", tick))
    with stateful.rocks(t.spark):
        jobs.write_batches(stateful.band_changes(stream, "customer_unique_id", "bought", F.col("delivered")), path)
    schema = "customer string, at timestamp_ntz, change string, last_order timestamp_ntz, batch long"
    return jobs.read_batches(t.spark, path, schema).drop(jobs.BATCH)


def band_changes(t: Marketplace) -> DataFrame:
    """Entries into the win-back band and exits by an order or by lapsing."""
    return _band(t).withColumnsRenamed({"customer": "customer_unique_id"})


def winback_band(t: Marketplace) -> DataFrame:
    """Who is in the band at the end of the stream: the batch audience of ``lifecycle.winback_audience``."""
    now = _last_bought(t, 1).scalar()
    inside = stateful.in_band(_band(t))
    recency = F.date_diff(now, F.col("last_order"))
    return inside.select(F.col("customer").alias("customer_unique_id"), F.col("last_order").alias("last_order_date"), recency.alias("recency_days"))
