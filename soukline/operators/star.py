"""Star schema: four dimensions and the sales fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soukline.functions import clock, numbers
from soukline.sources.sinks import day_series
from soukline.sources.tables import Tables


def staged_items(items: DataFrame) -> DataFrame:
    price, freight = numbers.money(F.col("price")), numbers.money(F.col("freight_value"))
    return items.select(
        "order_id", "order_item_id", "product_id", "seller_id",
        price.alias("price"), freight.alias("freight_value"), (price + freight).alias("item_total_value"),
    )


def dim_customer(tables: Tables, one_row_per_person: bool = False) -> DataFrame:
    """Person x address as written; optionally the address of the latest order."""
    rows = tables.customers.select(
        "customer_id",
        F.col("customer_unique_id").alias("person"),
        F.col("customer_city").alias("city"),
        F.col("customer_state").alias("state"),
    )
    if one_row_per_person:
        latest = F.struct("order_purchase_timestamp", "order_id")
        rows = (
            rows.join(tables.headers, "customer_id")
            .groupBy("person")
            .agg(F.max_by(F.struct("city", "state"), latest).alias("place"))
            .select("person", "place.city", "place.state")
        )
    else:
        rows = rows.select("person", "city", "state").distinct()
    return rows.select(
        numbers.surrogate_key(F.col("person")).alias("customer_key"),
        F.col("person").alias("customer_id"), "city", "state",
    )


def dim_product(tables: Tables) -> DataFrame:
    names = tables.translation.withColumnRenamed("product_category_name", "_native")
    native = F.col("product_category_name")
    return tables.products.join(names, native == F.col("_native"), "left").select(
        numbers.surrogate_key(F.col("product_id")).alias("product_key"),
        "product_id",
        F.coalesce("product_category_name_english", native, F.lit("unknown")).alias("category_name"),
        (F.col("product_weight_g") / F.lit(1000.0)).alias("weight_kg"),
    )


def dim_seller(tables: Tables) -> DataFrame:
    return tables.sellers.select(
        numbers.surrogate_key(F.col("seller_id")).alias("seller_key"),
        "seller_id",
        F.col("seller_city").alias("city"),
        F.col("seller_state").alias("state"),
    )


def calendar(days: DataFrame) -> DataFrame:
    """Calendar attributes for a one-column frame of dates."""
    day = F.col("date")
    return days.select(
        clock.day_key(day).alias("date_key"),
        "date",
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.dayofmonth(day).alias("day"),
        F.dayofweek(day).alias("day_of_week"),
        F.concat(F.lit("Q"), F.quarter(day)).alias("quarter"),
        F.date_format(day, "MMM yyyy").alias("month_year"),
        clock.month_label(day).alias("year_month"),
        (F.year(day) * 100 + F.month(day)).alias("month_year_sort"),
    )


def dim_date(spark: SparkSession, first: str, last: str) -> DataFrame:
    return calendar(day_series(spark, F.lit(first).cast("date"), F.lit(last).cast("date")))


def dim_date_of(tables: Tables) -> DataFrame:
    """Calendar from the first to the last purchase day."""
    bought = F.col("order_purchase_timestamp").cast("date")
    span = tables.headers.agg(F.min(bought).alias("lo"), F.max(bought).alias("hi"))
    return calendar(day_series(span.sparkSession, F.col("lo"), F.col("hi"), bounds=span))


def fact_sales(tables: Tables) -> DataFrame:
    """Delivered items with four surrogate keys and the order's mean review."""
    arrived, bought = F.col("order_delivered_customer_date"), F.col("order_purchase_timestamp")
    score = tables.scores.groupBy("order_id").agg(
        numbers.ratio(F.sum("review_score"), F.count("review_score")).alias("review_score")
    )
    orders = (
        tables.orders_in("delivered")
        .join(tables.customers.select("customer_id", "customer_unique_id"), "customer_id")
        .join(score, "order_id", "left")
        .select(
            "order_id",
            numbers.surrogate_key(F.col("customer_unique_id")).alias("customer_key"),
            clock.day_key(bought).alias("date_key"),
            clock.calendar_days(arrived, bought).alias("delivery_days"),
            numbers.flag(arrived > F.col("order_estimated_delivery_date")).alias("is_late"),
            "review_score",
        )
    )
    return staged_items(tables.items).join(orders, "order_id").select(
        "customer_key",
        numbers.surrogate_key(F.col("product_id")).alias("product_key"),
        numbers.surrogate_key(F.col("seller_id")).alias("seller_key"),
        "date_key", "order_id", "order_item_id",
        F.col("price").alias("item_price"),
        F.col("freight_value").alias("freight_cost"),
        F.col("item_total_value").alias("total_item_value"),
        "delivery_days", "is_late", "review_score",
    )
