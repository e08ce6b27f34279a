"""Order-level building blocks.

Items and reviews are reduced to one row per order (or per order and product)
before any join. Joins then meet one row per key, so neither a large order nor
one with many reviews can blow up or land on a single task. Where a result
counts item x review rows, it is computed from the two counts, not by emitting
the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soukline.functions import clock, numbers, text
from soukline.operators.cleaning import (
    clean_customers, clean_orders, clean_reviews,
)
from soukline.sources.tables import Tables


def item_sums(tables: Tables, *keys: str) -> DataFrame:
    """Item count and money per key, the money in whole cents."""
    return tables.item_cents.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_items"), *[F.sum(c).alias(c) for c in ("price", "freight_value", "total_value")]
    )


def order_totals(tables: Tables) -> DataFrame:
    """Per order: item count, price, freight and total as DECIMAL."""
    return item_sums(tables, "order_id").select(
        "order_id",
        F.col("n_items").alias("order_item_count"),
        numbers.from_cents(F.col("price")).alias("order_price"),
        numbers.from_cents(F.col("freight_value")).alias("order_freight"),
        numbers.from_cents(F.col("total_value")).alias("order_total_value"),
    )


def order_reviews(reviews: DataFrame, valid_only: bool = True) -> DataFrame:
    return (
        clean_reviews(reviews, valid_only)
        .groupBy("order_id")
        .agg(
            F.count(F.lit(1)).alias("n_reviews"),
            F.sum("review_score").alias("score_sum"),
            F.sum("is_detractor").alias("n_detractors"),
        )
    )


def people(tables: Tables) -> DataFrame:
    return clean_customers(tables.customers).select(
        "customer_id", "customer_unique_id", "customer_state", "customer_city"
    )


def delivered_headers(tables: Tables) -> DataFrame:
    return clean_orders(tables.headers_in("delivered"))


def delivered_orders(tables: Tables) -> DataFrame:
    """Delivered orders with lateness and delivery time in whole days."""
    arrived = F.col("order_delivered_customer_date")
    return clean_orders(tables.orders_in("delivered")).select(
        "*",
        numbers.flag(arrived > F.col("order_estimated_delivery_date")).alias("is_late_delivery"),
        clock.whole_days(arrived, F.col("order_purchase_timestamp")).alias("delivery_days"),
    )


def delivered_amounts(tables: Tables) -> DataFrame:
    """Delivered orders that have items, with their totals: one row per order."""
    return delivered_headers(tables).join(order_totals(tables), "order_id")


def person_orders(tables: Tables, headers: DataFrame) -> DataFrame:
    """Orders with the person, state and city behind the per-order customer id."""
    return headers.join(people(tables), "customer_id")


def with_category(lines: DataFrame, tables: Tables, how: str = "inner") -> DataFrame:
    """Adds the native and English category of each product.

    Products and translation are joined one after the other rather than with
    each other first: the planner sees the true size of each and can broadcast
    whichever is under its threshold.
    """
    native = tables.products.select(
        "product_id", F.lower("product_category_name").alias("_native"), F.lit(True).alias("_known")
    )
    english = tables.translation.select(
        F.lower("product_category_name").alias("_native"), F.lower("product_category_name_english").alias("_english")
    )
    named = lines.join(native, "product_id", how).join(english, "_native", "left")
    unknown = F.when(F.col("_known"), F.lit("unknown"))
    return named.select(
        *lines.columns,
        F.coalesce("_native", unknown).alias("product_category_name"),
        F.coalesce("_english", unknown).alias("category_english"),
    )


def sales_lines(tables: Tables) -> DataFrame:
    """One row per order, product and seller of a delivered order.

    Money is in cents. ``fan_out`` is the number of item x review rows one item
    stands for.
    """
    lines = item_sums(tables, "order_id", "product_id", "seller_id")
    orders = person_orders(tables, delivered_orders(tables)).join(
        order_reviews(tables.scores), "order_id", "left"
    )
    sellers = tables.sellers.select("seller_id", "seller_state")
    return (
        with_category(lines.join(orders, "order_id"), tables)
        .join(sellers, "seller_id")
        .withColumn("n_reviews", F.coalesce("n_reviews", F.lit(0)))
        .withColumn("fan_out", F.greatest(F.col("n_reviews"), F.lit(1)))
    )
