"""Cleaned base relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soukline.functions import clock, numbers, text
from soukline.sources.tables import ORDER_TIMES, Tables


def clean_customers(customers: DataFrame, pad_zip: bool = True) -> DataFrame:
    zip_code = F.col("customer_zip_code_prefix")
    return customers.select(
        "customer_id",
        "customer_unique_id",
        (text.zero_pad(zip_code) if pad_zip else zip_code).alias("customer_zip_code_prefix"),
        text.lower_trim(F.col("customer_city")).alias("customer_city"),
        text.upper_trim(F.col("customer_state")).alias("customer_state"),
        text.standardize_text(F.col("customer_city")).alias("customer_city_clean"),
    )


def clean_orders(orders: DataFrame) -> DataFrame:
    """Typed times, delivered flag, month and year; rows without purchase time go."""
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ORDER_TIMES if c in orders.columns]
    bought = F.col("order_purchase_timestamp")
    return (
        orders.select("order_id", "customer_id", "order_status", *times)
        .filter(bought.isNotNull())
        .withColumn("is_delivered", numbers.flag(F.col("order_status") == "delivered"))
        .withColumn("purchase_month", clock.month_start(bought))
        .withColumn("purchase_year", F.year(bought))
    )


def enrich_orders(orders: DataFrame) -> DataFrame:
    bought, approved = F.col("order_purchase_timestamp"), F.col("order_approved_at")
    arrived = F.col("order_delivered_customer_date")
    return orders.select(
        *orders.columns,
        clock.month_label(bought).alias("order_purchase_month"),
        F.year(bought).alias("order_purchase_year"),
        clock.weekday_name(bought).alias("order_purchase_weekday"),
        numbers.flag(F.col("order_status") == "delivered").alias("delivered_flag"),
        numbers.flag(arrived > F.col("order_estimated_delivery_date")).alias("late_delivery_flag"),
        clock.floor_days(arrived, bought).alias("delivery_days"),
        clock.fractional_days(approved, bought).alias("approval_days"),
        clock.fractional_days(F.col("order_delivered_carrier_date"), approved).alias("carrier_days"),
    )


def clean_items(items: DataFrame) -> DataFrame:
    price, freight = numbers.money(F.col("price")), numbers.money(F.col("freight_value"))
    return items.select(
        "order_id",
        "order_item_id",
        "product_id",
        "seller_id",
        F.col("shipping_limit_date").cast("timestamp_ntz").alias("shipping_limit_date"),
        price.alias("price"),
        freight.alias("freight_value"),
        numbers.money(price + freight).alias("total_value"),
        numbers.ratio(price, freight).alias("price_per_freight_ratio"),
    )


def clean_products(products: DataFrame, translation: DataFrame) -> DataFrame:
    """English names by left join; ``unknown`` where there is none."""
    english = translation.select(
        F.lower("product_category_name").alias("_native"),
        F.lower("product_category_name_english").alias("_english"),
    )
    native = F.lower("product_category_name")
    joined = products.join(english, native == F.col("_native"), "left")
    sizes = [c for c in products.columns if c not in ("product_id", "product_category_name")]
    return joined.select(
        "product_id",
        F.coalesce(native, F.lit("unknown")).alias("product_category_name"),
        F.coalesce("_english", F.lit("unknown")).alias("category_english"),
        *sizes,
        numbers.flag(native.isNotNull()).alias("has_category"),
        (F.col("product_weight_g") / F.lit(1000.0)).alias("product_weight_kg"),
    )


def clean_reviews(reviews: DataFrame, valid_only: bool = True) -> DataFrame:
    score = F.col("review_score")
    said = F.coalesce("review_comment_title", "review_comment_message").isNotNull()
    out = reviews.select(
        *reviews.columns,
        numbers.flag(score <= 2).alias("is_detractor"),
        numbers.flag(score >= 4).alias("is_promoter"),
        numbers.flag(said).alias("has_review_text"),
    )
    return out.filter(score.between(1, 5)) if valid_only else out


def clean_geolocation(geolocation: DataFrame, dedupe_first: bool = False) -> DataFrame:
    """One row per zip and state: mean point and most frequent city.

    Coordinates are averaged as DECIMAL so the mean does not depend on row
    order. City ties go to the smallest name. The city is standardised before
    it is counted. Cities are counted per zip first, so no task holds all rows
    of a large zip.
    """
    source = geolocation.dropDuplicates() if dedupe_first else geolocation
    rows = source.select(
        text.zero_pad(F.col("geolocation_zip_code_prefix")).alias("geolocation_zip_code_prefix"),
        F.upper(F.trim("geolocation_state")).alias("geolocation_state"),
        F.col("geolocation_lat").cast("decimal(18,8)").alias("lat"),
        F.col("geolocation_lng").cast("decimal(18,8)").alias("lng"),
        text.standardize_text(F.col("geolocation_city")).alias("city"),
    )
    place = ["geolocation_zip_code_prefix", "geolocation_state"]
    per_city = rows.groupBy(*place, "city").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"sum_{c}") for c in ("lat", "lng")],
        *[F.count(c).alias(f"n_{c}") for c in ("lat", "lng")],
    )
    # The smallest of (-count, name) is the mode with its tie rule.
    ranked = F.when(F.col("city").isNotNull(), F.struct((-F.col("n")).alias("k"), "city"))
    return per_city.groupBy(*place).agg(
        numbers.ratio(F.sum("sum_lat"), F.sum("n_lat")).alias("geolocation_lat"),
        numbers.ratio(F.sum("sum_lng"), F.sum("n_lng")).alias("geolocation_lng"),
        F.min(ranked)["city"].alias("geolocation_city_clean"),
    )


def clean_sellers(sellers: DataFrame) -> DataFrame:
    return sellers.select(
        "seller_id",
        text.zero_pad(F.col("seller_zip_code_prefix")).alias("seller_zip_code_prefix"),
        "seller_city",
        F.upper("seller_state").alias("seller_state"),
        text.standardize_text(F.col("seller_city")).alias("seller_city_clean"),
    )


def clean_payments(payments: DataFrame) -> DataFrame:
    return payments.select(
        "order_id",
        F.lower("payment_type").alias("payment_type"),
        "payment_installments",
        numbers.money(F.col("payment_value")).alias("payment_value"),
    )


def cleaning_audit(tables: Tables, lifecycle: DataFrame) -> DataFrame:
    """One row per measure: table sizes, delivered orders, late share."""
    def size(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("measure"), "value")

    frames = [size(f"{name}_rows", df) for name, df in tables.named().items()
              if name not in ("geolocation", "orders", "translation")]
    frames.append(size("geolocation_rows", clean_geolocation(tables.geolocation)))
    frames.append(size("customer_features_rows", lifecycle))
    late = enrich_orders(tables.orders)
    done = late.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("delivered_flag").alias("delivered"),
        F.sum(F.when(F.col("delivered_flag") == 1, F.col("late_delivery_flag"))).alias("late"),
    )
    frames.append(
        done.select(
            F.explode(
                F.create_map(
                    F.lit("orders_rows"), F.col("rows").cast("double"),
                    F.lit("delivered_orders"), F.col("delivered").cast("double"),
                    F.lit("late_delivery_rate"), numbers.rounded(numbers.percent(F.col("late"), F.col("delivered"))),
                )
            ).alias("measure", "value")
        )
    )
    return reduce(DataFrame.unionByName, frames)
