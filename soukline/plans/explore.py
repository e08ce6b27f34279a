"""Exploratory metrics and the series behind the standard charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soukline.functions import numbers
from soukline.functions.numbers import percent, ratio, right_closed_band, rounded
from soukline.operators import marts, ranking, rollups
from soukline.operators.cleaning import clean_orders, clean_payments, enrich_orders
from soukline.plans.trading import _amount, _cents, _rows, _with_share
from soukline.sources.tables import Tables

# Recency bands, closed on the right.
RECENCY_EDGES = [-1, 90, 180, 365, None]
RECENCY_LABELS = ["Recent", "Warm", "At Risk", "Lost"]


def delivered_values(t: Tables) -> DataFrame:
    """Delivered orders with their value; orders without items keep null."""
    return rollups.delivered_headers(t).join(rollups.order_totals(t), "order_id", "left")


def headline_metrics(t: Tables) -> DataFrame:
    values = delivered_values(t).select("order_total_value")
    late = enrich_orders(clean_orders(t.orders_in("delivered"))).agg(
        rounded(percent(F.sum("late_delivery_flag"), _rows()))
    )
    per_person = rollups.person_orders(t, rollups.delivered_headers(t)).groupBy("customer_unique_id").agg(
        _rows().alias("n")
    )
    single = per_person.agg(
        F.sum(numbers.flag(F.col("n") == 1)).alias("single"), F.sum(numbers.flag(F.col("n") > 1)).alias("repeat"),
        _rows().alias("all"),
    )
    sold = values.agg(F.sum("order_total_value").alias("v"), F.count("order_total_value").alias("n"))
    reviews = t.scores.agg(rounded(ratio(F.sum("review_score"), F.count("review_score"))))
    bought = F.col("order_purchase_timestamp")
    delivered = F.sum(numbers.flag(F.col("order_status") == "delivered"))
    return t.headers.agg(
        F.min(bought).alias("period_start"),
        F.max(bought).alias("period_end"),
        _rows().alias("orders"),
        delivered.alias("delivered_orders"),
        rounded(percent(delivered, _rows())).alias("delivery_rate_pct"),
    ).select(
        "*",
        t.customers.select(F.countDistinct("customer_unique_id")).scalar().alias("unique_customers"),
        sold.select(F.col("v").cast("double")).scalar().alias("gmv"),
        sold.select(rounded(ratio(F.col("v"), F.col("n")))).scalar().alias("aov"),
        ranking.percentiles(values, "order_total_value", {"m": 0.5}).select(rounded(F.col("m"), 4)).scalar().alias("median_order_value"),
        reviews.scalar().alias("avg_review_score"),
        late.scalar().alias("late_delivery_rate_pct"),
        single.select(rounded(percent(F.col("single"), F.col("all")))).scalar().alias("single_order_customer_pct"),
        single.select(rounded(percent(F.col("repeat"), F.col("all")))).scalar().alias("repeat_customer_pct"),
    )


def top_states(t: Tables, k: int = 5) -> DataFrame:
    return t.customers.groupBy("customer_state").agg(_rows().alias("customers")).orderBy(
        F.desc("customers"), "customer_state"
    ).limit(k)


def payment_shares(t: Tables) -> DataFrame:
    counts = clean_payments(t.payments).groupBy("payment_type").agg(_rows().alias("payments"))
    return _with_share(counts, "payments", "share_pct").orderBy(F.desc("payments"))


def monthly_series(t: Tables) -> DataFrame:
    return delivered_values(t).groupBy("purchase_month").agg(
        F.coalesce(F.sum("order_total_value"), F.lit(0)).cast("double").alias("order_total_value")
    ).orderBy("purchase_month")


def state_revenue(t: Tables, k: int = 10, leading: int = 5) -> DataFrame:
    """Top states by revenue, their share, and the share of the leading few."""
    states = rollups.person_orders(t, delivered_values(t)).groupBy("customer_state").agg(
        _amount("order_total_value").alias("revenue")
    )
    shared = _with_share(states, "revenue", "revenue_pct").withColumn(
        "place", F.row_number().over(Window.orderBy(F.desc("revenue"), "customer_state"))
    )
    lead = F.sum(F.when(F.col("place") <= leading, F.col("revenue_pct").cast("decimal(9,2)"))).over(Window.partitionBy())
    return shared.withColumn("leading_share_pct", lead.cast("double")).filter(F.col("place") <= k).orderBy("place")


def review_score_distribution(t: Tables) -> DataFrame:
    return t.scores.groupBy("review_score").agg(_rows().alias("reviews")).orderBy("review_score")


def _delivered_lines(t: Tables, key: str) -> DataFrame:
    lines = rollups.item_sums(t, "order_id", key)
    return lines.join(rollups.delivered_headers(t).select("order_id"), "order_id")


def top_seller_revenue(t: Tables, k: int = 15) -> DataFrame:
    return _delivered_lines(t, "seller_id").groupBy("seller_id").agg(_cents("total_value").alias("revenue")).orderBy(
        F.desc("revenue"), "seller_id"
    ).limit(k)


def top_category_revenue(t: Tables, k: int = 10) -> DataFrame:
    return (
        rollups.with_category(_delivered_lines(t, "product_id"), t)
        .groupBy("category_english")
        .agg(_cents("total_value").alias("revenue"))
        .orderBy(F.desc("revenue"), "category_english")
        .limit(k)
    )


def cohort_wide(t: Tables, periods: int | None = None, cohorts: int | None = None) -> DataFrame:
    """Cohort x period retention in percent, zero-filled; one column per period, by default up to the last one."""
    long = marts.cohort_retention(t)
    if periods is None:
        periods = (long.agg(F.max("period_number")).first()[0] or 0) + 1
    wide = (
        long.groupBy("cohort_month")
        .pivot("period_number", list(range(periods)))
        .agg(F.max("retention_rate"))
        .na.fill(0.0)
    )
    wide = wide.select("cohort_month", *[F.col(str(p)).alias(f"period_{p}") for p in range(periods)])
    return wide.orderBy("cohort_month").limit(cohorts) if cohorts else wide.orderBy("cohort_month")


def recency_segments(t: Tables) -> DataFrame:
    band = right_closed_band(F.col("recency_days"), RECENCY_EDGES, RECENCY_LABELS)
    return marts.customer_lifecycle(t).groupBy(band.alias("segment")).agg(_rows().alias("customers"))


def late_and_repeat_rates(t: Tables) -> DataFrame:
    late = enrich_orders(clean_orders(t.orders_in("delivered")))
    people = rollups.person_orders(t, rollups.delivered_headers(t)).groupBy("customer_unique_id").agg(_rows().alias("n"))
    single = F.sum(numbers.flag(F.col("n") == 1))
    split = people.agg(
        rounded(percent(single, _rows())).alias("s"), rounded(percent(_rows() - single, _rows())).alias("r")
    )
    return late.agg(rounded(percent(F.sum("late_delivery_flag"), _rows())).alias("late_delivery_rate_pct")).select(
        "late_delivery_rate_pct",
        split.select("s").scalar().alias("single_order_pct"),
        split.select("r").scalar().alias("repeat_pct"),
    )
