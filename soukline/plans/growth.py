"""Business questions, second set: growth, retention, operations, marketplace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soukline.functions import clock, numbers
from soukline.functions.numbers import percent, ratio, rounded
from soukline.operators import marts, ranking, rollups
from soukline.operators.cleaning import clean_orders
from soukline.plans.trading import _amount, _cents, _review_stats, _rows, _state_orders, _with_share
from soukline.sources.tables import Tables


def monthly_growth(t: Tables) -> DataFrame:
    monthly = rollups.delivered_amounts(t).groupBy("purchase_month").agg(
        _rows().alias("delivered_orders"), F.sum("order_total_value").alias("v")
    )
    before = F.lag("v").over(Window.orderBy("purchase_month"))
    return monthly.select(
        "purchase_month",
        "delivered_orders",
        F.col("v").cast("double").alias("gmv"),
        rounded(ratio(F.col("v"), F.col("delivered_orders"))).alias("aov"),
        rounded(percent(F.col("v") - before, before)).alias("mom_gmv_growth_pct"),
    ).orderBy("purchase_month")


def _category_orders(t: Tables) -> DataFrame:
    """Delivered order x category with its value in cents, no review involved."""
    lines = rollups.item_sums(t, "order_id", "product_id").join(
        rollups.delivered_headers(t).select("order_id", "purchase_month"), "order_id"
    )
    return rollups.with_category(lines, t).groupBy("order_id", "category_english", "purchase_month").agg(
        F.sum("total_value").alias("value")
    )


def category_month_value(t: Tables, min_orders: int = 25) -> DataFrame:
    cells = (
        _category_orders(t)
        .groupBy("purchase_month", "category_english")
        .agg(_rows().alias("delivered_orders"), F.sum("value").alias("v"))
        .filter(F.col("delivered_orders") >= min_orders)
    )
    best = Window.partitionBy("purchase_month").orderBy(F.desc("v"), "category_english")
    return cells.select(
        "purchase_month", "category_english", "delivered_orders",
        numbers.amount(F.col("v")).alias("gmv"),
        rounded(ratio(numbers.amount(F.col("v")), F.col("delivered_orders"))).alias("aov"),
        F.row_number().over(best).alias("category_rank_in_month"),
    ).orderBy("purchase_month", "category_rank_in_month")


def category_concentration(t: Tables) -> DataFrame:
    """Pareto over categories: a catalogue, so one window partition is enough."""
    cats = _category_orders(t).groupBy("category_english").agg(
        _rows().alias("delivered_orders"), F.sum("value").alias("revenue")
    )
    best = Window.orderBy(F.desc("revenue"), "category_english")
    upto = F.sum("revenue").over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.sum("revenue").over(Window.partitionBy())
    return cats.select(
        "category_english",
        "delivered_orders",
        numbers.amount(F.col("revenue")).alias("revenue"),
        rounded(percent(F.col("revenue"), whole)).alias("revenue_share_pct"),
        rounded(percent(upto, whole)).alias("cumulative_share_pct"),
        F.dense_rank().over(Window.orderBy(F.desc("revenue"))).alias("revenue_rank"),
    ).orderBy(F.desc("revenue"))


def first_time_vs_repeat(t: Tables) -> DataFrame:
    """Order counts over every status, revenue over delivered orders only."""
    placed = rollups.person_orders(t, clean_orders(t.headers)).groupBy("customer_unique_id").agg(
        _rows().alias("total_orders")
    )
    paid = rollups.person_orders(t, rollups.delivered_amounts(t)).groupBy("customer_unique_id").agg(
        F.sum("order_total_value").alias("value")
    )
    kind = F.when(F.col("total_orders") == 1, "First-time customers").otherwise("Repeat customers")
    split = placed.join(paid, "customer_unique_id").groupBy(kind.alias("customer_type")).agg(
        _rows().alias("customers"),
        _amount("value").alias("revenue"),
        rounded(ratio(F.sum("value"), _rows())).alias("avg_customer_revenue"),
    )
    shared = _with_share(split, "customers", "customer_share_pct")
    return _with_share(shared, "revenue", "revenue_share_pct").orderBy(F.desc("revenue"))


def second_purchase(t: Tables) -> DataFrame:
    """First to second order: conversion, mean and median days between."""
    orders = rollups.person_orders(t, rollups.delivered_headers(t))
    sequence = Window.partitionBy("customer_unique_id").orderBy("order_purchase_timestamp", "order_id")
    # The filter on the rank keeps two rows per person in every map task, so a
    # person with very many orders never gathers them all in one place.
    leading = (
        orders.select("customer_unique_id", "order_id", "order_purchase_timestamp")
        .withColumn("n", F.row_number().over(sequence))
        .filter(F.col("n") <= 2)
    )
    bought = F.col("order_purchase_timestamp")
    gaps = leading.groupBy("customer_unique_id").agg(
        clock.elapsed_micros(
            F.max(F.when(F.col("n") == 2, bought)), F.max(F.when(F.col("n") == 1, bought))
        ).alias("gap")
    )
    repeat = F.count("gap")
    day = F.lit(float(clock.MICROS_PER_DAY))
    totals = gaps.agg(
        _rows().alias("customers"),
        repeat.alias("repeat_customers"),
        rounded(percent(repeat, _rows())).alias("repeat_customer_rate_pct"),
        rounded(ratio(F.sum(F.col("gap").cast("decimal(20,0)")), repeat) / day, 1).alias("avg_days_to_second_order"),
    )
    median = ranking.percentiles(gaps, "gap", {"m": 0.5}).select(rounded(F.col("m") / day, 4))
    return totals.withColumn("median_days_to_second_order", median.scalar())


def cohort_curves(t: Tables) -> DataFrame:
    return marts.cohort_retention(t).withColumnRenamed("retention_rate", "retention_pct").orderBy(
        "cohort_month", "period_number"
    )


def _lifecycle_value(t: Tables, by: list[str]) -> DataFrame:
    reference = clock.plus_days(marts.last_purchase(t, delivered=False), 1)
    return (
        rollups.person_orders(t, rollups.delivered_amounts(t))
        .groupBy(*by)
        .agg(
            _rows().alias("order_count"),
            F.sum("order_total_value").cast(numbers.WIDE_MONEY).alias("lifetime_value"),
            F.max("order_purchase_timestamp").alias("last_order_date"),
        )
        .withColumn("recency_micros", clock.elapsed_micros(reference, F.col("last_order_date")))
        .drop("last_order_date")
    )


def rfm_value_segments(t: Tables) -> DataFrame:
    """Segments from fractional recency and ascending frequency and value."""
    scored = _lifecycle_value(t, ["customer_unique_id", "customer_state"])
    tie = ["customer_unique_id", "customer_state"]
    for column, out in (
        ("recency_micros", "recency_score"), ("order_count", "frequency_score"), ("lifetime_value", "monetary_score"),
    ):
        scored = ranking.ntile(scored, 5, [column, *tie], out)
    label = marts.rfm_label("recency_score", "frequency_score", "monetary_score")
    segments = scored.groupBy(label.alias("rfm_segment")).agg(
        _rows().alias("customers"),
        _amount("lifetime_value").alias("segment_revenue"),
        rounded(ratio(F.sum("lifetime_value"), _rows())).alias("avg_clv"),
        rounded(ratio(F.sum("order_count"), _rows())).alias("avg_orders_per_customer"),
    )
    shared = _with_share(segments, "customers", "customer_share_pct")
    return _with_share(shared, "segment_revenue", "revenue_share_pct").orderBy(F.desc("segment_revenue"))


def churn_status(recency_days: Column) -> Column:
    """Bands as written: fractional days between 30 and 31 or 90 and 91 are Active."""
    return (
        F.when(recency_days > 180, "Churned")
        .when(recency_days.between(91, 180), "At Risk")
        .when(recency_days.between(31, 90), "Warm")
        .otherwise("Active")
    )


def churn_funnel(t: Tables) -> DataFrame:
    people = _lifecycle_value(t, ["customer_unique_id"])
    day = F.lit(float(clock.MICROS_PER_DAY))
    recency = F.col("recency_micros") / day
    bands = people.groupBy(churn_status(recency).alias("churn_status")).agg(
        _rows().alias("customers"),
        _amount("lifetime_value").alias("revenue_at_status"),
        rounded(ratio(F.sum(F.col("recency_micros").cast("decimal(20,0)")), _rows()) / day, 1).alias("avg_recency_days"),
        rounded(ratio(F.sum("order_count"), _rows())).alias("avg_orders_per_customer"),
    )
    return _with_share(bands, "customers", "customer_share_pct").orderBy(F.desc("customers"))


def _delivery_spans(t: Tables) -> DataFrame:
    arrived, promised = F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")
    return (
        rollups.delivered_orders(t)
        .withColumn("on_time", numbers.flag(arrived <= promised))
        .withColumn("late", numbers.flag(arrived > promised))
        .withColumn("span", clock.elapsed_micros(arrived, F.col("order_purchase_timestamp")).cast("decimal(20,0)"))
    )


def _mean_span(digits: int = 2) -> Column:
    day = F.lit(float(clock.MICROS_PER_DAY))
    return rounded(ratio(F.sum("span"), F.count("span")) / day, digits)


def on_time_by_month(t: Tables) -> DataFrame:
    """Orders without a delivery date stay in the denominator."""
    return _delivery_spans(t).groupBy("purchase_month").agg(
        _rows().alias("delivered_orders"),
        F.sum("on_time").alias("on_time_orders"),
        F.sum("late").alias("late_orders"),
        rounded(percent(F.sum("on_time"), _rows())).alias("on_time_rate_pct"),
        _mean_span().alias("avg_delivery_days"),
    ).orderBy("purchase_month")


def _dated(t: Tables) -> DataFrame:
    return _delivery_spans(t).filter(
        F.col("order_delivered_customer_date").isNotNull() & F.col("order_estimated_delivery_date").isNotNull()
    )


def review_impact(t: Tables) -> DataFrame:
    status = F.when(F.col("late") == 1, "Late").otherwise("On Time")
    rows = rollups.order_reviews(t.scores).join(_dated(t), "order_id").withColumn("delivery_status", status)
    names = {"n": "reviews", "bad": "detractor_reviews", "rate": "detractor_rate_pct"}
    return _review_stats(rows, "delivery_status", names).orderBy("avg_review_score")


def late_by_state(t: Tables) -> DataFrame:
    return rollups.person_orders(t, _dated(t)).groupBy("customer_state").agg(
        _rows().alias("delivered_orders"),
        F.sum("late").alias("late_orders"),
        rounded(percent(F.sum("late"), _rows())).alias("late_delivery_rate_pct"),
        _mean_span().alias("avg_delivery_days"),
    ).orderBy(F.desc("late_delivery_rate_pct"), F.desc("delivered_orders"))


def category_demand(t: Tables) -> DataFrame:
    cats = _state_orders(t).groupBy("category_english").agg(
        F.countDistinct("order_id").alias("delivered_orders"),
        F.sum(F.col("n_items") * F.col("fan_out")).alias("item_lines"),
        _cents("value").alias("revenue"),
    )
    best = Window.orderBy(F.desc("revenue"))
    return _with_share(cats, "revenue", "revenue_share_pct").withColumn(
        "revenue_rank", F.dense_rank().over(best)
    ).orderBy(F.desc("revenue"))


def _weighted_delivery(df: DataFrame, by: str) -> DataFrame:
    rows = F.col("n_items") * F.col("fan_out")
    timed = F.when(F.col("delivery_days").isNotNull(), rows)
    return df.groupBy(by).agg(
        F.countDistinct("order_id").alias("delivered_orders"),
        F.sum("value").alias("revenue"),
        rounded(ratio(F.sum(F.col("score_sum") * F.col("n_items")), F.sum(F.col("n_reviews") * F.col("n_items")))).alias("avg_review_score"),
        rounded(ratio(F.sum(F.col("delivery_days") * timed), F.sum(timed))).alias("avg_delivery_days"),
        rounded(percent(F.sum(F.col("is_late_delivery") * rows), F.sum(rows))).alias("late_delivery_rate_pct"),
    )


def state_demand(t: Tables) -> DataFrame:
    """Demand against delivery per state, taken from the fact's own state."""
    states = _weighted_delivery(_state_orders(t), "customer_state").drop("avg_review_score")
    best = Window.orderBy(F.desc("revenue"), "customer_state")
    ranked = states.withColumn("state_rank_by_revenue", F.row_number().over(best))
    return _with_share(
        ranked.withColumn("revenue", numbers.amount(F.col("revenue"))), "revenue", "revenue_share_pct"
    ).orderBy("state_rank_by_revenue")


def seller_concentration(t: Tables) -> DataFrame:
    """Pareto over sellers, whose number grows with the data."""
    sellers = _state_orders(t).groupBy("seller_id").agg(
        F.countDistinct("order_id").alias("delivered_orders"), F.sum("value").alias("revenue")
    )
    ranked = ranking.running_totals(
        sellers, [F.desc("revenue"), "seller_id"], {"upto": "revenue"}, {"revenue_rank": "revenue"}
    )
    return ranked.select(
        "seller_id",
        "delivered_orders",
        numbers.amount(F.col("revenue")).alias("revenue"),
        rounded(percent(F.col("revenue"), F.col("upto_total"))).alias("revenue_share_pct"),
        rounded(percent(F.col("upto"), F.col("upto_total"))).alias("cumulative_revenue_share_pct"),
        "revenue_rank",
    ).orderBy(F.desc("revenue"), "seller_id")


def seller_scorecard(t: Tables, k: int = 50) -> DataFrame:
    """Top sellers; the rank is numbered over the k kept rows only."""
    best = [F.desc("revenue"), F.asc("seller_id")]
    top = _weighted_delivery(_state_orders(t), "seller_id").orderBy(*best).limit(k)
    return top.withColumn("seller_rank_by_revenue", F.row_number().over(Window.orderBy(*best))).withColumn(
        "revenue", numbers.amount(F.col("revenue"))
    ).orderBy("seller_rank_by_revenue")
