"""Business questions, first set: revenue, customers, delivery, payments.

Thresholds, top-k sizes and bands are parameters. Windows without a partition
appear only over months, weekdays, states, segments or other catalogues whose
size does not grow with the data; seller- and customer-sized relations use the
operators in ``ranking``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soukline.functions import clock, numbers
from soukline.functions.numbers import percent, ratio, rounded
from soukline.operators import marts, ranking, rollups
from soukline.operators.cleaning import clean_orders, clean_payments, clean_reviews
from soukline.sources.tables import Tables


def _amount(column: Column) -> Column:
    return F.sum(column).cast("double")


def _cents(column: Column | str) -> Column:
    return numbers.amount(F.sum(column))


def _rows() -> Column:
    return F.count(F.lit(1))


def _with_share(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.withColumn(out, rounded(ranking.share_of_total(df, column)))


def _item_weighted_value(by: str) -> list[Column]:
    """Order value averaged over item rows, so large baskets weigh more."""
    weighted = F.sum(F.col("order_total_value") * F.col("order_item_count"))
    return [rounded(ratio(weighted, F.sum("order_item_count"))).alias(by)]


def monthly_gmv(t: Tables) -> DataFrame:
    return rollups.delivered_amounts(t).groupBy("purchase_month").agg(
        _rows().alias("order_count"),
        _amount("order_total_value").alias("gmv"),
        *_item_weighted_value("avg_order_value"),
    ).orderBy("purchase_month")


def repeat_share(t: Tables, per_address: bool = True) -> DataFrame:
    kind = F.when(F.col("total_orders") == 1, "Single Order").otherwise("Repeat Customer")
    counts = marts.customer_summary(t, per_address=per_address).groupBy(kind.alias("customer_type")).agg(
        _rows().alias("customer_count")
    )
    return _with_share(counts, "customer_count", "pct_of_customers")


def _state_orders(t: Tables) -> DataFrame:
    """Sales lines with the review fan-out applied to the value, in cents."""
    return rollups.sales_lines(t).withColumn("value", F.col("total_value") * F.col("fan_out"))


def revenue_by_state(t: Tables) -> DataFrame:
    per_order = _state_orders(t).groupBy("customer_state", "customer_unique_id", "order_id").agg(
        F.sum("value").alias("value")
    )
    per_person = per_order.groupBy("customer_state", "customer_unique_id").agg(
        _rows().alias("orders"), F.sum("value").alias("value")
    )
    states = per_person.groupBy("customer_state").agg(
        _rows().alias("customers"), F.sum("orders").alias("orders"), _cents("value").alias("revenue")
    )
    return _with_share(states, "revenue", "revenue_pct").orderBy(F.desc("revenue"))


def top_categories(t: Tables, k: int = 10) -> DataFrame:
    lines = _state_orders(t)
    return (
        lines.groupBy("category_english")
        .agg(
            F.countDistinct("order_id").alias("orders"),
            F.countDistinct("product_id").alias("products"),
            _cents("value").alias("revenue"),
            rounded(
                ratio(_cents(F.col("price") * F.col("fan_out")), F.sum(F.col("n_items") * F.col("fan_out")))
            ).alias("avg_item_price"),
        )
        .orderBy(F.desc("revenue"), "category_english")
        .limit(k)
    )


def on_time_by_state(t: Tables, min_deliveries: int = 100, per_address_row: bool = True) -> DataFrame:
    """On-time share per state.

    As written every delivery counts once per customer row of its person. Both
    sides are reduced per person first, so the repeated rows are counted, not
    produced. With ``per_address_row=False`` each delivery counts once.
    """
    deliveries = marts.delivery_features(t)
    if per_address_row:
        done = deliveries.groupBy("customer_unique_id").agg(
            _rows().alias("n"), F.sum("is_on_time").alias("ok"), F.sum("delivery_days").alias("days")
        )
        copies = rollups.people(t).groupBy("customer_unique_id", "customer_state").agg(_rows().alias("copies"))
        rows = copies.join(done, "customer_unique_id").select(
            "customer_state", *[(F.col(c) * F.col("copies")).alias(c) for c in ("n", "ok", "days")]
        )
    else:
        place = rollups.person_orders(t, rollups.delivered_headers(t)).select("order_id", "customer_state")
        rows = deliveries.join(place, "order_id").select(
            "customer_state", F.lit(1).alias("n"), F.col("is_on_time").alias("ok"), F.col("delivery_days").alias("days")
        )
    return (
        rows.groupBy("customer_state")
        .agg(F.sum("n").alias("total_deliveries"), F.sum("ok").alias("on_time_count"), F.sum("days").alias("days"))
        .filter(F.col("total_deliveries") >= min_deliveries)
        .select(
            "customer_state",
            "total_deliveries",
            "on_time_count",
            rounded(percent(F.col("on_time_count"), F.col("total_deliveries"))).alias("on_time_pct"),
            rounded(ratio(F.col("days"), F.col("total_deliveries")), 1).alias("avg_delivery_days"),
        )
        .orderBy("on_time_pct")
    )


def _review_stats(rows: DataFrame, by: str, names: dict[str, str]) -> DataFrame:
    n, score, bad = F.sum("n_reviews"), F.sum("score_sum"), F.sum("n_detractors")
    return rows.groupBy(by).agg(
        n.alias(names["n"]),
        rounded(ratio(score, n)).alias("avg_review_score"),
        bad.alias(names["bad"]),
        rounded(percent(bad, n)).alias(names["rate"]),
    )


def reviews_by_lateness(t: Tables) -> DataFrame:
    status = F.when(F.col("is_late") == 1, "Late").otherwise("On Time")
    rows = rollups.order_reviews(t.scores).join(marts.delivery_features(t), "order_id")
    return _review_stats(
        rows.withColumn("delivery_status", status), "delivery_status",
        {"n": "review_count", "bad": "detractor_count", "rate": "detractor_pct"},
    )


def rfm_distribution(t: Tables) -> DataFrame:
    segments = marts.rfm_segments(marts.rfm_features(t)).groupBy("rfm_segment").agg(
        _rows().alias("customer_count"),
        _amount("monetary").alias("segment_revenue"),
        rounded(ratio(F.sum("frequency"), _rows())).alias("avg_frequency"),
        rounded(ratio(F.sum("monetary"), _rows())).alias("avg_monetary"),
    )
    shared = _with_share(segments, "customer_count", "customer_pct")
    return _with_share(shared, "segment_revenue", "revenue_pct").orderBy(F.desc("segment_revenue"))


def cohort_matrix_long(t: Tables) -> DataFrame:
    return marts.cohort_retention(t).withColumnRenamed("retention_rate", "retention_pct").orderBy(
        "cohort_month", "period_number"
    )


def clv_by_state(t: Tables, min_customers: int = 200, per_address: bool = True) -> DataFrame:
    summary = marts.customer_summary(t, per_address=per_address).select("customer_state", "lifetime_value")
    stats = (
        summary.groupBy("customer_state")
        .agg(
            _rows().alias("customers"),
            rounded(ratio(F.sum("lifetime_value"), _rows())).alias("avg_clv"),
            F.max("lifetime_value").cast("double").alias("max_clv"),
        )
        .filter(F.col("customers") >= min_customers)
    )
    medians = ranking.percentiles(summary, "lifetime_value", {"median_clv": 0.5}, by=["customer_state"])
    medians = medians.withColumn("median_clv", rounded(F.col("median_clv"), 4))
    return stats.join(medians, "customer_state").orderBy(F.desc("avg_clv"))


def payment_mix(t: Tables) -> DataFrame:
    per_order = clean_payments(t.payments).groupBy("order_id", "payment_type").agg(
        _rows().alias("n"), F.sum("payment_value").alias("value"), F.sum("payment_installments").alias("terms")
    )
    delivered = rollups.delivered_headers(t).select("order_id")
    mix = per_order.join(delivered, "order_id").groupBy("payment_type").agg(
        _rows().alias("order_count"),
        rounded(ratio(F.sum("value"), F.sum("n"))).alias("avg_payment_value"),
        rounded(ratio(F.sum("terms"), F.sum("n"))).alias("avg_installments"),
    )
    return _with_share(mix, "order_count", "pct").orderBy(F.desc("order_count"))


def top_sellers(t: Tables, k: int = 20, per_review: bool = True) -> DataFrame:
    """Best sellers with review and delivery.

    As written reviews are joined to rows already repeated per review, so value
    counts with the square of the fan-out. ``per_review=False`` counts it once.
    """
    lines = rollups.sales_lines(t)
    once = F.col("fan_out") if per_review else F.lit(1)
    twice = once * once
    timed = F.when(F.col("delivery_days").isNotNull(), F.col("n_items") * twice)
    scored = F.col("n_items") * once
    return (
        lines.groupBy("seller_id", "seller_state")
        .agg(
            F.countDistinct("order_id").alias("orders"),
            _cents(F.col("total_value") * twice).alias("revenue"),
            rounded(ratio(F.sum(F.col("score_sum") * scored), F.sum(F.col("n_reviews") * scored))).alias("avg_review"),
            rounded(ratio(F.sum(F.col("delivery_days") * timed), F.sum(timed)), 1).alias("avg_delivery_days"),
        )
        .orderBy(F.desc("revenue"), "seller_id")
        .limit(k)
    )


def cancellations_by_month(t: Tables) -> DataFrame:
    canceled = F.sum(numbers.flag(F.col("order_status") == "canceled"))
    return clean_orders(t.headers).groupBy("purchase_month").agg(
        _rows().alias("total_orders"),
        canceled.alias("canceled"),
        rounded(percent(canceled, _rows())).alias("cancel_rate_pct"),
    ).orderBy("purchase_month")


def churn_by_segment(t: Tables) -> DataFrame:
    segments = marts.rfm_segments(marts.rfm_features(t)).select("customer_unique_id", "rfm_segment")
    churn = marts.churn_features(t).select("customer_unique_id", "is_churned")
    return segments.join(churn, "customer_unique_id").groupBy("rfm_segment").agg(
        _rows().alias("total_customers"),
        F.sum("is_churned").alias("churned"),
        rounded(percent(F.sum("is_churned"), _rows())).alias("churn_rate_pct"),
    ).orderBy(F.desc("churn_rate_pct"))


def freight_share_by_category(t: Tables, min_items: int = 50, k: int = 15) -> DataFrame:
    w = F.col("fan_out")
    sums = rollups.sales_lines(t).groupBy("category_english").agg(
        F.sum(F.col("n_items") * w).alias("items"),
        _cents(F.col("price") * w).alias("price"),
        _cents(F.col("freight_value") * w).alias("freight"),
    )
    price, freight = ratio(F.col("price"), F.col("items")), ratio(F.col("freight"), F.col("items"))
    return (
        sums.filter(F.col("items") >= min_items)
        .select(
            "category_english",
            "items",
            rounded(price).alias("avg_price"),
            rounded(freight).alias("avg_freight"),
            rounded(percent(freight, price)).alias("freight_to_price_pct"),
        )
        .orderBy(F.desc("freight_to_price_pct"), "category_english")
        .limit(k)
    )


def days_to_review(t: Tables) -> DataFrame:
    reviews = clean_reviews(t.reviews).groupBy("order_id", "review_score", "review_creation_date").agg(
        _rows().alias("n")
    )
    arrived = clean_orders(t.orders).select("order_id", "order_delivered_customer_date")
    days = clock.whole_days(F.col("review_creation_date"), F.col("order_delivered_customer_date"))
    rows = reviews.join(arrived, "order_id", "left").withColumn("days", days)
    known = F.when(F.col("days").isNotNull(), F.col("n"))
    return rows.groupBy("review_score").agg(
        F.sum("n").alias("review_count"),
        rounded(ratio(F.sum(F.col("days") * known), F.sum(known)), 1).alias("avg_days_to_review"),
    ).orderBy("review_score")


def orders_by_weekday(t: Tables) -> DataFrame:
    bought = F.col("order_purchase_timestamp")
    return rollups.delivered_amounts(t).groupBy(
        clock.sunday_zero(bought).alias("day_of_week"), clock.weekday_name(bought).alias("day_name")
    ).agg(
        _rows().alias("order_count"),
        rounded(ratio(F.sum("order_total_value"), _rows())).alias("avg_order_value"),
    ).orderBy("day_of_week")


def basket_size_mix(t: Tables) -> DataFrame:
    kind = F.when(F.col("order_item_count") == 1, "Single Item").otherwise("Multi Item")
    mix = rollups.delivered_amounts(t).groupBy(kind.alias("order_type")).agg(
        _rows().alias("orders"), rounded(ratio(F.sum("order_total_value"), _rows())).alias("avg_order_value")
    )
    return _with_share(mix, "orders", "pct")


def customers_by_month_and_state(t: Tables, first_order_only: bool = False) -> DataFrame:
    """Customers per month and state.

    As written every customer active in the month counts as new;
    ``first_order_only`` counts a person only in the month of the first order.
    """
    orders = rollups.person_orders(t, rollups.delivered_headers(t))
    if first_order_only:
        place = F.struct("order_purchase_timestamp", "order_id")
        active = orders.groupBy("customer_unique_id").agg(
            F.min("purchase_month").alias("purchase_month"), F.min_by("customer_state", place).alias("customer_state")
        )
    else:
        active = orders.select("purchase_month", "customer_state", "customer_unique_id").distinct()
    return active.groupBy("purchase_month", "customer_state").agg(_rows().alias("new_customers")).orderBy(
        "purchase_month", F.desc("new_customers"), "customer_state"
    )


def cumulative_gmv(t: Tables) -> DataFrame:
    monthly = rollups.delivered_amounts(t).groupBy("purchase_month").agg(F.sum("order_total_value").alias("v"))
    by_month = Window.orderBy("purchase_month")
    recent = by_month.rowsBetween(-2, 0)
    upto = by_month.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return monthly.select(
        "purchase_month",
        F.col("v").cast("double").alias("monthly_gmv"),
        F.sum("v").over(upto).cast("double").alias("cumulative_gmv"),
        rounded(ratio(F.sum("v").over(recent), F.count("v").over(recent))).alias("rolling_3mo_avg"),
    ).orderBy("purchase_month")


def top_sellers_per_state(t: Tables, k: int = 5) -> DataFrame:
    revenue = _state_orders(t).groupBy("seller_state", "seller_id").agg(F.sum("value").alias("revenue"))
    best = Window.partitionBy("seller_state").orderBy(F.desc("revenue"))
    # A rank filter directly on the window limits every map task to its own
    # leading rows before the shuffle, so a large state stays small.
    return (
        revenue.withColumn("state_rank", F.rank().over(best))
        .filter(F.col("state_rank") <= k)
        .withColumn("revenue", numbers.amount(F.col("revenue")))
        .orderBy("seller_state", "state_rank")
    )


def delivery_by_month(t: Tables) -> DataFrame:
    rows = rollups.delivered_orders(t).filter(F.col("order_delivered_customer_date").isNotNull())
    return rows.groupBy("purchase_month").agg(
        _rows().alias("deliveries"),
        rounded(ratio(F.sum("delivery_days"), _rows()), 1).alias("avg_delivery_days"),
        rounded(percent(F.sum("is_late_delivery"), _rows())).alias("late_pct"),
    ).orderBy("purchase_month")


def detractors_by_category(t: Tables, min_reviews: int = 100, k: int = 10) -> DataFrame:
    lines = rollups.sales_lines(t).filter(F.col("n_reviews") > 0)
    rows = F.col("n_items") * F.col("n_reviews")
    timed = F.when(F.col("delivery_days").isNotNull(), rows)
    bad = F.sum(F.col("n_items") * F.col("n_detractors"))
    return (
        lines.groupBy("category_english")
        .agg(
            F.sum(rows).alias("total_reviews"),
            bad.alias("detractors"),
            rounded(percent(bad, F.sum(rows))).alias("detractor_rate"),
            rounded(ratio(F.sum(F.col("delivery_days") * timed), F.sum(timed)), 1).alias("avg_delivery_days"),
        )
        .filter(F.col("total_reviews") >= min_reviews)
        .orderBy(F.desc("detractor_rate"), "category_english")
        .limit(k)
    )


def value_by_installments(t: Tables, payment_type: str = "credit_card") -> DataFrame:
    per_order = (
        clean_payments(t.payments)
        .filter(F.col("payment_type") == payment_type)
        .groupBy("order_id", "payment_installments")
        .agg(_rows().alias("n"), F.sum("payment_value").alias("value"))
    )
    rows = per_order.join(rollups.delivered_headers(t).select("order_id"), "order_id")
    mean = ratio(F.sum("value"), F.sum("n"))
    return rows.groupBy("payment_installments").agg(
        F.sum("n").alias("payment_count"),
        rounded(mean).alias("avg_payment_value"),
        rounded(mean * F.col("payment_installments")).alias("implied_total"),
    ).orderBy("payment_installments")


def order_frequency(t: Tables, per_address: bool = True) -> DataFrame:
    counts = marts.customer_summary(t, per_address=per_address).groupBy("total_orders").agg(
        _rows().alias("customer_count"), _amount("lifetime_value").alias("segment_revenue")
    )
    return _with_share(counts, "customer_count", "pct").orderBy("total_orders")


def yearly_gmv(t: Tables) -> DataFrame:
    return rollups.delivered_amounts(t).groupBy("purchase_year").agg(
        _rows().alias("orders"), _amount("order_total_value").alias("gmv"), *_item_weighted_value("aov")
    ).orderBy("purchase_year")
