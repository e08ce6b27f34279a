"""Fact, customer and feature marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soukline.functions import clock, numbers, text
from soukline.operators import ranking, rollups
from soukline.operators.cleaning import (
    clean_items, clean_orders, clean_payments, clean_reviews,
    enrich_orders,
)
from soukline.sources.tables import Tables

# The rules are tried in this order, the first match names the segment.
RFM_RULES = [
    ("Champions", "r >= 4 and f >= 4 and m >= 4"),
    ("Loyal Customers", "r >= 3 and f >= 3"),
    ("Recent Customers", "r >= 4 and f <= 2"),
    ("At Risk", "r <= 2 and f >= 4"),
    ("Lost", "r <= 2 and f <= 2"),
]
RFM_DEFAULT = "Potential Loyalists"


def order_fact(tables: Tables, per_review: bool = True) -> DataFrame:
    """Delivered items with customer, product, seller and review.

    ``per_review=True`` repeats an item for every review of its order;
    ``False`` keeps one row per item with the mean score.
    """
    orders = rollups.person_orders(tables, rollups.delivered_orders(tables))
    if per_review:
        score = clean_reviews(tables.scores).select("order_id", "review_score", "is_detractor", "is_promoter")
    else:
        mean = numbers.ratio(F.sum("review_score"), F.count("review_score"))
        score = clean_reviews(tables.scores).groupBy("order_id").agg(mean.alias("review_score"))
    scored = orders.join(score, "order_id", "left")
    flags = ["is_detractor", "is_promoter"] if per_review else []
    # What is known of an order comes last: the shuffles by product and seller carry the delivered lines alone.
    sold = clean_items(tables.items).select(
        "order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value", "total_value"
    ).join(rollups.delivered_headers(tables).select("order_id"), "order_id", "left_semi")
    fact = (
        rollups.with_category(sold, tables)
        .join(tables.sellers.select("seller_id", "seller_state"), "seller_id")
        .join(scored, "order_id")
    )
    return fact.select(
        "order_id", "order_item_id", "order_status", "order_purchase_timestamp", "purchase_month",
        "purchase_year", "is_delivered", "customer_unique_id", "customer_state", "customer_city",
        "product_id", "product_category_name", "category_english", "seller_id", "seller_state",
        "price", "freight_value", "total_value", "review_score", *flags, "is_late_delivery", "delivery_days",
    )


def customer_summary(tables: Tables, per_address: bool = True, per_review: bool = True) -> DataFrame:
    """Orders, dates, value and review of each customer.

    As written the grain is person x state x city and every extra review counts
    an order's value again; both can be switched off.
    """
    orders = rollups.person_orders(tables, rollups.delivered_amounts(tables)).join(
        rollups.order_reviews(tables.scores), "order_id", "left"
    )
    weight = F.greatest(F.coalesce("n_reviews", F.lit(0)), F.lit(1)) if per_review else F.lit(1)
    weighted = orders.withColumn("w", weight.cast("decimal(8,0)"))
    keys = ["customer_unique_id", "customer_state", "customer_city"]
    grouping = keys if per_address else keys[:1]
    last_place = [] if per_address else [
        F.max_by(c, F.struct("order_purchase_timestamp", "order_id")).alias(c) for c in keys[1:]
    ]
    value = F.sum(F.col("order_total_value") * F.col("w")).cast(numbers.WIDE_MONEY)
    return weighted.groupBy(*grouping).agg(
        *last_place,
        F.count(F.lit(1)).alias("total_orders"),
        F.min("order_purchase_timestamp").alias("first_order_date"),
        F.max("order_purchase_timestamp").alias("last_order_date"),
        value.alias("lifetime_value"),
        numbers.ratio(value, F.sum("w")).alias("avg_order_value"),
        numbers.ratio(F.sum("score_sum"), F.sum("n_reviews")).alias("avg_review_score"),
    )


def last_purchase(tables: Tables, delivered: bool) -> Column:
    """Latest purchase time of the data set as a scalar subquery."""
    headers = rollups.delivered_headers(tables) if delivered else clean_orders(tables.headers)
    return headers.select(F.max("order_purchase_timestamp")).scalar()


def customer_lifecycle(tables: Tables) -> DataFrame:
    """Per person: dates, orders, spend, delivery, first-seen place, churn flags."""
    orders = enrich_orders(clean_orders(tables.orders_in("delivered")))
    # the city is folded once per person, after the first-seen one is known
    place = tables.customers.select(
        "customer_id", "customer_unique_id", text.upper_trim(F.col("customer_state")).alias("customer_state"), "customer_city"
    )
    rows = orders.join(place, "customer_id", "left").join(
        rollups.order_totals(tables), "order_id", "left"
    )
    bought = F.col("order_purchase_timestamp")
    seen = F.struct("order_id")
    spend = F.coalesce(F.sum("order_total_value"), F.lit(0)).cast(numbers.WIDE_MONEY)
    per_person = rows.groupBy("customer_unique_id").agg(
        F.min(bought).alias("first_order_date"),
        F.max(bought).alias("last_order_date"),
        F.count(F.lit(1)).alias("order_count"),
        spend.alias("total_spent"),
        numbers.ratio(F.sum("order_total_value"), F.count("order_total_value")).alias("avg_order_value"),
        numbers.ratio(F.sum("delivery_days"), F.count("delivery_days")).alias("avg_delivery_days"),
        numbers.ratio(F.sum("late_delivery_flag"), F.count(F.lit(1))).alias("late_delivery_rate"),
        F.min_by("customer_state", seen).alias("state"),
        F.min_by("customer_city", seen).alias("city"),
    ).withColumn("city", text.standardize_text(F.col("city")))
    reference = clock.plus_days(last_purchase(tables, delivered=False), 1)
    return (
        per_person.withColumn("recency_days", clock.floor_days(reference, F.col("last_order_date")))
        .withColumn("tenure_days", clock.floor_days(F.col("last_order_date"), F.col("first_order_date")))
        .withColumn("repeat_customer_flag", numbers.flag(F.col("order_count") > 1))
        .withColumn("churn_flag_180d", numbers.flag(F.col("recency_days") > 180))
    )


def rfm_features(tables: Tables, higher_is_better: bool = False) -> DataFrame:
    """Recency, frequency, monetary value and their quintiles.

    As written quintile 1 holds the most recent, most frequent and most
    valuable customers; ``higher_is_better`` reverses all three.
    """
    reference = clock.plus_days(last_purchase(tables, delivered=True), 1)
    orders = rollups.person_orders(tables, rollups.delivered_amounts(tables))
    features = (
        orders.groupBy("customer_unique_id")
        .agg(
            F.max("order_purchase_timestamp").alias("last_order"),
            F.count(F.lit(1)).alias("frequency"),
            F.sum("order_total_value").cast(numbers.WIDE_MONEY).alias("monetary"),
        )
        .withColumn("recency_days", clock.whole_days(reference, F.col("last_order")))
        .select("customer_unique_id", "recency_days", "frequency", "monetary")
    )
    tie = F.col("customer_unique_id")
    for column, ascending, out in (
        ("recency_days", True, "recency_quintile"),
        ("frequency", False, "frequency_quintile"),
        ("monetary", False, "monetary_quintile"),
    ):
        up = ascending != higher_is_better
        key = F.col(column).asc() if up else F.col(column).desc()
        features = ranking.ntile(features, 5, [key, tie], out)
    return features


def rfm_label(r: str, f: str, m: str) -> Column:
    """First matching rule over three score columns."""
    scores = {"r": r, "f": f, "m": m}
    label = F.lit(RFM_DEFAULT)
    for name, rule in reversed(RFM_RULES):
        words = [f"`{scores[w]}`" if w in scores else w for w in rule.split()]
        label = F.when(F.expr(" ".join(words)), F.lit(name)).otherwise(label)
    return label


def rfm_segments(features: DataFrame) -> DataFrame:
    return features.withColumn(
        "rfm_segment", rfm_label("recency_quintile", "frequency_quintile", "monetary_quintile")
    )


def cohort_features(tables: Tables) -> DataFrame:
    """One row per delivered order: cohort month, order month, months since."""
    orders = rollups.person_orders(tables, rollups.delivered_headers(tables)).select(
        "customer_unique_id", "order_id", F.col("purchase_month").alias("order_month")
    )
    first = orders.groupBy("customer_unique_id").agg(F.min("order_month").alias("cohort_month"))
    joined = orders.join(first, "customer_unique_id")
    return joined.select(
        "customer_unique_id",
        "cohort_month",
        "order_month",
        clock.months_apart(F.col("order_month"), F.col("cohort_month")).alias("period_number"),
    )


def cohort_activity(tables: Tables) -> DataFrame:
    """Distinct person x month rows with their cohort.

    The months of a person form a set no larger than the calendar, so they are
    collected per person with partial aggregation and the cohort is its minimum.
    """
    months = (
        rollups.person_orders(tables, rollups.delivered_headers(tables))
        .groupBy("customer_unique_id")
        .agg(F.collect_set("purchase_month").alias("months"))
    )
    return months.select(
        "customer_unique_id",
        F.array_min("months").alias("cohort_month"),
        F.explode("months").alias("order_month"),
    ).withColumn("period_number", clock.months_apart(F.col("order_month"), F.col("cohort_month")))


def cohort_retention(tables: Tables) -> DataFrame:
    """Active customers, cohort size and retention per cohort and period."""
    return retention_of(cohort_activity(tables))


def retention_of(activity: DataFrame) -> DataFrame:
    counts = activity.groupBy("cohort_month", "period_number").agg(
        F.count(F.lit(1)).alias("active_customers")
    )
    # Every person is active in period 0, so that row carries the cohort size.
    # The window runs over cohort x period rows, bounded by the calendar.
    size = F.max(F.when(F.col("period_number") == 0, F.col("active_customers"))).over(
        Window.partitionBy("cohort_month")
    )
    return counts.withColumn("cohort_size", size).withColumn(
        "retention_rate", numbers.rounded(numbers.percent(F.col("active_customers"), F.col("cohort_size")))
    )


def delivery_features(tables: Tables) -> DataFrame:
    """Delivered orders with a delivery date: four durations and two flags."""
    bought, approved = F.col("order_purchase_timestamp"), F.col("order_approved_at")
    handed, arrived = F.col("order_delivered_carrier_date"), F.col("order_delivered_customer_date")
    promised = F.col("order_estimated_delivery_date")
    orders = clean_orders(tables.orders_in("delivered")).filter(arrived.isNotNull())
    return rollups.person_orders(tables, orders).select(
        "order_id",
        "customer_unique_id",
        clock.whole_days(arrived, bought).alias("delivery_days"),
        clock.whole_days(handed, approved).alias("carrier_handoff_days"),
        clock.whole_days(arrived, handed).alias("transit_days"),
        clock.whole_days(promised, bought).alias("promised_days"),
        numbers.flag(arrived <= promised).alias("is_on_time"),
        numbers.flag(arrived > promised).alias("is_late"),
    )


def churn_features(tables: Tables, days: int = 180, per_review: bool = True) -> DataFrame:
    """Last order, orders, spend, review and churn flag of each person.

    As written spend and review run over item x review rows.
    """
    orders = rollups.person_orders(tables, rollups.delivered_amounts(tables)).join(
        rollups.order_reviews(tables.scores), "order_id", "left"
    )
    weight = F.greatest(F.coalesce("n_reviews", F.lit(0)), F.lit(1)) if per_review else F.lit(1)
    lines = F.col("order_item_count") if per_review else F.lit(1)
    reference = clock.plus_days(last_purchase(tables, delivered=False), 1)
    since = clock.whole_days(reference, F.col("last_order_date"))
    return (
        orders.groupBy("customer_unique_id")
        .agg(
            F.max("order_purchase_timestamp").alias("last_order_date"),
            F.count(F.lit(1)).alias("total_orders"),
            F.sum(F.col("order_total_value") * weight.cast("decimal(8,0)")).cast(numbers.WIDE_MONEY).alias("total_spent"),
            numbers.ratio(
                F.sum(F.col("score_sum") * lines), F.sum(F.col("n_reviews") * lines)
            ).alias("avg_review_score"),
        )
        .withColumn("days_since_last_order", since)
        .withColumn("is_churned", numbers.flag(F.col("days_since_last_order") > days))
    )


def payment_features(payments: DataFrame) -> DataFrame:
    def used(kind: str) -> Column:
        return F.max(numbers.flag(F.col("payment_type") == kind))

    return clean_payments(payments).groupBy("order_id").agg(
        used("credit_card").alias("used_credit_card"),
        used("boleto").alias("used_boleto"),
        F.max("payment_installments").alias("max_installments"),
        F.sum("payment_value").cast(numbers.WIDE_MONEY).alias("total_payment_value"),
    )


def kpi_snapshot(tables: Tables, churn_days: int = 180) -> DataFrame:
    """One row of headline measures: one pass over delivered orders, one row per person, then one aggregate.

    Customers are those with a delivered order that has items, as in the summary.
    """
    arrived = F.col("order_delivered_customer_date")
    orders = clean_orders(tables.orders_in("delivered")).join(rollups.order_totals(tables), "order_id", "left")
    orders = orders.join(rollups.people(tables).select("customer_id", "customer_unique_id"), "customer_id", "left")
    sold = F.col("order_total_value").isNotNull() & F.col("customer_unique_id").isNotNull()
    known = arrived.isNotNull() & F.col("customer_unique_id").isNotNull()
    people = orders.groupBy("customer_unique_id").agg(
        F.count(F.lit(1)).alias("orders"), F.count("order_total_value").alias("valued"),
        F.sum("order_total_value").alias("gmv"), F.count_if(known).alias("arrived"),
        F.count_if(known & (arrived > F.col("order_estimated_delivery_date"))).alias("late"),
        F.max(F.when(sold, F.col("order_purchase_timestamp"))).alias("last"),
    )
    since = clock.whole_days(clock.plus_days(last_purchase(tables, delivered=False), 1), F.col("last"))
    score = clean_reviews(tables.scores).agg(
        numbers.rounded(numbers.ratio(F.sum("review_score"), F.count(F.lit(1))))
    )
    customers = F.count("last")
    return people.agg(
        F.coalesce(F.sum("orders"), F.lit(0)).alias("delivered_orders"),
        customers.alias("unique_customers"),
        F.sum("gmv").cast("double").alias("total_gmv"),
        numbers.rounded(numbers.ratio(F.sum("gmv"), F.sum("valued"))).alias("avg_order_value"),
        numbers.rounded(numbers.percent(F.sum("late"), F.sum("arrived"))).alias("late_delivery_pct"),
        numbers.rounded(numbers.percent(F.count_if(since > churn_days), customers)).alias("churn_rate_pct"),
    ).select(
        "delivered_orders", "unique_customers", "total_gmv", "avg_order_value",
        score.scalar().alias("avg_review_score"), "late_delivery_pct", "churn_rate_pct",
    )


def monthly_revenue(tables: Tables) -> DataFrame:
    rows = rollups.person_orders(tables, rollups.delivered_amounts(tables))
    return rows.groupBy("purchase_month", "purchase_year").agg(
        F.count(F.lit(1)).alias("order_count"),
        F.countDistinct("customer_unique_id").alias("unique_customers"),
        F.sum("order_price").cast("double").alias("product_revenue"),
        F.sum("order_freight").cast("double").alias("freight_revenue"),
        F.sum("order_total_value").cast("double").alias("gmv"),
    )
