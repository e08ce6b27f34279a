"""Customer segments, lifetime value, baskets, diagnostics and model features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soukline.functions import clock, numbers
from soukline.functions.numbers import percent, ratio, right_closed_band, rounded
from soukline.operators import marts, ranking, rollups
from soukline.operators.cleaning import (
    clean_customers, clean_orders, clean_payments, enrich_orders,
)
from soukline.plans.explore import _delivered_lines, delivered_values
from soukline.plans.trading import _amount, _cents, _rows
from soukline.session import cut
from soukline.sources.tables import Tables

# Fixed values.
CHURN_EDGES = [-1, 90, 180, 365, None]
CHURN_LABELS = ["Active", "Warm", "At Risk", "Dormant"]
CLV_LABELS = ["Low", "Medium", "High", "Elite"]
SEGMENT_NAMES = ["High-Value Repeat", "Recent Active", "Dormant", "Standard"]


def review_by_order(t: Tables) -> DataFrame:
    return t.scores.groupBy("order_id").agg(
        ratio(F.sum("review_score"), F.count("review_score")).alias("review_score")
    )


def customer_reviews(t: Tables) -> DataFrame:
    """Mean over a person's delivered orders of each order's mean score."""
    orders = rollups.person_orders(t, rollups.delivered_headers(t)).join(review_by_order(t), "order_id", "left")
    # Order means are summed as DECIMAL so the result is independent of row order.
    exact = F.col("review_score").cast("decimal(20,12)")
    return orders.groupBy("customer_unique_id").agg(
        rounded(ratio(F.sum(exact), F.count("review_score")), 6).alias("avg_review")
    )


def customer_features(t: Tables) -> DataFrame:
    return marts.customer_lifecycle(t).join(customer_reviews(t), "customer_unique_id", "left")


def segment_profiles(features: DataFrame, segment: str) -> DataFrame:
    """Mean behaviour per segment and the name its profile earns."""
    def mean(column: str, out: str):
        exact = F.col(column).cast("decimal(24,8)")
        return rounded(ratio(F.sum(exact), F.count(column))).alias(out)

    profile = features.groupBy(F.col(segment).alias("segment_id")).agg(
        _rows().alias("customers"),
        mean("recency_days", "avg_recency"),
        mean("order_count", "avg_orders"),
        mean("total_spent", "avg_spent"),
        mean("avg_review", "avg_review"),
        mean("churn_flag_180d", "churn_rate"),
    )
    rich = (F.col("avg_orders") >= 2) & (F.col("avg_spent") >= 250)
    name = (
        F.when(rich, SEGMENT_NAMES[0])
        .when(F.col("avg_recency") <= 90, SEGMENT_NAMES[1])
        .when(F.col("churn_rate") >= 0.8, SEGMENT_NAMES[2])
        .otherwise(SEGMENT_NAMES[3])
    )
    return profile.withColumn("segment_name", name)


def recency_band_profiles(t: Tables) -> DataFrame:
    """Profiles of the recency bands: the same operator on a rule-made segment."""
    band = right_closed_band(F.col("recency_days"), CHURN_EDGES, CHURN_LABELS)
    return segment_profiles(customer_features(t).withColumn("band", band), "band")


def cohort_averages(t: Tables, months: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    """Mean retention over all cohorts at given ages; missing cells count as 0."""
    long = marts.cohort_retention(t)
    cohorts = F.count(F.when(F.col("period_number") == 0, 1))
    rate = F.col("retention_rate").cast("decimal(9,2)")
    return long.agg(
        cohorts.alias("cohorts"),
        (F.max("period_number") + 1).alias("periods"),
        *[
            rounded(ratio(F.sum(F.when(F.col("period_number") == m, rate).otherwise(F.lit(0).cast("decimal(9,2)"))), cohorts)).alias(f"month_{m}_retention_avg")
            for m in months
        ],
    )


def clv_table(t: Tables) -> DataFrame:
    """Order rate, spend quartile band and churn band per customer.

    Quartile edges are exact and bands closed on the right. Where edges
    coincide the empty bands vanish and the remaining ones keep the low labels.
    """
    life = marts.customer_lifecycle(t)
    edges = ranking.percentiles(life, "total_spent", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    cut = edges.select(F.struct("q1", "q2", "q3")).scalar()
    spent = F.col("total_spent").cast("double")
    band = F.lit(CLV_LABELS[3])
    for edge, label in reversed(list(zip(("q1", "q2", "q3"), CLV_LABELS))):
        band = F.when(spent <= F.col("_cut")[edge], F.lit(label)).otherwise(band)
    active = F.when(F.col("tenure_days") != 0, numbers.bounded(F.col("tenure_days"), low=1))
    return (
        life.withColumn("_cut", cut)
        .withColumn("avg_orders_per_month", ratio(F.col("order_count"), active) * F.lit(30.0))
        .withColumn("clv_band", band)
        .withColumn("churn_band", right_closed_band(F.col("recency_days"), CHURN_EDGES, CHURN_LABELS))
        .drop("_cut")
    )


def category_pairs(t: Tables, k: int | None = 15) -> DataFrame:
    """Unordered category pairs bought in one delivered order, with counts.

    Orders are first reduced to their category set and equal sets counted, so
    pairs are formed once per distinct set. A set is no larger than the
    catalogue, whatever the order holds.
    """
    delivered = rollups.delivered_headers(t).select("order_id")
    bought = t.items.select("order_id", "product_id").join(delivered, "order_id", "left_semi").distinct()
    sets = (
        rollups.with_category(bought, t)
        .groupBy("order_id")
        .agg(F.array_sort(F.collect_set("category_english")).alias("cats"))
        .filter(F.size("cats") > 1)
        .groupBy("cats")
        .agg(_rows().alias("orders"))
    )
    pairs = (
        sets.select("orders", "cats", F.posexplode("cats").alias("i", "category_a"))
        .select("orders", "category_a", F.explode(F.slice("cats", F.col("i") + 2, F.size("cats"))).alias("category_b"))
        .groupBy("category_a", "category_b")
        .agg(F.sum("orders").alias("co_occurrences"))
        .orderBy(F.desc("co_occurrences"), "category_a", "category_b")
    )
    return pairs.limit(k) if k else pairs


def _delivered_enriched(t: Tables) -> DataFrame:
    return enrich_orders(clean_orders(t.orders_in("delivered")))


def geo_summary(t: Tables) -> DataFrame:
    """Per state; delivery days and lateness averaged over item rows."""
    orders = rollups.person_orders(t, _delivered_enriched(t)).join(rollups.order_totals(t), "order_id", "left")
    rows = F.greatest(F.coalesce("order_item_count", F.lit(0)), F.lit(1))
    timed = F.when(F.col("delivery_days").isNotNull(), rows)
    return orders.groupBy("customer_state").agg(
        _rows().alias("orders"),
        F.countDistinct("customer_unique_id").alias("customers"),
        _amount("order_total_value").alias("revenue"),
        rounded(ratio(F.sum(F.col("delivery_days") * timed), F.sum(timed))).alias("avg_delivery_days"),
        rounded(ratio(F.sum(F.col("late_delivery_flag") * rows), F.sum(rows))).alias("late_delivery_rate"),
    ).orderBy(F.desc("revenue"))


def seller_summary(t: Tables, per_review: bool = True) -> DataFrame:
    """Per seller; as written every review repeats the order's item rows."""
    lines = rollups.item_sums(t, "order_id", "seller_id")
    orders = _delivered_enriched(t).join(rollups.order_reviews(t.scores, valid_only=False), "order_id", "left")
    rows = lines.join(orders, "order_id").withColumn("n_reviews", F.coalesce("n_reviews", F.lit(0)))
    copies = F.greatest(F.col("n_reviews"), F.lit(1)) if per_review else F.lit(1)
    w = F.col("n_items") * copies
    timed = F.when(F.col("delivery_days").isNotNull(), w)
    scored = F.col("n_items")
    return rows.groupBy("seller_id").agg(
        F.countDistinct("order_id").alias("orders"),
        _cents(F.col("total_value") * copies).alias("revenue"),
        rounded(ratio(F.sum(F.col("score_sum") * scored), F.sum(F.col("n_reviews") * scored))).alias("avg_review"),
        rounded(ratio(F.sum(F.col("delivery_days") * timed), F.sum(timed))).alias("avg_delivery_days"),
        rounded(ratio(F.sum(F.col("late_delivery_flag") * w), F.sum(w))).alias("late_delivery_rate"),
    ).orderBy(F.desc("revenue"), "seller_id")


def product_summary(t: Tables) -> DataFrame:
    sums = ("n_items", "price", "freight_value", "total_value")
    per_order = (
        rollups.with_category(_delivered_lines(t, "product_id"), t)
        .groupBy("order_id", "category_english")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )
    return per_order.groupBy("category_english").agg(
        _rows().alias("orders"),
        F.sum("n_items").alias("items"),
        _cents("total_value").alias("revenue"),
        rounded(ratio(_cents("price"), F.sum("n_items"))).alias("avg_price"),
        rounded(ratio(_cents("freight_value"), F.sum("n_items"))).alias("avg_freight"),
    ).orderBy(F.desc("revenue"))


def delivery_summary(t: Tables) -> DataFrame:
    """Per state over orders, with fractional days."""
    span = clock.elapsed_micros(F.col("order_delivered_customer_date"), F.col("order_purchase_timestamp"))
    orders = rollups.person_orders(t, _delivered_enriched(t)).withColumn("span", span.cast("decimal(20,0)"))
    return orders.groupBy("customer_state").agg(
        _rows().alias("deliveries"),
        rounded(ratio(F.sum("span"), F.count("span")) / F.lit(float(clock.MICROS_PER_DAY))).alias("avg_delivery_days"),
        rounded(ratio(F.sum("late_delivery_flag"), _rows())).alias("late_delivery_rate"),
    ).orderBy(F.desc("late_delivery_rate"))


def order_profile(t: Tables, orders: DataFrame) -> DataFrame:
    """Per order of ``orders``: value, items, mean price and freight, modal category and seller state."""
    sellers = t.sellers.select("seller_id", F.upper("seller_state").alias("seller_state"))
    items = t.item_cents.join(orders.select("order_id"), "order_id", "left_semi")
    lines = rollups.with_category(items, t, "left").join(sellers, "seller_id", "left")
    # An order's lines meet once; what follows is sorted and summed where they are, in buffers of fixed size.
    counted = (
        lines.select("order_id", "category_english", "seller_state", "total_value", "price", "freight_value")
        .repartition("order_id")
        .withColumn("n_category", _rows().over(Window.partitionBy("order_id", "category_english")))
        .withColumn("n_state", _rows().over(Window.partitionBy("order_id", "seller_state")))
    )

    def most(name: str, n: str) -> Column:
        """The most frequent name; the smallest of several."""
        return F.min(F.when(F.col(name).isNotNull(), F.struct((-F.col(n)).alias("n"), name)))[name]

    return counted.groupBy("order_id").agg(
        _cents("total_value").alias("first_order_value"),
        _rows().alias("first_order_item_count"),
        ratio(_cents("price"), _rows()).alias("first_avg_item_price"),
        ratio(_cents("freight_value"), _rows()).alias("first_avg_freight"),
        most("category_english", "n_category").alias("product_category_name_english"),
        most("seller_state", "n_state").alias("seller_state"),
    )


def first_orders(t: Tables) -> DataFrame:
    """The first delivered order of each person, as a whole row."""
    place = clean_customers(t.customers).select("customer_id", "customer_unique_id", "customer_state")
    orders = clean_orders(t.orders_in("delivered")).join(place, "customer_id")
    columns = [
        "order_id", "customer_state", "order_purchase_timestamp",
        "order_delivered_customer_date", "order_estimated_delivery_date",
    ]
    first = F.min_by(F.struct(*columns), F.struct("order_purchase_timestamp", "order_id"))
    rows = orders.groupBy("customer_unique_id").agg(first.alias("o")).select("customer_unique_id", "o.*")
    rows = cut(rows)  # read twice below: to pick the lines and for the rows themselves
    return rows.join(order_profile(t, rows), "order_id", "left")


def main_payment(t: Tables) -> DataFrame:
    """Type of the largest payment, most installments, total paid."""
    largest = F.struct("payment_value", "payment_type")
    return clean_payments(t.payments).groupBy("order_id").agg(
        F.max_by("payment_type", largest).alias("payment_type"),
        F.max("payment_installments").alias("payment_installments"),
        F.sum("payment_value").cast("double").alias("payment_value"),
    )


def repeat_features(t: Tables) -> DataFrame:
    """First-order attributes with the repeat flag and total spend as targets."""
    arrived = F.col("order_delivered_customer_date")
    target = marts.customer_lifecycle(t).select("customer_unique_id", "repeat_customer_flag", "total_spent")
    rows = (
        first_orders(t)
        .join(target, "customer_unique_id", "left")
        .join(review_by_order(t), "order_id", "left")
        .join(main_payment(t), "order_id", "left")
    )
    median = ranking.percentiles(rows, "review_score", {"m": 0.5}).select("m").scalar()
    return (
        rows.select(
            "customer_unique_id",
            F.coalesce("first_order_value", F.lit(0.0)).alias("first_order_value"),
            "first_order_item_count",
            "first_avg_item_price",
            "first_avg_freight",
            clock.fractional_days(arrived, F.col("order_purchase_timestamp")).alias("first_delivery_days"),
            numbers.flag(arrived > F.col("order_estimated_delivery_date")).alias("first_late_flag"),
            F.coalesce("review_score", median).alias("review_score"),
            "payment_type",
            "payment_installments",
            "customer_state",
            "product_category_name_english",
            "repeat_customer_flag",
            F.col("total_spent").cast("double").alias("total_spent"),
        )
        .na.drop(subset=["repeat_customer_flag", "first_order_value", "payment_type", "customer_state"])
        .drop("payment_type")
    )


def delivery_risk_features(t: Tables, status: str = "delivered") -> DataFrame:
    """Per order of a status: its totals, payment, places, first-order traits, late flag (0 while it is open)."""
    place = clean_customers(t.customers).select("customer_id", "customer_unique_id", "customer_state")
    sums = rollups.item_sums(t, "order_id")
    totals = sums.select(
        "order_id",
        numbers.amount(F.col("total_value")).alias("order_total_value"),
        F.col("n_items").alias("order_item_count"),
        ratio(numbers.amount(F.col("price")), F.col("n_items")).alias("avg_item_price"),
        ratio(numbers.amount(F.col("freight_value")), F.col("n_items")).alias("avg_freight"),
    )
    orders = (
        clean_orders(t.orders_in(status))
        .join(place, "customer_id")
        .withColumn("is_late", numbers.flag(F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")))
        .select("order_id", "customer_unique_id", "customer_state", "is_late")
        .join(totals, "order_id", "left")
        .join(main_payment(t).drop("payment_value"), "order_id", "left")
    )
    # stored before the orders are joined, so that its shuffles are given back first
    traits = cut(first_orders(t).select(
        "customer_unique_id", "product_category_name_english", "seller_state", "first_order_value", "first_order_item_count"
    ))
    counted = ["order_total_value", "order_item_count", "avg_item_price", "avg_freight",
               "payment_installments", "first_order_value", "first_order_item_count"]
    named = ["payment_type", "customer_state", "seller_state", "product_category_name_english"]
    rows = orders.join(traits, "customer_unique_id", "left")
    return rows.na.fill(0, subset=counted).na.fill("unknown", subset=named).select("order_id", *counted, *named, "is_late")


def phase_summary(t: Tables) -> DataFrame:
    """One row: cohort shape and averages, lifetime value, churn, late share."""
    life = marts.customer_lifecycle(t)
    band = right_closed_band(F.col("recency_days"), CHURN_EDGES, CHURN_LABELS)
    people = life.agg(
        _rows().alias("customers"),
        rounded(ratio(F.sum("total_spent"), _rows())).alias("avg_clv"),
        rounded(percent(F.sum("churn_flag_180d"), _rows())).alias("churn_rate_pct"),
        F.sum(numbers.flag(band == "At Risk")).alias("at_risk_customers"),
    )
    averages = cohort_averages(t)
    late = _delivered_enriched(t).agg(rounded(percent(F.sum("late_delivery_flag"), _rows())))
    median = ranking.percentiles(life, "total_spent", {"m": 0.5}).select(rounded(F.col("m"), 4))
    packed = averages.select(F.struct(*averages.columns)).scalar()
    pairs = category_pairs(t, 10)
    top = pairs.agg(F.max("co_occurrences")).scalar()
    return people.withColumn("_c", packed).select(
        *people.columns,
        *[F.col("_c")[c].alias(c) for c in averages.columns],
        median.scalar().alias("median_clv"),
        late.scalar().alias("late_delivery_rate_pct"),
        top.alias("top_pair_orders"),
    )


def phase_lists(t: Tables, pairs: int = 10) -> DataFrame:
    """Sizes of the activity segments and the category pairs bought together most often."""
    band = right_closed_band(F.col("recency_days"), CHURN_EDGES, CHURN_LABELS)
    segments = marts.customer_lifecycle(t).groupBy(band.alias("name")).agg(_rows().alias("value"))
    top = category_pairs(t, pairs).select(
        F.concat_ws(" + ", "category_a", "category_b").alias("name"), F.col("co_occurrences").alias("value")
    )
    return segments.select(F.lit("segment").alias("list"), "name", "value").unionByName(
        top.select(F.lit("pair").alias("list"), "name", "value")
    )


def peak_month(t: Tables) -> DataFrame:
    """Best month against the mean month of its year."""
    monthly = delivered_values(t).groupBy("purchase_year", "purchase_month").agg(
        F.coalesce(F.sum("order_total_value"), F.lit(0)).alias("v")
    )
    year = Window.partitionBy("purchase_year")
    mean = ratio(F.sum("v").over(year), F.count("v").over(year))
    return monthly.select(
        "purchase_month",
        F.col("v").cast("double").alias("gmv"),
        rounded(mean).alias("year_monthly_mean"),
        rounded(percent(F.col("v").cast("double") - mean, mean)).alias("uplift_pct"),
    ).orderBy(F.desc("gmv"), "purchase_month").limit(1)


def top_decile_customers(t: Tables) -> DataFrame:
    """Customers at or above the exact 90th percentile of spend."""
    life = marts.customer_lifecycle(t).select("customer_unique_id", "total_spent", "order_count")
    cut = ranking.percentiles(life, "total_spent", {"p": 0.9}).scalar()
    return life.withColumn("total_spent", F.col("total_spent").cast("double")).filter(F.col("total_spent") >= cut)


def preferred_sellers(t: Tables, fraction: float = 0.01, max_late: float = 0.03, min_review: float = 4.2) -> DataFrame:
    """Top sellers by value, with the service test that keeps them qualified."""
    lines = rollups.item_sums(t, "order_id", "seller_id")
    orders = _delivered_enriched(t).join(rollups.order_reviews(t.scores), "order_id", "left")
    sellers = lines.join(orders, "order_id").groupBy("seller_id").agg(
        F.sum("total_value").alias("gmv"),
        ratio(F.sum("late_delivery_flag"), _rows()).alias("late"),
        ratio(F.sum("score_sum"), F.sum("n_reviews")).alias("review"),
    )
    sellers = cut(sellers)  # read twice below: for the cutoff and for the members
    cutoff = ranking.leading_share(sellers, "gmv", fraction).select("cutoff").scalar()
    qualified = (F.col("late") < max_late) | (F.col("review") > min_review)
    return sellers.filter(F.col("gmv") >= cutoff).select(
        "seller_id",
        numbers.amount(F.col("gmv")).alias("gmv"),
        rounded(F.col("late"), 4).alias("late_delivery_rate"),
        rounded(F.col("review"), 4).alias("avg_review"),
        numbers.flag(qualified).alias("is_qualified"),
    )


def winback_audience(t: Tables, after: int = 90, until: int = 180) -> DataFrame:
    """Customers whose last order lies more than ``after`` and at most ``until`` days back."""
    days = F.col("recency_days")
    return marts.customer_lifecycle(t).filter((days > after) & (days <= until)).select(
        "customer_unique_id", "last_order_date", "recency_days", F.col("total_spent").cast("double").alias("total_spent")
    )
