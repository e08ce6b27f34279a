"""Business measures evaluated in a filter context.

A ``Slicer`` holds the report filters. ``Context`` applies them once: order
filters go to the orders, line filters (category, seller state) to the lines,
and each side is narrowed by a semi-join on the other. A measure then groups
the narrowed rows by any of their columns. Removing a filter for a total is a
second context without it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soukline.functions import numbers
from soukline.functions.numbers import divide_or, ratio, right_closed_band, rounded
from soukline.operators import marts, ranking, rollups
from soukline.operators.cleaning import clean_orders, enrich_orders
from soukline.sources.tables import Tables

# Targets of the executive page and price band edges.
TARGETS = {"gmv": 15_000_000.0, "repeat_rate_pct": 10.0, "late_rate_pct": 5.0}
PRICE_EDGES = [0, 50, 100, 250, 500, 1000, None]
PRICE_LABELS = ["up to 50", "50 to 100", "100 to 250", "250 to 500", "500 to 1000", "over 1000"]


@dataclass(frozen=True)
class Slicer:
    first_day: str | None = None
    last_day: str | None = None
    states: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    seller_states: tuple[str, ...] = ()
    segments: tuple[str, ...] = ()

    def without(self, *names: str) -> Slicer:
        empty = Slicer()
        return replace(self, **{n: getattr(empty, n) for n in names})


def _rows() -> Column:
    return F.count(F.lit(1))


class Context:
    def __init__(self, tables: Tables, slicer: Slicer = Slicer(), segment_of: DataFrame | None = None) -> None:
        self.tables, self.slicer, self.segment_of = tables, slicer, segment_of

    def _order_filter(self, orders: DataFrame) -> DataFrame:
        s, day = self.slicer, F.col("order_purchase_timestamp").cast("date")
        if s.first_day:
            orders = orders.filter(day >= F.lit(s.first_day).cast("date"))
        if s.last_day:
            orders = orders.filter(day <= F.lit(s.last_day).cast("date"))
        if s.statuses:
            orders = orders.filter(F.col("order_status").isin(*s.statuses))
        if s.states:
            orders = orders.filter(F.col("customer_state").isin(*s.states))
        if s.segments:
            kept = self.segment_of.filter(F.col("segment").isin(*s.segments))
            orders = orders.join(kept, "customer_unique_id", "left_semi")
        return orders

    def _line_filter(self, lines: DataFrame) -> DataFrame:
        s = self.slicer
        if s.categories:
            lines = lines.filter(F.col("category_english").isin(*s.categories))
        if s.seller_states:
            lines = lines.filter(F.col("seller_state").isin(*s.seller_states))
        return lines

    def _lines(self, by: list[str] = ()) -> DataFrame:
        """Item sums in cents per order, with product and seller only where used.

        An item whose product or seller is missing stays, under a null name.
        """
        t = self.tables
        sold = {"category_english", "product_id"} & set(by) or self.slicer.categories
        by_seller = {"seller_state", "seller_id"} & set(by) or self.slicer.seller_states
        keys = ["order_id", *(["product_id"] if sold else []), *(["seller_id"] if by_seller else [])]
        lines = rollups.item_sums(t, *keys)
        if sold:
            lines = rollups.with_category(lines, t, "left")
        if by_seller:
            lines = lines.join(t.sellers.select("seller_id", "seller_state"), "seller_id", "left")
        return self._line_filter(lines)

    def orders(self, delivery: bool = False) -> DataFrame:
        """Orders of every status; line filters keep orders with such a line."""
        t = self.tables
        source = enrich_orders(clean_orders(t.orders)) if delivery else clean_orders(t.headers)
        orders = self._order_filter(rollups.person_orders(t, source))
        if self.slicer.categories or self.slicer.seller_states:
            orders = orders.join(self._lines().select("order_id"), "order_id", "left_semi")
        return orders

    def lines(self, by: list[str] = ()) -> DataFrame:
        """Lines of every status with the attributes of their order."""
        orders = self._order_filter(rollups.person_orders(self.tables, clean_orders(self.tables.headers)))
        return self._lines(by).join(orders, "order_id")

    def people(self, rows: DataFrame) -> DataFrame:
        """The rows of people with an order in context; all of them where nothing is filtered."""
        return rows if self.slicer == Slicer() else rows.join(self.orders(), "customer_unique_id", "left_semi")

    def items(self) -> DataFrame:
        """Single items in cents whose order and line are in context."""
        t, s = self.tables, self.slicer
        items = t.item_cents
        if s.categories:
            items = rollups.with_category(items, t, "left")
        if s.seller_states:
            items = items.join(t.sellers.select("seller_id", "seller_state"), "seller_id", "left")
        items = self._line_filter(items)
        if s.without("categories", "seller_states") == Slicer():
            return items
        orders = self._order_filter(rollups.person_orders(t, clean_orders(t.headers)))
        return items.join(orders, "order_id", "left_semi")

    def fact(self) -> DataFrame:
        """Delivered lines; ``fan_out`` counts the item x review rows."""
        return self._line_filter(self._order_filter(rollups.sales_lines(self.tables)))


def _value(column: Column | str) -> Column:
    return numbers.amount(F.sum(column))


def _fact_value(ctx: Context, by: list[str]) -> DataFrame:
    return ctx.fact().groupBy(*by).agg(
        _value(F.col("total_value") * F.col("fan_out")).alias("gmv"), F.countDistinct("order_id").alias("delivered_orders")
    )


def gmv(ctx: Context, by: list[str]) -> DataFrame:
    return _fact_value(ctx, by).select(*by, "gmv")


def gmv_of_items(ctx: Context, by: list[str]) -> DataFrame:
    """Price plus freight of all items, whatever the order status."""
    return ctx.lines(by).groupBy(*by).agg(_value("total_value").alias("gmv"))


def order_success(ctx: Context, by: list[str]) -> DataFrame:
    delivered = F.sum("is_delivered")
    return ctx.orders().groupBy(*by).agg(
        _rows().alias("total_orders"),
        delivered.alias("delivered_orders"),
        rounded(divide_or(delivered, _rows()), 4).alias("order_success_rate"),
    )


def average_order_value(ctx: Context, by: list[str]) -> DataFrame:
    return _fact_value(ctx, by).select(
        *by, "delivered_orders", rounded(divide_or(F.col("gmv"), F.col("delivered_orders"))).alias("aov")
    )


def median_order_value(ctx: Context, by: list[str]) -> DataFrame:
    delivered = Context(ctx.tables, replace(ctx.slicer, statuses=("delivered",)), ctx.segment_of)
    per_order = delivered.lines(by).groupBy(*by, "order_id").agg(_value("total_value").alias("v"))
    medians = ranking.percentiles(per_order, "v", {"m": 0.5}, by=by)
    return medians.select(*by, rounded(F.col("m"), 4).alias("median_order_value"))


def unique_customers(ctx: Context, by: list[str]) -> DataFrame:
    """People behind the orders that have a line in context."""
    return ctx.lines(by).groupBy(*by).agg(F.countDistinct("customer_unique_id").alias("unique_customers"))


def repeat_rate(ctx: Context, by: list[str]) -> DataFrame:
    """Share of the people in context whose whole history has a second order."""
    active = ctx.lines(by).select(*by, "customer_unique_id").distinct()
    history = marts.customer_lifecycle(ctx.tables).select("customer_unique_id", "repeat_customer_flag")
    repeat = F.coalesce(F.sum("repeat_customer_flag"), F.lit(0))
    return active.join(history, "customer_unique_id", "left").groupBy(*by).agg(
        _rows().alias("unique_customers"),
        repeat.alias("repeat_customers"),
        rounded(divide_or(repeat, _rows()), 4).alias("repeat_purchase_rate"),
    )


def lifetime_value(ctx: Context, by: list[str]) -> DataFrame:
    """Mean and median whole-history spend of the people with an order in context."""
    people = ctx.people(marts.customer_lifecycle(ctx.tables))
    means = people.groupBy(*by).agg(rounded(ratio(F.sum("total_spent"), _rows())).alias("average_clv"))
    medians = ranking.percentiles(people, "total_spent", {"m": 0.5}, by=by)
    return means.join(medians, by).select(*by, "average_clv", rounded(F.col("m"), 4).alias("median_clv"))


def on_time_rate(ctx: Context, by: list[str]) -> DataFrame:
    """Distinct delivered orders not flagged late over all of them."""
    orders = ctx.fact().groupBy(*by, "order_id").agg(F.max("is_late_delivery").alias("late"))
    on_time = F.sum(numbers.flag(F.col("late") == 0))
    rate = divide_or(on_time, _rows())
    return orders.groupBy(*by).agg(
        rounded(rate, 4).alias("on_time_delivery_rate"), rounded(F.lit(1.0) - rate, 4).alias("late_delivery_rate")
    )


def sla_rate_of_all_orders(ctx: Context, by: list[str]) -> DataFrame:
    """Variant over every order: one without a delivery date counts as on time."""
    on_time = F.sum(numbers.flag(F.col("late_delivery_flag") == 0))
    rate = divide_or(on_time, _rows())
    return ctx.orders(delivery=True).groupBy(*by).agg(
        rounded(rate, 4).alias("on_time_sla_rate"), rounded(F.lit(1.0) - rate, 4).alias("late_sla_rate")
    )


def service_averages(ctx: Context, by: list[str]) -> DataFrame:
    """Mean delivery days and review over item x review rows."""
    rows = F.col("n_items") * F.col("fan_out")
    timed = F.when(F.col("delivery_days").isNotNull(), rows)
    scored = F.col("n_items") * F.col("n_reviews")
    return ctx.fact().groupBy(*by).agg(
        rounded(ratio(F.sum(F.col("delivery_days") * timed), F.sum(timed))).alias("average_delivery_days"),
        rounded(ratio(F.sum(F.col("score_sum") * F.col("n_items")), F.sum(scored))).alias("average_review_score"),
    )


def leading_seller_share(ctx: Context, fraction: float = 0.01) -> DataFrame:
    """Share of value held by the top sellers; ties at the cut are kept."""
    sellers = ctx.fact().groupBy("seller_id").agg(F.sum(F.col("total_value") * F.col("fan_out")).alias("gmv"))
    return ranking.leading_share(sellers, "gmv", fraction).select(
        F.col("members").alias("sellers"),
        F.col("leading").alias("leading_sellers"),
        rounded(divide_or(F.col("leading_value"), F.col("whole_value")), 4).alias("leading_share"),
    )


def category_share(ctx: Context) -> DataFrame:
    """Category value over the value with the category filter removed."""
    everything = Context(ctx.tables, ctx.slicer.without("categories"), ctx.segment_of)
    whole = _fact_value(everything, []).select("gmv").scalar()
    return _fact_value(ctx, ["category_english"]).select(
        "category_english",
        "gmv",
        rounded(divide_or(F.col("gmv"), whole), 4).alias("category_share"),
    )


def cohort_retention_share(ctx: Context) -> DataFrame:
    """Active people over cohort size; the size ignores the period filter."""
    s = ctx.slicer
    undated = Context(ctx.tables, s.without("first_day", "last_day"), ctx.segment_of)
    long = marts.retention_of(undated.people(marts.cohort_activity(ctx.tables)))
    month = F.expr("add_months(cohort_month, period_number)")
    if s.first_day:
        long = long.filter(month >= F.trunc(F.lit(s.first_day).cast("date"), "month"))
    if s.last_day:
        long = long.filter(month <= F.lit(s.last_day).cast("date"))
    return long.select(
        "cohort_month", "period_number",
        rounded(divide_or(F.col("active_customers"), F.col("cohort_size")), 4).alias("retention"),
    )


def kpi_status(ctx: Context) -> DataFrame:
    """Headline measures against their targets."""
    value = gmv_of_items(Context(ctx.tables, replace(ctx.slicer, statuses=("delivered",))), [])
    repeat = repeat_rate(ctx, []).select(rounded(F.col("repeat_purchase_rate") * 100.0).alias("v"))
    late = on_time_rate(ctx, []).select(rounded(F.col("late_delivery_rate") * 100.0).alias("v"))
    row = value.select(
        F.coalesce("gmv", F.lit(0.0)).alias("gmv"),
        repeat.scalar().alias("repeat_rate_pct"),
        late.scalar().alias("late_rate_pct"),
    )
    kpis = F.array(*[
        F.struct(F.lit(name).alias("kpi"), F.col(name).alias("value"), F.lit(target).alias("target"))
        for name, target in TARGETS.items()
    ])
    met = F.when(F.col("kpi") == "late_rate_pct", F.col("value") < F.col("target")).otherwise(
        F.col("value") >= F.col("target")
    )
    status = F.when(met, "Achieved").when(F.col("kpi") == "late_rate_pct", "Risk Zone").otherwise("Below Target")
    return row.select(F.explode(kpis).alias("k")).select("k.*").withColumn("status", status)


def detractor_relative_risk(ctx: Context) -> DataFrame:
    """How many times likelier a low score is after a late delivery."""
    late_orders = ctx.orders(delivery=True).filter(
        (F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull()
    )
    rows = rollups.order_reviews(ctx.tables.scores).join(late_orders.select("order_id", "late_delivery_flag"), "order_id")
    late = F.col("late_delivery_flag") == 1
    def rate(when: Column) -> Column:
        return ratio(F.sum(F.when(when, F.col("n_detractors"))), F.sum(F.when(when, F.col("n_reviews"))))

    return rows.agg(
        rounded(rate(late), 4).alias("late_detractor_rate"),
        rounded(rate(~late), 4).alias("on_time_detractor_rate"),
        rounded(F.try_divide(rate(late), rate(~late)), 4).alias("relative_risk"),
    )


def price_bands(ctx: Context, edges: list = PRICE_EDGES, labels: list[str] = PRICE_LABELS) -> DataFrame:
    in_cents = [None if edge is None else edge * 100 for edge in edges]
    band = right_closed_band(F.col("price"), [-1, *in_cents[1:]], labels)
    return ctx.items().groupBy(band.alias("price_band")).agg(
        _rows().alias("items"), _value("total_value").alias("value")
    )


def basket_measures(ctx: Context, by: list[str]) -> DataFrame:
    """Share of orders with several items, and mean freight per item."""
    orders = ctx.orders().join(rollups.order_totals(ctx.tables), "order_id")
    several = F.sum(numbers.flag(F.col("order_item_count") > 1))
    return orders.groupBy(*by).agg(
        rounded(divide_or(several, _rows()), 4).alias("multi_item_order_rate"),
        rounded(ratio(F.sum("order_freight"), F.sum("order_item_count"))).alias("average_freight"),
    )


def sliced_report(ctx: Context, by: list[str]) -> DataFrame:
    """Value, orders, customers and order value under all slicers."""
    per_order = ctx.lines(by).groupBy(*by, "order_id").agg(
        F.sum("total_value").alias("value"), F.max("customer_unique_id").alias("person")
    )
    return per_order.groupBy(*by).agg(
        _value("value").alias("gmv"),
        _rows().alias("orders"),
        F.countDistinct("person").alias("customers"),
        rounded(divide_or(_value("value"), _rows())).alias("aov"),
    )


