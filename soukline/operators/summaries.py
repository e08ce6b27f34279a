"""Mergeable summaries and rollups: cells that are stored once and merged for any coarser question.

A cell holds additive sums, a distinct-count sketch of the people and a quantile sketch of the order values. Cells merge
in any order and at any level, so a dashboard's filter reads cells, never orders. Estimates are an opt-in: the exact
measures stay the default, and ``*_check`` holds each estimate against its exact twin.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soukline.functions import numbers
from soukline.operators import ranking, rollups
from soukline.sources.tables import Tables

# Distinct counts: 2 ** LG_K registers, relative standard error 1.04 / sqrt(2 ** LG_K), 1.6 %.
LG_K = 12
# Quantiles: size parameter of the sketch and the rank error that 99 of 100 estimates keep to.
KLL_K, RANK_ERROR = 400, 0.0085
DISTINCT_ERROR = 3 * 1.04 / math.sqrt(1 << LG_K)
CELL = ["purchase_month", "customer_state"]


def order_cells(tables: Tables, by: list[str] = CELL) -> DataFrame:
    """One cell per group of delivered orders with items: orders, value, people and value sketches."""
    orders = rollups.person_orders(tables, rollups.delivered_amounts(tables))
    value = F.col("order_total_value").cast("double")
    return orders.groupBy(*by).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("order_total_value").alias("value"),
        F.hll_sketch_agg("customer_unique_id", LG_K).alias("people"), F.kll_sketch_agg_double(value, KLL_K).alias("values"),
    )


def merged(cells: DataFrame, by: list[str]) -> DataFrame:
    """The cells of a coarser grouping; a filter on the cells' keys is applied before."""
    return cells.groupBy(*by).agg(
        F.sum("orders").alias("orders"), F.sum("value").alias("value"),
        F.hll_union_agg("people").alias("people"), F.kll_merge_agg_double("values").alias("values"),
    )


def customers(cells: DataFrame) -> Column:
    return F.hll_sketch_estimate(cells["people"])


def quantile(cells: DataFrame, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(cells["values"], F.lit(share))


def distinct_check(tables: Tables, cells: DataFrame, by: list[str]) -> DataFrame:
    """Per group the exact number of customers, and whether the merged sketches come within three standard errors."""
    told = merged(cells, by)
    orders = rollups.person_orders(tables, rollups.delivered_amounts(tables))
    exact = orders.groupBy(*by).agg(F.countDistinct("customer_unique_id").alias("customers"))
    # below a few hundred values the sketch is exact up to one or two
    bound = F.greatest(F.lit(2.0), F.col("customers") * DISTINCT_ERROR)
    near = told.select(*by, customers(told).alias("estimate"))
    return exact.join(near, by, "left").select(
        *by, "customers", F.coalesce(F.abs(F.col("estimate") - F.col("customers")) <= bound, F.lit(False)).alias("within")
    )


def quantile_check(tables: Tables, cells: DataFrame, by: list[str], shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Per group the number of orders, and whether each estimated quantile's true rank is within twice the bound."""
    told = merged(cells, by)
    points = told.select(*by, *[quantile(told, s).alias(f"q{k}") for k, s in enumerate(shares)])
    orders = rollups.person_orders(tables, rollups.delivered_amounts(tables))
    # groups are months or states: their few rows are joined to the orders without dealing these out
    rows = orders.select(*by, F.col("order_total_value").cast("double").alias("v")).join(points, by)
    n = F.count(F.lit(1))
    checks = []
    for k, share in enumerate(shares):
        below = F.count_if(F.col("v") < F.col(f"q{k}"))
        upto = F.count_if(F.col("v") <= F.col(f"q{k}"))
        # equal values span ranks; one order is the least difference there is
        slack = 2 * RANK_ERROR * n + 1
        checks.append((below <= n * share + slack) & (upto >= n * share - slack))
    within = checks[0]
    for c in checks[1:]:
        within = within & c
    return rows.groupBy(*by).agg(n.alias("orders"), within.alias("within"))


def exact_and_estimated(tables: Tables, cells: DataFrame, by: list[str]) -> DataFrame:
    """The estimates beside their exact twins, for a reader who decides which to use."""
    told = merged(cells, by)
    estimates = told.select(*by, "orders", customers(told).alias("customers_estimate"), quantile(told, 0.5).alias("median_estimate"))
    values = rollups.person_orders(tables, rollups.delivered_amounts(tables))
    people = values.groupBy(*by).agg(F.countDistinct("customer_unique_id").alias("customers"))
    medians = ranking.percentiles(values, "order_total_value", {"median": 0.5}, by=by)
    return estimates.join(people, by).join(medians, by)


# Rollups ---------------------------------------------------------------------------------------------------------


def _levels(rows: DataFrame, outer: str, inner: str, names: tuple[str, str, str]) -> DataFrame:
    """Sums and people of each inner group, each outer group and all, in one pass.

    ``rows`` has one row per outer, inner and person with orders and value; a person who is in several inner groups counts
    once in the outer one.
    """
    level = F.element_at(F.array(*[F.lit(x) for x in names]), F.lit(3) - F.least(F.grouping_id().cast("int"), F.lit(2)))
    return rows.rollup(outer, inner).agg(
        level.alias("level"), F.sum("orders").alias("orders"), F.countDistinct("customer_unique_id").alias("customers"),
        numbers.amount(F.sum("value")).alias("value"),
    )


def _per_person(tables: Tables, *keys: Column) -> DataFrame:
    orders = rollups.person_orders(tables, rollups.delivered_amounts(tables))
    return orders.groupBy(*keys, "customer_unique_id").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.col("order_total_value") * 100).cast("long").alias("value")
    )


def place_rollup(tables: Tables) -> DataFrame:
    """State and city, state, all: orders, customers, value."""
    rows = _per_person(tables, F.col("customer_state"), F.col("customer_city"))
    return _levels(rows, "customer_state", "customer_city", ("all", "state", "city"))


def calendar_rollup(tables: Tables) -> DataFrame:
    """Year and month, year, all: orders, customers, value."""
    rows = _per_person(tables, F.col("purchase_year"), F.col("purchase_month"))
    return _levels(rows, "purchase_year", "purchase_month", ("all", "year", "month"))
