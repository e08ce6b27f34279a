"""Data quality: profiles, integrity, duplicates, date order, outliers, freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soukline.functions import clock, numbers
from soukline.functions.numbers import percent, rounded
from soukline.operators import ranking, rollups, star
from soukline.operators.cleaning import clean_orders
from soukline.session import cut
from soukline.sources.tables import Tables


def _rows() -> Column:
    return F.count(F.lit(1))


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def profile_table(name: str, df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and repeated rows in one shuffle.

    Equal rows are counted map-side first, so copies of one row travel once.
    """
    missing = reduce(lambda a, b: a + b, [numbers.flag(F.col(c).isNull()) for c in df.columns])
    distinct = df.groupBy(*df.columns).agg(_rows().alias("_n")).withColumn("_missing", missing)
    total = F.coalesce(F.sum("_n"), F.lit(0))
    return distinct.agg(
        total.alias("rows"),
        F.coalesce(F.sum(F.col("_n") * F.col("_missing")), F.lit(0)).alias("missing_cells"),
        (total - _rows()).alias("duplicate_rows"),
    ).select(F.lit(name).alias("dataset"), "rows", F.lit(len(df.columns)).alias("columns"), "missing_cells", "duplicate_rows")


def profile_tables(t: Tables) -> DataFrame:
    return _stack([profile_table(name, df) for name, df in t.named().items()])


def profile_columns(name: str, df: DataFrame) -> DataFrame:
    """Type and null count of every column in one narrow aggregate."""
    nulls = df.agg(*[F.sum(numbers.flag(F.col(c).isNull())).alias(c) for c in df.columns])
    cells = F.array(*[
        F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
            F.coalesce(F.col(f.name), F.lit(0)).alias("nulls"),
        )
        for f in df.schema.fields
    ])
    return nulls.select(F.lit(name).alias("dataset"), F.explode(cells).alias("c")).select("dataset", "c.*")


def profile_all_columns(t: Tables) -> DataFrame:
    return _stack([profile_columns(name, df) for name, df in t.named().items()])


def orphan_count(check: str, child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key has no parent; children are counted per key first."""
    keys = child.groupBy(key).agg(_rows().alias("n"))
    lost = keys.join(parent.select(key), key, "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans")).select(F.lit(check).alias("check"), "orphans")


def orphan_counts(t: Tables) -> DataFrame:
    return _stack([
        orphan_count("items without order", t.items, t.headers, "order_id"),
        orphan_count("payments without order", t.payments, t.headers, "order_id"),
        orphan_count("orders without customer", t.headers, t.customers, "customer_id"),
        orphan_count("items without product", t.items, t.products, "product_id"),
        orphan_count("items without seller", t.items, t.sellers, "seller_id"),
    ])


def duplicate_report(t: Tables) -> DataFrame:
    """Geolocation rows before and after removing exact copies."""
    profile = profile_table("geolocation", t.geolocation)
    return profile.select(
        "dataset", "rows", "duplicate_rows", (F.col("rows") - F.col("duplicate_rows")).alias("rows_kept")
    )


# What is done with a missing value of each column.
MISSING_POLICY = [
    ("products", "product_category_name", "keep, treat as unknown"),
    ("orders", "order_delivered_customer_date", "keep, leave out of delivery measures"),
    ("orders", "order_delivered_carrier_date", "keep, never reached the carrier"),
    ("reviews", "review_comment_title", "keep, review without text"),
    ("reviews", "review_comment_message", "keep, review without text"),
]


def missing_values(t: Tables) -> DataFrame:
    frames = []
    for table in dict.fromkeys(name for name, _, _ in MISSING_POLICY):
        rules = [(c, p) for n, c, p in MISSING_POLICY if n == table]
        df = getattr(t, table)
        counted = df.agg(_rows().alias("rows"), *[F.sum(numbers.flag(F.col(c).isNull())).alias(c) for c, _ in rules])
        cells = F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).alias("missing"), F.lit(p).alias("policy")) for c, p in rules
        ])
        frames.append(
            counted.select(F.lit(table).alias("dataset"), "rows", F.explode(cells).alias("c")).select(
                "dataset", "c.column", "c.missing",
                rounded(percent(F.col("c.missing"), F.col("rows"))).alias("missing_pct"), "c.policy",
            )
        )
    return _stack(frames)


def date_fault(bought: Column, handed: Column, arrived: Column) -> Column:
    return (
        F.when(arrived < bought, "delivered before purchase")
        .when(handed < bought, "shipped before purchase")
        .when(arrived < handed, "delivered before shipped")
    )


def split_by_date_order(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders whose dates are in sequence, and the others with the first fault."""
    fault = date_fault(
        F.col("order_purchase_timestamp"), F.col("order_delivered_carrier_date"), F.col("order_delivered_customer_date")
    )
    marked = clean_orders(orders).withColumn("fault", fault)
    return marked.filter(F.col("fault").isNull()).drop("fault"), marked.filter(F.col("fault").isNotNull())


def date_quarantine(t: Tables) -> DataFrame:
    _, bad = split_by_date_order(t.orders)
    return bad.select("order_id", "order_status", "fault")


def order_outliers(t: Tables, reach: float = 1.5) -> DataFrame:
    """Quartile fences of delivered order totals; outliers are counted, not removed."""
    values = rollups.delivered_amounts(t).select("order_total_value")
    quartiles = ranking.percentiles(values, "order_total_value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    edges = quartiles.select(
        F.struct(
            "q1", "median", "q3",
            (F.col("q1") - (F.col("q3") - F.col("q1")) * reach).alias("low"),
            (F.col("q3") + (F.col("q3") - F.col("q1")) * reach).alias("high"),
        )
    ).scalar()
    v = F.col("order_total_value").cast("double")
    return values.withColumn("e", edges).agg(
        _rows().alias("orders"),
        *[rounded(F.max(f"e.{name}"), 4).alias(out) for name, out in (
            ("q1", "q1"), ("median", "median"), ("q3", "q3"), ("low", "lower_fence"), ("high", "upper_fence"))],
        F.sum(numbers.flag(v < F.col("e.low"))).alias("low_outliers"),
        F.sum(numbers.flag(v > F.col("e.high"))).alias("high_outliers"),
        F.max(v).alias("largest"),
    )


def not_unique(test: str, df: DataFrame, key: str) -> DataFrame:
    repeated = df.groupBy(key).agg(_rows().alias("n")).filter(F.col("n") > 1)
    return repeated.agg(_rows().alias("failing")).select(F.lit(test).alias("test"), "failing")


def nulls_in(prefix: str, df: DataFrame, columns: list[str]) -> DataFrame:
    counted = df.agg(*[F.coalesce(F.sum(numbers.flag(F.col(c).isNull())), F.lit(0)).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(f"{prefix}.{c} not null").alias("test"), F.col(c).alias("failing")) for c in columns])
    return counted.select(F.explode(cells).alias("c")).select("c.*")


def unmatched(test: str, child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return orphan_count(test, child, parent, key).select(F.col("check").alias("test"), F.col("orphans").alias("failing"))


def schema_tests(t: Tables) -> DataFrame:
    """Uniqueness, non-null and foreign keys of the star schema: failing rows per test."""
    customers, products, sellers, days = star.dim_customer(t), star.dim_product(t), star.dim_seller(t), star.dim_date_of(t)
    keys = ["customer_key", "product_key", "seller_key", "date_key"]
    fact = cut(star.fact_sales(t).select(*keys, "order_id"))  # read by five tests
    dims = dict(zip(keys, (customers, products, sellers, days)))
    return _stack(
        [not_unique(f"{key} unique", dim, key) for key, dim in dims.items()]
        + [not_unique("order_id unique", t.headers, "order_id")]
        + [nulls_in("fact", fact, [*keys, "order_id"])]
        + [unmatched(f"fact.{key} in dimension", fact, dim, key) for key, dim in dims.items()]
    )


def freshness(df: DataFrame, ts: str, reference: Column, max_hours: float = 24.0) -> DataFrame:
    """Hours between the newest row and a reference time, against the limit."""
    hours = clock.elapsed_micros(F.col("reference"), F.col("newest")).cast("double") / F.lit(3.6e9)
    return df.agg(F.max(ts).alias("newest")).withColumn("reference", reference).select(
        "newest", "reference", rounded(hours).alias("lag_hours"),
        F.when(hours <= max_hours, "fresh").otherwise("stale").alias("status"),
    )


def order_freshness(t: Tables) -> DataFrame:
    """Purchases against the latest approval seen in the data."""
    latest = t.headers.select(F.max("order_approved_at")).scalar()
    return freshness(t.headers, "order_purchase_timestamp", latest)
