"""Sources and sinks exercised end to end below the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soukline.functions import clock
from soukline.operators import cleaning, marts, rollups, star
from soukline.session import cut, scratch_path
from soukline.sources import guarded, readers, sinks
from soukline.sources.tables import SCHEMAS, Tables


def csv_scan(t: Tables) -> DataFrame:
    """Orders written as CSV and scanned again with the fixed schema."""
    orders = t.orders
    spark, path = orders.sparkSession, scratch_path(orders.sparkSession, "csv")
    sinks.write_stage({"orders": orders.select(*_columns(spark, "orders"))}, path, fmt="csv")
    return readers.read_csv(spark, f"{path}/orders", "orders")


def _columns(spark, table: str) -> list[str]:
    return spark.createDataFrame([], readers.SCHEMAS[table]).columns


def stage_rescan(t: Tables) -> DataFrame:
    """All nine relations staged as Parquet, read back and counted."""
    frames = t.named()
    spark = t.items.sparkSession
    path = scratch_path(spark, "stage")
    sinks.write_stage(frames, path)
    return _manifest(readers.read_stage(spark, path).named())


def _manifest(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows of each data set."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("dataset"), "rows") for name, df in frames.items()
    ]
    out = counts[0]
    for df in counts[1:]:
        out = out.unionByName(df)
    return out


def cleaned_frames(t: Tables) -> dict[str, DataFrame]:
    """Every relation after cleaning; orders carry their calendar and delivery columns."""
    return {
        "customers": cleaning.clean_customers(t.customers),
        "orders": cleaning.enrich_orders(cleaning.clean_orders(t.orders)),
        "items": cleaning.clean_items(t.items),
        "payments": cleaning.clean_payments(t.payments),
        "reviews": cleaning.clean_reviews(t.reviews),
        "products": cleaning.clean_products(t.products, t.translation),
        "sellers": cleaning.clean_sellers(t.sellers),
        "geolocation": cleaning.clean_geolocation(t.geolocation),
        "translation": t.translation,
    }


def derived_frames(t: Tables) -> dict[str, DataFrame]:
    return {
        "order_fact": marts.order_fact(t),
        "customer_summary": marts.customer_summary(t),
        "customer_lifecycle": marts.customer_lifecycle(t),
        "rfm_features": marts.rfm_features(t),
        "cohort_features": marts.cohort_features(t),
        "delivery_features": marts.delivery_features(t),
        "churn_features": marts.churn_features(t),
        "monthly_revenue": marts.monthly_revenue(t),
    }


def _staged(frames: dict[str, DataFrame], label: str) -> dict[str, DataFrame]:
    """The frames written as Parquet and scanned again."""
    spark = next(iter(frames.values())).sparkSession
    path = scratch_path(spark, label)
    sinks.write_stage(frames, path)
    return {name: spark.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in frames.items()}


def output_manifest(t: Tables) -> DataFrame:
    """All cleaned and derived outputs stored, with the rows of each."""
    # the derived ones first: their shuffles are the largest, and then stand beside few outputs
    return _manifest(_staged(derived_frames(t) | {f"clean_{k}": v for k, v in cleaned_frames(t).items()}, "outputs"))


def lifecycle_from_stage(t: Tables) -> DataFrame:
    """The cleaned tables staged, and the customer lifecycle computed from what was staged."""
    frames = _staged(cleaned_frames(t), "cleaned")
    # cleaning leaves the base columns in place, and cleaning them again changes nothing
    known = {name: [c for c in _columns(t.items.sparkSession, name) if c in df.columns] for name, df in frames.items()}
    return marts.customer_lifecycle(Tables(**{name: frames[name].select(*known[name]) for name in SCHEMAS}))


def metrics_document(t: Tables) -> DataFrame:
    metrics = rollups.person_orders(t, rollups.delivered_headers(t)).agg(
        F.count(F.lit(1)).alias("delivered_orders"), F.countDistinct("customer_unique_id").alias("customers")
    )
    path = scratch_path(metrics.sparkSession, "metrics")
    sinks.write_metrics(metrics, path)
    return metrics.sparkSession.read.schema("delivered_orders bigint, customers bigint").json(path)


def star_tables(t: Tables) -> DataFrame:
    """The star schema saved as tables of a database, then joined on its keys."""
    spark = t.items.sparkSession
    path = scratch_path(spark, "warehouse")
    database = "souk_" + path.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{path}'")
    tables = {
        "dim_customer": star.dim_customer(t), "dim_product": star.dim_product(t), "dim_seller": star.dim_seller(t),
        "dim_date": star.dim_date_of(t), "fact_sales": star.fact_sales(t),
    }
    for name, df in tables.items():
        sinks.write_table(df, f"{database}.{name}")
    joined = spark.table(f"{database}.fact_sales")
    for key in ("customer", "product", "seller", "date"):
        columns = {"customer": "state AS customer_state", "product": "category_name", "seller": "seller_id", "date": "year"}
        dim = spark.table(f"{database}.dim_{key}").selectExpr(f"{key}_key", columns[key])
        joined = joined.join(dim, f"{key}_key")
    totals = cut(joined.groupBy("year", "customer_state", "category_name").agg(
        F.count(F.lit(1)).alias("items"), F.sum("total_item_value").alias("value")
    ))
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return totals


def stored_mart(mart: DataFrame) -> DataFrame:
    """A reporting mart written as Parquet and read back."""
    path = scratch_path(mart.sparkSession, "mart")
    sinks.write_stage({"mart": mart}, path)
    return mart.sparkSession.read.schema(mart.schema).parquet(f"{path}/mart")


def named_views(t: Tables) -> DataFrame:
    """Base relations as views, queried with SQL text."""
    sinks.register_views({"orders": t.headers, "customers": t.customers}, prefix="souk_")
    return t.headers.sparkSession.sql(
        "SELECT order_status, count(*) AS orders FROM souk_orders JOIN souk_customers USING (customer_id) GROUP BY order_status"
    )


def mart_views(t: Tables) -> DataFrame:
    """Base relations and marts as views, joined with SQL text."""
    sinks.register_views(t.named(), prefix="souk_")
    marted = derived_frames(t) | {
        "order_totals": rollups.order_totals(t), "cohort_retention": marts.cohort_retention(t),
        "kpi_snapshot": marts.kpi_snapshot(t), "payment_features": marts.payment_features(t.payments),
        "rfm_segments": marts.rfm_segments(marts.rfm_features(t)),
    }
    sinks.register_views(marted, prefix="souk_")
    return t.items.sparkSession.sql("""
        SELECT m.purchase_month, m.gmv, m.unique_customers, c.cohort_size, k.unique_customers AS all_customers
        FROM souk_monthly_revenue m
        LEFT JOIN souk_cohort_retention c ON c.cohort_month = m.purchase_month AND c.period_number = 0
        CROSS JOIN souk_kpi_snapshot k""")


def monthly_refresh(t: Tables) -> DataFrame:
    """The fact stored by month; its last month is then rewritten in place."""
    fact = marts.order_fact(t)
    spark = fact.sparkSession
    path = scratch_path(spark, "fact")
    sinks.refresh_months(fact, path)
    last = rollups.delivered_headers(t).select(F.max("purchase_month")).scalar()
    sinks.refresh_months(fact.filter(F.col("purchase_month") == last), path)
    return spark.read.parquet(path).groupBy("purchase_month").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("total_value").cast("double").alias("value")
    )


def daily_landing(events: DataFrame) -> DataFrame:
    path = scratch_path(events.sparkSession, "landing")
    sinks.land_daily(events, path, F.col("ts"))
    return events.sparkSession.read.parquet(path).groupBy("year", "month", "day").agg(
        F.count(F.lit(1)).alias("events")
    )


def bucketed_sales(t: Tables, buckets: int = 8) -> DataFrame:
    """The fact and two dimensions stored in buckets of their key, joined and summed: no join shuffles."""
    spark = t.items.sparkSession
    path = scratch_path(spark, "buckets")
    database = "souk_" + path.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{path}'")
    people = star.dim_customer(t, one_row_per_person=True).select("customer_key", "state")
    guarded.write_bucketed(people, f"{database}.dim_customer", "customer_key", buckets)
    guarded.write_bucketed(star.dim_product(t).select("product_key", "category_name"), f"{database}.dim_product", "product_key", buckets)
    fact = cut(star.fact_sales(t).select("customer_key", "product_key", "total_item_value"))
    for key in ("customer", "product"):
        guarded.write_bucketed(fact, f"{database}.fact_by_{key}", f"{key}_key", buckets)
    totals = cut(_bucketed_totals(spark, database))
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return totals


def bucketed_joins(spark, database: str) -> dict[str, DataFrame]:
    """The fact joined to each dimension, both sides in the same buckets."""
    joins = {}
    for key, column in (("customer", "state"), ("product", "category_name")):
        fact, dim = spark.table(f"{database}.fact_by_{key}"), spark.table(f"{database}.dim_{key}")
        joins[column] = fact.join(dim, f"{key}_key")
    return joins


def _bucketed_totals(spark, database: str) -> DataFrame:
    out = None
    for column, joined in bucketed_joins(spark, database).items():
        part = joined.groupBy(F.col(column).alias("name")).agg(
            F.count(F.lit(1)).alias("items"), F.sum("total_item_value").cast("double").alias("value")
        ).withColumn("dimension", F.lit(column))
        out = part if out is None else out.unionByName(part)
    return out


def refreshed_months(t: Tables) -> DataFrame:
    """Monthly figures of purchases that land in two batches; the second rewrites only the months it brings rows for."""
    spark, path = t.items.sparkSession, scratch_path(t.items.sparkSession, "months")
    amounts = rollups.delivered_amounts(t).select("order_id", "purchase_month", "order_total_value")
    # what the ingestion's log holds: the last month and corrections to one order in a hundred of the first come later
    last = amounts.select(F.max("purchase_month")).scalar()
    first = amounts.select(F.min("purchase_month")).scalar()
    late = (F.col("purchase_month") == last) | ((F.col("purchase_month") == first) & (F.pmod(F.crc32(F.col("order_id").cast("binary")), F.lit(100)) == 0))
    log = cut(amounts.withColumn("batch", F.when(late, 1).otherwise(0)))

    def figures(rows: DataFrame) -> DataFrame:
        return rows.groupBy("purchase_month").agg(
            F.count(F.lit(1)).alias("orders"), F.sum("order_total_value").cast("double").alias("value"),
            F.max("batch").alias("last_batch"),
        )

    guarded.refresh_changed(figures(log.filter("batch = 0")), guarded.changed_months(log.filter("batch = 0"), -1, F.col("purchase_month")), path)
    guarded.refresh_changed(figures(log), guarded.changed_months(log, 0, F.col("purchase_month")), path)
    schema = "orders long, value double, last_batch int, purchase_month date"
    return spark.read.schema(schema).parquet(path).select("purchase_month", "orders", "value")


def checked_write(t: Tables) -> DataFrame:
    """Orders written once with their tests: what the write counted, beside what is in the two parts."""
    spark, path = t.items.sparkSession, scratch_path(t.items.sparkSession, "checked")
    arrived, promised = F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")
    rules = guarded.Rules(
        required=("order_id", "order_purchase_timestamp", "order_delivered_customer_date"),
        keys=(("customer_id", t.customers, "customer_id"),),
        tests=(("delivered as promised", F.coalesce(arrived <= promised, F.lit(True))),
               ("carrier within a week", F.coalesce(clock.calendar_days(F.col("order_delivered_carrier_date"), F.col("order_purchase_timestamp")) <= 7, F.lit(True)))),
        unique=("order_id",),
    )
    told = guarded.write_checked(t.orders, path, rules)
    rows = [(k, int(v)) for k, v in told.items() if not k.endswith("different")]
    counted = spark.createDataFrame(rows, "measure string, counted long")
    parts = guarded.quarantine(spark, path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(guarded.FAULT).alias("measure"), F.col("n").alias("stored"))
    kept = guarded.good_rows(spark, path).agg(F.count(F.lit(1)).alias("n"))
    near = F.lit(abs(told["order_id different"] - told["rows"]) <= 0.05 * told["rows"] + 1)
    return counted.join(parts, "measure", "left").withColumn("kept", kept.scalar()).withColumn("order_id_near_unique", near)
