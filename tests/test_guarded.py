import datetime as dt
import pathlib
import uuid

from pyspark.sql import functions as F

from soukline.operators import summaries
from soukline.plans import storage
from soukline.sources import guarded


def month(k):
    return dt.date(2024, k, 1)


def test_a_checked_write_counts_and_parts_in_one_pass(spark, tmp_path):
    rows = [(1, "a", 5.0), (2, None, 5.0), (3, "b", -1.0), (4, "x", 5.0), (5, "x", -2.0), (6, "a", None)]
    df = spark.createDataFrame(rows, "id long, kind string, price double")
    kinds = spark.createDataFrame([("a",), ("b",), ("b",)], "name string")
    rules = guarded.Rules(("kind",), (("kind", kinds, "name"),), (("price", F.col("price") >= 0),), ("id",))
    path = str(tmp_path / "out")
    told = guarded.write_checked(df, path, rules)
    assert told == {"rows": 6, "quarantined": 5, "kind not null": 1, "kind in name": 2, "price": 3, "id different": 6}
    assert [tuple(r) for r in guarded.good_rows(spark, path).collect()] == [(1, "a", 5.0)]
    bad = {r.id: r.faults for r in guarded.quarantine(spark, path).collect()}
    assert bad == {2: ["kind not null"], 3: ["price"], 4: ["kind in name"], 5: ["kind in name", "price"], 6: ["price"]}


def test_tables_in_the_same_buckets_join_without_a_shuffle(spark, tmp_path):
    database = f"b{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{tmp_path}/{database}'")
    fact = spark.range(2000).select((F.col("id") % 50).alias("customer_key"), (F.col("id") % 7).alias("product_key"), F.lit(1).alias("v"))
    guarded.write_bucketed(fact, f"{database}.fact_by_customer", "customer_key", 4)
    guarded.write_bucketed(fact, f"{database}.fact_by_product", "product_key", 4)
    guarded.write_bucketed(spark.range(50).select(F.col("id").alias("customer_key"), F.lit("s").alias("state")), f"{database}.dim_customer", "customer_key", 4)
    guarded.write_bucketed(spark.range(7).select(F.col("id").alias("product_key"), F.lit("c").alias("category_name")), f"{database}.dim_product", "product_key", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for joined in storage.bucketed_joins(spark, database).values():
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
            assert joined.count() == 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    files = list(pathlib.Path(tmp_path, database).rglob("part-*.parquet"))
    assert len([f for f in files if "fact_by_customer" in str(f)]) == 4
    spark.sql(f"DROP DATABASE {database} CASCADE")


def test_only_changed_months_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "months")
    log = spark.createDataFrame(
        [(month(1), 1, 0), (month(2), 2, 0), (month(3), 3, 0), (month(2), 10, 1), (month(4), 4, 1)], "purchase_month date, v int, batch int"
    )
    figures = lambda rows: rows.groupBy("purchase_month").agg(F.sum("v").alias("v"))
    key = F.col("purchase_month")
    guarded.refresh_changed(figures(log.filter("batch = 0")), guarded.changed_months(log.filter("batch = 0"), -1, key), path)
    first = {p.name: p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet")}
    guarded.refresh_changed(figures(log), guarded.changed_months(log, 0, key), path)
    got = {r.purchase_month: r.v for r in spark.read.parquet(path).collect()}
    assert got == {r.purchase_month: r.v for r in figures(log).collect()}
    after = {p.name: str(p.parent) for p in pathlib.Path(path).rglob("*.parquet")}
    same = {after[n][-10:] for n in first if n in after}
    assert same == {"2024-01-01", "2024-03-01"}


def test_sketches_merge_to_what_one_pass_gives(shop):
    for k in range(400):
        shop.order(f"o{k}", f"p{k % 90}", f"2024-0{1 + k % 6}-11T10:00:00", state="AB"[k % 2] * 2, items=(("p1", "s1", 10 + k % 37, 1),))
    tables = shop.tables()
    cells = summaries.order_cells(tables)
    for by in (["customer_state"], ["purchase_month"], summaries.CELL):
        assert summaries.distinct_check(tables, cells, by).filter("NOT within").isEmpty()
        assert summaries.quantile_check(tables, cells, by).filter("NOT within").isEmpty()
    told = summaries.exact_and_estimated(tables, cells, ["customer_state"]).collect()
    assert len(told) == 2 and all(abs(r.customers_estimate - r.customers) <= 2 and abs(r.median_estimate - r.median) <= 2 for r in told)
    # a filter reads cells only
    some = cells.filter(F.col("purchase_month") == dt.date(2024, 2, 1))
    assert sum(r.orders for r in summaries.merged(some, ["purchase_month"]).collect()) == 67


def test_a_check_sees_a_wrong_estimate(shop):
    for k in range(60):
        shop.order(f"o{k}", f"p{k}", "2024-01-11T10:00:00", items=(("p1", "s1", 10 + k, 1),))
    tables = shop.tables()
    few = summaries.order_cells(tables)
    half = few.withColumn("values", F.lit(few.sparkSession.range(60).select((F.col("id") / 100).alias("v")).agg(
        F.kll_sketch_agg_double("v", summaries.KLL_K).alias("s")).first().s))
    assert not summaries.quantile_check(tables, half, ["customer_state"]).first().within


def test_a_person_in_two_cities_counts_once_in_the_state(shop):
    shop.order("1", "p", "2024-01-01T00:00:00", city="x").order("2", "p", "2024-02-01T00:00:00", city="y")
    shop.order("3", "q", "2025-01-01T00:00:00", city="y", state="BB")
    tables = shop.tables()
    got = {(r.customer_state, r.customer_city, r.level): (r.orders, r.customers, r.value) for r in summaries.place_rollup(tables).collect()}
    assert got == {
        ("AA", "x", "city"): (1, 1, 100.0), ("AA", "y", "city"): (1, 1, 100.0), ("BB", "y", "city"): (1, 1, 100.0),
        ("AA", None, "state"): (2, 1, 200.0), ("BB", None, "state"): (1, 1, 100.0), (None, None, "all"): (3, 2, 300.0),
    }
    years = {r.purchase_year: r.customers for r in summaries.calendar_rollup(tables).collect() if r.level == "year"}
    assert years == {2024: 1, 2025: 1}
