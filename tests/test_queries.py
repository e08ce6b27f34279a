"""Registry, invariants, and a selection of queries against DuckDB at the smallest scale."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from soukline.operators import marts, measures
from soukline.plans.registry import QUERIES
from soukline.sources import marketplace
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test data")

CHECKED = [
    "m7_clean_geolocation", "m10_order_fact", "m12_customer_summary", "m13_customer_lifecycle", "m20_rfm_features",
    "m26_kpi_snapshot", "m28_cohort_retention", "d6_fact_sales", "q5_on_time_by_state", "q11_top_sellers",
    "q15_days_to_review", "q20_top_sellers_per_state", "r5_second_purchase", "r7_rfm_value_segments",
    "r14_seller_concentration", "g4_clv_table", "g5_category_pairs", "g12_delivery_risk_features", "b11_leading_seller_share",
    "p17_sliced_report", "z1_profile_tables", "z8_schema_tests", "k5_stratified_split", "st3_winback_triggers",
    "st2_overdue_orders", "st3_winback_band", "a1_place_rollup", "z8_checked_write",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    without = set(QUERIES) - set(entry.oracle_sql())
    assert without == {
        "k2_kmeans_elbow", "k3_customer_segments", "k3_kmeans_profiles", "k6_k8_repeat_model",
        "k6_k8_delay_model", "k7_k8_lifetime_value_model", "k12_propensity_audience",
        "st2_scored_alerts", "k13_campaign_by_score", "a2_summaries_beside_exact",
    }


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_statement(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    assert rows_of(df.columns, got, order) == rows_of(columns, cursor.fetchall(), order)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_shares_and_retention_add_up(spark):
    t = marketplace.load(spark, SF)
    retention = marts.cohort_retention(t).filter("period_number = 0 and retention_rate <> 100.0")
    assert retention.count() == 0
    shares = entry.queries()["r12_category_demand"](spark, SF).agg({"revenue_share_pct": "sum"}).first()[0]
    assert shares == pytest.approx(100, abs=0.1)
    sizes = [r["count"] for r in marts.rfm_features(t).groupBy("monetary_quintile").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    assert marts.order_fact(t, per_review=False).count() == entry.queries()["d6_fact_sales"](spark, SF).count()


def test_removed_category_filter_widens_the_total(spark):
    t = marketplace.load(spark, SF)
    part = measures.category_share(measures.Context(t, measures.Slicer(categories=("type_small",)))).first()
    whole = measures.gmv(measures.Context(t), []).first().gmv
    assert part.category_share == round(part.gmv / whole, 4)


@pytest.mark.parametrize("slicer", [
    measures.Slicer(states=("NATION_1",)), measures.Slicer(last_day="1995-12-31"), measures.Slicer(categories=("type_small",)),
    measures.Slicer(statuses=("shipped",)),
])
def test_every_filter_narrows_every_measure(spark, slicer):
    t = marketplace.load(spark, SF)
    whole, part = measures.Context(t), measures.Context(t, slicer)
    items = [measures.price_bands(c).agg({"items": "sum"}).first()[0] or 0 for c in (whole, part)]
    assert items[1] < items[0]
    people = [c.people(marts.customer_lifecycle(t)).count() for c in (whole, part)]
    assert people[1] < people[0]
    rows = [sorted(map(tuple, measures.cohort_retention_share(c).collect())) for c in (whole, part)]
    assert rows[0] != rows[1]
