import datetime as dt
import itertools

from soukline.operators import cleaning, marts, quality, star
from soukline.plans import explore, growth, lifecycle, trading
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_two_reviews_double_the_fact_unless_reduced(shop):
    t = shop.order("o1", "p", "2020-01-01", reviews=(1, 5)).tables()
    written = marts.order_fact(t)
    assert written.count() == 2 and written.agg(F.sum("total_value")).first()[0] == 200
    once = marts.order_fact(t, per_review=False)
    assert rows(once, "review_score", "total_value") == [(3.0, 100)]
    assert trading.revenue_by_state(t).first().revenue == 200.0
    assert marts.customer_summary(t).first().lifetime_value == 200
    assert marts.customer_summary(t, per_review=False).first().lifetime_value == 100


def test_a_mover_counts_per_address_or_once(shop):
    shop.order("o1", "p", "2020-01-01", state="AA").order("o2", "p", "2020-03-01", state="BB")
    t = shop.tables()
    assert marts.customer_summary(t).count() == 2
    one = marts.customer_summary(t, per_address=False).collect()
    assert len(one) == 1 and one[0].total_orders == 2 and one[0].customer_state == "BB"
    doubled = trading.on_time_by_state(t, min_deliveries=1)
    assert rows(doubled, "customer_state", "total_deliveries") == [("AA", 2), ("BB", 2)]
    single = trading.on_time_by_state(t, min_deliveries=1, per_address_row=False)
    assert rows(single, "customer_state", "total_deliveries") == [("AA", 1), ("BB", 1)]
    keys = star.dim_customer(t)
    assert keys.count() == 2 and keys.select("customer_key").distinct().count() == 1
    assert star.dim_customer(t, one_row_per_person=True).first().state == "BB"
    assert quality.not_unique("k", keys, "customer_key").first().failing == 1


def test_missing_delivery_is_neither_late_nor_on_time(shop):
    shop.order("o1", "p", "2020-01-01", arrived=None).order("o2", "q", "2020-01-01", arrived="2020-02-01")
    t = shop.tables()
    assert marts.delivery_features(t).count() == 1
    month = growth.on_time_by_month(t).first()
    assert (month.delivered_orders, month.on_time_orders, month.late_orders) == (2, 0, 1)
    assert growth.late_by_state(t).first().delivered_orders == 1


def test_segment_rules_first_match_wins(spark):
    triples = list(itertools.product(range(1, 6), repeat=3))
    df = spark.createDataFrame(triples, "recency_quintile int, frequency_quintile int, monetary_quintile int")
    got = {tuple(r[:3]): r[3] for r in marts.rfm_segments(df).collect()}
    for r, f, m in triples:
        if min(r, f, m) >= 4:
            want = "Champions"
        elif min(r, f) >= 3:
            want = "Loyal Customers"
        elif r >= 4 and f <= 2:
            want = "Recent Customers"
        elif r <= 2 and f >= 4:
            want = "At Risk"
        elif max(r, f) <= 2:
            want = "Lost"
        else:
            want = "Potential Loyalists"
        assert got[(r, f, m)] == want


def test_cohort_periods(shop):
    for i, day in enumerate(("2017-01-31", "2017-02-01", "2017-12-15", "2018-01-01", "2018-01-20")):
        shop.order(f"o{i}", "p", day)
    t = shop.tables()
    assert rows(marts.cohort_features(t), "period_number") == [(0,), (1,), (11,), (12,), (12,)]
    assert rows(marts.cohort_retention(t), "period_number", "active_customers", "retention_rate") == [
        (0, 1, 100.0), (1, 1, 100.0), (11, 1, 100.0), (12, 1, 100.0)]
    wide = explore.cohort_wide(t, 3).first()
    assert (wide.period_0, wide.period_1, wide.period_2) == (100.0, 100.0, 0.0)


def test_churn_bands_keep_their_gaps(spark):
    values = [30.0, 30.5, 31.0, 90.0, 90.5, 91.0, 180.0, 180.5]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    got = [r[0] for r in df.select(growth.churn_status(F.col("d"))).collect()]
    assert got == ["Active", "Active", "Warm", "Warm", "Active", "At Risk", "At Risk", "Churned"]


def test_category_pairs_use_sets(shop):
    for p, c in (("pa", "a"), ("pb", "b"), ("pc", "c")):
        shop.product(p, c)
    line = lambda *ps: tuple((p, "s1", 10, 1) for p in ps)
    shop.order("o1", "x", "2020-01-01", items=line("pa", "pb", "pc"))
    shop.order("o2", "x", "2020-01-01", items=line("pb", "pa", "pa")).order("o3", "x", "2020-01-01", items=line("pa"))
    got = lifecycle.category_pairs(shop.tables()).collect()
    assert list(map(tuple, got)) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]


def test_pareto_over_sellers(shop):
    for s, price in (("s1", 50), ("s2", 30), ("s3", 20)):
        shop.seller(s)
        shop.order(f"o{s}", "x", "2020-01-01", items=(("p1", s, price, 0),))
    got = growth.seller_concentration(shop.tables()).collect()
    assert [(r.cumulative_revenue_share_pct, r.revenue_rank) for r in got] == [(50.0, 1), (80.0, 2), (100.0, 3)]


def test_growth_is_null_without_a_base(shop):
    shop.order("o1", "x", "2020-01-05").order("o2", "x", "2020-02-05", items=(("p1", "s1", 0, 0),))
    shop.order("o3", "x", "2020-03-05", items=(("p1", "s1", 50, 0),))
    got = [r.mom_gmv_growth_pct for r in growth.monthly_growth(shop.tables()).collect()]
    assert got == [None, -100.0, None]


def test_zero_freight_gives_no_ratio(shop):
    items = cleaning.clean_items(shop.order("o1", "x", "2020-01-01", items=(("p1", "s1", 10, 0),)).tables().items)
    assert items.first().price_per_freight_ratio is None


def test_quartile_bands(shop):
    for i in range(1, 9):
        shop.order(f"o{i}", f"p{i}", "2020-01-01", items=(("p1", "s1", i, 0),))
    bands = lifecycle.clv_table(shop.tables()).groupBy("clv_band").count()
    assert rows(bands, "clv_band", "count") == [("Elite", 2), ("High", 2), ("Low", 2), ("Medium", 2)]


def test_second_purchase(shop):
    shop.order("o1", "p", "2020-01-01").order("o2", "p", "2020-01-04").order("o3", "p", "2020-05-01").order("o4", "q", "2020-01-01")
    row = growth.second_purchase(shop.tables()).first()
    assert tuple(row) == (2, 1, 50.0, 3.0, 3.0)


def test_first_order_is_one_whole_row(shop):
    shop.product("p1", "toys").product("p2", "books")
    shop.order("o1", "p", "2020-01-01", arrived=None, items=(("p1", "s1", 5, 1), ("p2", "s1", 5, 1), ("p2", "s1", 8, 1)))
    shop.order("o2", "p", "2020-02-01")
    row = lifecycle.first_orders(shop.tables()).first()
    assert row.order_id == "o1" and row.order_delivered_customer_date is None
    assert (row.product_category_name_english, row.first_order_item_count, row.first_order_value) == ("books", 3, 21.0)


def test_review_median_fills_missing_scores(shop):
    pay = (("boleto", 1, 5), ("credit_card", 3, 95))
    shop.order("o1", "p", "2020-01-01", reviews=(2,), payments=pay).order("o2", "q", "2020-01-02", reviews=(5,), payments=pay)
    shop.order("o3", "r", "2020-01-03", payments=pay).order("o4", "s", "2020-01-03")
    got = rows(lifecycle.repeat_features(shop.tables()), "customer_unique_id", "review_score", "payment_installments")
    assert got == [("p", 2.0, 3), ("q", 5.0, 3), ("r", 3.5, 3)]  # no payment: dropped


def test_date_faults_are_set_apart(shop):
    shop.order("o1", "p", "2020-01-10", arrived="2020-01-01").order("o2", "p", "2020-01-10", arrived="2020-01-12")
    good, bad = quality.split_by_date_order(shop.tables().orders)
    assert rows(good, "order_id") == [("o2",)] and rows(bad, "order_id", "fault") == [("o1", "delivered before purchase")]


def test_orphans_and_duplicates(spark, shop):
    shop.order("o1", "p", "2020-01-01", items=(("p1", "s1", 1, 0), ("gone", "s1", 1, 0), ("gone", "s9", 1, 0)))
    t = shop.tables()
    got = dict(rows(quality.orphan_counts(t), "check", "orphans"))
    assert got["items without product"] == 2 and got["items without seller"] == 1 and got["items without order"] == 0
    geo = spark.createDataFrame([("1", None), ("1", None), ("2", "x")], "a string, b string")
    assert tuple(quality.profile_table("g", geo).first()) == ("g", 3, 2, 2, 1)


def test_geolocation_mode_and_copies(spark):
    schema = "geolocation_zip_code_prefix string, geolocation_lat double, geolocation_lng double, geolocation_city string, geolocation_state string"
    df = spark.createDataFrame(
        [("12", 1.0, 2.0, " São  Paulo", "sp"), ("12", 1.0, 2.0, " São  Paulo", "sp"), ("12", 4.0, 5.0, "b", "sp"), ("12", 4.0, 6.0, "a", "sp")], schema)
    assert tuple(cleaning.clean_geolocation(df).first()) == ("00012", "SP", 2.5, 3.75, "sao paulo")
    assert cleaning.clean_geolocation(df, dedupe_first=True).first().geolocation_city_clean == "a"


def test_calendar_covers_both_ends(spark):
    days = star.dim_date(spark, "2016-09-01", "2018-10-31")
    assert days.count() == 791
    first = days.orderBy("date_key").first()
    assert (first.date_key, first.date, first.month_name, first.day_of_week, first.quarter) == (
        20160901, dt.date(2016, 9, 1), "September", 5, "Q3")
