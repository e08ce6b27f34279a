"""Business measures, data quality, sources and sinks."""

from oracles.base import avg, mean, pct, rnd, sql
from oracles.marts import KEY

LINES = """al AS (SELECT order_id, customer_unique_id, order_status, purchase_month, bought::DATE AS day, pe.customer_state, category_english,
  seller_id, seller_state, price, freight_value, total_value
  FROM i JOIN o_all USING (order_id) JOIN person pe USING (customer_id) JOIN p USING (product_id) JOIN b_sellers USING (seller_id))"""
TABLES = ["customers", "orders", "items", "payments", "reviews", "products", "sellers", "geolocation", "translation"]
TIMES = ["order_purchase_timestamp", "order_approved_at", "order_estimated_delivery_date", "order_delivered_carrier_date", "order_delivered_customer_date"]
COLUMNS = {
    "customers": {c: "string" for c in ("customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state")},
    "orders": {**{c: "string" for c in ("order_id", "customer_id", "order_status")}, **{c: "timestamp_ntz" for c in TIMES}},
    "items": {"order_id": "string", "order_item_id": "int", "product_id": "string", "seller_id": "string",
              "shipping_limit_date": "timestamp_ntz", "price": "decimal(18,2)", "freight_value": "decimal(18,2)"},
    "payments": {"order_id": "string", "payment_type": "string", "payment_installments": "int", "payment_value": "decimal(18,2)"},
    "reviews": {"review_id": "string", "order_id": "string", "review_score": "int", "review_comment_title": "string",
                "review_comment_message": "string", "review_creation_date": "timestamp_ntz", "review_answer_timestamp": "timestamp_ntz"},
    "products": {"product_id": "string", "product_category_name": "string", "product_name_lenght": "int", "product_description_lenght": "int",
                 "product_photos_qty": "int", "product_weight_g": "int", "product_length_cm": "int", "product_height_cm": "int", "product_width_cm": "int"},
    "sellers": {c: "string" for c in ("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state")},
    "geolocation": {"geolocation_zip_code_prefix": "string", "geolocation_lat": "double", "geolocation_lng": "double",
                    "geolocation_city": "string", "geolocation_state": "string"},
    "translation": {"product_category_name": "string", "product_category_name_english": "string"},
}
RENAMED = {"order_purchase_timestamp": "bought", "order_approved_at": "approved", "order_delivered_carrier_date": "handed",
           "order_delivered_customer_date": "arrived", "order_estimated_delivery_date": "promised"}
WEEK = "bought AS order_purchase_timestamp, approved AS order_approved_at, handed AS order_delivered_carrier_date, arrived AS order_delivered_customer_date, promised AS order_estimated_delivery_date"


def profile(name: str) -> str:
    cells = " + ".join(f"({RENAMED.get(c, c)} IS NULL)::INT" for c in COLUMNS[name])
    return (f"SELECT '{name}' AS dataset, count(*) AS rows, {len(COLUMNS[name])} AS columns, sum({cells})::BIGINT AS missing_cells, "
            f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM b_{name})) AS duplicate_rows FROM b_{name}")


def columns(name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS dataset, '{c}' AS column, '{kind}' AS type, count(*) - count({RENAMED.get(c, c)}) AS nulls FROM b_{name}"
        for c, kind in COLUMNS[name].items())


def missing(table: str, column: str, policy: str) -> str:
    n = f"count(*) - count({RENAMED.get(column, column)})"
    return f"SELECT '{table}' AS dataset, '{column}' AS column, {n} AS missing, {pct(n, 'count(*)')} AS missing_pct, '{policy}' AS policy FROM b_{table}"


def orphan(check: str, child: str, parent: str, key: str) -> str:
    return f"SELECT '{check}' AS check, count(*) AS orphans FROM b_{child} c WHERE NOT EXISTS (SELECT 1 FROM b_{parent} q WHERE q.{key} = c.{key})"


FACT_KEYS = f"""fk AS (SELECT {KEY.format('customer_unique_id')} AS customer_key, {KEY.format('product_id')} AS product_key,
  {KEY.format('seller_id')} AS seller_key, strftime(bought, '%Y%m%d')::INT AS date_key, order_id FROM po JOIN i USING (order_id)),
dc AS (SELECT DISTINCT {KEY.format('customer_unique_id')} AS customer_key, customer_city, customer_state FROM b_customers),
dp AS (SELECT {KEY.format('product_id')} AS product_key FROM b_products), ds AS (SELECT {KEY.format('seller_id')} AS seller_key FROM b_sellers),
dd AS (SELECT strftime(unnest(generate_series(min(bought)::DATE, max(bought)::DATE, INTERVAL 1 DAY)), '%Y%m%d')::INT AS date_key FROM b_orders)"""
DIMS = {"customer_key": "dc", "product_key": "dp", "seller_key": "ds", "date_key": "dd"}
SCHEMA_TESTS = " UNION ALL ".join(
    [f"SELECT '{k} unique' AS test, count(*) AS failing FROM (SELECT {k} FROM {d} GROUP BY 1 HAVING count(*) > 1)" for k, d in DIMS.items()]
    + ["SELECT 'order_id unique', count(*) FROM (SELECT order_id FROM b_orders GROUP BY 1 HAVING count(*) > 1)"]
    + [f"SELECT 'fact.{k} not null', count(*) FILTER ({k} IS NULL) FROM fk" for k in [*DIMS, "order_id"]]
    + [f"SELECT 'fact.{k} in dimension', count(*) FROM fk WHERE NOT EXISTS (SELECT 1 FROM {d} WHERE {d}.{k} = fk.{k})" for k, d in DIMS.items()])

LATE = f"{rnd('1.0 - count(DISTINCT order_id) FILTER (is_late = 0)::DOUBLE / count(DISTINCT order_id)', 4)}"
REPEAT_ALL = f"""(SELECT {mean('sum(repeat_customer_flag)', 'count(*)', 4)} FROM (SELECT DISTINCT customer_unique_id FROM al)
  LEFT JOIN life USING (customer_unique_id))"""

ORACLES = {
    "b1_gmv_by_state": sql("SELECT customer_state, sum(total_value)::DOUBLE AS gmv FROM fact GROUP BY 1"),
    "b1_gmv_of_all_items_by_status": sql("SELECT order_status, sum(total_value)::DOUBLE AS gmv FROM al GROUP BY 1", LINES),
    "b2_b5_orders_and_success": sql(f"""SELECT purchase_month, count(DISTINCT order_id) AS total_orders, count(*) FILTER (order_status = 'delivered') AS delivered_orders,
      {mean("count(*) FILTER (order_status = 'delivered')", 'count(*)', 4)} AS order_success_rate FROM o_all GROUP BY 1"""),
    "b3_aov_by_category": sql(f"""SELECT category_english, count(DISTINCT order_id) AS delivered_orders,
      {mean('sum(total_value)', 'count(DISTINCT order_id)')} AS aov FROM fact GROUP BY 1"""),
    "b4_median_order_value_by_state": sql(f"""SELECT customer_state, {rnd('quantile_cont(v::DOUBLE, 0.5)', 4)} AS median_order_value FROM (
      SELECT customer_state, order_id, sum(price + freight_value) AS v FROM al WHERE order_status = 'delivered' GROUP BY 1, 2) GROUP BY 1""", LINES),
    "b6_unique_customers_by_category": sql("SELECT category_english, count(DISTINCT customer_unique_id) AS unique_customers FROM al GROUP BY 1", LINES),
    "b7_repeat_rate_by_month": sql(f"""SELECT purchase_month, count(*) AS unique_customers, coalesce(sum(repeat_customer_flag), 0)::BIGINT AS repeat_customers,
      {mean('coalesce(sum(repeat_customer_flag), 0)', 'count(*)', 4)} AS repeat_purchase_rate
      FROM (SELECT DISTINCT purchase_month, customer_unique_id FROM al) LEFT JOIN life USING (customer_unique_id) GROUP BY 1""", LINES),
    "b8_clv_by_state": sql(f"""SELECT state, {avg('total_spent')} AS average_clv, {rnd('quantile_cont(total_spent::DOUBLE, 0.5)', 4)} AS median_clv
      FROM life GROUP BY 1"""),
    "b9_on_time_rate_by_state": sql(f"""SELECT customer_state, {mean('count(DISTINCT order_id) FILTER (is_late = 0)', 'count(DISTINCT order_id)', 4)} AS on_time_delivery_rate,
      {LATE} AS late_delivery_rate FROM fact GROUP BY 1"""),
    "b9_sla_rate_of_all_orders": sql(f"""SELECT order_status, {mean('count(*) FILTER (is_late = 0)', 'count(*)', 4)} AS on_time_sla_rate,
      {rnd('1.0 - (count(*) FILTER (is_late = 0))::DOUBLE / count(*)', 4)} AS late_sla_rate FROM o_all GROUP BY 1"""),
    "b10_service_averages_by_state": sql(f"""SELECT customer_state, {avg('delivery_days')} AS average_delivery_days, {avg('review_score')} AS average_review_score
      FROM fact GROUP BY 1"""),
    "b11_leading_seller_share": sql(f"""SELECT count(*) AS sellers, count(*) FILTER (k <= n) AS leading_sellers,
      {mean('sum(v) FILTER (k <= n)', 'sum(v)', 4)} AS leading_share FROM (
      SELECT v, rank() OVER (ORDER BY v DESC) AS k, greatest(1, round(count(*) OVER () * 0.01)) AS n
      FROM (SELECT seller_id, sum(total_value) AS v FROM fact GROUP BY 1))"""),
    "b12_category_share": sql(f"""SELECT category_english, sum(total_value)::DOUBLE AS gmv,
      {mean('sum(total_value)', "(SELECT sum(total_value) FROM fact)", 4)} AS category_share
      FROM fact WHERE category_english IN ('type_small', 'type_large') GROUP BY 1"""),
    "b13_cohort_retention": sql(f"SELECT cohort_month, period_number, {mean('active_customers', 'cohort_size', 4)} AS retention FROM retention"),
    "b8_clv_by_state_in_dates": sql(f"""SELECT state, {avg('total_spent')} AS average_clv, {rnd('quantile_cont(total_spent::DOUBLE, 0.5)', 4)} AS median_clv
      FROM life WHERE customer_unique_id IN (SELECT customer_unique_id FROM o_all JOIN person USING (customer_id)
        WHERE bought::DATE BETWEEN DATE '1996-01-01' AND DATE '1998-06-30') GROUP BY 1"""),
    "b13_cohort_retention_in_states": sql(f"""SELECT cohort_month, period_number, {mean('n', 'max(n) FILTER (period_number = 0) OVER (PARTITION BY cohort_month)', 4)} AS retention
      FROM (SELECT cohort_month, period_number, count(DISTINCT customer_unique_id) AS n FROM cohort
        WHERE customer_unique_id IN (SELECT customer_unique_id FROM o_all JOIN person USING (customer_id)
          WHERE customer_state IN ('NATION_1', 'NATION_2', 'NATION_3')) GROUP BY 1, 2)"""),
    "b13_cohort_retention_in_dates": sql(f"""SELECT cohort_month, period_number, {mean('active_customers', 'cohort_size', 4)} AS retention
      FROM retention WHERE cohort_month + to_months(period_number) BETWEEN DATE '1996-01-01' AND DATE '1998-06-30'"""),
    "b16_price_bands_on_shelf": sql("""SELECT CASE WHEN price <= 50 THEN 'up to 50' WHEN price <= 100 THEN '50 to 100' WHEN price <= 250 THEN '100 to 250'
      WHEN price <= 500 THEN '250 to 500' WHEN price <= 1000 THEN '500 to 1000' ELSE 'over 1000' END AS price_band, count(*) AS items,
      sum(total_value)::DOUBLE AS value FROM i JOIN p USING (product_id) JOIN b_sellers USING (seller_id)
      JOIN (SELECT order_id FROM o_all WHERE order_status = 'delivered') USING (order_id)
      WHERE category_english IN ('type_small', 'unknown') AND seller_state IN ('NATION_4', 'NATION_5', 'NATION_6') GROUP BY 1"""),
    "b14_kpi_status": sql(f"""SELECT *, CASE WHEN kpi = 'late_rate_pct' THEN if(value < target, 'Achieved', 'Risk Zone')
        ELSE if(value >= target, 'Achieved', 'Below Target') END AS status FROM (
      SELECT 'gmv' AS kpi, sum(total_value)::DOUBLE AS value, 15000000.0::DOUBLE AS target FROM al WHERE order_status = 'delivered'
      UNION ALL SELECT 'repeat_rate_pct', {rnd(f'{REPEAT_ALL} * 100.0')}, 10.0
      UNION ALL SELECT 'late_rate_pct', {rnd(f'(SELECT {LATE} FROM fact) * 100.0')}, 5.0)""", LINES),
    "b15_detractor_relative_risk": sql(f"""SELECT {rnd('a', 4)} AS late_detractor_rate, {rnd('b', 4)} AS on_time_detractor_rate, {rnd('a / b', 4)} AS relative_risk FROM (
      SELECT (sum(is_detractor) FILTER (is_late = 1))::DOUBLE / count(*) FILTER (is_late = 1) AS a,
        (sum(is_detractor) FILTER (is_late = 0))::DOUBLE / count(*) FILTER (is_late = 0) AS b FROM r JOIN delivery USING (order_id))"""),
    "b16_price_bands": sql("""SELECT CASE WHEN price <= 50 THEN 'up to 50' WHEN price <= 100 THEN '50 to 100' WHEN price <= 250 THEN '100 to 250'
      WHEN price <= 500 THEN '250 to 500' WHEN price <= 1000 THEN '500 to 1000' ELSE 'over 1000' END AS price_band, count(*) AS items,
      sum(total_value)::DOUBLE AS value FROM i GROUP BY 1"""),
    "b16_basket_by_month": sql(f"""SELECT purchase_month, {mean('count(*) FILTER (order_item_count > 1)', 'count(*)', 4)} AS multi_item_order_rate,
      {mean('sum(order_freight)', 'sum(order_item_count)')} AS average_freight FROM o_all JOIN amount USING (order_id) GROUP BY 1"""),
    "p17_sliced_report": sql(f"""SELECT purchase_month, sum(total_value)::DOUBLE AS gmv, count(DISTINCT order_id) AS orders,
      count(DISTINCT customer_unique_id) AS customers, {mean('sum(total_value)', 'count(DISTINCT order_id)')} AS aov
      FROM al WHERE day BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND customer_state IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_5', 'NATION_8')
      AND order_status IN ('delivered', 'shipped') AND category_english IN ('type_small', 'type_large', 'unknown')
      AND seller_state <> 'NATION_0' AND customer_unique_id IN (SELECT customer_unique_id FROM life WHERE recency_days > 180) GROUP BY 1""", LINES),
    "z1_profile_tables": sql(" UNION ALL ".join(profile(t) for t in TABLES)),
    "z2_profile_columns": sql(" UNION ALL ".join(columns(t) for t in TABLES)),
    "z3_orphan_counts": sql(" UNION ALL ".join([
        orphan("items without order", "items", "orders", "order_id"), orphan("payments without order", "payments", "orders", "order_id"),
        orphan("orders without customer", "orders", "customers", "customer_id"), orphan("items without product", "items", "products", "product_id"),
        orphan("items without seller", "items", "sellers", "seller_id")])),
    "z4_duplicates": sql("""SELECT 'geolocation' AS dataset, count(*) AS rows, count(*) - any_value(n) AS duplicate_rows, any_value(n) AS rows_kept
      FROM b_geolocation, (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM b_geolocation))"""),
    "z5_missing_values": sql(" UNION ALL ".join([
        missing("products", "product_category_name", "keep, treat as unknown"),
        missing("orders", "order_delivered_customer_date", "keep, leave out of delivery measures"),
        missing("orders", "order_delivered_carrier_date", "keep, never reached the carrier"),
        missing("reviews", "review_comment_title", "keep, review without text"),
        missing("reviews", "review_comment_message", "keep, review without text")])),
    "z6_date_quarantine": sql("""SELECT order_id, order_status, CASE WHEN arrived < bought THEN 'delivered before purchase'
      WHEN handed < bought THEN 'shipped before purchase' ELSE 'delivered before shipped' END AS fault
      FROM o_all WHERE arrived < bought OR handed < bought OR arrived < handed"""),
    "z7_order_outliers": sql(f"""SELECT count(*) AS orders, {rnd('any_value(q1)', 4)} AS q1, {rnd('any_value(q2)', 4)} AS median, {rnd('any_value(q3)', 4)} AS q3,
      {rnd('any_value(q1 - (q3 - q1) * 1.5)', 4)} AS lower_fence, {rnd('any_value(q3 + (q3 - q1) * 1.5)', 4)} AS upper_fence,
      count(*) FILTER (v < q1 - (q3 - q1) * 1.5) AS low_outliers, count(*) FILTER (v > q3 + (q3 - q1) * 1.5) AS high_outliers, max(v) AS largest
      FROM v, (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM v)""",
      "v AS (SELECT order_total_value::DOUBLE AS v FROM o_done JOIN amount USING (order_id))"),
    "z8_schema_tests": sql(SCHEMA_TESTS, FACT_KEYS),
    "z9_freshness": sql(f"""SELECT newest, reference, {rnd('h')} AS lag_hours, if(h <= 24, 'fresh', 'stale') AS status FROM (
      SELECT max(bought) AS newest, max(approved) AS reference, (epoch_us(max(approved)) - epoch_us(max(bought)))::DOUBLE / 3.6e9 AS h FROM b_orders)"""),
    "s1_csv_scan": sql(f"SELECT order_id, customer_id, order_status, {WEEK} FROM b_orders"),
    "s2_stage_rescan": sql(" UNION ALL ".join(f"SELECT '{t}' AS dataset, count(*) AS rows FROM b_{t}" for t in TABLES)),
    "s4_metrics_document": sql(f"SELECT count(*) AS delivered_orders, count(DISTINCT customer_unique_id) AS customers FROM po"),
    "s2_lifecycle_from_stage": sql("SELECT * REPLACE (total_spent::DOUBLE AS total_spent) FROM life"),
    "s3_output_manifest": sql(" UNION ALL ".join(f"SELECT '{name}' AS dataset, count(*) AS rows FROM {source}" for name, source in {
        "clean_customers": "b_customers", "clean_orders": "o_all", "clean_items": "b_items", "clean_payments": "b_payments",
        "clean_reviews": "r", "clean_products": "b_products", "clean_sellers": "b_sellers", "clean_translation": "b_translation",
        "clean_geolocation": "(SELECT DISTINCT geolocation_zip_code_prefix, geolocation_state FROM b_geolocation)",
        "order_fact": "fact", "customer_summary": "summary", "customer_lifecycle": "life", "rfm_features": "rfm",
        "cohort_features": "cohort", "delivery_features": "delivery", "churn_features": "churn",
        "monthly_revenue": "(SELECT DISTINCT purchase_month FROM po JOIN i USING (order_id))"}.items())),
    "s6_mart_views": sql("""SELECT purchase_month, gmv, unique_customers, active_customers AS cohort_size,
      (SELECT count(DISTINCT customer_unique_id) FROM summary) AS all_customers FROM (
      SELECT purchase_month, sum(total_value)::DOUBLE AS gmv, count(DISTINCT customer_unique_id) AS unique_customers
      FROM po JOIN i USING (order_id) GROUP BY 1) LEFT JOIN (SELECT * FROM retention WHERE period_number = 0) ON cohort_month = purchase_month"""),
    "s5_star_tables": sql("""SELECT purchase_year AS year, customer_state, coalesce(product_category_name_english, b.product_category_name, 'unknown') AS category_name,
      count(*) AS items, sum(total_value)::DOUBLE AS value FROM po JOIN i USING (order_id) JOIN b_products b USING (product_id)
      LEFT JOIN b_translation t ON t.product_category_name = b.product_category_name GROUP BY 1, 2, 3"""),
    "s6_named_views": sql("SELECT order_status, count(*) AS orders FROM b_orders JOIN b_customers USING (customer_id) GROUP BY 1"),
    "s8_monthly_refresh": sql("SELECT purchase_month, count(*) AS rows, sum(total_value)::DOUBLE AS value FROM fact GROUP BY 1"),
    "s9_daily_landing": "SELECT year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, count(*) AS events FROM events GROUP BY ALL",
    "s5_bucketed_sales": sql("""SELECT * FROM (
      SELECT 'state' AS dimension, customer_state AS name, count(*) AS items, sum(total_value)::DOUBLE AS value
        FROM i JOIN o_done USING (order_id) JOIN (SELECT customer_unique_id, arg_max(customer_state, (bought, order_id)) AS customer_state
          FROM b_orders JOIN b_customers USING (customer_id) GROUP BY 1) ON customer_unique_id = (
            SELECT customer_unique_id FROM b_customers c WHERE c.customer_id = o_done.customer_id) GROUP BY ALL
      UNION ALL SELECT 'category_name', coalesce(product_category_name_english, p2.product_category_name, 'unknown'), count(*), sum(total_value)::DOUBLE
        FROM i JOIN o_done USING (order_id) JOIN b_products p2 USING (product_id)
          LEFT JOIN b_translation tr ON tr.product_category_name = p2.product_category_name GROUP BY ALL)"""),
    "s8_refreshed_months": sql("""SELECT purchase_month, count(*) AS orders, sum(order_total_value)::DOUBLE AS value
      FROM o_done JOIN amount USING (order_id) GROUP BY 1"""),
    "z8_checked_write": sql("""SELECT measure, counted, CASE WHEN measure = 'quarantined' THEN counted END AS stored, kept, true AS order_id_near_unique FROM (
      SELECT unnest([{measure: 'rows', counted: count(*)}, {measure: 'quarantined', counted: count(*) FILTER (a OR b OR c OR d OR e OR f)},
        {measure: 'order_id not null', counted: count(*) FILTER (a)}, {measure: 'order_purchase_timestamp not null', counted: count(*) FILTER (b)},
        {measure: 'order_delivered_customer_date not null', counted: count(*) FILTER (c)}, {measure: 'customer_id in customer_id', counted: count(*) FILTER (d)},
        {measure: 'delivered as promised', counted: count(*) FILTER (e)}, {measure: 'carrier within a week', counted: count(*) FILTER (f)}], recursive := true),
        count(*) FILTER (NOT (a OR b OR c OR d OR e OR f)) AS kept
      FROM (SELECT order_id IS NULL AS a, bought IS NULL AS b, arrived IS NULL AS c, k IS NULL AND x.customer_id IS NOT NULL AS d,
          coalesce(arrived > promised, false) AS e, coalesce(date_diff('day', bought, handed) > 7, false) AS f
        FROM b_orders x LEFT JOIN (SELECT DISTINCT customer_id AS k FROM b_customers) ON k = x.customer_id))"""),
    "a2_customers_by_state_check": sql("""SELECT customer_state, count(DISTINCT customer_unique_id) AS customers, true AS within
      FROM po JOIN amount USING (order_id) GROUP BY 1"""),
    "a2_customers_by_month_check": sql("""SELECT purchase_month, count(DISTINCT customer_unique_id) AS customers, true AS within
      FROM po JOIN amount USING (order_id) GROUP BY 1"""),
    "p12_order_value_check": sql("SELECT customer_state, count(*) AS orders, true AS within FROM po JOIN amount USING (order_id) GROUP BY 1"),
    "a1_place_rollup": sql("""SELECT customer_state, customer_city, CASE grouping(customer_state) + grouping(customer_city) WHEN 0 THEN 'city' WHEN 1 THEN 'state' ELSE 'all' END AS level,
      count(*) AS orders, count(DISTINCT customer_unique_id) AS customers, sum(order_total_value)::DOUBLE AS value
      FROM po JOIN amount USING (order_id) GROUP BY ROLLUP (customer_state, customer_city)"""),
    "a1_calendar_rollup": sql("""SELECT purchase_year, purchase_month, CASE grouping(purchase_year) + grouping(purchase_month) WHEN 0 THEN 'month' WHEN 1 THEN 'year' ELSE 'all' END AS level,
      count(*) AS orders, count(DISTINCT customer_unique_id) AS customers, sum(order_total_value)::DOUBLE AS value
      FROM po JOIN amount USING (order_id) GROUP BY ROLLUP (purchase_year, purchase_month)"""),
}
