"""Cleaning, marts, star schema."""

from oracles.base import RFM_CASE, mean, pct, rnd, sql

ZIP = "CASE WHEN length({0}) < 5 THEN lpad({0}, 5, '0') ELSE {0} END"
KEY = "('0x' || substr(md5({0}), 1, 15))::BIGINT"
SPACES = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
LABEL = RFM_CASE.format(r="recency_quintile", f="frequency_quintile", m="monetary_quintile")

FACT_COLUMNS = """order_id, order_item_id, order_status, bought AS order_purchase_timestamp, purchase_month, purchase_year,
  is_delivered, customer_unique_id, customer_state, customer_city, product_id, product_category_name, category_english,
  seller_id, seller_state, price::DOUBLE AS price, freight_value::DOUBLE AS freight_value, total_value::DOUBLE AS total_value"""

CALENDAR = """SELECT strftime(d, '%Y%m%d')::INT AS date_key, d AS date, year(d)::INT AS year, month(d)::INT AS month,
  strftime(d, '%B') AS month_name, day(d)::INT AS day, (dayofweek(d) + 1)::INT AS day_of_week, 'Q' || quarter(d) AS quarter,
  strftime(d, '%b %Y') AS month_year, strftime(d, '%Y-%m') AS year_month, (year(d) * 100 + month(d))::INT AS month_year_sort
FROM days"""

FACT_SALES = f"""SELECT {KEY.format('customer_unique_id')} AS customer_key, {KEY.format('product_id')} AS product_key,
  {KEY.format('seller_id')} AS seller_key, strftime(bought, '%Y%m%d')::INT AS date_key, order_id, order_item_id,
  price::DOUBLE AS item_price, freight_value::DOUBLE AS freight_cost, total_value::DOUBLE AS total_item_value,
  date_diff('day', bought, arrived)::INT AS delivery_days, is_late, review_score
FROM po JOIN i USING (order_id) LEFT JOIN (SELECT order_id, sum(review_score)::DOUBLE / count(*) AS review_score
  FROM b_reviews GROUP BY 1) USING (order_id)"""

ORACLES = {
    "m1_clean_customers": sql(f"""SELECT customer_id, customer_unique_id, {ZIP.format('customer_zip_code_prefix')} AS customer_zip_code_prefix,
      lower(trim(customer_city)) AS customer_city, upper(trim(customer_state)) AS customer_state,
      {SPACES.format('customer_city')} AS customer_city_clean FROM b_customers"""),
    "m2_clean_orders": sql("""SELECT order_id, customer_id, order_status, bought AS order_purchase_timestamp, approved AS order_approved_at,
      handed AS order_delivered_carrier_date, arrived AS order_delivered_customer_date, promised AS order_estimated_delivery_date,
      is_delivered, purchase_month, purchase_year FROM o_all"""),
    "m3_enrich_orders": sql("""SELECT order_id, customer_id, order_status, bought AS order_purchase_timestamp, approved AS order_approved_at,
      handed AS order_delivered_carrier_date, arrived AS order_delivered_customer_date, promised AS order_estimated_delivery_date,
      strftime(bought, '%Y-%m') AS order_purchase_month, purchase_year AS order_purchase_year, dayname(bought) AS order_purchase_weekday,
      is_delivered AS delivered_flag, is_late AS late_delivery_flag, floor_days AS delivery_days,
      (epoch_us(approved) - epoch_us(bought))::DOUBLE / 86400000000.0 AS approval_days,
      (epoch_us(handed) - epoch_us(approved))::DOUBLE / 86400000000.0 AS carrier_days FROM o_all"""),
    "m4_clean_items": sql("""SELECT order_id, order_item_id, product_id, seller_id, shipping_limit_date, price::DOUBLE AS price,
      freight_value::DOUBLE AS freight_value, total_value::DOUBLE AS total_value,
      price::DOUBLE / nullif(freight_value::DOUBLE, 0) AS price_per_freight_ratio FROM i"""),
    "m5_clean_products": sql("""SELECT p.product_id, p.product_category_name, category_english, product_name_lenght,
      product_description_lenght, product_photos_qty, product_weight_g, product_length_cm, product_height_cm, product_width_cm,
      (b.product_category_name IS NOT NULL)::INT AS has_category, product_weight_g / 1000.0::DOUBLE AS product_weight_kg
      FROM p JOIN b_products b ON b.product_id = p.product_id"""),
    "m6_clean_reviews": sql("""SELECT review_id, order_id, review_score, review_comment_title, review_comment_message,
      review_creation_date, review_answer_timestamp, is_detractor, is_promoter,
      (review_comment_title IS NOT NULL OR review_comment_message IS NOT NULL)::INT AS has_review_text FROM r"""),
    "m7_clean_geolocation": sql(f"""SELECT z AS geolocation_zip_code_prefix, s AS geolocation_state,
      sum(lat * n)::DOUBLE / sum(n) AS geolocation_lat, sum(lng * n)::DOUBLE / sum(n) AS geolocation_lng,
      (SELECT c FROM cities x WHERE x.z = y.z AND x.s = y.s ORDER BY k DESC, c LIMIT 1) AS geolocation_city_clean
      FROM points y GROUP BY z, s""",
      f"""pl AS (SELECT {ZIP.format('geolocation_zip_code_prefix')} AS z, upper(geolocation_state) AS s, geolocation_lat::DECIMAL(18,8) AS lat,
      geolocation_lng::DECIMAL(18,8) AS lng, {SPACES.format('geolocation_city')} AS c FROM b_geolocation),
      points AS (SELECT z, s, lat, lng, 1 AS n FROM pl), cities AS (SELECT z, s, c, count(*) AS k FROM pl GROUP BY ALL)"""),
    "m8_clean_sellers": sql(f"""SELECT seller_id, {ZIP.format('seller_zip_code_prefix')} AS seller_zip_code_prefix, seller_city,
      upper(seller_state) AS seller_state, {SPACES.format('seller_city')} AS seller_city_clean FROM b_sellers"""),
    "m9_clean_payments": sql("SELECT order_id, lower(payment_type) AS payment_type, payment_installments, payment_value::DOUBLE AS payment_value FROM b_payments"),
    "m10_order_fact": sql(f"SELECT {FACT_COLUMNS}, review_score, is_detractor, is_promoter, is_late AS is_late_delivery, delivery_days FROM fact"),
    "m10_order_fact_one_row_per_item": sql(f"""SELECT {FACT_COLUMNS}, score AS review_score, is_late AS is_late_delivery, delivery_days
      FROM i JOIN po USING (order_id) JOIN p USING (product_id) JOIN b_sellers USING (seller_id)
      LEFT JOIN (SELECT order_id, sum(review_score)::DOUBLE / count(*) AS score FROM r GROUP BY 1) USING (order_id)"""),
    "m11_order_totals": sql("""SELECT order_id, order_item_count, order_price::DOUBLE AS order_price, order_freight::DOUBLE AS order_freight,
      order_total_value::DOUBLE AS order_total_value FROM amount"""),
    "m12_customer_summary": sql("SELECT * REPLACE (lifetime_value::DOUBLE AS lifetime_value) FROM summary"),
    "m12_customer_summary_per_person": sql("""SELECT customer_unique_id, arg_max(customer_state, (bought, order_id)) AS customer_state,
      arg_max(customer_city, (bought, order_id)) AS customer_city, count(*) AS total_orders, min(bought) AS first_order_date,
      max(bought) AS last_order_date, sum(order_total_value)::DOUBLE AS lifetime_value,
      sum(order_total_value)::DOUBLE / count(*) AS avg_order_value, sum(s)::DOUBLE / nullif(sum(n)::DOUBLE, 0) AS avg_review_score
      FROM po JOIN amount USING (order_id) LEFT JOIN (SELECT order_id, sum(review_score) AS s, count(*) AS n FROM r GROUP BY 1) USING (order_id)
      GROUP BY customer_unique_id"""),
    "m13_customer_lifecycle": sql("SELECT * REPLACE (total_spent::DOUBLE AS total_spent) FROM life"),
    "m14_cleaning_audit": sql("""SELECT 'customers_rows' AS measure, count(*)::DOUBLE AS value FROM b_customers
      UNION ALL SELECT 'orders_rows', count(*) FROM o_all UNION ALL SELECT 'items_rows', count(*) FROM b_items
      UNION ALL SELECT 'payments_rows', count(*) FROM b_payments UNION ALL SELECT 'reviews_rows', count(*) FROM b_reviews
      UNION ALL SELECT 'products_rows', count(*) FROM b_products UNION ALL SELECT 'sellers_rows', count(*) FROM b_sellers
      UNION ALL SELECT 'geolocation_rows', count(*) FROM (SELECT DISTINCT geolocation_zip_code_prefix, geolocation_state FROM b_geolocation)
      UNION ALL SELECT 'customer_features_rows', count(*) FROM life UNION ALL SELECT 'delivered_orders', count(*) FROM o_done
      UNION ALL SELECT 'late_delivery_rate', """ + pct("sum(is_late)", "count(*)") + " FROM o_done"),
    "m20_rfm_features": sql("SELECT * REPLACE (monetary::DOUBLE AS monetary) FROM rfm"),
    "m20_rfm_features_higher_is_better": sql("""SELECT customer_unique_id, recency_days, frequency, monetary::DOUBLE AS monetary,
      ntile(5) OVER (ORDER BY recency_days DESC, customer_unique_id)::INT AS recency_quintile,
      ntile(5) OVER (ORDER BY frequency, customer_unique_id)::INT AS frequency_quintile,
      ntile(5) OVER (ORDER BY monetary, customer_unique_id)::INT AS monetary_quintile FROM rfm"""),
    "m21_rfm_segments": sql(f"SELECT * REPLACE (monetary::DOUBLE AS monetary), {LABEL} AS rfm_segment FROM rfm"),
    "m22_cohort_features": sql("SELECT * FROM cohort"),
    "m23_delivery_features": sql("""SELECT order_id, customer_unique_id, delivery_days, carrier_handoff_days, transit_days, promised_days,
      is_on_time, is_late FROM delivery"""),
    "m24_churn_features": sql("SELECT * REPLACE (total_spent::DOUBLE AS total_spent) FROM churn"),
    "m25_payment_features": sql("""SELECT order_id, max((payment_type = 'credit_card')::INT) AS used_credit_card,
      max((payment_type = 'boleto')::INT) AS used_boleto, max(payment_installments) AS max_installments,
      sum(payment_value)::DOUBLE AS total_payment_value FROM b_payments GROUP BY order_id"""),
    "m26_kpi_snapshot": sql(f"""SELECT (SELECT count(*) FROM o_done) AS delivered_orders,
      (SELECT count(DISTINCT customer_unique_id) FROM summary) AS unique_customers,
      (SELECT sum(total_value)::DOUBLE FROM i JOIN o_done USING (order_id)) AS total_gmv,
      (SELECT {mean('sum(order_total_value)', 'count(*)')} FROM amount JOIN o_done USING (order_id)) AS avg_order_value,
      (SELECT {mean('sum(review_score)', 'count(*)')} FROM r) AS avg_review_score,
      (SELECT {pct('sum(is_late)', 'count(*)')} FROM delivery) AS late_delivery_pct,
      (SELECT {pct('sum(is_churned)', 'count(*)')} FROM churn) AS churn_rate_pct"""),
    "m27_monthly_revenue": sql("""SELECT purchase_month, purchase_year, count(DISTINCT order_id) AS order_count,
      count(DISTINCT customer_unique_id) AS unique_customers, sum(price)::DOUBLE AS product_revenue,
      sum(freight_value)::DOUBLE AS freight_revenue, sum(total_value)::DOUBLE AS gmv
      FROM po JOIN i USING (order_id) GROUP BY purchase_month, purchase_year"""),
    "m28_cohort_retention": sql("SELECT * FROM retention"),
    "d1_staged_items": sql("""SELECT order_id, order_item_id, product_id, seller_id, price::DOUBLE AS price, freight_value::DOUBLE AS freight_value,
      total_value::DOUBLE AS item_total_value FROM i"""),
    "d2_dim_customer": sql(f"""SELECT DISTINCT {KEY.format('customer_unique_id')} AS customer_key, customer_unique_id AS customer_id,
      customer_city AS city, customer_state AS state FROM b_customers"""),
    "d2_dim_customer_one_row_per_person": sql(f"""SELECT {KEY.format('customer_unique_id')} AS customer_key, customer_unique_id AS customer_id,
      arg_max(c.customer_city, (bought, order_id)) AS city, arg_max(c.customer_state, (bought, order_id)) AS state
      FROM b_customers c JOIN b_orders USING (customer_id) GROUP BY customer_unique_id"""),
    "d3_dim_product": sql(f"""SELECT {KEY.format('product_id')} AS product_key, product_id,
      coalesce(product_category_name_english, b.product_category_name, 'unknown') AS category_name,
      product_weight_g / 1000.0::DOUBLE AS weight_kg
      FROM b_products b LEFT JOIN b_translation t ON b.product_category_name = t.product_category_name"""),
    "d4_dim_seller": sql(f"SELECT {KEY.format('seller_id')} AS seller_key, seller_id, seller_city AS city, seller_state AS state FROM b_sellers"),
    "d5_dim_date": sql(CALENDAR, """days AS (SELECT unnest(generate_series(min(bought)::DATE, max(bought)::DATE, INTERVAL 1 DAY))::DATE AS d FROM b_orders)"""),
    "d6_fact_sales": sql(FACT_SALES),
    "d7_mart_customer_segmentation": sql(f"SELECT * REPLACE (monetary::DOUBLE AS monetary), {LABEL} AS rfm_segment FROM rfm"),
}
ORACLES["d7_mart_monthly_revenue"] = ORACLES["m27_monthly_revenue"]
