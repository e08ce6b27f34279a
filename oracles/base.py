"""Shared CTEs: the nine base relations over the given tables, then cleaned forms."""

BASE = """
line_span AS (
  SELECT l_orderkey, max(l_shipdate) AS last_ship, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_orderkey
),
b_customers AS (
  SELECT o_orderkey::VARCHAR AS customer_id, o_custkey::VARCHAR AS customer_unique_id,
         (c_nationkey * 37)::VARCHAR AS customer_zip_code_prefix, c_mktsegment AS customer_city, n_name AS customer_state
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
b_orders AS (
  SELECT o_orderkey::VARCHAR AS order_id, o_orderkey::VARCHAR AS customer_id,
         CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' WHEN 'P' THEN 'canceled' END AS order_status,
         o_orderdate AS bought, o_orderdate + to_days((o_orderkey % 3)::INT) AS approved,
         first_ship AS handed, last_ship AS arrived,
         o_orderdate + to_days(CASE left(o_orderpriority, 1) WHEN '1' THEN 600 WHEN '2' THEN 900 WHEN '3' THEN 1200
                               WHEN '4' THEN 1500 WHEN '5' THEN 1800 END) AS promised
  FROM orders LEFT JOIN line_span ON l_orderkey = o_orderkey
),
b_items AS (
  SELECT l_orderkey::VARCHAR AS order_id, l_linenumber AS order_item_id, l_partkey::VARCHAR AS product_id,
         l_suppkey::VARCHAR AS seller_id, l_shipdate AS shipping_limit_date,
         round(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)), 2)::DECIMAL(18,2) AS price,
         round(l_extendedprice::DECIMAL(12,2) * l_tax::DECIMAL(4,2), 2)::DECIMAL(18,2) AS freight_value
  FROM lineitem
),
b_payments AS (
  SELECT o_orderkey::VARCHAR AS order_id,
         CASE left(o_orderpriority, 1) WHEN '3' THEN 'boleto' WHEN '4' THEN 'voucher' WHEN '5' THEN 'debit_card'
              ELSE 'credit_card' END AS payment_type,
         (1 + o_orderkey % 10)::INT AS payment_installments, o_totalprice::DECIMAL(18,2) AS payment_value
  FROM orders
  UNION ALL
  SELECT o_orderkey::VARCHAR, 'voucher', 1, 10.00::DECIMAL(18,2) FROM orders WHERE o_orderkey % 17 = 0
),
review_rows AS (
  SELECT o_orderkey, 1 AS no, (1 + o_orderkey % 5)::INT AS score FROM orders WHERE o_orderkey % 11 <> 3
  UNION ALL
  SELECT o_orderkey, 2, (1 + (o_orderkey // 5) % 5)::INT FROM orders WHERE o_orderkey % 53 = 0
),
b_reviews AS (
  SELECT o_orderkey::VARCHAR || '-' || no AS review_id, o_orderkey::VARCHAR AS order_id, score AS review_score,
         CASE WHEN o_orderkey % 3 = 0 THEN 'title' END AS review_comment_title,
         CASE WHEN o_orderkey % 2 <> 0 THEN 'message' END AS review_comment_message,
         last_ship + to_days((o_orderkey % 15)::INT) AS review_creation_date,
         last_ship + to_days((o_orderkey % 15)::INT) + to_days(1) AS review_answer_timestamp
  FROM review_rows LEFT JOIN line_span ON l_orderkey = o_orderkey
),
b_products AS (
  SELECT p_partkey::VARCHAR AS product_id, CASE WHEN p_partkey % 50 <> 0 THEN lower(p_type) END AS product_category_name,
         p_size AS product_name_lenght, p_size AS product_description_lenght, p_size AS product_photos_qty,
         p_size * 100 AS product_weight_g, p_size AS product_length_cm, p_size AS product_height_cm, p_size AS product_width_cm
  FROM part
),
b_translation AS (
  SELECT DISTINCT lower(p_type) AS product_category_name, 'type_' || lower(p_type) AS product_category_name_english
  FROM part WHERE lower(p_type) <> 'promo'
),
b_sellers AS (
  SELECT s_suppkey::VARCHAR AS seller_id, (s_nationkey * 37)::VARCHAR AS seller_zip_code_prefix,
         '  ' || upper(n_name) || ' ' AS seller_city, n_name AS seller_state
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
b_geolocation AS (
  SELECT regexp_extract(p_brand, '(\\d+)', 1) AS geolocation_zip_code_prefix, p_retailprice / 100 AS geolocation_lat,
         p_size::DOUBLE AS geolocation_lng,
         CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN '  ' || replace(p_name, ' ', '  ') || ' ' ELSE p_name END AS geolocation_city,
         left(p_type, 2) AS geolocation_state
  FROM part
),
person AS (SELECT customer_id, customer_unique_id, upper(trim(customer_state)) AS customer_state,
                  lower(trim(customer_city)) AS customer_city FROM b_customers),
o_all AS (
  SELECT *, (order_status = 'delivered')::INT AS is_delivered, date_trunc('month', bought)::DATE AS purchase_month,
         year(bought)::INT AS purchase_year, (coalesce(arrived > promised, false))::INT AS is_late,
         (coalesce(arrived <= promised, false))::INT AS is_on_time,
         date_part('day', arrived - bought)::INT AS delivery_days,
         floor((epoch_us(arrived) - epoch_us(bought)) / 86400000000)::INT AS floor_days
  FROM b_orders WHERE bought IS NOT NULL
),
o_done AS (SELECT * FROM o_all WHERE is_delivered = 1),
i AS (SELECT *, price + freight_value AS total_value FROM b_items),
p AS (
  SELECT product_id, coalesce(b.product_category_name, 'unknown') AS product_category_name,
         coalesce(product_category_name_english, 'unknown') AS category_english
  FROM b_products b LEFT JOIN b_translation USING (product_category_name)
),
r AS (SELECT *, (review_score <= 2)::INT AS is_detractor, (review_score >= 4)::INT AS is_promoter
      FROM b_reviews WHERE review_score BETWEEN 1 AND 5),
amount AS (
  SELECT order_id, count(*) AS order_item_count, sum(price) AS order_price, sum(freight_value) AS order_freight,
         sum(total_value) AS order_total_value FROM i GROUP BY order_id
),
po AS (SELECT * FROM o_done JOIN person USING (customer_id)),
fact AS (
  SELECT order_id, order_item_id, order_status, bought, purchase_month, purchase_year, is_delivered, customer_unique_id,
         customer_state, customer_city, product_id, product_category_name, category_english, seller_id, seller_state,
         price, freight_value, total_value, review_score, is_detractor, is_promoter, is_late, delivery_days
  FROM i JOIN po USING (order_id) JOIN p USING (product_id) JOIN b_sellers USING (seller_id)
         LEFT JOIN (SELECT order_id, review_score, is_detractor, is_promoter FROM r) USING (order_id)
),
summary AS (
  SELECT customer_unique_id, customer_state, customer_city, count(DISTINCT order_id) AS total_orders,
         min(bought) AS first_order_date, max(bought) AS last_order_date, sum(order_total_value) AS lifetime_value,
         sum(order_total_value)::DOUBLE / count(*) AS avg_order_value,
         sum(review_score)::DOUBLE / nullif(count(review_score), 0) AS avg_review_score
  FROM po JOIN amount USING (order_id) LEFT JOIN r USING (order_id)
  GROUP BY ALL
),
life AS (
  SELECT *, date_diff('day', first_order_date, last_order_date)::INT AS tenure_days, (order_count > 1)::INT AS repeat_customer_flag,
         (recency_days > 180)::INT AS churn_flag_180d
  FROM (
    SELECT customer_unique_id, min(bought) AS first_order_date, max(bought) AS last_order_date, count(*) AS order_count,
           coalesce(sum(order_total_value), 0) AS total_spent,
           sum(order_total_value)::DOUBLE / nullif(count(order_total_value), 0) AS avg_order_value,
           sum(floor_days)::DOUBLE / nullif(count(floor_days), 0) AS avg_delivery_days,
           sum(is_late)::DOUBLE / count(*) AS late_delivery_rate,
           arg_min(customer_state, order_id) AS state, arg_min(customer_city, order_id) AS city,
           floor((epoch_us((SELECT max(bought) FROM o_all)) + 86400000000 - epoch_us(max(bought))) / 86400000000)::INT AS recency_days
    FROM po LEFT JOIN amount USING (order_id) GROUP BY customer_unique_id
  )
),
rfm AS (
  SELECT *, ntile(5) OVER (ORDER BY recency_days, customer_unique_id)::INT AS recency_quintile,
         ntile(5) OVER (ORDER BY frequency DESC, customer_unique_id)::INT AS frequency_quintile,
         ntile(5) OVER (ORDER BY monetary DESC, customer_unique_id)::INT AS monetary_quintile
  FROM (
    SELECT customer_unique_id,
           date_part('day', (SELECT max(bought) FROM o_done) + INTERVAL 1 DAY - max(bought))::INT AS recency_days,
           count(DISTINCT order_id) AS frequency, sum(total_value) AS monetary
    FROM po JOIN i USING (order_id) GROUP BY customer_unique_id
  )
),
churn AS (
  SELECT *, (days_since_last_order > 180)::INT AS is_churned FROM (
    SELECT customer_unique_id, max(bought) AS last_order_date, count(DISTINCT order_id) AS total_orders,
           sum(total_value) AS total_spent, sum(review_score)::DOUBLE / nullif(count(review_score), 0) AS avg_review_score,
           date_part('day', (SELECT max(bought) FROM o_all) + INTERVAL 1 DAY - max(bought))::INT AS days_since_last_order
    FROM po JOIN i USING (order_id) LEFT JOIN r USING (order_id) GROUP BY customer_unique_id
  )
),
cohort AS (
  SELECT customer_unique_id, cohort_month, purchase_month AS order_month,
         ((year(purchase_month) * 12 + month(purchase_month)) - (year(cohort_month) * 12 + month(cohort_month)))::INT AS period_number
  FROM po JOIN (SELECT customer_unique_id, min(purchase_month) AS cohort_month FROM po GROUP BY 1) USING (customer_unique_id)
),
retention AS (
  SELECT cohort_month, period_number, count(DISTINCT customer_unique_id) AS active_customers, any_value(n) AS cohort_size,
         {ret} AS retention_rate
  FROM cohort JOIN (SELECT cohort_month, count(DISTINCT customer_unique_id) AS n FROM cohort WHERE period_number = 0 GROUP BY 1)
       USING (cohort_month)
  GROUP BY cohort_month, period_number
),
delivery AS (
  SELECT order_id, customer_unique_id, customer_state, purchase_month, delivery_days,
         date_part('day', handed - approved)::INT AS carrier_handoff_days, date_part('day', arrived - handed)::INT AS transit_days,
         date_part('day', promised - bought)::INT AS promised_days, is_on_time, is_late
  FROM po WHERE arrived IS NOT NULL
)"""


def rnd(expr: str, digits: int = 2) -> str:
    """Half away from zero on DOUBLE."""
    x, s = f"(({expr})::DOUBLE)", f"1e{digits}"
    return f"(sign{x} * floor(abs{x} * {s} + 0.5) / {s})"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return rnd(f"({part})::DOUBLE * 100.0 / nullif(({whole})::DOUBLE, 0)", digits)


def mean(total: str, n: str, digits: int = 2) -> str:
    return rnd(f"({total})::DOUBLE / nullif(({n})::DOUBLE, 0)", digits)


def avg(column: str, digits: int = 2) -> str:
    return mean(f"sum({column})", f"count({column})", digits)


RFM_CASE = """CASE WHEN {r} >= 4 AND {f} >= 4 AND {m} >= 4 THEN 'Champions' WHEN {r} >= 3 AND {f} >= 3 THEN 'Loyal Customers'
  WHEN {r} >= 4 AND {f} <= 2 THEN 'Recent Customers' WHEN {r} <= 2 AND {f} >= 4 THEN 'At Risk'
  WHEN {r} <= 2 AND {f} <= 2 THEN 'Lost' ELSE 'Potential Loyalists' END"""

_BASE = BASE.replace("{ret}", pct("count(DISTINCT customer_unique_id)", "any_value(n)"))


def sql(body: str, *ctes: str) -> str:
    """The shared CTEs, any extra ones, then the statement."""
    return "WITH " + ",\n".join([_BASE, *ctes]) + "\n" + body
