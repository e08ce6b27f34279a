"""Exploratory metrics, customer analytics and model features."""

from oracles.base import avg, mean, pct, rnd, sql
from oracles.questions import share

DELIVERED_VALUE = "dv AS (SELECT * FROM po LEFT JOIN amount USING (order_id))"
BAND = "CASE WHEN {0} > -1 AND {0} <= 90 THEN '{1}' WHEN {0} > 90 AND {0} <= 180 THEN '{2}' WHEN {0} > 180 AND {0} <= 365 THEN '{3}' WHEN {0} > 365 THEN '{4}' END"
CHURN_BAND = BAND.format("recency_days", "Active", "Warm", "At Risk", "Dormant")
ORDER_REVIEW = "orv AS (SELECT order_id, sum(review_score)::DOUBLE / count(*) AS review_score FROM b_reviews GROUP BY 1)"
PERSON_REVIEW = f"""prv AS (SELECT customer_unique_id,
  {rnd('sum(review_score::DECIMAL(20,12))::DOUBLE / nullif(count(review_score), 0)', 6)} AS avg_review
  FROM po LEFT JOIN orv USING (order_id) GROUP BY 1)"""
DAY = "86400000000.0"
PAIRS = """pairs AS (SELECT a.c AS category_a, b.c AS category_b, count(*) AS co_occurrences
  FROM (SELECT DISTINCT order_id, category_english AS c FROM o_done JOIN i USING (order_id) JOIN p USING (product_id)) a
  JOIN (SELECT DISTINCT order_id, category_english AS c FROM o_done JOIN i USING (order_id) JOIN p USING (product_id)) b
  ON a.order_id = b.order_id AND a.c < b.c GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT {k})"""
PROFILE = """lines AS (SELECT order_id, price, freight_value, total_value, category_english, seller_state
  FROM i LEFT JOIN p USING (product_id) LEFT JOIN b_sellers USING (seller_id)),
cat_mode AS (SELECT order_id, category_english AS product_category_name_english FROM (
  SELECT order_id, category_english, row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, category_english) AS k
  FROM lines GROUP BY 1, 2) WHERE k = 1),
state_mode AS (SELECT order_id, seller_state FROM (
  SELECT order_id, seller_state, row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, seller_state) AS k
  FROM lines GROUP BY 1, 2) WHERE k = 1),
profile AS (SELECT order_id, sum(total_value)::DOUBLE AS first_order_value, count(*) AS first_order_item_count,
  sum(price)::DOUBLE / count(*) AS first_avg_item_price, sum(freight_value)::DOUBLE / count(*) AS first_avg_freight
  FROM lines GROUP BY order_id),
first_one AS (SELECT customer_unique_id, order_id, customer_state, bought, arrived, promised FROM po
  QUALIFY row_number() OVER (PARTITION BY customer_unique_id ORDER BY bought, order_id) = 1),
first_orders AS (SELECT * FROM first_one LEFT JOIN profile USING (order_id) LEFT JOIN cat_mode USING (order_id) LEFT JOIN state_mode USING (order_id)),
pay AS (SELECT order_id, arg_max(payment_type, (payment_value, payment_type)) AS payment_type,
  max(payment_installments) AS payment_installments FROM b_payments GROUP BY 1)"""
REPEAT = f"""joined AS (SELECT f.*, repeat_customer_flag, total_spent, review_score, payment_type, payment_installments
  FROM first_orders f LEFT JOIN life USING (customer_unique_id) LEFT JOIN orv USING (order_id) LEFT JOIN pay USING (order_id)),
repeat_rows AS (SELECT customer_unique_id, coalesce(first_order_value, 0) AS first_order_value, first_order_item_count, first_avg_item_price,
  first_avg_freight, (epoch_us(arrived) - epoch_us(bought))::DOUBLE / {DAY} AS first_delivery_days,
  (coalesce(arrived > promised, false))::INT AS first_late_flag,
  coalesce(review_score, (SELECT quantile_cont(review_score, 0.5) FROM joined)) AS review_score, payment_installments, customer_state,
  product_category_name_english, repeat_customer_flag, total_spent::DOUBLE AS total_spent
  FROM joined WHERE payment_type IS NOT NULL AND customer_state IS NOT NULL AND repeat_customer_flag IS NOT NULL)"""
RISK = """risk_rows AS (SELECT d.order_id, coalesce(f.order_total_value::DOUBLE, 0) AS order_total_value,
  coalesce(f.order_item_count, 0) AS order_item_count, coalesce(f.order_price::DOUBLE / f.order_item_count, 0) AS avg_item_price,
  coalesce(f.order_freight::DOUBLE / f.order_item_count, 0) AS avg_freight, coalesce(pay.payment_installments, 0) AS payment_installments,
  coalesce(x.first_order_value, 0) AS first_order_value, coalesce(x.first_order_item_count, 0) AS first_order_item_count,
  coalesce(pay.payment_type, 'unknown') AS payment_type, coalesce(d.customer_state, 'unknown') AS customer_state,
  coalesce(x.seller_state, 'unknown') AS seller_state, coalesce(x.product_category_name_english, 'unknown') AS product_category_name_english,
  d.is_late FROM po d LEFT JOIN amount f USING (order_id) LEFT JOIN pay USING (order_id) LEFT JOIN first_orders x ON x.customer_unique_id = d.customer_unique_id)"""
COHORT_MEANS = ", ".join(
    f"{rnd(f'(sum(retention_rate::DECIMAL(9,2)) FILTER (period_number = {m}))::DOUBLE / count(*) FILTER (period_number = 0)')} AS month_{m}_retention_avg"
    for m in (1, 3, 6)
)
GEO = f"""SELECT customer_state, count(DISTINCT order_id) AS orders, count(DISTINCT customer_unique_id) AS customers,
  sum(total_value)::DOUBLE AS revenue, {avg('floor_days')} AS avg_delivery_days, {mean('sum(is_late)', 'count(*)')} AS late_delivery_rate
  FROM po LEFT JOIN i USING (order_id) GROUP BY 1"""


def wide(periods: int, limit: str = "") -> str:
    cells = ", ".join(f"coalesce(max(retention_rate) FILTER (period_number = {k}), 0) AS period_{k}" for k in range(periods))
    return f"SELECT cohort_month, {cells} FROM retention GROUP BY 1 ORDER BY 1 {limit}"


# The matrix is as wide as the data's last period; a statement has a fixed width, that of the test data at sf 0.01.
COHORT_PERIODS = 79

ORACLES = {
    "e1_headline_metrics": sql(f"""SELECT min(bought) AS period_start, max(bought) AS period_end, count(*) AS orders,
      sum(is_delivered)::BIGINT AS delivered_orders, {pct('sum(is_delivered)', 'count(*)')} AS delivery_rate_pct,
      (SELECT count(DISTINCT customer_unique_id) FROM person) AS unique_customers,
      (SELECT sum(order_total_value)::DOUBLE FROM dv) AS gmv, (SELECT {avg('order_total_value')} FROM dv) AS aov,
      (SELECT {rnd('quantile_cont(order_total_value::DOUBLE, 0.5)', 4)} FROM dv) AS median_order_value,
      (SELECT {avg('review_score')} FROM b_reviews) AS avg_review_score,
      (SELECT {pct('sum(is_late)', 'count(*)')} FROM o_done) AS late_delivery_rate_pct,
      (SELECT {pct('count(*) FILTER (order_count = 1)', 'count(*)')} FROM life) AS single_order_customer_pct,
      (SELECT {pct('count(*) FILTER (order_count > 1)', 'count(*)')} FROM life) AS repeat_customer_pct FROM o_all""", DELIVERED_VALUE),
    "e2_top_states": sql("SELECT customer_state, count(*) AS customers FROM b_customers GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "e3_payment_shares": sql(f"SELECT *, {share('payments')} AS share_pct FROM (SELECT payment_type, count(*) AS payments FROM b_payments GROUP BY 1)"),
    "e4_monthly_series": sql("SELECT purchase_month, coalesce(sum(order_total_value), 0)::DOUBLE AS order_total_value FROM dv GROUP BY 1", DELIVERED_VALUE),
    "e5_state_revenue": sql(f"""SELECT *, (sum(revenue_pct::DECIMAL(9,2)) FILTER (place <= 5) OVER ())::DOUBLE AS leading_share_pct FROM (
      SELECT customer_state, revenue, {share('revenue')} AS revenue_pct, (row_number() OVER (ORDER BY revenue DESC, customer_state))::INT AS place
      FROM (SELECT customer_state, sum(order_total_value)::DOUBLE AS revenue FROM dv GROUP BY 1)) ORDER BY place LIMIT 10""", DELIVERED_VALUE),
    "e6_review_scores": sql("SELECT review_score, count(*) AS reviews FROM b_reviews GROUP BY 1"),
    "e7_top_seller_revenue": sql("SELECT seller_id, sum(total_value)::DOUBLE AS revenue FROM i JOIN o_done USING (order_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
    "e8_top_category_revenue": sql("""SELECT category_english, sum(total_value)::DOUBLE AS revenue FROM i JOIN o_done USING (order_id) JOIN p USING (product_id)
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""),
    "e9_cohort_matrix_12x8": sql(wide(8, "LIMIT 12")),
    "e10_recency_segments": sql(f"SELECT {BAND.format('recency_days', 'Recent', 'Warm', 'At Risk', 'Lost')} AS segment, count(*) AS customers FROM life GROUP BY 1"),
    "e11_late_and_repeat": sql(f"""SELECT (SELECT {pct('sum(is_late)', 'count(*)')} FROM o_done) AS late_delivery_rate_pct,
      {pct('count(*) FILTER (order_count = 1)', 'count(*)')} AS single_order_pct, {pct('count(*) FILTER (order_count <> 1)', 'count(*)')} AS repeat_pct FROM life"""),
    "g1_review_by_order": sql("SELECT * FROM orv", ORDER_REVIEW),
    "g1_customer_reviews": sql("SELECT * FROM prv", ORDER_REVIEW, PERSON_REVIEW),
    "g2_segment_profiles": sql(f"""SELECT *, CASE WHEN avg_orders >= 2 AND avg_spent >= 250 THEN 'High-Value Repeat' WHEN avg_recency <= 90 THEN 'Recent Active'
      WHEN churn_rate >= 0.8 THEN 'Dormant' ELSE 'Standard' END AS segment_name FROM (
      SELECT {CHURN_BAND} AS segment_id, count(*) AS customers, {avg('recency_days')} AS avg_recency, {avg('order_count')} AS avg_orders,
      {avg('total_spent')} AS avg_spent, {avg('avg_review::DECIMAL(24,8)')} AS avg_review, {avg('churn_flag_180d')} AS churn_rate
      FROM life LEFT JOIN prv USING (customer_unique_id) GROUP BY 1)""", ORDER_REVIEW, PERSON_REVIEW),
    "g3_cohort_matrix": sql("SELECT cohort_month, " + ", ".join(
        f"coalesce(max(retention_rate) FILTER (period_number = {k}), 0) AS period_{k}" for k in range(COHORT_PERIODS)
      ) + " FROM retention GROUP BY cohort_month"),
    "g3_cohort_averages": sql(f"SELECT count(*) FILTER (period_number = 0) AS cohorts, (max(period_number) + 1)::INT AS periods, {COHORT_MEANS} FROM retention"),
    "g4_clv_table": sql(f"""SELECT * EXCLUDE (q) REPLACE (total_spent::DOUBLE AS total_spent),
      order_count::DOUBLE / CASE WHEN tenure_days <> 0 THEN greatest(tenure_days, 1) END::DOUBLE * 30.0 AS avg_orders_per_month,
      CASE WHEN total_spent::DOUBLE <= q[1] THEN 'Low' WHEN total_spent::DOUBLE <= q[2] THEN 'Medium' WHEN total_spent::DOUBLE <= q[3] THEN 'High' ELSE 'Elite' END AS clv_band,
      {CHURN_BAND} AS churn_band FROM (SELECT *, (SELECT quantile_cont(total_spent::DOUBLE, [0.25, 0.5, 0.75]) FROM life) AS q FROM life)"""),
    "g5_category_pairs": sql("SELECT * FROM pairs", PAIRS.format(k=15)),
    "g6_geo_summary": sql(GEO),
    "g7_seller_summary": sql(f"""SELECT seller_id, count(DISTINCT order_id) AS orders, sum(total_value)::DOUBLE AS revenue, {avg('review_score')} AS avg_review,
      {avg('floor_days')} AS avg_delivery_days, {mean('sum(is_late)', 'count(*)')} AS late_delivery_rate
      FROM i JOIN o_done USING (order_id) LEFT JOIN (SELECT order_id, review_score FROM b_reviews) USING (order_id) GROUP BY 1"""),
    "g7_seller_summary_value_once": sql(f"""SELECT seller_id, count(DISTINCT order_id) AS orders, sum(total_value)::DOUBLE AS revenue,
      {mean('sum(s)', 'sum(n)')} AS avg_review, {avg('floor_days')} AS avg_delivery_days, {mean('sum(is_late)', 'count(*)')} AS late_delivery_rate
      FROM i JOIN o_done USING (order_id) LEFT JOIN (SELECT order_id, sum(review_score) AS s, count(*) AS n FROM b_reviews GROUP BY 1) USING (order_id) GROUP BY 1"""),
    "g8_product_summary": sql(f"""SELECT category_english, count(DISTINCT order_id) AS orders, count(*) AS items, sum(total_value)::DOUBLE AS revenue,
      {avg('price')} AS avg_price, {avg('freight_value')} AS avg_freight FROM i JOIN o_done USING (order_id) JOIN p USING (product_id) GROUP BY 1"""),
    "g9_delivery_summary": sql(f"""SELECT customer_state, count(*) AS deliveries,
      {rnd(f'sum(epoch_us(arrived) - epoch_us(bought))::DOUBLE / count(arrived) / {DAY}')} AS avg_delivery_days,
      {mean('sum(is_late)', 'count(*)')} AS late_delivery_rate FROM po GROUP BY 1"""),
    "g10_first_orders": sql("""SELECT customer_unique_id, order_id, customer_state, bought AS order_purchase_timestamp, arrived AS order_delivered_customer_date,
      promised AS order_estimated_delivery_date, first_order_value, first_order_item_count, first_avg_item_price, first_avg_freight,
      product_category_name_english, seller_state FROM first_orders""", PROFILE),
    "g11_repeat_features": sql("SELECT * FROM repeat_rows", ORDER_REVIEW, PROFILE, REPEAT),
    "g12_delivery_risk_features": sql("SELECT * FROM risk_rows", PROFILE, RISK),
    "g13_phase_summary": sql(f"""SELECT count(*) AS customers, {avg('total_spent')} AS avg_clv, {pct('sum(churn_flag_180d)', 'count(*)')} AS churn_rate_pct,
      count(*) FILTER (recency_days > 180 AND recency_days <= 365) AS at_risk_customers,
      (SELECT count(*) FILTER (period_number = 0) FROM retention) AS cohorts, (SELECT (max(period_number) + 1)::INT FROM retention) AS periods,
      (SELECT month_1_retention_avg FROM cm) AS month_1_retention_avg, (SELECT month_3_retention_avg FROM cm) AS month_3_retention_avg,
      (SELECT month_6_retention_avg FROM cm) AS month_6_retention_avg,
      {rnd('quantile_cont(total_spent::DOUBLE, 0.5)', 4)} AS median_clv, (SELECT {pct('sum(is_late)', 'count(*)')} FROM o_done) AS late_delivery_rate_pct,
      (SELECT max(co_occurrences) FROM pairs) AS top_pair_orders FROM life""", f"cm AS (SELECT {COHORT_MEANS} FROM retention)", PAIRS.format(k=10)),
    "g13_phase_lists": sql(f"""SELECT 'segment' AS list, {CHURN_BAND} AS name, count(*) AS value FROM life GROUP BY ALL
      UNION ALL SELECT 'pair', category_a || ' + ' || category_b, co_occurrences FROM pairs""", PAIRS.format(k=10)),
    "g14_peak_month": sql(f"""SELECT purchase_month, v::DOUBLE AS gmv, {rnd('m')} AS year_monthly_mean, {pct('v::DOUBLE - m', 'm')} AS uplift_pct FROM (
      SELECT *, (sum(v) OVER w)::DOUBLE / count(*) OVER w AS m FROM (
        SELECT purchase_year, purchase_month, coalesce(sum(order_total_value), 0) AS v FROM dv GROUP BY 1, 2) WINDOW w AS (PARTITION BY purchase_year))
      ORDER BY v DESC, 1 LIMIT 1""", DELIVERED_VALUE),
    "g15_top_decile_customers": sql("""SELECT customer_unique_id, total_spent::DOUBLE AS total_spent, order_count FROM life
      WHERE total_spent::DOUBLE >= (SELECT quantile_cont(total_spent::DOUBLE, 0.9) FROM life)"""),
    "g16_preferred_sellers": sql(f"""SELECT seller_id, gmv::DOUBLE AS gmv, {rnd('late', 4)} AS late_delivery_rate, {rnd('review', 4)} AS avg_review,
      (coalesce(late < 0.03 OR review > 4.2, false))::INT AS is_qualified FROM (
      SELECT *, rank() OVER (ORDER BY gmv DESC) AS k, count(*) OVER () AS n FROM (
        SELECT seller_id, sum(v) AS gmv, sum(is_late)::DOUBLE / count(*) AS late, sum(s)::DOUBLE / sum(c)::DOUBLE AS review
        FROM (SELECT order_id, seller_id, sum(total_value) AS v FROM i GROUP BY 1, 2) JOIN o_done USING (order_id)
        LEFT JOIN (SELECT order_id, sum(review_score) AS s, count(*) AS c FROM r GROUP BY 1) USING (order_id) GROUP BY 1))
      WHERE k <= greatest(1, round(n * 0.01))"""),
    "g17_winback_audience": sql("""SELECT customer_unique_id, last_order_date, recency_days, total_spent::DOUBLE AS total_spent
      FROM life WHERE recency_days > 90 AND recency_days <= 180"""),
}
