"""The two sets of business questions."""

from oracles.base import RFM_CASE, avg, mean, pct, rnd, sql

LABEL = RFM_CASE.format(r="recency_quintile", f="frequency_quintile", m="monetary_quintile")
SCORE_LABEL = RFM_CASE.format(r="recency_score", f="frequency_score", m="monetary_score")
DAY = "86400000000.0"


def share(column: str, of: str | None = None) -> str:
    return pct(column, of or f"sum({column}) OVER ()")


WEIGHTED = "fl AS (SELECT bought, purchase_month, purchase_year, order_id, total_value, order_total_value FROM o_done JOIN i USING (order_id) JOIN amount USING (order_id))"
CAT_ORDERS = "co AS (SELECT order_id, purchase_month, category_english, total_value FROM o_done JOIN i USING (order_id) JOIN p USING (product_id))"
SPAN = "(epoch_us(arrived) - epoch_us(bought))"
LIFE_VALUE = f"""lv AS (SELECT customer_unique_id, any_value(customer_state) AS customer_state, count(DISTINCT order_id) AS order_count,
  sum(total_value) AS lifetime_value, epoch_us((SELECT max(bought) FROM o_all)) + 86400000000 - epoch_us(max(bought)) AS us
  FROM po JOIN i USING (order_id) GROUP BY customer_unique_id{{extra}})"""

ORACLES = {
    "q1_monthly_gmv": sql(f"""SELECT purchase_month, count(DISTINCT order_id) AS order_count, sum(total_value)::DOUBLE AS gmv,
      {mean('sum(order_total_value)', 'count(*)')} AS avg_order_value FROM fl GROUP BY purchase_month""", WEIGHTED),
    "q2_repeat_share": sql(f"""SELECT kind AS customer_type, n AS customer_count, {share('n')} AS pct_of_customers FROM (
      SELECT if(total_orders = 1, 'Single Order', 'Repeat Customer') AS kind, count(*) AS n FROM summary GROUP BY 1)"""),
    "q3_revenue_by_state": sql(f"""SELECT *, {share('revenue')} AS revenue_pct FROM (
      SELECT customer_state, count(DISTINCT customer_unique_id) AS customers, count(DISTINCT order_id) AS orders,
      sum(total_value)::DOUBLE AS revenue FROM fact GROUP BY 1)"""),
    "q4_top_categories": sql(f"""SELECT category_english, count(DISTINCT order_id) AS orders, count(DISTINCT product_id) AS products,
      sum(total_value)::DOUBLE AS revenue, {avg('price')} AS avg_item_price FROM fact GROUP BY 1 ORDER BY revenue DESC, 1 LIMIT 10"""),
    "q5_on_time_by_state": sql(f"""SELECT c.customer_state, count(*) AS total_deliveries, sum(is_on_time)::BIGINT AS on_time_count,
      {pct('sum(is_on_time)', 'count(*)')} AS on_time_pct, {mean('sum(delivery_days)', 'count(*)', 1)} AS avg_delivery_days
      FROM delivery d JOIN person c ON d.customer_unique_id = c.customer_unique_id GROUP BY 1 HAVING count(*) >= 100"""),
    "q5_on_time_by_state_each_delivery_once": sql(f"""SELECT customer_state, count(*) AS total_deliveries, sum(is_on_time)::BIGINT AS on_time_count,
      {pct('sum(is_on_time)', 'count(*)')} AS on_time_pct, {mean('sum(delivery_days)', 'count(*)', 1)} AS avg_delivery_days
      FROM delivery GROUP BY 1 HAVING count(*) >= 100"""),
    "q6_reviews_by_lateness": sql(f"""SELECT if(is_late = 1, 'Late', 'On Time') AS delivery_status, count(*) AS review_count,
      {avg('review_score')} AS avg_review_score, sum(is_detractor)::BIGINT AS detractor_count,
      {pct('sum(is_detractor)', 'count(*)')} AS detractor_pct FROM r JOIN delivery USING (order_id) GROUP BY 1"""),
    "q7_rfm_distribution": sql(f"""SELECT *, {share('customer_count')} AS customer_pct, {share('segment_revenue')} AS revenue_pct FROM (
      SELECT {LABEL} AS rfm_segment, count(*) AS customer_count, sum(monetary)::DOUBLE AS segment_revenue,
      {avg('frequency')} AS avg_frequency, {avg('monetary')} AS avg_monetary FROM rfm GROUP BY 1)"""),
    "q8_cohort_matrix": sql("SELECT cohort_month, period_number, active_customers, cohort_size, retention_rate AS retention_pct FROM retention"),
    "q9_clv_by_state": sql(f"""SELECT customer_state, count(*) AS customers, {avg('lifetime_value')} AS avg_clv,
      {rnd('quantile_cont(lifetime_value::DOUBLE, 0.5)', 4)} AS median_clv, max(lifetime_value)::DOUBLE AS max_clv
      FROM summary GROUP BY 1 HAVING count(*) >= 200"""),
    "q9_clv_by_state_from_50_customers": sql(f"""SELECT customer_state, count(*) AS customers, {avg('lifetime_value')} AS avg_clv,
      {rnd('quantile_cont(lifetime_value::DOUBLE, 0.5)', 4)} AS median_clv, max(lifetime_value)::DOUBLE AS max_clv
      FROM summary GROUP BY 1 HAVING count(*) >= 50"""),
    "q10_payment_mix": sql(f"""SELECT *, {share('order_count')} AS pct FROM (
      SELECT payment_type, count(DISTINCT order_id) AS order_count, {avg('payment_value')} AS avg_payment_value,
      {avg('payment_installments')} AS avg_installments FROM b_payments JOIN o_done USING (order_id) GROUP BY 1)"""),
    "q11_top_sellers": sql(f"""SELECT seller_id, seller_state, count(DISTINCT order_id) AS orders, sum(total_value)::DOUBLE AS revenue,
      {mean('sum(r.review_score)', 'count(r.review_score)')} AS avg_review, {avg('delivery_days', 1)} AS avg_delivery_days
      FROM fact LEFT JOIN r USING (order_id) GROUP BY 1, 2 ORDER BY revenue DESC, seller_id LIMIT 20"""),
    "q11_top_sellers_value_once": sql(f"""SELECT seller_id, seller_state, count(DISTINCT order_id) AS orders, sum(total_value)::DOUBLE AS revenue,
      {mean('sum(s)', 'sum(n)')} AS avg_review, {avg('delivery_days', 1)} AS avg_delivery_days
      FROM i JOIN po USING (order_id) JOIN p USING (product_id) JOIN b_sellers USING (seller_id)
      LEFT JOIN (SELECT order_id, sum(review_score) AS s, count(*) AS n FROM r GROUP BY 1) USING (order_id)
      GROUP BY 1, 2 ORDER BY revenue DESC, seller_id LIMIT 20"""),
    "q12_cancellations": sql(f"""SELECT purchase_month, count(*) AS total_orders, count(*) FILTER (order_status = 'canceled') AS canceled,
      {pct("count(*) FILTER (order_status = 'canceled')", 'count(*)')} AS cancel_rate_pct FROM o_all GROUP BY 1"""),
    "q13_churn_by_segment": sql(f"""SELECT {LABEL} AS rfm_segment, count(*) AS total_customers, sum(is_churned)::BIGINT AS churned,
      {pct('sum(is_churned)', 'count(*)')} AS churn_rate_pct FROM rfm JOIN churn USING (customer_unique_id) GROUP BY 1"""),
    "q14_freight_share": sql(f"""SELECT category_english, count(*) AS items, {avg('price')} AS avg_price, {avg('freight_value')} AS avg_freight,
      {pct('sum(freight_value)::DOUBLE / count(*)', 'sum(price)::DOUBLE / count(*)')} AS freight_to_price_pct
      FROM fact GROUP BY 1 HAVING count(*) >= 50 ORDER BY freight_to_price_pct DESC, 1 LIMIT 15"""),
    "q15_days_to_review": sql(f"""SELECT review_score, count(*) AS review_count, {avg('d', 1)} AS avg_days_to_review FROM (
      SELECT review_score, date_part('day', review_creation_date - arrived) AS d FROM r LEFT JOIN o_all USING (order_id)) GROUP BY 1"""),
    "q16_weekday": sql(f"""SELECT dayofweek(bought)::INT AS day_of_week, dayname(bought) AS day_name, count(*) AS order_count,
      {avg('order_total_value')} AS avg_order_value FROM o_done JOIN amount USING (order_id) GROUP BY 1, 2"""),
    "q17_basket_size": sql(f"""SELECT *, {share('orders')} AS pct FROM (
      SELECT if(order_item_count = 1, 'Single Item', 'Multi Item') AS order_type, count(*) AS orders, {avg('order_total_value')} AS avg_order_value
      FROM o_done JOIN amount USING (order_id) GROUP BY 1)"""),
    "q18_customers_by_month_state": sql("""SELECT purchase_month, customer_state, count(DISTINCT customer_unique_id) AS new_customers FROM po GROUP BY 1, 2"""),
    "q18_first_time_customers_by_month_state": sql("""SELECT purchase_month, customer_state, count(*) AS new_customers FROM po
      WHERE NOT EXISTS (SELECT 1 FROM po b WHERE b.customer_unique_id = po.customer_unique_id AND (b.bought, b.order_id) < (po.bought, po.order_id))
      GROUP BY 1, 2"""),
    "q19_cumulative_gmv": sql(f"""SELECT purchase_month, v::DOUBLE AS monthly_gmv, (sum(v) OVER (ORDER BY purchase_month))::DOUBLE AS cumulative_gmv,
      {mean('sum(v) OVER w3', 'count(v) OVER w3')} AS rolling_3mo_avg
      FROM (SELECT purchase_month, sum(total_value) AS v FROM o_done JOIN i USING (order_id) GROUP BY 1)
      WINDOW w3 AS (ORDER BY purchase_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""),
    "q20_top_sellers_per_state": sql("""SELECT seller_state, seller_id, v::DOUBLE AS revenue, place::INT AS state_rank FROM (
      SELECT *, rank() OVER (PARTITION BY seller_state ORDER BY v DESC) AS place
      FROM (SELECT seller_state, seller_id, sum(total_value) AS v FROM fact GROUP BY 1, 2)) WHERE place <= 5"""),
    "q21_delivery_by_month": sql(f"""SELECT purchase_month, count(*) AS deliveries, {avg('delivery_days', 1)} AS avg_delivery_days,
      {pct('sum(is_late)', 'count(*)')} AS late_pct FROM delivery GROUP BY 1"""),
    "q22_detractors_by_category": sql(f"""SELECT category_english, count(*) AS total_reviews, sum(is_detractor)::BIGINT AS detractors,
      {pct('sum(is_detractor)', 'count(*)')} AS detractor_rate, {avg('delivery_days', 1)} AS avg_delivery_days
      FROM fact WHERE review_score IS NOT NULL GROUP BY 1 HAVING count(*) >= 100 ORDER BY detractor_rate DESC, 1 LIMIT 10"""),
    "q23_value_by_installments": sql(f"""SELECT payment_installments, count(*) AS payment_count, {avg('payment_value')} AS avg_payment_value,
      {rnd('sum(payment_value)::DOUBLE / count(*) * payment_installments')} AS implied_total
      FROM b_payments JOIN o_done USING (order_id) WHERE payment_type = 'credit_card' GROUP BY 1"""),
    "q24_order_frequency": sql(f"""SELECT *, {share('customer_count')} AS pct FROM (
      SELECT total_orders, count(*) AS customer_count, sum(lifetime_value)::DOUBLE AS segment_revenue FROM summary GROUP BY 1)"""),
    "q25_yearly_gmv": sql(f"""SELECT purchase_year, count(DISTINCT order_id) AS orders, sum(total_value)::DOUBLE AS gmv,
      {mean('sum(order_total_value)', 'count(*)')} AS aov FROM fl GROUP BY 1""", WEIGHTED),
    "r1_monthly_growth": sql(f"""SELECT purchase_month, n AS delivered_orders, v::DOUBLE AS gmv, {mean('v', 'n')} AS aov,
      {pct('v - lag(v) OVER (ORDER BY purchase_month)', 'lag(v) OVER (ORDER BY purchase_month)')} AS mom_gmv_growth_pct
      FROM (SELECT purchase_month, count(DISTINCT order_id) AS n, sum(total_value) AS v FROM o_done JOIN i USING (order_id) GROUP BY 1)"""),
    "r2_category_month_value": sql(f"""SELECT purchase_month, category_english, n AS delivered_orders, v::DOUBLE AS gmv, {mean('v', 'n')} AS aov,
      (row_number() OVER (PARTITION BY purchase_month ORDER BY v DESC, category_english))::INT AS category_rank_in_month
      FROM (SELECT purchase_month, category_english, count(DISTINCT order_id) AS n, sum(total_value) AS v FROM co GROUP BY 1, 2)
      WHERE n >= 25""", CAT_ORDERS),
    "r3_category_concentration": sql(f"""SELECT category_english, n AS delivered_orders, v::DOUBLE AS revenue, {share('v')} AS revenue_share_pct,
      {pct('sum(v) OVER (ORDER BY v DESC, category_english ROWS UNBOUNDED PRECEDING)', 'sum(v) OVER ()')} AS cumulative_share_pct,
      (dense_rank() OVER (ORDER BY v DESC))::INT AS revenue_rank
      FROM (SELECT category_english, count(DISTINCT order_id) AS n, sum(total_value) AS v FROM co GROUP BY 1)""", CAT_ORDERS),
    "r4_first_time_vs_repeat": sql(f"""SELECT *, {share('customers')} AS customer_share_pct, {share('revenue')} AS revenue_share_pct FROM (
      SELECT if(n = 1, 'First-time customers', 'Repeat customers') AS customer_type, count(*) AS customers, sum(v)::DOUBLE AS revenue,
      {avg('v')} AS avg_customer_revenue
      FROM (SELECT customer_unique_id, count(*) AS n FROM person JOIN o_all USING (customer_id) GROUP BY 1)
      JOIN (SELECT customer_unique_id, sum(total_value) AS v FROM po JOIN i USING (order_id) GROUP BY 1) USING (customer_unique_id) GROUP BY 1)"""),
    "r5_second_purchase": sql(f"""SELECT count(*) AS customers, count(*) FILTER (n > 1) AS repeat_customers,
      {pct('count(*) FILTER (n > 1)', 'count(*)')} AS repeat_customer_rate_pct,
      {rnd(f'sum(gap)::DOUBLE / count(gap) / {DAY}', 1)} AS avg_days_to_second_order,
      {rnd(f'quantile_cont(gap::DOUBLE, 0.5) / {DAY}', 4)} AS median_days_to_second_order
      FROM (SELECT customer_unique_id, count(*) AS n, max(epoch_us(bought)) FILTER (k = 2) - max(epoch_us(bought)) FILTER (k = 1) AS gap
        FROM (SELECT *, row_number() OVER (PARTITION BY customer_unique_id ORDER BY bought, order_id) AS k FROM po) GROUP BY 1)"""),
    "r6_cohort_curves": sql("SELECT cohort_month, period_number, active_customers, cohort_size, retention_rate AS retention_pct FROM retention"),
    "r7_rfm_value_segments": sql(f"""SELECT *, {share('customers')} AS customer_share_pct, {share('segment_revenue')} AS revenue_share_pct FROM (
      SELECT {SCORE_LABEL} AS rfm_segment, count(*) AS customers, sum(lifetime_value)::DOUBLE AS segment_revenue,
      {avg('lifetime_value')} AS avg_clv, {avg('order_count')} AS avg_orders_per_customer
      FROM (SELECT *, ntile(5) OVER (ORDER BY us, customer_unique_id, customer_state) AS recency_score,
        ntile(5) OVER (ORDER BY order_count, customer_unique_id, customer_state) AS frequency_score,
        ntile(5) OVER (ORDER BY lifetime_value, customer_unique_id, customer_state) AS monetary_score FROM lv) GROUP BY 1)""",
      LIFE_VALUE.format(extra=", po.customer_state")),
    "r8_churn_funnel": sql(f"""SELECT *, {share('customers')} AS customer_share_pct FROM (
      SELECT CASE WHEN d > 180 THEN 'Churned' WHEN d >= 91 AND d <= 180 THEN 'At Risk' WHEN d >= 31 AND d <= 90 THEN 'Warm' ELSE 'Active' END AS churn_status,
      count(*) AS customers, sum(lifetime_value)::DOUBLE AS revenue_at_status,
      {rnd(f'sum(us)::DOUBLE / count(*) / {DAY}', 1)} AS avg_recency_days, {avg('order_count')} AS avg_orders_per_customer
      FROM (SELECT *, us / {DAY} AS d FROM lv) GROUP BY 1)""", LIFE_VALUE.format(extra="")),
    "r9_on_time_by_month": sql(f"""SELECT purchase_month, count(*) AS delivered_orders, sum(is_on_time)::BIGINT AS on_time_orders,
      sum(is_late)::BIGINT AS late_orders, {pct('sum(is_on_time)', 'count(*)')} AS on_time_rate_pct,
      {rnd(f'sum({SPAN})::DOUBLE / count(arrived) / {DAY}')} AS avg_delivery_days FROM o_done GROUP BY 1"""),
    "r10_review_impact": sql(f"""SELECT if(is_late = 1, 'Late', 'On Time') AS delivery_status, count(*) AS reviews, {avg('review_score')} AS avg_review_score,
      sum(is_detractor)::BIGINT AS detractor_reviews, {pct('sum(is_detractor)', 'count(*)')} AS detractor_rate_pct
      FROM r JOIN o_done USING (order_id) WHERE arrived IS NOT NULL AND promised IS NOT NULL GROUP BY 1"""),
    "r11_late_by_state": sql(f"""SELECT customer_state, count(*) AS delivered_orders, sum(is_late)::BIGINT AS late_orders,
      {pct('sum(is_late)', 'count(*)')} AS late_delivery_rate_pct, {rnd(f'sum({SPAN})::DOUBLE / count(*) / {DAY}')} AS avg_delivery_days
      FROM po WHERE arrived IS NOT NULL AND promised IS NOT NULL GROUP BY 1"""),
    "r12_category_demand": sql(f"""SELECT *, {share('revenue')} AS revenue_share_pct, (dense_rank() OVER (ORDER BY revenue DESC))::INT AS revenue_rank FROM (
      SELECT category_english, count(DISTINCT order_id) AS delivered_orders, count(*) AS item_lines, sum(total_value)::DOUBLE AS revenue
      FROM fact GROUP BY 1)"""),
    "r13_state_demand": sql(f"""SELECT *, {share('revenue')} AS revenue_share_pct,
      (row_number() OVER (ORDER BY revenue DESC, customer_state))::INT AS state_rank_by_revenue FROM (
      SELECT customer_state, count(DISTINCT order_id) AS delivered_orders, sum(total_value)::DOUBLE AS revenue,
      {avg('delivery_days')} AS avg_delivery_days, {pct('sum(is_late)', 'count(*)')} AS late_delivery_rate_pct FROM fact GROUP BY 1)"""),
    "r14_seller_concentration": sql(f"""SELECT seller_id, n AS delivered_orders, v::DOUBLE AS revenue, {share('v')} AS revenue_share_pct,
      {pct('sum(v) OVER (ORDER BY v DESC, seller_id ROWS UNBOUNDED PRECEDING)', 'sum(v) OVER ()')} AS cumulative_revenue_share_pct,
      (dense_rank() OVER (ORDER BY v DESC))::INT AS revenue_rank
      FROM (SELECT seller_id, count(DISTINCT order_id) AS n, sum(total_value) AS v FROM fact GROUP BY 1)"""),
    "r15_seller_scorecard": sql(f"""SELECT *, (row_number() OVER (ORDER BY revenue DESC, seller_id))::INT AS seller_rank_by_revenue FROM (
      SELECT seller_id, count(DISTINCT order_id) AS delivered_orders, sum(total_value)::DOUBLE AS revenue, {avg('review_score')} AS avg_review_score,
      {avg('delivery_days')} AS avg_delivery_days, {pct('sum(is_late)', 'count(*)')} AS late_delivery_rate_pct FROM fact GROUP BY 1)
      ORDER BY revenue DESC, seller_id LIMIT 50"""),
}
