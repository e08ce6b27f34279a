"""Batch statements of what the streaming jobs deliver."""

from oracles.base import rnd, sql

RISK = f"""hist AS (SELECT customer_state, count(*) AS n, sum(is_late) AS l FROM po WHERE arrived IS NOT NULL GROUP BY 1),
risk AS (SELECT customer_state, {rnd('l::DOUBLE / n', 6)} AS late_rate FROM hist)"""

ORACLES = {
    "st1_ingested_state": """SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type,
      arg_max(value, (ts, event_id)) AS value, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY user_id""",
    "st2_daily_purchases": """SELECT ts::DATE AS day, sum(value::DECIMAL(18,2))::DOUBLE AS value, count(*) AS events FROM events
      WHERE event_type = 'purchase' GROUP BY 1""",
    "st2_late_delivery_alerts": sql(f"""SELECT order_id, customer_state, late_rate, promised AS order_estimated_delivery_date
      FROM o_all JOIN person USING (customer_id) JOIN risk USING (customer_state)
      WHERE order_status = 'shipped' AND promised > (SELECT max(bought) FROM o_all)
        AND late_rate >= (SELECT {rnd('sum(l)::DOUBLE / sum(n)::DOUBLE', 6)} FROM hist)""", RISK),
    "st2_scored_alerts_check": sql("""SELECT 0::BIGINT AS extra, 0::BIGINT AS missing, 0::BIGINT AS repeated, count(*) AS orders
      FROM o_all JOIN person USING (customer_id) WHERE order_status = 'shipped'"""),
    "st3_winback_triggers": sql("""SELECT customer_unique_id, max(bought) AS last_order, max(bought) + to_days(90) AS inactive_since, count(*) AS orders
      FROM (SELECT *, sum(fresh) OVER (PARTITION BY customer_unique_id ORDER BY bought, order_id) AS run FROM (
        SELECT customer_unique_id, bought, order_id, coalesce(bought > lag(bought) OVER (PARTITION BY customer_unique_id ORDER BY bought, order_id)
          + to_days(90), true)::INT AS fresh FROM po)) GROUP BY customer_unique_id, run
      HAVING max(bought) + to_days(90) <= (SELECT max(bought) FROM po) - to_days(1)"""),
    "st1_deduplicated_events": "SELECT DISTINCT * FROM events",
    "st2_overdue_orders": sql("""SELECT order_id, customer_id, bought AS order_purchase_timestamp, promised AS order_estimated_delivery_date
      FROM o_all WHERE order_status <> 'canceled' AND promised <= (SELECT max(bought) FROM o_all)
        AND NOT coalesce(order_status = 'delivered' AND arrived <= promised, false)"""),
    "st3_band_changes": sql("""SELECT customer_unique_id, moment AS "at", change, bought AS last_order FROM (
        SELECT *, unnest([
          {moment: bought + to_days(91), change: 'entered'},
          {moment: bought + to_days(181), change: 'lapsed'},
          {moment: next, change: 'ordered'}], recursive := true)
        FROM (SELECT customer_unique_id, bought, lead(bought) OVER (PARTITION BY customer_unique_id ORDER BY bought, order_id) AS next FROM po))
      WHERE moment <= (SELECT max(bought) FROM o_all) + to_days(1) AND bought + to_days(91) <= coalesce(next, moment)
        AND (change <> 'lapsed' OR moment <= coalesce(next, moment)) AND (change <> 'ordered' OR next < bought + to_days(181))"""),
    "st3_winback_band": sql("""SELECT customer_unique_id, last_order_date, recency_days FROM life WHERE recency_days > 90 AND recency_days <= 180"""),
}
