"""Parts of the model work that SQL can state: scaling, splits, metrics, campaign."""

from oracles.base import rnd, sql
from oracles.explore import ORDER_REVIEW, PERSON_REVIEW, PROFILE, REPEAT, RISK
from oracles.marts import KEY
from soukline.operators.learning import REPEAT_NAMES, REPEAT_NUMBERS

COLUMNS = ["recency_days", "order_count", "total_spent", "avg_review", "avg_delivery_days", "late_delivery_rate"]
FILLED = "cf AS (SELECT customer_unique_id, " + ", ".join(f"coalesce({c}::DOUBLE, 0) AS {c}" for c in COLUMNS) + " FROM life LEFT JOIN prv USING (customer_unique_id))"


def report(y: str, p: str, source: str) -> tuple[str, str]:
    cells = f"""c AS (SELECT k, count(*) FILTER ({y} = k AND {p} = k) AS hit, count(*) FILTER ({p} = k) AS said, count(*) FILTER ({y} = k) AS support
      FROM {source}, (VALUES (0), (1)) v(k) GROUP BY k),
    m AS (SELECT *, coalesce(hit::DOUBLE / nullif(said, 0), 0) AS precision, coalesce(hit::DOUBLE / nullif(support, 0), 0) AS recall,
      coalesce((hit * 2)::DOUBLE / nullif(said + support, 0), 0) AS f1 FROM c)"""
    out = ", ".join(f"{rnd(x, 6)} AS {x}" for x in ("precision", "recall", "f1"))
    avgs = ", ".join(f"{rnd(f'avg({x})', 6)}" for x in ("precision", "recall", "f1"))
    weights = ", ".join(f"{rnd(f'sum({x} * support) / sum(support)', 6)}" for x in ("precision", "recall", "f1"))
    acc = rnd("sum(hit)::DOUBLE / sum(support)::DOUBLE", 6)
    body = f"""SELECT k::VARCHAR AS class, {out}, support FROM m UNION ALL SELECT 'macro avg', {avgs}, sum(support)::BIGINT FROM m
      UNION ALL SELECT 'weighted avg', {weights}, sum(support)::BIGINT FROM m UNION ALL SELECT 'accuracy', {acc}, {acc}, {acc}, sum(support)::BIGINT FROM m"""
    return cells, body


_cells, _body = report("repeat_customer_flag", "first_late_flag", "repeat_rows")

ORACLES = {
    "k1_standardised_features": sql(
        "SELECT customer_unique_id, " + ", ".join(
            f"{rnd(f'coalesce(({c} - (SELECT avg({c}) FROM cf)) / nullif((SELECT stddev_pop({c}) FROM cf), 0), 0)', 6)} AS z_{c}" for c in COLUMNS
        ) + " FROM cf", ORDER_REVIEW, PERSON_REVIEW, FILLED),
    "k3_kmeans_check": sql("SELECT count(*) AS customers, 4::BIGINT AS clusters, 0::BIGINT AS misplaced FROM life"),
    "k6_forest_check": sql(f"""SELECT count(*) AS tested, sum(is_late)::BIGINT AS late, 0::BIGINT AS outside, 1.0::DOUBLE AS importance,
      true AS accuracy_agrees, true AS votes_agree, true AS area_agrees FROM (
      SELECT is_late, row_number() OVER (PARTITION BY is_late ORDER BY {KEY.format('order_id')}, order_id) AS k,
      count(*) OVER (PARTITION BY is_late) AS n FROM po) WHERE k <= ceil(n * 0.3::DOUBLE)"""),
    "k6_balanced_subsample_check": sql(f"""SELECT count(*) AS tested, sum(is_late)::BIGINT AS late, 0::BIGINT AS outside, 12::INT AS even_trees,
      true AS draws, true AS ranks FROM (
      SELECT is_late, row_number() OVER (PARTITION BY is_late ORDER BY {KEY.format('order_id')}, order_id) AS k,
      count(*) OVER (PARTITION BY is_late) AS n FROM po) WHERE k <= ceil(n * 0.3::DOUBLE)"""),
    "k12_audience_check": sql("""SELECT count(*) AS customers, true AS parted, 0::BIGINT AS repeated, 0::BIGINT AS misplaced, 0::BIGINT AS strangers
      FROM repeat_rows""", ORDER_REVIEW, PROFILE, REPEAT),
    "k2_elbow_check": sql(f"""SELECT k::INT AS k, customers, {rnd('squares', 3)} AS squares, true AS cost_is_inside, true AS falls FROM
      (SELECT count(*) AS customers, {" + ".join(f"count(*) * (stddev_pop({c}) > 0)::INT" for c in COLUMNS)} AS squares FROM cf),
      (SELECT unnest(range(2, 8)) AS k)""", ORDER_REVIEW, PERSON_REVIEW, FILLED),
    "k7_lifetime_value_check": sql(f"""SELECT count(*) AS tested, {rnd('avg(total_spent)', 4)} AS mean_value, true AS error_agrees, true AS r2_agrees, 0::BIGINT AS outside
      FROM (SELECT total_spent, row_number() OVER (ORDER BY {KEY.format('customer_unique_id')}, customer_unique_id) AS k, count(*) OVER () AS n
      FROM repeat_rows) WHERE k <= ceil(n * 0.3::DOUBLE)""", ORDER_REVIEW, PROFILE, REPEAT),
    "k13_scored_campaign_check": sql(f"""SELECT cs AS control_size, cr AS control_repeats, ts AS treatment_size, tr AS treatment_repeats,
      greatest(0, tr - cr) AS incremental_repeat_purchases, {rnd('greatest(0, tr - cr) * m')} AS incremental_revenue,
      true AS offers_follow, true AS cost_follows, true AS profit_follows FROM (
      SELECT count(*) FILTER (NOT t) AS cs, count(*) FILTER (NOT t AND repeat_customer_flag = 1) AS cr, count(*) FILTER (t) AS ts,
        count(*) FILTER (t AND repeat_customer_flag = 1) AS tr, sum(total_spent)::DOUBLE / count(*) AS m
      FROM (SELECT *, row_number() OVER (ORDER BY {KEY.format('customer_unique_id')}, customer_unique_id) > floor(count(*) OVER () / 2) AS t
        FROM repeat_rows))""", ORDER_REVIEW, PROFILE, REPEAT),
    "k4_encoded_features": sql("SELECT customer_unique_id, [" + ", ".join(f"coalesce({c}::DOUBLE, 0)" for c in REPEAT_NUMBERS) + "]"
      + "".join(f""" || list_transform((SELECT list(DISTINCT {c} ORDER BY {c}) FROM repeat_rows WHERE {c} IS NOT NULL),
        lambda v: (v IS NOT DISTINCT FROM {c})::INT::DOUBLE) || [({c} IS NULL)::INT::DOUBLE, 0]""" for c in REPEAT_NAMES)
      + " AS features FROM repeat_rows", ORDER_REVIEW, PROFILE, REPEAT),
    "k5_stratified_split": sql(f"""SELECT order_id, is_late, (k <= ceil(n * 0.3::DOUBLE))::INT AS is_test FROM (
      SELECT order_id, is_late, row_number() OVER (PARTITION BY is_late ORDER BY {KEY.format('order_id')}, order_id) AS k,
      count(*) OVER (PARTITION BY is_late) AS n FROM po)"""),
    "k5_plain_split": sql(f"""SELECT customer_unique_id, (k <= ceil(n * 0.3::DOUBLE))::INT AS is_test FROM (
      SELECT customer_unique_id, row_number() OVER (ORDER BY {KEY.format('customer_unique_id')}, customer_unique_id) AS k, count(*) OVER () AS n
      FROM repeat_rows)""", ORDER_REVIEW, PROFILE, REPEAT),
    "k9_value_as_late_score_auc": sql(f"""SELECT {rnd('(sum(rk) FILTER (is_late = 1) - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * q::DOUBLE)', 6)} AS auc FROM (
      SELECT is_late, sum(is_late) OVER () AS p, count(*) OVER () - sum(is_late) OVER () AS q,
        rank() OVER (ORDER BY order_total_value) + (count(*) OVER (PARTITION BY order_total_value) - 1) / 2.0::DOUBLE AS rk FROM risk_rows)
      GROUP BY p, q""", PROFILE, RISK),
    "k10_first_late_as_repeat_report": sql(_body, ORDER_REVIEW, PROFILE, REPEAT, _cells),
    "k11_first_value_as_clv_report": sql(f"""SELECT {rnd('avg(abs(total_spent - first_order_value))', 4)} AS mae,
      {rnd('1.0 - sum(pow(total_spent - first_order_value, 2)) / sum(pow(total_spent - m, 2))', 6)} AS r2, count(*) AS rows
      FROM repeat_rows, (SELECT avg(total_spent) AS m FROM repeat_rows)""", ORDER_REVIEW, PROFILE, REPEAT),
    "k13_campaign": sql(f"""SELECT cs AS control_size, cr AS control_repeats, {rnd('cr::DOUBLE / cs * 100.0')} AS control_repeat_rate_pct,
      ts AS treatment_size, tr AS treatment_repeats, {rnd('tr::DOUBLE / ts * 100.0')} AS treatment_repeat_rate_pct,
      greatest(0, tr - cr) AS incremental_repeat_purchases, tc AS targeted_customers, rc AS redeemed_coupons,
      {rnd('rc * 15.0::DOUBLE')} AS total_campaign_cost, {rnd('greatest(0, tr - cr) * m')} AS incremental_revenue,
      {rnd('greatest(0, tr - cr) * m - rc * 15.0::DOUBLE')} AS net_profit,
      {rnd('coalesce((greatest(0, tr - cr) * m - rc * 15.0::DOUBLE) / nullif(rc * 15.0::DOUBLE, 0) * 100.0, 0)')} AS roi_pct FROM (
      SELECT count(*) FILTER (NOT t) AS cs, count(*) FILTER (NOT t AND repeat_customer_flag = 1) AS cr, count(*) FILTER (t) AS ts,
        count(*) FILTER (t AND repeat_customer_flag = 1) AS tr, count(*) FILTER (t AND late_delivery_rate <= 0.15) AS tc,
        count(*) FILTER (t AND late_delivery_rate <= 0.15 AND repeat_customer_flag = 1) AS rc, sum(total_spent)::DOUBLE / count(*) AS m
      FROM (SELECT *, row_number() OVER (ORDER BY {KEY.format('customer_unique_id')}, customer_unique_id) > floor(count(*) OVER () / 2) AS t FROM life))"""),
}
