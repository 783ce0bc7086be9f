"""Common table expressions of the oracle: canonical events, merge map, profiles.

Written from the definitions, not generated from the Spark code.
"""

from __future__ import annotations

WEB = """
web_raw AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS raw_id,
         CASE event_type WHEN 'signup' THEN 'session_start' WHEN 'view' THEN 'view_item'
              WHEN 'click' THEN 'add_to_cart' WHEN 'purchase' THEN 'purchase' WHEN 'error' THEN 'refund' END AS event_type,
         ts, CAST(value AS DECIMAL(18,2)) AS amount, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
web_history AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS past_id, CAST(user_id - 1 AS VARCHAR) AS target
  FROM events WHERE user_id % 10 IN (7, 8)),
web_walk AS (
  SELECT past_id, target, 1 AS depth FROM web_history
  UNION ALL
  SELECT w.past_id, h.target, w.depth + 1 FROM web_walk w JOIN web_history h ON h.past_id = w.target WHERE w.depth < 20),
web_map AS (
  SELECT past_id, arg_max(target, depth) AS canonical_id, max(depth) AS depth FROM web_walk GROUP BY past_id),
web_ev AS (
  SELECT event_id, coalesce(m.canonical_id, raw_id) AS customer_id, event_type, ts,
         CASE WHEN event_type IN ('purchase', 'refund') THEN amount END AS amount,
         'c' || (k % 5) AS l1, 'c' || (k % 5) || '_' || (k % 20) AS l2,
         CASE k % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' END AS device
  FROM web_raw LEFT JOIN web_map m ON m.past_id = raw_id)
"""

SHOP = """
lines AS (
  SELECT l_orderkey, l_linenumber, o_custkey, o_orderdate, o_orderpriority, l_linestatus, p_name, p_brand, p_type, p_size,
         CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'refund'
              WHEN l_returnflag = 'N' THEN 'view_item' ELSE 'purchase_item' END AS kind
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
shop_ev AS (
  SELECT 'p' || o_orderkey AS event_id, CAST(o_custkey AS VARCHAR) AS customer_id, 'purchase' AS event_type,
         CAST(o_orderdate AS TIMESTAMP) AS ts, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
         CAST(NULL AS VARCHAR) AS l1, CAST(NULL AS VARCHAR) AS l2, CAST(NULL AS VARCHAR) AS device FROM orders
  UNION ALL
  SELECT 's' || o_orderkey, CAST(o_custkey AS VARCHAR), 'session_start', CAST(o_orderdate AS TIMESTAMP) - INTERVAL 1 HOUR,
         NULL, NULL, NULL, NULL FROM orders
  UNION ALL
  SELECT 'l' || l_orderkey || '_' || l_linenumber, CAST(o_custkey AS VARCHAR), kind, CAST(o_orderdate AS TIMESTAMP),
         NULL, p_type, p_brand, NULL FROM lines)
"""

REFERENCE = {"web": "TIMESTAMP '2024-02-01 00:00:00'", "shop": "TIMESTAMP '2001-09-01 00:00:00'"}


def whole_days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000) AS BIGINT)"


def profiles(source: str) -> str:
    """CTEs ending in `profiles` over `{source}_ev`."""
    ev, ref = f"{source}_ev", REFERENCE[source]
    base = WEB if source == "web" else SHOP
    return f"""{base},
tot AS (
  SELECT customer_id, count(*) AS total_events, min(ts) AS first_seen, max(ts) AS last_seen,
    count(*) FILTER (WHERE event_type = 'purchase') AS total_purchases,
    coalesce(sum(amount) FILTER (WHERE event_type = 'purchase'), 0) AS total_revenue,
    min(ts) FILTER (WHERE event_type = 'purchase') AS first_purchase,
    max(ts) FILTER (WHERE event_type = 'purchase') AS last_purchase,
    count(*) FILTER (WHERE event_type = 'refund') AS total_refunds,
    count(*) FILTER (WHERE event_type = 'session_start') AS total_sessions,
    count(*) FILTER (WHERE event_type IN ('view_item', 'view_category')) AS total_page_views,
    count(*) FILTER (WHERE event_type = 'view_item') AS total_items_viewed,
    count(*) FILTER (WHERE event_type = 'add_to_cart') AS total_cart_additions,
    coalesce(avg(CASE WHEN device IN ('mobile', 'tablet', 'ios', 'android') THEN 1.0 ELSE 0.0 END)
             FILTER (WHERE device IS NOT NULL), 0.0) AS mobile_session_ratio
  FROM {ev} GROUP BY customer_id),
dows AS (
  SELECT customer_id, v, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, f, v) AS rn FROM (
    SELECT customer_id, isodow(ts) - 1 AS v, count(*) AS n, min(ts) AS f FROM {ev} GROUP BY 1, 2)),
hours AS (
  SELECT customer_id, v, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, f, v) AS rn FROM (
    SELECT customer_id, hour(ts) AS v, count(*) AS n, min(ts) AS f FROM {ev} GROUP BY 1, 2)),
devices AS (
  SELECT customer_id, v, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, f, v) AS rn FROM (
    SELECT customer_id, device AS v, count(*) AS n, min(ts) AS f FROM {ev} WHERE device IS NOT NULL GROUP BY 1, 2)),
cat_ev AS (
  SELECT customer_id, 1 AS level, l1 AS category, event_type, ts FROM {ev} WHERE l1 IS NOT NULL
  UNION ALL SELECT customer_id, 2, l2, event_type, ts FROM {ev} WHERE l2 IS NOT NULL),
aff0 AS (
  SELECT customer_id, level, category,
    sum(CASE WHEN event_type IN ('view_item', 'view_category') THEN 1 WHEN event_type = 'add_to_cart' THEN 2
             WHEN event_type IN ('purchase', 'purchase_item') THEN 5 ELSE 0 END) AS engagement,
    count(*) FILTER (WHERE event_type IN ('view_item', 'view_category')) AS view_count,
    count(*) FILTER (WHERE event_type IN ('purchase', 'purchase_item')) AS purchase_count,
    min(ts) FILTER (WHERE event_type IN ('view_item', 'view_category', 'add_to_cart', 'purchase', 'purchase_item')) AS first_engaged
  FROM cat_ev GROUP BY 1, 2, 3),
aff AS (
  SELECT *, CAST(engagement AS DOUBLE) / max(engagement) OVER (PARTITION BY customer_id, level) AS engagement_score
  FROM aff0 WHERE engagement > 0),
aff_pos AS (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY engagement_score DESC, first_engaged, level, category) AS position
  FROM aff),
gaps AS (
  SELECT customer_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY customer_id ORDER BY ts, event_id)) / 86400000000.0 AS gap
  FROM {ev} WHERE event_type = 'purchase'),
ivals AS (
  SELECT customer_id, avg(gap) AS interval_mean, stddev_samp(gap) AS interval_std, min(gap) AS interval_min,
         max(gap) AS interval_max, CASE WHEN avg(gap) > 0 THEN stddev_samp(gap) / avg(gap) END AS interval_cv
  FROM gaps WHERE gap IS NOT NULL GROUP BY 1),
p1 AS (
  SELECT t.*, CAST(total_revenue AS DOUBLE) / nullif(total_purchases, 0) AS aov0,
    {whole_days(ref, 'last_purchase')} AS days_since_last_purchase,
    CASE WHEN total_purchases = 0 THEN 0.0
         WHEN {whole_days('last_purchase', 'first_purchase')} > 0
         THEN total_purchases / ({whole_days('last_purchase', 'first_purchase')} / CAST(30.0 AS DOUBLE))
         ELSE CAST(total_purchases AS DOUBLE) END AS purchase_frequency_per_month,
    CASE WHEN total_cart_additions > 0
         THEN greatest(0.0, 1 - CAST(total_purchases AS DOUBLE) / total_cart_additions) ELSE 0.0 END AS cart_abandonment_rate,
    {whole_days(ref, 'first_seen')} AS ref_tenure,
    {whole_days('last_seen', 'first_seen')} AS tenure_days,
    coalesce(CAST(total_refunds AS DOUBLE) / nullif(total_purchases, 0), 0.0) AS raw_refund_rate
  FROM tot t),
profiles AS (
  SELECT p.*, coalesce(aov0, 0.0) AS avg_order_value, least(1.0, raw_refund_rate) AS refund_rate,
    d.v AS preferred_day_of_week, h.v AS preferred_hour_of_day, dv.v AS primary_device_type, tc.category AS top_category,
    coalesce(cc.n, 0) AS category_count,
    i.interval_mean, i.interval_std, i.interval_min, i.interval_max, i.interval_cv,
    CASE WHEN i.interval_cv IS NOT NULL THEN 1 - least(i.interval_cv / 2, 1.0) END AS regularity_index,
    CASE WHEN total_purchases = 0 OR ref_tenure <= 0 THEN 0.0
         ELSE round_even(purchase_frequency_per_month * coalesce(aov0, 0.0) * CAST(31.435143641317083 AS DOUBLE), 2) END AS clv_estimate,
    least(1.0, greatest(0.0,
      0.4 * CASE WHEN days_since_last_purchase IS NOT NULL THEN least(1.0, days_since_last_purchase / CAST(180.0 AS DOUBLE))
                 WHEN ref_tenure > 30 THEN 1.0 ELSE 0.5 END
      + 0.25 * CASE WHEN purchase_frequency_per_month <= 1.0 THEN greatest(0.0, 1 - purchase_frequency_per_month) ELSE 0.0 END
      + 0.2 * cart_abandonment_rate
      + 0.15 * CASE WHEN total_sessions = 0 THEN 1.0 ELSE 0.0 END)) AS churn_risk_score,
    CASE WHEN total_purchases = 0 THEN 'new' WHEN total_purchases = 1 THEN 'one_time'
         WHEN i.interval_cv IS NULL OR i.interval_mean IS NULL THEN 'new'
         WHEN i.interval_cv <= 0.5 THEN 'regular'
         WHEN i.interval_mean >= 90 AND i.interval_cv <= 1 THEN 'long_cycle' ELSE 'irregular' END AS behavior_type
  FROM p1 p
  LEFT JOIN dows d ON d.customer_id = p.customer_id AND d.rn = 1
  LEFT JOIN hours h ON h.customer_id = p.customer_id AND h.rn = 1
  LEFT JOIN devices dv ON dv.customer_id = p.customer_id AND dv.rn = 1
  LEFT JOIN aff_pos tc ON tc.customer_id = p.customer_id AND tc.position = 1
  LEFT JOIN (SELECT customer_id, count(*) AS n FROM aff GROUP BY 1) cc ON cc.customer_id = p.customer_id
  LEFT JOIN ivals i ON i.customer_id = p.customer_id)
"""


def with_(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts if p.strip()) + "\n" + select.strip()
