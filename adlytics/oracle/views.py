"""The stand-in views written in DuckDB SQL, independently of the Spark code.

``with_views(sql, names)`` prefixes a query with the CTEs it needs; the
driver tables are pre-registered as views in the oracle connection.
"""

from __future__ import annotations

VIEW_SQL: dict[str, str] = {
    "ab_sessions": """
        SELECT event_id AS session_id,
               ts AS session_timestamp,
               'arm' || CAST(user_id % 2 AS VARCHAR) AS id,
               'exp1' AS test_id,
               CASE event_id % 3 WHEN 0 THEN 'Mobile' WHEN 1 THEN 'Desktop' ELSE 'Tablet' END AS device_type,
               user_id AS cookie_user_id,
               CASE WHEN user_id % 3 = 0 THEN 'Returning Visitor' ELSE 'New Visitor' END AS visitor_group,
               CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS revenue,
               CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS booking_quantity_direct_before_cancellations_onsite_booking,
               CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS booking_quantity_direct_before_cancellations,
               CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS searches
        FROM events""",
    "sessions": """
        SELECT event_id AS session_id,
               ts AS session_timestamp,
               CASE WHEN event_type = 'signup' THEN user_id END AS uref,
               'site' || CAST(user_id % 4 AS VARCHAR) || CASE WHEN user_id % 4 = 0 THEN '.de' ELSE '.ch' END AS site_id,
               CASE user_id % 7 WHEN 0 THEN 'vacaro' WHEN 1 THEN 'villamo' WHEN 2 THEN 'domiva' ELSE 'main' END AS legal_entity_short_name,
               CASE WHEN user_id % 2 = 0 THEN 'google/ch/' ELSE 'bing/ch/' END || CAST(user_id AS VARCHAR) AS adword_30_days,
               'camp' || CAST(user_id % 3 AS VARCHAR) AS campaign_30_days,
               CASE WHEN event_id % 3 = 0 THEN 'g' || CAST(event_id AS VARCHAR) END AS google_click_id_30_days,
               CASE WHEN event_id % 3 = 1 THEN 'm' || CAST(event_id AS VARCHAR) END AS microsoft_click_id_30_days
        FROM events""",
    "crm_users": """
        SELECT user_id AS uref,
               CAST(min(ts) AS DATE) + CAST(user_id % 20 AS INTEGER) AS registration_date,
               user_id % 2 = 0 AS is_subscriber,
               'src' || CAST(user_id % 5 AS VARCHAR) AS origin_source
        FROM events GROUP BY user_id""",
    "crm_modals": """
        SELECT event_id AS session_id,
               ts AS session_timestamp,
               CASE WHEN user_id % 5 <> 0 THEN '["exp1"]' ELSE '["other"]' END AS test_ids,
               CASE WHEN event_id % 8 = 0 THEN 1 ELSE 0 END AS account_subscription_apple,
               CASE WHEN event_id % 8 = 1 THEN 1 ELSE 0 END AS account_subscription_facebook,
               CASE WHEN event_id % 8 = 2 THEN 1 ELSE 0 END AS account_subscription_google,
               CASE WHEN event_id % 8 = 3 THEN 1 ELSE 0 END AS account_subscription_email,
               CASE WHEN event_id % 8 = 4 THEN 1 ELSE 0 END AS account_creation_apple,
               CASE WHEN event_id % 8 = 5 THEN 1 ELSE 0 END AS account_creation_facebook,
               CASE WHEN event_id % 8 = 6 THEN 1 ELSE 0 END AS account_creation_google,
               CASE WHEN event_id % 8 = 7 THEN 1 ELSE 0 END AS account_creation_email
        FROM events WHERE event_type IN ('signup', 'click')""",
    "interactions": """
        SELECT * FROM (
          SELECT event_id - event_id % 3 AS session_id,
                 CASE WHEN event_id % 4 <> 3 THEN 'overlay_cta_click'
                      ELSE 'install_overlay_close' END AS metric_name,
                 CASE WHEN user_id % 3 <> 1 THEN 'install_overlay' ELSE 'other' END AS se_category,
                 event_id AS interactions_key,
                 ts AS interaction_timestamp
          FROM events WHERE event_type = 'click') x
        UNION ALL
        SELECT * FROM (
          SELECT event_id - event_id % 3, CASE WHEN event_id % 4 <> 3 THEN 'overlay_cta_click'
                      ELSE 'install_overlay_close' END,
                 CASE WHEN user_id % 3 <> 1 THEN 'install_overlay' ELSE 'other' END,
                 event_id, ts
          FROM events WHERE event_type = 'click') y""",
    "installs": """
        SELECT ts AS install_time,
               ts AS date,
               CASE event_type WHEN 'signup' THEN 'install' WHEN 'click' THEN 'af_skad_install'
                    WHEN 'view' THEN 'retargeting' WHEN 'error' THEN 'uninstall' ELSE 'other' END AS event_name,
               CASE event_type WHEN 'signup' THEN 'install' WHEN 'click' THEN 'af_skad_install'
                    WHEN 'view' THEN 'retargeting' WHEN 'error' THEN 'uninstall' ELSE 'other' END AS activity_kind,
               CASE WHEN user_id % 20 < 10 THEN 'android' ELSE 'ios' END AS os_name,
               CASE WHEN user_id % 20 < 10 THEN 'com.app' ELSE '1104' END AS app_id,
               CASE WHEN user_id % 10 < 4 THEN 'organic' WHEN user_id % 10 < 6 THEN 'Facebook Ads'
                    WHEN user_id % 10 < 8 THEN 'googleadwords_int' ELSE 'Apple Search Ads' END AS media_source,
               user_id AS tracker_id,
               user_id AS app_user_id,
               CASE event_id % 4 WHEN 0 THEN 'overlay_deals'
                    WHEN 1 THEN 'overlay_deals_south'
                    ELSE 'camp' || CAST(event_id % 4 AS VARCHAR) END AS campaign_name
        FROM events""",
    "uploads": """
        SELECT DISTINCT ts AS export_updated_at_utc FROM (
          SELECT ts, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value DESC, event_id DESC) AS top,
                 row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value, event_id) AS low,
                 max(ts) OVER (PARTITION BY CAST(ts AS DATE)) AS late
          FROM events WHERE event_type = 'signup') WHERE top = 1 OR low = 1 OR ts = late""",
    "ads_report": """
        SELECT ts AS date, value * 0.1 AS cost, CAST(1 AS BIGINT) AS clicks, value AS revenue
        FROM events WHERE event_type = 'click' AND dayofmonth(ts) > 2""",
    "micro_conversions": """
        SELECT event_id AS click_id,
               event_id AS session_id,
               ts AS click_id_timestamp,
               CAST(user_id AS VARCHAR) AS provider_id,
               event_type AS site_id,
               CAST(event_id % 2 AS VARCHAR) AS device_type,
               CAST(dayofmonth(ts) % 5 AS VARCHAR) AS offer_bidding_tags,
               value AS revenue_cpc,
               value AS revenue_final,
               value * 200 AS ecpc,
               CASE event_type WHEN 'click' THEN 'Clickout' WHEN 'purchase' THEN 'Onsite-Booking'
                    WHEN 'view' THEN 'Onsite-Inquiry' WHEN 'signup' THEN 'Inline-Ad'
                    WHEN 'error' THEN 'Popunder' END AS click_id_source,
               CASE WHEN event_id % 3 = 0 THEN 'g' || CAST(event_id AS VARCHAR) END AS session_google_click_id_30_days,
               CASE WHEN event_id % 3 = 1 THEN 'm' || CAST(event_id AS VARCHAR) END AS session_microsoft_click_id_30_days,
               CASE WHEN event_id % 4 <> 0 THEN value * 0.8 END AS estimated_group_commission_after_cancellations_updated_eur,
               CASE WHEN event_id % 4 <> 1 THEN value * 0.7 END AS estimated_commission_reported_after_cancellations_updated_eur,
               CASE WHEN event_id % 4 <> 2 THEN value * 0.6 END AS estimated_group_commission_direct_after_cancellations_updated_eur,
               CASE WHEN event_id % 4 NOT IN (2, 3) THEN value * 0.5 END AS estimated_commission_reported_direct_after_cancellations_updated_eur,
               value * 0.1 AS revenue_add_ons,
               CAST(NULL AS DOUBLE) AS revenue_service_fee,
               CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS booking_quantity_before_cancellations
        FROM events""",
    "google_clicks": """
        SELECT 'g' || CAST(event_id AS VARCHAR) AS google_click_id,
               'acc' || CAST(user_id % 3 AS VARCHAR) AS mkt_account_id,
               ts AS mkt_date
        FROM events WHERE event_id % 3 = 0""",
    "unqualified_bookings": """
        SELECT event_id AS session_id,
               ts AS click_id_timestamp,
               CASE WHEN event_id % 3 = 0 THEN 'g' || CAST(event_id AS VARCHAR) END AS session_google_click_id_30_days,
               CASE WHEN event_id % 3 = 1 THEN 'm' || CAST(event_id AS VARCHAR) END AS session_microsoft_click_id_30_days,
               value AS imputed_revenue_after_cancellations_adjusted
        FROM events WHERE event_type = 'purchase'""",
    "subscription_revenue": """
        SELECT event_id AS click_id,
               CASE WHEN event_id % 2 = 0 THEN 'B2C_limited_leads' ELSE 'other' END AS subscription_type,
               CASE WHEN event_id % 5 <> 0 THEN value * 0.3 END AS subscription_revenue_direct_attribution
        FROM events WHERE event_type = 'view'""",
    "estimates": """
        SELECT event_id AS click_id,
               CAST(user_id % 5 AS VARCHAR) AS provider_id,
               CAST(user_id % 3 AS VARCHAR) AS site_id,
               CAST(event_id % 2 AS VARCHAR) AS device_type,
               CAST(user_id % 4 AS VARCHAR) AS app_id,
               ts AS click_id_timestamp,
               value + 1 AS actual_offsite_booking_rev,
               value * (0.8 + 0.04 * (event_id % 11)) AS estimated_offsite_booking_rev
        FROM events WHERE event_type = 'purchase'""",
    "budgets": """
        SELECT CAST(l_shipdate AS DATE) AS mkt_date,
               l_orderkey AS id,
               l_suppkey AS mkt_account_id,
               CASE WHEN l_linenumber < 7 THEN l_partkey % 40 END AS bid_strategy_id,
               l_quantity * 100 AS day_budget,
               l_quantity * 120 AS recommended_budget_amount,
               l_extendedprice * l_tax AS conversions_value,
               l_extendedprice * l_discount AS mkt_cost,
               CAST(l_linenumber AS BIGINT) AS conversions
        FROM lineitem""",
    "strategies": """
        SELECT CAST(l_shipdate AS DATE) AS mkt_date,
               l_partkey % 40 AS bidding_strategy_id,
               CASE WHEN (l_partkey % 40) % 2 = 0 THEN 'Target ROAS' ELSE 'Maximize Conversion Value' END AS bidding_strategy_type
        FROM lineitem""",
    "cases": """
        SELECT l_orderkey * 10 + l_linenumber AS case_id,
               l_shipdate AS created_datetime,
               CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS owner_is_autoclose_queue,
               CASE WHEN l_partkey % 10 = 0 THEN 'Sales' ELSE 'Customer Service' END AS business_domain_channel,
               CASE l_suppkey % 8 WHEN 0 THEN 'DE' WHEN 1 THEN 'EN' WHEN 2 THEN 'NL' WHEN 3 THEN 'IT'
                    WHEN 4 THEN 'ES' WHEN 5 THEN 'FR' WHEN 6 THEN 'PL' ELSE 'SV' END AS language_channel,
               CASE WHEN l_linestatus = 'F' THEN 'Payment issue' ELSE 'Other' END AS sub_topic
        FROM lineitem WHERE l_returnflag = 'R'""",
    "conversions": """
        SELECT o_orderdate AS conversion_date,
               o_orderkey AS on_site_order_id,
               CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS is_platform_payment
        FROM orders""",
    "inventory": """
        SELECT CAST(l_shipdate AS DATE) AS dt,
               l_partkey AS offer_id,
               CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS offers_payment
        FROM lineitem""",
    "dim_site": """
        SELECT 'site' || CAST(n_nationkey AS VARCHAR) || CASE WHEN n_nationkey % 2 = 0 THEN '.de' ELSE '.ch' END AS site_id,
               CASE WHEN n_nationkey % 7 = 0 THEN NULL WHEN n_nationkey % 7 = 1 THEN 'vacaro'
                    WHEN n_nationkey % 7 = 2 THEN 'casalia' ELSE 'northstay' END AS legal_entity
        FROM nation""",
    "main_revenues": """
        SELECT CAST(o.o_orderdate AS DATE) AS date,
               o.o_orderkey AS conversion_click_id,
               'site' || CAST(n.n_nationkey AS VARCHAR) || CASE WHEN n.n_nationkey % 2 = 0 THEN '.de' ELSE '.ch' END AS site_id,
               r.r_name AS site_global_region,
               o.o_custkey % 10 = 0 AS inter_company_group,
               CASE WHEN c.c_mktsegment = 'HOUSEHOLD' THEN 'Click and lead deals' ELSE c.c_mktsegment END AS deal_type,
               CAST(1 AS BIGINT) AS conversions,
               o.o_totalprice AS est_revenue_before_cancellations,
               CASE WHEN o.o_orderstatus = 'F' THEN 0.0 ELSE o.o_totalprice END AS est_revenue,
               o.o_totalprice * 0.1 AS revenue,
               CASE WHEN o.o_orderkey % 3 = 0 THEN CAST(o.o_orderdate AS DATE) + 1 ELSE CAST(o.o_orderdate AS DATE) END AS date_ifrs
        FROM orders o
        JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "keyword_master": """
        SELECT CASE WHEN p_size % 2 = 0 THEN 'city' ELSE 'region' END AS object_type,
               'tpl' || CAST(p_size % 3 AS VARCHAR) AS template,
               p_name AS keyword,
               CASE WHEN p_size % 2 = 0 THEN 'city' ELSE 'region' END || ' ' || p_name AS object_type_keyword,
               p_partkey AS location_id,
               p_type AS location_name,
               'base' AS word_form,
               string_split(p_name, ' ')[-1] AS amenity_keyword,
               p_brand AS prefix,
               CASE WHEN p_size % 9 = 0 THEN 'True' ELSE 'False' END AS is_blacklisted,
               CASE WHEN p_size % 11 = 0 THEN 'True' ELSE 'False' END AS is_blacklisted_amenity,
               CASE WHEN p_partkey % 2 = 0 THEN 'DE' ELSE 'US' END AS market
        FROM part""",
    "keyword_volume": """
        SELECT p_name AS keyword,
               CASE WHEN p_partkey % 2 = 0 THEN 'DE' ELSE 'US' END AS market,
               CAST(DATE '2022-06-01' + to_months(CAST(p_partkey % 18 AS INTEGER)) AS DATE) AS year_month,
               CAST(p_size AS BIGINT) AS google_search_volume
        FROM part""",
    "search_terms_raw": """
        SELECT CASE WHEN p_partkey % 7 = 0 THEN t0 || ' extra' ELSE t0 END AS search_term,
               CASE WHEN impr >= 1000 THEN CAST(impr // 1000 AS VARCHAR) || ',' || lpad(CAST(impr % 1000 AS VARCHAR), 3, '0')
                    ELSE CAST(impr AS VARCHAR) END AS impr,
               CAST(p_size AS VARCHAR) AS clicks,
               CASE WHEN p_partkey % 5 = 0 THEN ' --' ELSE CAST(p_size % 10 AS VARCHAR) || '.5%' END AS cr,
               CASE WHEN p_partkey % 6 = 0 THEN ' --' ELSE CAST(p_size * 3 AS VARCHAR) || '%' END AS roas,
               CASE WHEN p_partkey % 4 = 0 THEN ' --' ELSE CAST(p_size % 3 AS VARCHAR) END AS bookings,
               '€' || CASE WHEN cents // 100 >= 1000
                           THEN CAST(cents // 100 // 1000 AS VARCHAR) || ',' || lpad(CAST(cents // 100 % 1000 AS VARCHAR), 3, '0')
                           ELSE CAST(cents // 100 AS VARCHAR) END
                   || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS revenue
        FROM (SELECT p_partkey, p_size, CAST(p_size AS BIGINT) * 113 AS impr,
                     CAST(round(p_retailprice * 100) AS BIGINT) AS cents,
                     CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN ' ' || p_name || '  '
                          ELSE p_name END AS t0
              FROM part) q""",
}


def with_views(body: str, *names: str) -> str:
    """``WITH <view CTEs> <body>``; ``body`` may start with further CTEs
    written as ``name AS (...)`` items when it begins with a comma."""
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]}\n)" for n in names)
    body = body.strip()
    if body.startswith(","):
        return f"WITH {ctes}{body}"
    return f"WITH {ctes}\n{body}"


def rounded(body: str, cols: dict[str, int]) -> str:
    """Wrap a query so that the named float columns are rounded."""
    if not cols:
        return body
    # round(x * 10^d) / 10^d, half away from zero on the scaled double: the
    # same arithmetic as the Spark side (registry.round_half_away); "+ 0.0"
    # turns a negative zero into zero.
    rep = ", ".join(f"round({c} * 1e{d}) / 1e{d} + 0.0 AS {c}" for c, d in cols.items())
    return f"SELECT * REPLACE ({rep}) FROM (\n{body}\n) q__"
