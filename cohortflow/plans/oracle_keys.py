"""Oracle SQL (DuckDB) for every registered query key.

Reports and segments come from the set definitions of ``oracle.py``; the
single-operator keys are plain SQL over the adapter CTEs.
"""

from __future__ import annotations

from ..params import DRIVER_PARAMS, VERTICALS, ReportParams
from .oracle import (MARKET_LABEL, anti_sql, metric_sql, months_cte, order_flags_sql, report_sql, seg_pred,
                     segment_sql, union, with_adapter)
from .queries import METRIC_KEYS, slug

P: ReportParams = DRIVER_PARAMS

FO_DP = "FROM fact_orders fo LEFT JOIN dim_partner dp ON dp.partner_id = fo.partner_id"

#: Orders whose ids repeat: other status, other partner, other user, or no id at all.
REPEATED_ORDERS = """
  SELECT * FROM driver_orders
  UNION ALL
  SELECT * REPLACE (CASE WHEN order_status = 'CONFIRMED' THEN 'REJECTED' ELSE 'CONFIRMED' END AS order_status)
  FROM driver_orders WHERE order_id % 7 = 0
  UNION ALL
  SELECT * REPLACE (partner_id + 1 AS partner_id, 1 - has_voucher_discount AS has_voucher_discount)
  FROM driver_orders WHERE order_id % 5 = 0
  UNION ALL
  SELECT * REPLACE (user_id + 1 AS user_id) FROM driver_orders WHERE order_id % 3 = 0
  UNION ALL
  SELECT * REPLACE (CAST(NULL AS BIGINT) AS order_id) FROM driver_orders WHERE order_id % 11 = 0"""

#: A placeholder id on a third of all rows.
HOT_ORDER = """
  SELECT * REPLACE (CASE WHEN order_id % 3 = 0 THEN CAST(13 AS BIGINT) ELSE order_id END AS order_id) FROM driver_orders"""

#: Partners listed twice, every sixth one with another category.
REPEATED_PARTNERS = """
  SELECT * FROM driver_partners
  UNION ALL
  SELECT * REPLACE (CASE WHEN partner_id % 6 = 0 THEN 'Bodega' ELSE category_name END AS category_name)
  FROM driver_partners WHERE partner_id % 3 = 0"""

#: Users unknown on a few days, and in a few first purchases.
NULL_USERS = f"""
  SELECT * REPLACE (CASE WHEN order_id % 16 = 0 AND registered_date BETWEEN DATE '1997-05-01' AND DATE '1997-05-20'
                           OR first_successful AND registered_date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31' AND order_id % 3 = 0
                         THEN NULL ELSE user_id END AS user_id)
  FROM driver_orders"""


def build_oracle() -> dict[str, str]:
    lo, hi = P.report_months()[-1], P.range_end
    sql = {
        "report_all": report_sql(P),
        "union_reports": report_sql(P),
        "sink_roundtrip": report_sql(P),
        "seg_labels": segment_sql("labels", "user_id, user_type"),
        "seg_new_users": segment_sql("fresh", "user_id, users"),
        "seg_acquisitions": segment_sql("acquired", "user_id, users"),
        "seg_reactivated": segment_sql("back", "user_id"),
        "anti_null_aware": anti_sql(),
        "src_fact_orders": with_adapter("SELECT * FROM fact_orders"),
        "src_dim_partner": with_adapter(
            "SELECT partner_id, is_darkstore, business_type_name, category_name, city_id "
            "FROM dim_partner"),
        "nested_fields": with_adapter(
            f"SELECT fo.order_id, fo.user_id, fo.partner_id, fo.first_successful, "
            f"dp.business_type_name, dp.category_name {FO_DP}"),
        "fn_month_label": with_adapter(
            "SELECT order_id, strftime(registered_date, '%Y-%m') AS Month FROM fact_orders"),
        "report_incremental": report_sql(P),
        "report_repeated_orders": report_sql(P, fact=REPEATED_ORDERS),
        "report_hot_order": report_sql(P, fact=HOT_ORDER),
        "sink_months": report_sql(P),
        "join_partner_repeated": report_sql(P, partner=REPEATED_PARTNERS),
        "seg_null_users": segment_sql("labels", "user_id, user_type", fact=NULL_USERS),
        "report_null_users": report_sql(P, fact=NULL_USERS),
        "anti_null_users": anti_sql(fact=NULL_USERS),
        "report_months": with_adapter("""
SELECT mo.label AS "Month", a AS from_date, z AS to_date, before_a AS from_date_lm, before_z AS to_date_lm, count(f.registered_date) AS orders
FROM mo LEFT JOIN fact_orders f ON f.registered_date BETWEEN mo.a AND mo.z GROUP BY ALL""", months_cte(P)),
        "month_windows": with_adapter("""
SELECT strftime(m, '%Y-%m') AS Month, m AS from_date, CAST(last_day(m) AS DATE) AS to_date,
       CAST(m - INTERVAL 1 MONTH AS DATE) AS from_date_lm, CAST(m - INTERVAL 1 DAY AS DATE) AS to_date_lm
FROM (SELECT DISTINCT CAST(date_trunc('month', registered_date) AS DATE) AS m FROM fact_orders)"""),
        "filter_date_between": with_adapter(
            f"SELECT order_id, strftime(registered_date, '%Y-%m') AS Month FROM fact_orders "
            f"WHERE registered_date BETWEEN '{lo}' AND '{hi}'"),
        "filter_country": with_adapter(
            f"SELECT order_id, user_id FROM fact_orders WHERE country_id = {P.country_id}"),
        "filter_confirmed": with_adapter(
            "SELECT order_id, user_id FROM fact_orders WHERE order_status = 'CONFIRMED'"),
        "scope_membership": with_adapter(union(
            f"SELECT fo.order_id, '{v}' AS vertical FROM fact_orders fo "
            f"JOIN dim_partner dp ON dp.partner_id = fo.partner_id WHERE {seg_pred(v)}"
            for v in VERTICALS)),
        "market_sublabel": with_adapter(
            f"SELECT order_id, vertical FROM (SELECT fo.order_id, {MARKET_LABEL} AS vertical "
            f"{FO_DP} WHERE dp.business_type_name = 'Market') WHERE vertical IS NOT NULL"),
        "join_partner": with_adapter(
            f"SELECT fo.order_id, fo.partner_id, dp.is_darkstore, dp.business_type_name {FO_DP}"),
        "enrich_region": with_adapter(
            "SELECT fo.order_id, fo.partner_id, r.Id AS region_id FROM fact_orders fo "
            "LEFT JOIN regiones_oficinas_kam r ON fo.partner_id = r.Id"),
        "enrich_user": with_adapter(
            "SELECT fo.order_id, fo.user_id, aul.user_id AS aul_user_id, du.user_id AS du_user_id "
            "FROM fact_orders fo LEFT JOIN agg_user_lifecycle aul ON fo.user_id = aul.user_id "
            "LEFT JOIN dim_user du ON fo.user_id = du.user_id"),
        "enrich_city": with_adapter(
            "SELECT dp.partner_id, dp.city_id AS partner_city_id, dim_city.city_id "
            "FROM dim_partner dp LEFT JOIN dim_city ON dp.city_id = dim_city.city_id"),
        "enrich_product": with_adapter(
            "SELECT fo.order_id, fd.product_id, dim_product.product_id AS dim_product_id, "
            "pr.id AS product_ref_id FROM fact_orders fo "
            "LEFT JOIN fact_details fd ON fd.order_id = fo.order_id "
            "LEFT JOIN dim_product ON fd.product_id = dim_product.product_id "
            "LEFT JOIN product pr ON dim_product.product_id = pr.id"),
        "enrich_subsidized": with_adapter(
            "SELECT fo.order_id, fd.product_id, fd.is_subsidized, dsp.product_id AS subsidized_product_id, "
            "dsc.subsidized_campaign_id FROM fact_orders fo "
            "LEFT JOIN fact_details fd ON fd.order_id = fo.order_id "
            "LEFT JOIN dim_subsidized_product dsp ON fd.product_id = dsp.product_id AND fd.is_subsidized = true "
            "LEFT JOIN dim_subsidized_campaign dsc "
            "ON dsp.subsidized_product_campaing_id = dsc.subsidized_campaign_id"),
        "unnest_details": with_adapter(
            "SELECT fo.order_id, fd.product_id, fd.is_subsidized, CAST(NULL AS DOUBLE) AS amount "
            "FROM fact_orders fo LEFT JOIN fact_details fd ON fd.order_id = fo.order_id "
            "UNION ALL "
            "SELECT fx.order_id, CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN), fx.amount "
            "FROM fact_orders fo JOIN fact_discounts fx ON fx.order_id = fo.order_id"),
        "unnest_singleton": with_adapter(
            "SELECT partner_id, franchise_id, business_type_name FROM dim_partner"),
        "coupon_window": with_adapter(f"""
SELECT k.order_id,
       bool_or(coalesce(contains(n.talon_campaign_name, 'LOCAL') OR contains(n.talon_campaign_name, 'CENTRAL'), FALSE)) AS crm,
       bool_or(coalesce(contains(n.talon_campaign_name, 'COOP'), FALSE)) AS coop
FROM fact_talon_coupons k LEFT JOIN dim_talon_campaigns n USING (talon_campaign_id)
WHERE CAST(k.coupon_created_at AS DATE) > DATE '{P.coupon_cutoff}'
GROUP BY k.order_id"""),
        "bank_campaign": with_adapter(
            "SELECT DISTINCT ol.order_id FROM order_log ol "
            "JOIN campaign_log_items cli ON ol.id = cli.order_log_id "
            "JOIN campaign c ON cli.id = c.id WHERE c.name IS NOT NULL AND ol.order_id IS NOT NULL"),
        "order_flags": order_flags_sql(),
    }
    for v in VERTICALS:
        sql[f"report_{slug(v)}"] = report_sql(P, [v])
        sql[f"scope_{slug(v)}"] = with_adapter(
            f"SELECT fo.order_id, fo.partner_id {FO_DP} WHERE {seg_pred(v)}")
    for k, cols in METRIC_KEYS.items():
        sql[k] = metric_sql(cols)
    return sql
