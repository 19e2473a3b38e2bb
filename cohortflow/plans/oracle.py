"""Oracle SQL for DuckDB: the report from its rules, as set definitions.

The Spark code answers all months and verticals with bitmask aggregates; the
oracle writes the same rules down as sets and is independent of that method:

* ``placed``     every order row with the scopes (verticals) it belongs to;
* ``visits``     who ordered in which month and scope, ``buys`` who bought;
* ``acquired``, ``fresh``, ``back``  the three segments, with ``NOT IN`` where
                 the rules say so, per month and scope;
* ``marks``      incentives per order id;
* the report counts distinct users and distinct orders with ``FILTER``.

Adapter CTEs map the driver's tables (orders, customer, supplier, lineitem,
part, nation) to the logical tables with flat column names (FIXTURES.md F-B).
"""

from __future__ import annotations

from ..params import DRIVER_PARAMS, ReportParams, add_months, month_end

ADAPTER_CTES = """
ord_first AS (
  SELECT o_orderkey,
         row_number() OVER (PARTITION BY o_custkey, (o_orderstatus IN ('F','P'))
                            ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders),
ord_partner AS (
  SELECT l_orderkey, min(l_suppkey) AS partner_id FROM lineitem GROUP BY l_orderkey),
driver_orders AS (
  SELECT o.o_orderkey AS order_id,
         o.o_custkey AS user_id,
         op.partner_id AS partner_id,
         CAST(o.o_orderdate AS DATE) AS registered_date,
         CASE WHEN c.c_nationkey < 20 THEN 3 ELSE 1 END AS country_id,
         CASE WHEN o.o_orderstatus IN ('F','P') THEN 'CONFIRMED' ELSE 'REJECTED' END AS order_status,
         (o.o_orderstatus IN ('F','P') AND f.rn = 1) AS first_successful,
         CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS has_voucher_discount,
         CAST(CASE WHEN o.o_orderpriority = '5-LOW' THEN 0.0 ELSE 9.5 END AS DOUBLE) AS shipping_amount_no_discount,
         (o.o_orderkey % 2 = 0) AS with_logistics,
         CASE WHEN c.c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS is_user_plus
  FROM orders o
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN ord_partner op ON op.l_orderkey = o.o_orderkey
  LEFT JOIN ord_first f ON f.o_orderkey = o.o_orderkey),
fact_orders AS ({fact}),
fact_details AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, (l_discount >= 0.09) AS is_subsidized
  FROM lineitem),
fact_discounts AS (
  SELECT l_orderkey AS order_id, l_discount AS amount FROM lineitem WHERE l_discount > 0),
driver_partners AS (
  SELECT s_suppkey AS partner_id,
         CASE s_suppkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END AS is_darkstore,
         CASE s_suppkey % 8 WHEN 0 THEN 'Restaurant' WHEN 1 THEN 'Coffee' WHEN 2 THEN 'Market'
              WHEN 3 THEN 'Market' WHEN 4 THEN 'Pharmacy' WHEN 5 THEN 'Drinks'
              WHEN 6 THEN 'Kiosks' ELSE NULL END AS business_type_name,
         CASE s_suppkey % 7 WHEN 0 THEN 'Supermercados' WHEN 1 THEN 'minimercado'
              WHEN 2 THEN 'Express' WHEN 3 THEN 'Carnes' WHEN 4 THEN NULL ELSE 'Bodega' END
           AS category_name,
         CAST(s_nationkey AS BIGINT) AS city_id,
         CAST(s_nationkey AS BIGINT) AS franchise_id
  FROM supplier),
dim_partner AS ({partner}),
fact_talon_coupons AS (
  SELECT l_orderkey AS order_id, l_partkey % 6 AS talon_campaign_id, l_shipdate AS coupon_created_at
  FROM lineitem WHERE l_returnflag = 'R'),
dim_talon_campaigns AS (
  SELECT CAST(talon_campaign_id AS BIGINT) AS talon_campaign_id, talon_campaign_name
  FROM (VALUES (0, 'AR-LOCAL-1'), (1, 'AR-CENTRAL-2'), (2, 'COOP-3'), (3, 'local-4'),
               (4, 'OTHER-5'), (5, NULL)) t(talon_campaign_id, talon_campaign_name)),
fact_wallet AS (
  SELECT o_orderkey AS order_id,
         CASE WHEN o_orderkey % 3 = 0 THEN 'COOP-W' ELSE 'GIFT' END AS campaign_name
  FROM orders WHERE o_orderkey % 11 = 0),
order_log AS (
  SELECT o_orderkey AS id, o_orderkey AS order_id FROM orders WHERE o_orderkey % 13 = 0),
campaign_log_items AS (
  SELECT l_partkey AS id, l_orderkey AS order_log_id FROM lineitem WHERE l_orderkey % 13 = 0),
campaign AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS name FROM part),
agg_user_lifecycle AS (SELECT c_custkey AS user_id FROM customer),
dim_user AS (SELECT c_custkey AS user_id FROM customer),
regiones_oficinas_kam AS (SELECT s_suppkey AS Id FROM supplier),
dim_city AS (SELECT CAST(n_nationkey AS BIGINT) AS city_id FROM nation),
dim_product AS (SELECT p_partkey AS product_id FROM part),
product AS (SELECT p_partkey AS id FROM part),
dim_subsidized_product AS (
  SELECT p_partkey AS product_id, p_partkey % 3 AS subsidized_product_campaing_id
  FROM part WHERE p_partkey % 5 = 0),
dim_subsidized_campaign AS (
  SELECT CAST(subsidized_campaign_id AS BIGINT) AS subsidized_campaign_id
  FROM (VALUES (0), (1)) t(subsidized_campaign_id))
"""

# The rules of the verticals over the columns of a partner.
OPEN_STORE = "is_darkstore IS NOT TRUE"
OTHER_THAN_FOOD = "business_type_name NOT IN ('Restaurant', 'Coffee')"
CATEGORY = "upper(coalesce(category_name, 'Without Category'))"
SUPERMARKET = f"(starts_with({CATEGORY}, 'SUPERMERCADO') OR starts_with({CATEGORY}, 'MINIMERCADO') OR {CATEGORY} = 'EXPRESS')"
MARKET_LABEL = (f"CASE WHEN {SUPERMARKET} THEN 'Supermercados' "
                "WHEN upper(business_type_name) = 'MARKET' AND is_darkstore = FALSE THEN 'Comercios Especializados' END")


def seg_pred(v: str) -> str:
    """Whether a partner counts for the segments of a vertical."""
    rules = {"DMarts": "is_darkstore", "QC": OTHER_THAN_FOOD, "Local Stores": f"{OPEN_STORE} AND {OTHER_THAN_FOOD}"}
    return rules.get(v, f"{OPEN_STORE} AND business_type_name = '{v}'")


def final_pred(v: str) -> str:
    """Whether a partner's orders are counted in the report of a vertical."""
    return "business_type_name = 'Market'" if v == "Market" else seg_pred(v)


def vertical_expr(v: str) -> str:
    return MARKET_LABEL if v == "Market" else f"'{v}'"


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def with_adapter(body: str, ctes: str = "", fact: str = "FROM driver_orders", partner: str = "FROM driver_partners") -> str:
    """``body`` over the logical tables; ``fact`` and ``partner`` may be other rows derived from the driver's."""
    more = f",\n{ctes}" if ctes else ""
    return f"WITH {ADAPTER_CTES.replace('{fact}', fact).replace('{partner}', partner)}{more}\n{body}"


def months_cte(p: ReportParams) -> str:
    """mo: label, first and last day, first and last day of the month before."""
    rows = ", ".join(f"('{m:%Y-%m}', DATE '{m}', DATE '{month_end(m)}', DATE '{add_months(m, -1)}', DATE '{month_end(add_months(m, -1))}')"
                     for m in p.report_months())
    return f"mo(label, a, z, before_a, before_z) AS (VALUES {rows})"


def segment_ctes(p: ReportParams, verticals) -> str:
    """placed, visits, acquired, fresh, back, labels for all months and verticals."""
    scopes = union(f"SELECT '{v}' AS scope, partner_id AS scope_partner FROM dim_partner WHERE {seg_pred(v)}" for v in verticals)
    return f"""{months_cte(p)},
scoped_partner AS ({scopes}),
placed AS (
  SELECT s.scope, f.user_id, f.registered_date AS d, f.order_status = 'CONFIRMED' AS bought, f.first_successful AS first_buy
  FROM scoped_partner s JOIN fact_orders f ON f.partner_id = s.scope_partner
  WHERE f.country_id = {p.country_id}),
visits AS (
  SELECT mo.label, placed.scope, placed.user_id, coalesce(bool_or(bought), FALSE) AS bought,
         coalesce(bool_or(bought AND first_buy), FALSE) AS first_buy
  FROM mo JOIN placed ON placed.d BETWEEN mo.a AND mo.z GROUP BY ALL),
history AS (
  SELECT DISTINCT mo.label, placed.scope, placed.user_id
  FROM mo JOIN placed ON placed.d BETWEEN DATE '{p.history_start}' AND mo.before_z WHERE bought),
month_before AS (
  SELECT DISTINCT mo.label, placed.scope, placed.user_id
  FROM mo JOIN placed ON placed.d BETWEEN mo.before_a AND mo.before_z WHERE bought),
acquired AS (SELECT label, scope, user_id, CAST(bought AS BIGINT) AS users FROM visits WHERE first_buy),
fresh AS (
  SELECT label, scope, user_id, CAST(bought AS BIGINT) AS users FROM visits v
  WHERE user_id NOT IN (SELECT h.user_id FROM history h WHERE h.label = v.label AND h.scope = v.scope)
    AND user_id NOT IN (SELECT q.user_id FROM acquired q WHERE q.label = v.label AND q.scope = v.scope)),
back AS (
  SELECT label, scope, user_id FROM visits v
  WHERE bought
    AND user_id NOT IN (SELECT b.user_id FROM month_before b WHERE b.label = v.label AND b.scope = v.scope)
    AND NOT EXISTS (FROM acquired q WHERE q.label = v.label AND q.scope = v.scope AND q.user_id = v.user_id)
    AND NOT EXISTS (FROM fresh n WHERE n.label = v.label AND n.scope = v.scope AND n.user_id = v.user_id)),
labels AS (
  SELECT label, scope, user_id, 'Reactivados' AS user_type FROM back WHERE user_id IS NOT NULL
  UNION ALL SELECT label, scope, user_id, 'Acquisition' FROM acquired WHERE user_id IS NOT NULL
  UNION ALL SELECT label, scope, user_id, 'New Users' FROM fresh WHERE user_id IS NOT NULL)"""


def marks_cte(p: ReportParams) -> str:
    """marks: per order id, whether its coupons, wallet and log name an incentive."""
    return f"""marks AS (
  SELECT order_id, bool_or(kind = 'crm') AS crm, bool_or(kind = 'coop') AS coop, bool_or(kind = 'bank') AS bank
  FROM (
    SELECT k.order_id, CASE WHEN contains(n.talon_campaign_name, 'LOCAL') OR contains(n.talon_campaign_name, 'CENTRAL') THEN 'crm' END AS kind
    FROM fact_talon_coupons k JOIN dim_talon_campaigns n USING (talon_campaign_id)
    WHERE CAST(k.coupon_created_at AS DATE) > DATE '{p.coupon_cutoff}'
    UNION ALL
    SELECT k.order_id, CASE WHEN contains(n.talon_campaign_name, 'COOP') THEN 'coop' END
    FROM fact_talon_coupons k JOIN dim_talon_campaigns n USING (talon_campaign_id)
    WHERE CAST(k.coupon_created_at AS DATE) > DATE '{p.coupon_cutoff}'
    UNION ALL
    SELECT order_id, CASE WHEN contains(campaign_name, 'COOP') THEN 'coop' END FROM fact_wallet
    UNION ALL
    SELECT g.order_id, 'bank' FROM order_log g JOIN campaign_log_items i ON i.order_log_id = g.id
    JOIN campaign b ON b.id = i.{p.campaign_item_key} WHERE b.name IS NOT NULL)
  GROUP BY order_id)"""


def flags_select(p: ReportParams) -> str:
    """The seven tests of an order row ``f`` with its marks ``k`` (NULL counts as false)."""
    t = {"ok": "f.order_status = 'CONFIRMED'", "vou": "f.has_voucher_discount > 0", "crm": "k.crm", "coop": "k.coop", "bank": "k.bank",
         "df0": "f.shipping_amount_no_discount = 0 AND f.with_logistics", "plus": "f.is_user_plus = 1"}
    return ", ".join(f"coalesce({c}, FALSE) AS {n}" for n, c in t.items())


def incentive(p: ReportParams) -> str:
    """The incentive test: only the voucher needs a CONFIRMED order, unless all are to."""
    rest = "crm OR df0 OR coop OR bank OR plus"
    return f"(ok AND (vou OR {rest}))" if p.strict_confirmed else f"((ok AND vou) OR {rest})"


def counts(p: ReportParams) -> str:
    """The ten counts of the report over rows of flags."""
    users = {"q_user_voucher": "vou", "Vouchers_CRM": "crm", "q_user_df0": "df0", "q_user_corporate": "coop",
             "q_user_banks": "bank", "q_user_plus": "plus"}
    rows = [f"count(DISTINCT g.user_id) FILTER (WHERE ok AND {f}) AS {n}" for n, f in users.items()]
    rows += ["count(DISTINCT g.user_id) FILTER (WHERE ok) AS q_user_totales", "count(DISTINCT g.order_id) FILTER (WHERE ok) AS q_orders_totales",
             f"count(DISTINCT g.user_id) FILTER (WHERE {incentive(p)}) AS q_users_incentive",
             f"count(DISTINCT g.order_id) FILTER (WHERE {incentive(p)}) AS q_orders_incentive"]
    return ",\n       ".join(rows)


def flagged_cte(p: ReportParams, verticals) -> str:
    """flagged: order rows of the country with flags, one per scope and label they are reported under."""
    places = union(f"SELECT '{v}' AS scope, {vertical_expr(v)} AS vertical, partner_id AS place FROM dim_partner WHERE {final_pred(v)}"
                   for v in verticals)
    return f"""{marks_cte(p)},
report_place AS (SELECT DISTINCT * FROM ({places}) WHERE vertical IS NOT NULL),
flagged AS (
  SELECT r.scope, r.vertical, f.order_id, f.user_id, f.registered_date AS d, strftime(f.registered_date, '%Y-%m') AS label, {flags_select(p)}
  FROM report_place r JOIN fact_orders f ON f.partner_id = r.place LEFT JOIN marks k ON k.order_id = f.order_id
  WHERE f.country_id = {p.country_id})"""


def report_sql(p: ReportParams = DRIVER_PARAMS, verticals=None, adapter: bool = True, **tables: str) -> str:
    """All months and verticals; with the adapter CTEs at the head, or over
    logical tables registered under their own names."""
    verticals = verticals or p.verticals
    ctes = f"{segment_ctes(p, verticals)},\n{flagged_cte(p, verticals)}"
    body = f"""SELECT g.label AS "Month", g.vertical, l.user_type,
       {counts(p)}
FROM flagged g JOIN labels l ON l.label = g.label AND l.scope = g.scope AND l.user_id = g.user_id
GROUP BY g.label, g.scope, g.vertical, l.user_type"""
    return with_adapter(body, ctes, **tables) if adapter else f"WITH {ctes}\n{body}"


def segment_sql(cte: str, columns: str, p: ReportParams = DRIVER_PARAMS, **tables: str) -> str:
    """Rows of one segment: Month, vertical, user and more; NULL users never join to an order."""
    return with_adapter(f'SELECT label AS "Month", scope AS vertical, {columns} FROM {cte} WHERE user_id IS NOT NULL',
                        segment_ctes(p, p.verticals), **tables)


def metric_sql(cols, p: ReportParams = DRIVER_PARAMS) -> str:
    """Some of the ten counts per (Month, vertical) over every month."""
    return with_adapter(f"""SELECT "Month", vertical, {', '.join(cols)} FROM (
  SELECT label AS "Month", vertical, {counts(p)} FROM flagged g GROUP BY label, scope, vertical)""", flagged_cte(p, p.verticals))


def anti_sql(p: ReportParams = DRIVER_PARAMS, **tables: str) -> str:
    """Buyers of a month and scope NOT IN the buyers of the month before."""
    return with_adapter("""SELECT label AS "Month", scope AS vertical, user_id FROM visits v
WHERE bought AND user_id NOT IN (SELECT b.user_id FROM month_before b WHERE b.label = v.label AND b.scope = v.scope)""",
                        segment_ctes(p, p.verticals), **tables)


def order_flags_sql(p: ReportParams = DRIVER_PARAMS) -> str:
    return with_adapter(f"""SELECT order_id, ok AS is_confirmed, ok AND vou AS f_voucher, ok AND crm AS f_crm, ok AND df0 AS f_df0,
       ok AND coop AS f_corporate, ok AND bank AS f_banks, ok AND plus AS f_plus, {incentive(p)} AS f_incentive
FROM (SELECT f.order_id, {flags_select(p)} FROM fact_orders f LEFT JOIN marks k ON k.order_id = f.order_id)""", marks_cte(p))
