"""

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the logical
tables derived from the driver tables (``staging.staged_catalog``) -- whole
tables, no sampling. Column
names match the oracle SQL in ``oracle_keys.py``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import month_label, month_start, report_months_df, with_month_windows
from ..functions.scopes import flat_partner, market_sublabel, partner_scopes, segment_predicate
from ..incremental.monthly_state import months_to_refresh, report_from_rollup, update_month, update_months
from ..operators import enrich
from ..operators.anti import not_in
from ..operators.base import flat_orders, order_base
from ..operators.flags import bank_campaign_orders, coupons_after_cutoff, order_metric_flags, \
    order_incentives, coop_sql, crm_sql
from ..operators.report import monthly_reports, report, scope_month_metrics
from ..operators.segments import ACQUISITION, NEW_USERS, REACTIVATED, segments
from ..params import CONFIRMED, DRIVER_PARAMS, VERTICALS, ReportParams, add_months
from ..session import shared_path
from ..sources.catalog import Catalog
from ..sources.sinks import append_months, roundtrip_csv
from ..sources.staging import staged_catalog

P: ReportParams = DRIVER_PARAMS

Query = Callable[[SparkSession, str], DataFrame]


def _cat(spark: SparkSession, sf_dir: str) -> Catalog:
    """Logical tables derived from the driver tables (staged once per input)."""
    return staged_catalog(spark, sf_dir)


def slug(v: str) -> str:
    return v.lower().replace(" ", "_")


# ---- reports -------------------------------------------------------------

def q_report_all(spark, sf_dir):
    return report(_cat(spark, sf_dir), P)


def q_report_vertical(v: str) -> Query:
    def q(spark, sf_dir):
        return report(_cat(spark, sf_dir), P.with_(verticals=(v,)))
    return q


def q_union_reports(spark, sf_dir):
    """Append of single-month reports (the original's loop), ``unionByName``."""
    return reduce(lambda a, b: a.unionByName(b), monthly_reports(_cat(spark, sf_dir), P))


def q_report_incremental(spark, sf_dir):
    """The report from a monthly rollup: a backfill of the history in one job, then the newest month on its own."""
    cat = _cat(spark, sf_dir)
    path = shared_path(spark, "cohortflow-rollup", uuid.uuid4().hex)
    *history, newest = months_to_refresh(P)
    update_months(cat, P, history, path)
    update_month(cat, P, newest, path)
    return report_from_rollup(cat, spark, P, path)


# ---- the same operators over rows that repeat or lack ids ---------------------

def repeated_orders(f: DataFrame) -> DataFrame:
    """Order rows whose id comes again: other status, other partner, other user, or no id."""
    oid = F.col("order_id")
    status = F.when(F.col("order_status") == CONFIRMED, "REJECTED").otherwise(CONFIRMED)
    return (f.unionByName(f.where(oid % 7 == 0).withColumn("order_status", status))
            .unionByName(f.where(oid % 5 == 0)
                         .withColumn("restaurant", F.struct((F.col("restaurant.id") + 1).alias("id")))
                         .withColumn("has_voucher_discount", (1 - F.col("has_voucher_discount")).cast("int")))
            .unionByName(f.where(oid % 3 == 0).withColumn("user", F.struct((F.col("user.id") + 1).alias("id"))))
            .unionByName(f.where(oid % 11 == 0).withColumn("order_id", F.lit(None).cast("bigint"))))


def repeated_partners(p: DataFrame) -> DataFrame:
    """Partners listed twice, every sixth one with another category."""
    other = F.when(F.col("partner_id") % 6 == 0, "Bodega").otherwise(F.col("businessCategory.name"))
    return p.unionByName(p.where(F.col("partner_id") % 3 == 0).withColumn("businessCategory", F.struct(other.alias("name"))))


def null_users(f: DataFrame) -> DataFrame:
    """Users unknown on a few days, and in a few first purchases."""
    gone = F.expr("""order_id % 16 = 0 AND registered_date BETWEEN DATE'1997-05-01' AND DATE'1997-05-20'
                     OR data.firstSuccessful AND registered_date BETWEEN DATE'1997-03-01' AND DATE'1997-03-31' AND order_id % 3 = 0""")
    return f.withColumn("user", F.struct(F.when(~gone, F.col("user.id")).alias("id")))


def _variant(spark, sf_dir, table: str, change) -> Catalog:
    cat = _cat(spark, sf_dir)
    return cat.with_tables(**{table: change(cat[table])})


def q_report_repeated_orders(spark, sf_dir):
    return report(_variant(spark, sf_dir, "fact_orders", repeated_orders), P)


def hot_order(f: DataFrame) -> DataFrame:
    """A placeholder id on a third of all rows."""
    return f.withColumn("order_id", F.when(F.col("order_id") % 3 == 0, F.lit(13)).otherwise(F.col("order_id")).cast("bigint"))


def q_report_hot_order(spark, sf_dir):
    return report(_variant(spark, sf_dir, "fact_orders", hot_order), P)


def q_join_partner_repeated(spark, sf_dir):
    return report(_variant(spark, sf_dir, "dim_partner", repeated_partners), P)


def q_report_null_users(spark, sf_dir):
    return report(_variant(spark, sf_dir, "fact_orders", null_users), P)


def q_seg_null_users(spark, sf_dir):
    return _segments(_variant(spark, sf_dir, "fact_orders", null_users)).drop("users")


def q_anti_null_users(spark, sf_dir):
    return _anti(_variant(spark, sf_dir, "fact_orders", null_users))


def q_sink_roundtrip(spark, sf_dir):
    return roundtrip_csv(spark, report(_cat(spark, sf_dir), P), "report_all")


def q_sink_months(spark, sf_dir):
    """Months written into one folder run by run: the older ones, the newest, and one older month again."""
    rep = report(_cat(spark, sf_dir), P)
    newest, older = (m.strftime("%Y-%m") for m in (P.report_months()[0], P.report_months()[2]))
    return append_months(spark, [rep.where(F.col("Month") != newest), rep.where(F.col("Month") == newest), rep.where(F.col("Month") == older)])


# ---- segments --------------------------------------------------------------

def _segments(cat: Catalog) -> DataFrame:
    base = order_base(cat, P, P.range_start, P.range_end)
    s = segments(base, P)
    return s.select(month_label(F.col("m")).alias("Month"), F.col("scope").alias("vertical"),
                    "user_id", "user_type", "users")


def q_seg_labels(spark, sf_dir):
    return _segments(_cat(spark, sf_dir)).drop("users")


def q_seg_new_users(spark, sf_dir):
    s = _segments(_cat(spark, sf_dir))
    return s.where(F.col("user_type") == NEW_USERS).select("Month", "vertical", "user_id", "users")


def q_seg_acquisitions(spark, sf_dir):
    s = _segments(_cat(spark, sf_dir))
    return s.where(F.col("user_type") == ACQUISITION).select("Month", "vertical", "user_id", "users")


def q_seg_reactivated(spark, sf_dir):
    s = _segments(_cat(spark, sf_dir))
    return s.where(F.col("user_type") == REACTIVATED).select("Month", "vertical", "user_id")


def q_anti_null_aware(spark, sf_dir):
    return _anti(_cat(spark, sf_dir))


def _anti(cat: Catalog) -> DataFrame:
    """Per reported month and scope: CONFIRMED buyers of the month whose id is
    NOT IN last month's CONFIRMED buyers (SQL NULL semantics)."""
    months = P.report_months()
    # reported months and the month before each: nothing older is read
    base = order_base(cat, P, add_months(months[-1], -1), P.range_end).where(F.col("ok"))
    x = base.select("user_id", "m", F.explode("seg_scopes").alias("vertical"))
    left = x.where(F.col("m").isin(*months)).select("vertical", "m", "user_id").distinct()
    right = x.where(F.col("m").isin(*[add_months(m, -1) for m in months])) \
        .select("vertical", F.add_months("m", 1).alias("m"), "user_id")
    r = not_in(left, right, "user_id", by=["vertical", "m"])
    return r.select(month_label(F.col("m")).alias("Month"), "vertical", "user_id")


# ---- sources, projections, filters ------------------------------------------

def _flat(spark, sf_dir) -> DataFrame:
    return flat_orders(_cat(spark, sf_dir)["fact_orders"])


def q_src_fact_orders(spark, sf_dir):
    return _flat(spark, sf_dir).withColumnRenamed("d", "registered_date")


def q_src_dim_partner(spark, sf_dir):
    return flat_partner(_cat(spark, sf_dir)["dim_partner"], "city_id")


def q_nested_fields(spark, sf_dir):
    cat = _cat(spark, sf_dir)
    f, p = cat["fact_orders"], cat["dim_partner"]
    j = f.join(p, F.col("restaurant.id") == p.partner_id, "left")
    return j.select("order_id", F.col("user.id").alias("user_id"),
                    F.col("restaurant.id").alias("partner_id"),
                    F.col("data.firstSuccessful").alias("first_successful"),
                    F.col("business_type.business_type_name").alias("business_type_name"),
                    F.col("businessCategory.name").alias("category_name"))


def q_fn_month_label(spark, sf_dir):
    f = _flat(spark, sf_dir)
    return f.select("order_id", month_label(F.col("d")).alias("Month"))


def q_month_windows(spark, sf_dir):
    f = _flat(spark, sf_dir)
    months = f.select(month_start(F.col("d")).alias("m")).distinct()
    return with_month_windows(months).drop("m")


def q_report_months(spark, sf_dir):
    """The reported months and their window dates, from the parameters, with the orders of each month."""
    f = _flat(spark, sf_dir).where(F.col("d").between(F.lit(P.report_months()[-1]), F.lit(P.range_end)))
    orders = f.groupBy(month_start(F.col("d")).alias("om")).agg(F.count("*").alias("orders"))
    return (report_months_df(spark, P).join(orders, F.col("m") == F.col("om"), "left")
            .select("Month", "from_date", "to_date", "from_date_lm", "to_date_lm", F.coalesce("orders", F.lit(0)).alias("orders")))


def q_filter_date_between(spark, sf_dir):
    f = _flat(spark, sf_dir)
    lo, hi = P.report_months()[-1], P.range_end
    return (f.where(F.col("d").between(F.lit(lo), F.lit(hi)))
            .select("order_id", month_label(F.col("d")).alias("Month")))


def q_filter_country(spark, sf_dir):
    f = _flat(spark, sf_dir)
    return f.where(F.col("country_id") == P.country_id).select("order_id", "user_id")


def q_filter_confirmed(spark, sf_dir):
    f = _flat(spark, sf_dir)
    return f.where(F.col("order_status") == CONFIRMED).select("order_id", "user_id")


def q_scope_membership(spark, sf_dir):
    cat = _cat(spark, sf_dir)
    f = flat_orders(cat["fact_orders"]).select("order_id", "partner_id")
    s = partner_scopes(cat["dim_partner"]).select("partner_id", "seg_scopes")
    return f.join(s, "partner_id").select("order_id", F.explode("seg_scopes").alias("vertical"))


def q_scope(v: str) -> Query:
    def q(spark, sf_dir):
        cat = _cat(spark, sf_dir)
        f = flat_orders(cat["fact_orders"]).select("order_id", "partner_id")
        p = flat_partner(cat["dim_partner"])
        keep = p.where(segment_predicate(v))
        return f.join(keep.select("partner_id"), "partner_id", "left_semi") \
            .select("order_id", "partner_id")
    return q


def q_market_sublabel(spark, sf_dir):
    cat = _cat(spark, sf_dir)
    f = flat_orders(cat["fact_orders"]).select("order_id", "partner_id")
    p = flat_partner(cat["dim_partner"]).where(F.col("business_type_name") == "Market")
    lab = p.select("partner_id", market_sublabel().alias("vertical"))
    return f.join(lab.where(F.col("vertical").isNotNull()), "partner_id").select("order_id", "vertical")


# ---- joins ------------------------------------------------------------------

def q_join_partner(spark, sf_dir):
    cat = _cat(spark, sf_dir)
    f = flat_orders(cat["fact_orders"]).select("order_id", "partner_id")
    p = flat_partner(cat["dim_partner"]).select("partner_id", "is_darkstore", "business_type_name")
    return f.join(p, "partner_id", "left").select("order_id", "partner_id", "is_darkstore",
                                                  "business_type_name")


def _enrich(fn) -> Query:
    return lambda spark, sf_dir: fn(_cat(spark, sf_dir))


def q_coupon_window(spark, sf_dir):
    c = coupons_after_cutoff(_cat(spark, sf_dir), P)
    name = "talon_campaign_name"
    return (c.groupBy("order_id")
            .agg(F.expr(f"bool_or({crm_sql(name)}) AS crm"), F.expr(f"bool_or({coop_sql(name)}) AS coop")))


def q_bank_campaign(spark, sf_dir):
    return bank_campaign_orders(_cat(spark, sf_dir), item_key=P.campaign_item_key)


def q_order_flags(spark, sf_dir):
    cat = _cat(spark, sf_dir)
    f = flat_orders(cat["fact_orders"]).withColumn(
        "ok", F.coalesce(F.col("order_status") == CONFIRMED, F.lit(False)))
    o = f.select("order_id", "ok", "has_voucher_discount", "shipping_amount_no_discount",
                 "with_logistics", "is_user_plus")
    x = order_metric_flags(o, order_incentives(cat, P), P.strict_confirmed)
    return x.select("order_id", F.col("ok").alias("is_confirmed"), "f_voucher", "f_crm", "f_df0",
                    "f_corporate", "f_banks", "f_plus", F.col("f_inc").alias("f_incentive"))


# ---- aggregations -------------------------------------------------------------

METRIC_KEYS = {
    "metric_voucher": ("q_user_voucher",),
    "metric_crm": ("Vouchers_CRM",),
    "metric_df0": ("q_user_df0",),
    "metric_corporate": ("q_user_corporate",),
    "metric_banks": ("q_user_banks",),
    "metric_plus": ("q_user_plus",),
    "metric_totals": ("q_user_totales", "q_orders_totales"),
    "metric_incentive": ("q_users_incentive", "q_orders_incentive"),
}


def q_metric(cols) -> Query:
    def q(spark, sf_dir):
        return scope_month_metrics(_cat(spark, sf_dir), P).select("Month", "vertical", *cols)
    return q


def build_queries() -> dict[str, Query]:
    qs: dict[str, Query] = {
        "report_all": q_report_all,
        "union_reports": q_union_reports,
        "report_incremental": q_report_incremental,
        "report_repeated_orders": q_report_repeated_orders,
        "join_partner_repeated": q_join_partner_repeated,
        "report_null_users": q_report_null_users,
        "seg_null_users": q_seg_null_users,
        "anti_null_users": q_anti_null_users,
        "sink_roundtrip": q_sink_roundtrip,
        "sink_months": q_sink_months,
        "report_hot_order": q_report_hot_order,
        "seg_labels": q_seg_labels,
        "seg_new_users": q_seg_new_users,
        "seg_acquisitions": q_seg_acquisitions,
        "seg_reactivated": q_seg_reactivated,
        "anti_null_aware": q_anti_null_aware,
        "src_fact_orders": q_src_fact_orders,
        "src_dim_partner": q_src_dim_partner,
        "nested_fields": q_nested_fields,
        "fn_month_label": q_fn_month_label,
        "report_months": q_report_months,
        "month_windows": q_month_windows,
        "filter_date_between": q_filter_date_between,
        "filter_country": q_filter_country,
        "filter_confirmed": q_filter_confirmed,
        "scope_membership": q_scope_membership,
        "market_sublabel": q_market_sublabel,
        "join_partner": q_join_partner,
        "enrich_region": _enrich(enrich.enrich_region),
        "enrich_user": _enrich(enrich.enrich_user),
        "enrich_city": _enrich(enrich.enrich_city),
        "enrich_product": _enrich(enrich.enrich_product),
        "enrich_subsidized": _enrich(enrich.enrich_subsidized),
        "unnest_details": _enrich(enrich.unnest_details),
        "unnest_singleton": _enrich(enrich.unnest_singleton),
        "coupon_window": q_coupon_window,
        "bank_campaign": q_bank_campaign,
        "order_flags": q_order_flags,
    }
    for v in VERTICALS:
        qs[f"report_{slug(v)}"] = q_report_vertical(v)
        qs[f"scope_{slug(v)}"] = q_scope(v)
    for k, cols in METRIC_KEYS.items():
        qs[k] = q_metric(cols)
    return qs
