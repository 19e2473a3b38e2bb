"""Order-level incentive flags from the side tables.

The original left-joins coupons, campaigns, wallet and the bank-campaign
bridge onto every order row and relies on ``COUNT(DISTINCT ...)`` to hide the
fan-out. Here each side table is reduced to at most one row per order:

* coupons created after the cut-off, joined to their campaign names
  -> ``crm`` (name contains LOCAL or CENTRAL), ``coop`` (contains COOP)
* wallet movements -> ``coop`` (campaign name contains COOP)
* order log -> log items -> campaign with a name -> ``bank``

The three streams are unioned and reduced by order id (partial aggregation
map-side, one shuffle for all side tables). The report reduces them together
with its order rows (``report.order_level``), so there they need no join at all.
Text matches are case-sensitive, as in the original.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import date_lit
from ..params import ReportParams
from ..sources.catalog import Catalog

# Fixed values of the original text matches (LIKE '%...%', case-sensitive).
CRM_MARKERS = ("LOCAL", "CENTRAL")
CORPORATE_MARKER = "COOP"


def crm_sql(col: str) -> str:
    return "coalesce(" + " OR ".join(f"{col} LIKE '%{m}%'" for m in CRM_MARKERS) + ", false)"


def coop_sql(col: str) -> str:
    return f"coalesce({col} LIKE '%{CORPORATE_MARKER}%', false)"


def coupons_after_cutoff(cat: Catalog, params: ReportParams) -> DataFrame:
    """Coupons with ``DATE(created_at) > cutoff`` and their campaign name (left join)."""
    c = cat["fact_talon_coupons"].where(
        F.to_date("coupon_created_at") > date_lit(params.coupon_cutoff))
    return c.join(cat["dim_talon_campaigns"], "talon_campaign_id", "left")


def bank_campaign_orders(cat: Catalog, distinct: bool = True, item_key: str = "id") -> DataFrame:
    """Order ids reached by order_log -> campaign_log_items -> named campaign
    (distinct unless the caller reduces by order id itself)."""
    log = cat["order_log"].where(F.col("order_id").isNotNull())
    named = cat["campaign"].where(F.col("name").isNotNull()).select(F.col("id").alias("campaign_id"))
    items = cat["campaign_log_items"].select("order_log_id", F.col(item_key).alias("campaign_id"))
    # one row per log id (map-side distinct): a log with a third of all items
    # cannot skew the semi join below
    items = items.join(named, "campaign_id", "left_semi").select("order_log_id").distinct()
    out = log.join(items, log.id == items.order_log_id, "left_semi").select("order_id")
    return out.distinct() if distinct else out


# Incentives of an order that come from side tables, as bits.
CRM, CORPORATE, BANK = 1, 2, 4


def incentive_rows(cat: Catalog, params: ReportParams) -> DataFrame:
    """order_id, inc: side-table rows that name an incentive (CRM, CORPORATE, BANK bits), not reduced.

    Whoever reduces them by order id shuffles each once; a restriction to the
    reported orders by a join would shuffle them for that join as well.
    """
    def bits(name: str) -> str:
        return f"CASE WHEN {crm_sql(name)} THEN {CRM} ELSE 0 END | CASE WHEN {coop_sql(name)} THEN {CORPORATE} ELSE 0 END AS inc"

    coupons = coupons_after_cutoff(cat, params).selectExpr("order_id", bits("talon_campaign_name"))
    wallet = cat["fact_wallet"].selectExpr("order_id", f"CASE WHEN {coop_sql('campaign_name')} THEN {CORPORATE} ELSE 0 END AS inc")
    # rows that name no incentive say nothing about their order
    named = coupons.union(wallet).where("order_id IS NOT NULL AND inc <> 0")
    bank = bank_campaign_orders(cat, distinct=False, item_key=params.campaign_item_key)
    return named.union(bank.selectExpr("order_id", f"{BANK} AS inc"))


def order_incentives(cat: Catalog, params: ReportParams) -> DataFrame:
    """order_id -> crm, coop, bank (booleans; orders absent here have none)."""
    return (incentive_rows(cat, params).groupBy("order_id").agg(F.expr("bit_or(inc) AS inc"))
            .selectExpr("order_id", f"inc & {CRM} <> 0 AS crm", f"inc & {CORPORATE} <> 0 AS coop", f"inc & {BANK} <> 0 AS bank"))


# Incentives that the order row itself names.
ROW_TERMS = {
    "vou": "coalesce(has_voucher_discount > 0, false)",
    "df0": "coalesce(shipping_amount_no_discount = 0 AND with_logistics = true, false)",
    "plus": "coalesce(is_user_plus = 1, false)",
}


def order_metric_flags(orders: DataFrame, incentives: DataFrame, strict_confirmed: bool = False) -> DataFrame:
    """Adds the per-order metric booleans to ``orders`` (flat order rows).

    ``inc`` keeps the original precedence ``ok AND voucher OR crm OR df0 OR
    corporate OR bank OR plus``: only the voucher term requires a CONFIRMED
    order. ``strict_confirmed`` requires it for every term.
    """
    j = orders.join(incentives, "order_id", "left")
    t = ROW_TERMS | {c: f"coalesce({c}, false)" for c in ("crm", "coop", "bank")}
    if strict_confirmed:
        inc = f"ok AND ({' OR '.join(t.values())})"
    else:  # AND binds tighter than OR: only the voucher term needs a CONFIRMED order
        inc = f"ok AND {t['vou']} OR {t['crm']} OR {t['df0']} OR {t['coop']} OR {t['bank']} OR {t['plus']}"
    return j.selectExpr(
        *orders.columns,
        f"ok AND {t['vou']} AS f_voucher", f"ok AND {t['crm']} AS f_crm",
        f"ok AND {t['df0']} AS f_df0", f"ok AND {t['coop']} AS f_corporate",
        f"ok AND {t['bank']} AS f_banks", f"ok AND {t['plus']} AS f_plus",
        f"{inc} AS f_inc",
    )
