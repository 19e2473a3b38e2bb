"""Order base: the fact, flattened, filtered, and tagged with its scopes.

One scan of ``fact_orders`` restricted to the country and a date range (both
pushed to the Parquet reader; a fact partitioned by month is pruned to the
months of the range), joined to the partner scopes. The partner
dimension is joined inner: every scope predicate rejects orders without a
partner, and the planner broadcasts the dimension only when its measured size
is below the configured threshold (sort-merge join otherwise).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import date_lit
from ..functions.scopes import partner_scopes
from ..params import CONFIRMED, ReportParams
from ..sources.catalog import Catalog


MONTH_PARTITION = "registered_month"


def flat_orders(fact_orders: DataFrame) -> DataFrame:
    """Nested fact -> flat columns (nested-schema pruning reads only these leaves)."""
    return fact_orders.selectExpr(
        "order_id", "user.id AS user_id", "restaurant.id AS partner_id", "registered_date AS d",
        "country_id", "order_status", "data.firstSuccessful AS first_successful",
        "has_voucher_discount", "shipping_amount_no_discount", "with_logistics", "is_user_plus",
    )


def order_base(cat: Catalog, params: ReportParams, start: dt.date | None,
               end: dt.date | None) -> DataFrame:
    """Order rows of the country (and of ``[start, end]`` when given) in any scope.

    Every row of the fact is kept, also when it repeats an order id or when the
    partner dimension repeats a partner: the counts are distinct later on.
    """
    cond = F.col("country_id") == F.lit(params.country_id)
    if start is not None:
        cond = cond & F.col("d").between(date_lit(start), date_lit(end))
    ok = f"coalesce(order_status = '{CONFIRMED}', false)"
    # status and first-purchase flag become booleans first: every column that
    # is shuffled later is then fixed-width
    fact = cat["fact_orders"]
    if start is not None and MONTH_PARTITION in fact.columns:
        # the folders of the months outside the range are not even listed
        fact = fact.where(F.col(MONTH_PARTITION).between(date_lit(start.replace(day=1)), date_lit(end.replace(day=1))))
    fo = (flat_orders(fact).where(cond)
          .selectExpr("order_id", "user_id", "partner_id", "d", f"{ok} AS ok",
                      f"{ok} AND coalesce(first_successful, false) AS first",
                      "has_voucher_discount", "shipping_amount_no_discount", "with_logistics",
                      "is_user_plus"))
    scopes = cat.memo(("partner_scopes", params.verticals),
                      lambda: partner_scopes(cat["dim_partner"], params.verticals))
    return fo.join(scopes, "partner_id", "inner").selectExpr("*", "trunc(d, 'month') AS m")
