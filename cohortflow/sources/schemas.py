"""Explicit schemas of the logical source tables and of the report.

The logical tables mirror the warehouse model the report was written for:
nested structs for user / partner / order data, arrays of structs for the
order details. Production sources are read with these schemas (no inference);
the adapter for the driver's TPC-H-like tables produces the same shapes.
"""

from pyspark.sql import types as T

L, I, S, D, B, DT, TS = (T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(),
                         T.BooleanType(), T.DateType(), T.TimestampType())


def _s(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


DETAIL = _s(("product", _s(("product_id", L))), ("is_subsidized", B))
DISCOUNT = _s(("amount", D))

FACT_ORDERS = _s(
    ("order_id", L),
    ("user", _s(("id", L))),
    ("restaurant", _s(("id", L))),
    ("registered_date", DT),
    ("country_id", I),
    ("order_status", S),
    ("data", _s(("firstSuccessful", B))),
    ("has_voucher_discount", I),
    ("shipping_amount_no_discount", D),
    ("with_logistics", B),
    ("is_user_plus", I),
    ("details", T.ArrayType(DETAIL, True)),
    ("discounts", T.ArrayType(DISCOUNT, True)),
)

DIM_PARTNER = _s(
    ("partner_id", L),
    ("is_darkstore", B),
    ("business_type", _s(("business_type_name", S))),
    ("businessCategory", _s(("name", S))),
    ("city_id", L),
    ("franchise", _s(("id", L))),
)

FACT_WALLET = _s(("order_id", L), ("campaign_name", S))
FACT_TALON_COUPONS = _s(("order_id", L), ("talon_campaign_id", L), ("coupon_created_at", TS))
DIM_TALON_CAMPAIGNS = _s(("talon_campaign_id", L), ("talon_campaign_name", S))
ORDER_LOG = _s(("id", L), ("order_id", L))
CAMPAIGN_LOG_ITEMS = _s(("id", L), ("order_log_id", L))
CAMPAIGN = _s(("id", L), ("name", S))
AGG_USER_LIFECYCLE = _s(("user_id", L))
DIM_USER = _s(("user_id", L))
REGIONES_OFICINAS_KAM = _s(("Id", L))
DIM_CITY = _s(("city_id", L))
DIM_PRODUCT = _s(("product_id", L))
PRODUCT = _s(("id", L))
DIM_SUBSIDIZED_PRODUCT = _s(("product_id", L), ("subsidized_product_campaing_id", L))
DIM_SUBSIDIZED_CAMPAIGN = _s(("subsidized_campaign_id", L))

# Items beyond the first chunk of very large orders (optional: a source that keeps all in the fact has no such table).
ORDER_ITEMS_MORE = _s(("order_id", L), ("chunk", I), ("details", T.ArrayType(DETAIL, True)), ("discounts", T.ArrayType(DISCOUNT, True)))

LOGICAL_SCHEMAS = {
    "fact_orders": FACT_ORDERS,
    "dim_partner": DIM_PARTNER,
    "fact_wallet": FACT_WALLET,
    "fact_talon_coupons": FACT_TALON_COUPONS,
    "dim_talon_campaigns": DIM_TALON_CAMPAIGNS,
    "order_log": ORDER_LOG,
    "campaign_log_items": CAMPAIGN_LOG_ITEMS,
    "campaign": CAMPAIGN,
    "agg_user_lifecycle": AGG_USER_LIFECYCLE,
    "dim_user": DIM_USER,
    "regiones_oficinas_kam": REGIONES_OFICINAS_KAM,
    "dim_city": DIM_CITY,
    "dim_product": DIM_PRODUCT,
    "product": PRODUCT,
    "dim_subsidized_product": DIM_SUBSIDIZED_PRODUCT,
    "dim_subsidized_campaign": DIM_SUBSIDIZED_CAMPAIGN,
    "order_items_more": ORDER_ITEMS_MORE,
}

# Report column names and order, as in the original output.
METRIC_COLUMNS = (
    "q_user_voucher", "Vouchers_CRM", "q_user_df0", "q_user_corporate", "q_user_banks",
    "q_user_plus", "q_user_totales", "q_orders_totales", "q_users_incentive",
    "q_orders_incentive",
)
REPORT_KEYS = ("Month", "vertical", "user_type")
REPORT = T.StructType(
    [T.StructField("Month", S, True), T.StructField("vertical", S, True),
     T.StructField("user_type", S, True)]
    + [T.StructField(c, L, True) for c in METRIC_COLUMNS]
)
