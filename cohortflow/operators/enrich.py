"""Enrichment joins and unnests of the original final statement.

These joins do not change any report number (every report output is a
distinct count, and none of their columns is read), so ``report`` leaves them
out. They are kept here as operators for users who need the enriched rows:
partner city, KAM region, user lifecycle/dimension, product chain,
subsidised-product campaign, and the LEFT UNNEST of the order arrays.
Dimension joins are left joins; the planner decides broadcast by measured
size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from ..sources.catalog import Catalog
from .base import flat_orders


def fact_with_items(cat: Catalog) -> DataFrame:
    """The fact including its ``details``/``discounts`` arrays."""
    try:
        return cat["fact_orders_nested"]
    except KeyError:
        return cat["fact_orders"]


def unnest_details(cat: Catalog) -> DataFrame:
    """``LEFT JOIN UNNEST(details)`` and ``UNNEST(discounts)`` of every order.

    The original unnests both arrays in one FROM clause, i.e. it pairs every
    detail with every discount of the order; those pairs carry nothing (the
    report only counts distinct users and orders) and grow quadratically with
    the order size. Here the two unnests are stacked, not paired: a detail
    row has ``amount`` NULL, a discount row has the detail columns NULL, and
    an order without details keeps one NULL detail row (``explode_outer``).
    """
    item = ("struct(d.product.product_id AS product_id, d.is_subsidized AS is_subsidized, "
            "CAST(NULL AS DOUBLE) AS amount)")
    extra = "struct(CAST(NULL AS BIGINT) AS product_id, CAST(NULL AS BOOLEAN) AS is_subsidized, x.amount AS amount)"
    none = "struct(CAST(NULL AS BIGINT) AS product_id, CAST(NULL AS BOOLEAN) AS is_subsidized, CAST(NULL AS DOUBLE) AS amount)"
    rows = "concat({}, transform(coalesce(discounts, array()), x -> " + extra + "))"
    first = rows.format(f"CASE WHEN coalesce(size(details), 0) > 0 THEN transform(details, d -> {item}) ELSE array({none}) END")
    out = fact_with_items(cat).selectExpr("order_id", f"inline({first})")
    more = cat.optional("order_items_more")      # further chunks of very large orders
    if more is None:
        return out
    return out.union(more.selectExpr("order_id", f"inline({rows.format(f'transform(details, d -> {item})')})"))


def details(cat: Catalog) -> DataFrame:
    x = fact_with_items(cat).select("order_id", F.explode_outer("details").alias("d"))
    more = cat.optional("order_items_more")
    if more is not None:
        x = x.union(more.select("order_id", F.explode("details")))
    return x.select("order_id", F.col("d.product.product_id").alias("product_id"),
                    F.col("d.is_subsidized").alias("is_subsidized"))


def enrich_product(cat: Catalog) -> DataFrame:
    """The product chain is joined and written first, as product and whether it is known: the planner then knows its size,
    and the details meet it in one join (shuffled once at most, and a hot product's join can be split)."""
    dprod = cat["dim_product"].select(F.col("product_id").alias("dim_product_id"))
    prod = cat["product"].select(F.col("id").alias("product_ref_id"))
    chain = written(dprod.join(prod, dprod.dim_product_id == prod.product_ref_id, "left")
                    .selectExpr("dim_product_id", "product_ref_id IS NOT NULL AS known"), "products")
    d = details(cat)
    return (d.join(chain, d.product_id == chain.dim_product_id, "left")
            .selectExpr("order_id", "product_id", "dim_product_id", "CASE WHEN known THEN dim_product_id END AS product_ref_id"))


def enrich_subsidized(cat: Catalog) -> DataFrame:
    """Join with a condition on the probe side (``is_subsidized = true``), then
    the subsidised campaign."""
    d = details(cat)
    dsp = cat["dim_subsidized_product"].select(
        F.col("product_id").alias("subsidized_product_id"), "subsidized_product_campaing_id")
    dsc = cat["dim_subsidized_campaign"]
    j = d.join(dsp, (d.product_id == dsp.subsidized_product_id)
               & (d.is_subsidized == F.lit(True)), "left")
    j = j.join(dsc, j.subsidized_product_campaing_id == dsc.subsidized_campaign_id, "left")
    return j.select("order_id", "product_id", "is_subsidized", "subsidized_product_id",
                    "subsidized_campaign_id")


def enrich_city(cat: Catalog) -> DataFrame:
    p = cat["dim_partner"].select("partner_id", F.col("city_id").alias("partner_city_id"))
    c = cat["dim_city"]
    return (p.join(c, p.partner_city_id == c.city_id, "left")
            .select("partner_id", "partner_city_id", "city_id"))


def enrich_region(cat: Catalog) -> DataFrame:
    f = flat_orders(cat["fact_orders"]).select("order_id", "partner_id")
    r = cat["regiones_oficinas_kam"].select(F.col("Id").alias("region_id"))
    return f.join(r, f.partner_id == r.region_id, "left").select("order_id", "partner_id",
                                                                  "region_id")


def enrich_user(cat: Catalog) -> DataFrame:
    f = flat_orders(cat["fact_orders"]).select("order_id", "user_id")
    aul = cat["agg_user_lifecycle"].select(F.col("user_id").alias("aul_user_id"))
    du = cat["dim_user"].select(F.col("user_id").alias("du_user_id"))
    j = f.join(aul, f.user_id == aul.aul_user_id, "left")
    j = j.join(du, j.user_id == du.du_user_id, "left")
    return j.select("order_id", "user_id", "aul_user_id", "du_user_id")


def unnest_singleton(cat: Catalog) -> DataFrame:
    """``LEFT JOIN UNNEST([dp.franchise])`` / ``UNNEST([dp.business_type])``:
    a one-element array built from a struct, unnested -- the struct itself."""
    p = cat["dim_partner"]
    x = p.select("partner_id", F.explode_outer(F.array("franchise")).alias("fr"), "business_type")
    x = x.select("partner_id", "fr", F.explode_outer(F.array("business_type")).alias("bt"))
    return x.select("partner_id", F.col("fr.id").alias("franchise_id"),
                    F.col("bt.business_type_name").alias("business_type_name"))
