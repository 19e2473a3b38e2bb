"""Logical tables derived from the driver's TPC-H-like Parquet tables.

Mapping (see FIXTURES.md, F-B): orders become the order fact, suppliers the
partners, return-flagged line items the coupons, and so on. Everything is a
lazy DataFrame expression over the given tables, so the work grows with them
and Catalyst prunes what a query does not read.

Scale notes
* ``firstSuccessful`` (a customer's earliest confirmed order) is computed with
  a grouped ``min(struct(date, key))`` -- partial aggregation happens map-side,
  so a customer owning a third of all orders costs one row per task in the
  shuffle. It meets the customer's attributes first, so the orders are shuffled
  by customer once (adaptive execution splits a hot probe partition).
* the partner of an order is ``min(l_suppkey)`` per order. The nested fact gets
  it from the aggregate that collects the order's items: the line items are
  shuffled once, into partitions of a bounded size, and nothing is sorted that
  does not fit a task.
* rows travel flat; ``order_shape`` makes structs and arrays of them at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.base import MONTH_PARTITION
from ..session import table_bytes, written
from .catalog import Catalog
from .schemas import DIM_SUBSIDIZED_CAMPAIGN, DIM_TALON_CAMPAIGNS

# Fixed values of the fixture mapping (FIXTURES.md F-B), kept together.
TALON_CAMPAIGN_NAMES = [(0, "AR-LOCAL-1"), (1, "AR-CENTRAL-2"), (2, "COOP-3"),
                        (3, "local-4"), (4, "OTHER-5"), (5, None)]
BUSINESS_TYPE_BY_SUPPKEY_MOD8 = {0: "Restaurant", 1: "Coffee", 2: "Market", 3: "Market",
                                 4: "Pharmacy", 5: "Drinks", 6: "Kiosks", 7: None}
CATEGORY_BY_SUPPKEY_MOD7 = {0: "Supermercados", 1: "minimercado", 2: "Express", 3: "Carnes",
                            4: None, 5: "Bodega", 6: "Bodega"}
SUBSIDIZED_CAMPAIGN_IDS = [0, 1]


def _case(key: Column, mapping: dict) -> Column:
    expr = None
    for k, v in mapping.items():
        val = F.lit(v).cast("string")
        expr = F.when(key == k, val) if expr is None else expr.when(key == k, val)
    return expr


def _confirmed(status: Column) -> Column:
    return status.isin("F", "P")


#: Line items that one row holds in its arrays at most.
ITEM_CHUNK = 4096

#: Bytes of the line item files that one partition by order holds (about half a million line items): a task sorts
#: them in memory, however large the table is.
PARTITION_BYTES = 8 << 20

# Schemas of the driver tables the adapter reads (declared, not inferred: no
# footer reads at planning time). The files hold time-zone-naive timestamps:
# reading them as TIMESTAMP_NTZ keeps dates independent of the session zone.
DRIVER_SCHEMAS = {
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
            "p_retailprice DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
}


#: details and discounts of the items that travel as (l_partkey, l_discount)
ITEM_ARRAYS = (
    "transform(items, i -> struct(struct(i.l_partkey AS product_id) AS product, i.l_discount >= 0.09 AS is_subsidized)) AS details",
    "transform(filter(items, i -> i.l_discount > 0), i -> struct(i.l_discount AS amount)) AS discounts")


def order_shape(rows: DataFrame) -> DataFrame:
    """The fact's nested columns from its flat rows; with ``items`` also the ``details``/``discounts`` arrays."""
    return rows.selectExpr(
        "order_id", "struct(user_id AS id) AS user", "struct(partner_id AS id) AS restaurant", "registered_date", "country_id",
        "CASE WHEN confirmed THEN 'CONFIRMED' ELSE 'REJECTED' END AS order_status", "struct(first AS firstSuccessful) AS data",
        "has_voucher_discount", "shipping_amount_no_discount", "order_id % 2 = 0 AS with_logistics", "is_user_plus",
        *(ITEM_ARRAYS if "items" in rows.columns else ()), *(c for c in rows.columns if c == MONTH_PARTITION))


def driver_catalog(spark: SparkSession, sf_dir: str, chunk: int = ITEM_CHUNK) -> Catalog:
    raw: dict[str, DataFrame] = {}

    def read(name: str) -> DataFrame:
        # one relation per table: every logical table derived from it shares
        # the same scan node, so Spark can reuse it across branches
        if name not in raw:
            raw[name] = spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
        return raw[name]

    def customers() -> DataFrame:
        """Per customer key its attributes and earliest confirmed order; the key NULL has the order only."""
        c = read("customer").where("c_custkey IS NOT NULL").select("c_custkey", "c_nationkey", "c_mktsegment")
        first = (read("orders").where(_confirmed(F.col("o_orderstatus")))
                 .groupBy(F.col("o_custkey").alias("f_custkey"))
                 .agg(F.min(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"]
                      .alias("first_orderkey")))
        return first.join(c, first.f_custkey == c.c_custkey, "full").selectExpr(
            "coalesce(f_custkey, c_custkey) AS custkey", "first_orderkey",
            "CASE WHEN c_nationkey < 20 THEN 3 ELSE 1 END AS country_id",
            "CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS is_user_plus")

    def order_rows(partner: DataFrame) -> DataFrame:
        """The fact as flat rows; ``partner`` has ``l_orderkey``, ``partner_id`` and what else goes along."""
        confirmed = _confirmed(F.col("o_orderstatus"))
        o = read("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
            F.to_date("o_orderdate").alias("registered_date"), confirmed.alias("confirmed"),
            F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("has_voucher_discount"),
            F.when(F.col("o_orderpriority") == "5-LOW", 0.0).otherwise(9.5).alias("shipping_amount_no_discount"))
        c = customers()
        j = (o.join(c, o.user_id.eqNullSafe(c.custkey), "left")
             .withColumn("first", F.col("confirmed") & F.coalesce(F.col("order_id") == F.col("first_orderkey"), F.lit(False)))
             .withColumn("country_id", F.coalesce("country_id", F.lit(1)))
             .withColumn("is_user_plus", F.coalesce("is_user_plus", F.lit(0)))
             .drop("custkey", "first_orderkey"))
        return j.join(partner, j.order_id == partner.l_orderkey, "left").drop("l_orderkey")

    def fact_orders() -> DataFrame:
        return order_shape(order_rows(read("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("partner_id"))))

    def large_orders() -> DataFrame:
        """Orders of more than ``chunk`` items, with their chunks and partner, written once: the planner knows how few they are."""
        if "large" not in raw:
            raw["large"] = written(
                read("lineitem").where("l_orderkey IS NOT NULL").groupBy(F.col("l_orderkey").alias("large_id"))
                .agg(F.count("*").alias("items"), F.min("l_suppkey").alias("large_partner")).where(F.col("items") > chunk)
                .selectExpr("large_id", f"CAST(ceil(2 * items / {chunk}) AS INT) AS chunks", "large_partner"), "orders-large")
        return raw["large"]

    def chunked_lines(more: bool) -> DataFrame:
        """Line items with the chunk of their order: the first chunk of every order, or the others of very large ones.

        Only orders of more than ``chunk`` items are dealt into several chunks, by a hash of the row's
        number in the scan and into twice the chunks needed, so that a chunk stays below its bound.
        """
        li, large = read("lineitem").withColumn("row", F.monotonically_increasing_id()), large_orders()
        return (li.join(large, li.l_orderkey == large.large_id, "inner" if more else "left")
                .withColumn("chunk", F.expr("coalesce(CAST(pmod(xxhash64(row), chunks) AS INT), 0)"))
                .where("chunk > 0" if more else "chunk = 0 AND l_orderkey IS NOT NULL")
                .select("l_orderkey", "chunk", "l_partkey", "l_discount", "l_suppkey"))

    def order_items_more() -> DataFrame:
        return (chunked_lines(True).groupBy(F.col("l_orderkey").alias("order_id"), "chunk")
                .agg(F.collect_list(F.struct("l_partkey", "l_discount")).alias("items"))
                .selectExpr("order_id", "chunk", *ITEM_ARRAYS))

    def order_item_rows() -> DataFrame:
        """The fact as flat rows with its ``items`` (empty when none; the first chunk of very many)."""
        size = table_bytes(spark, f"{sf_dir}/lineitem.parquet")
        parts = max(spark.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))
        # the partner of a large order is that of all its chunks: a row of its own, which is no item
        partners = large_orders().selectExpr("large_id", "CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)", "large_partner", "false")
        items = (chunked_lines(False).selectExpr("l_orderkey", "l_partkey", "l_discount", "l_suppkey", "true AS item").union(partners)
                 .repartition(parts, "l_orderkey").groupBy("l_orderkey")
                 .agg(F.collect_list(F.expr("CASE WHEN item THEN struct(l_partkey, l_discount) END")).alias("items"),
                      F.min("l_suppkey").alias("partner_id")))
        none = F.array().cast(items.schema["items"].dataType)
        return order_rows(items).withColumn("items", F.coalesce("items", none))

    def dim_partner() -> DataFrame:
        s = read("supplier")
        k = F.col("s_suppkey")
        return s.select(
            k.alias("partner_id"),
            F.when(k % 5 == 0, True).when(k % 5 == 1, F.lit(None).cast("boolean"))
            .otherwise(False).alias("is_darkstore"),
            F.struct(_case(k % 8, BUSINESS_TYPE_BY_SUPPKEY_MOD8).alias("business_type_name"))
            .alias("business_type"),
            F.struct(_case(k % 7, CATEGORY_BY_SUPPKEY_MOD7).alias("name")).alias("businessCategory"),
            F.col("s_nationkey").cast("long").alias("city_id"),
            F.struct(F.col("s_nationkey").cast("long").alias("id")).alias("franchise"),
        )

    def fact_talon_coupons() -> DataFrame:
        li = read("lineitem").where(F.col("l_returnflag") == "R")
        return li.select(F.col("l_orderkey").alias("order_id"),
                         (F.col("l_partkey") % 6).alias("talon_campaign_id"),
                         F.col("l_shipdate").alias("coupon_created_at"))

    def dim_talon_campaigns() -> DataFrame:
        return spark.createDataFrame(TALON_CAMPAIGN_NAMES, schema=DIM_TALON_CAMPAIGNS)

    def fact_wallet() -> DataFrame:
        o = read("orders").where(F.col("o_orderkey") % 11 == 0)
        return o.select(F.col("o_orderkey").alias("order_id"),
                        F.when(F.col("o_orderkey") % 3 == 0, "COOP-W").otherwise("GIFT")
                        .alias("campaign_name"))

    def order_log() -> DataFrame:
        o = read("orders").where(F.col("o_orderkey") % 13 == 0)
        return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("order_id"))

    def campaign_log_items() -> DataFrame:
        li = read("lineitem").where(F.col("l_orderkey") % 13 == 0)
        return li.select(F.col("l_partkey").alias("id"),
                         F.col("l_orderkey").alias("order_log_id"))

    def campaign() -> DataFrame:
        return read("part").select(F.col("p_partkey").alias("id"),
                                   F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("name"))

    def users() -> DataFrame:
        return read("customer").select(F.col("c_custkey").alias("user_id"))

    def regions() -> DataFrame:
        return read("supplier").select(F.col("s_suppkey").alias("Id"))

    def dim_city() -> DataFrame:
        return read("nation").select(F.col("n_nationkey").cast("long").alias("city_id"))

    def dim_product() -> DataFrame:
        return read("part").select(F.col("p_partkey").alias("product_id"))

    def product() -> DataFrame:
        return read("part").select(F.col("p_partkey").alias("id"))

    def dim_subsidized_product() -> DataFrame:
        p = read("part").where(F.col("p_partkey") % 5 == 0)
        return p.select(F.col("p_partkey").alias("product_id"),
                        (F.col("p_partkey") % 3).alias("subsidized_product_campaing_id"))

    def dim_subsidized_campaign() -> DataFrame:
        return spark.createDataFrame([(i,) for i in SUBSIDIZED_CAMPAIGN_IDS],
                                     schema=DIM_SUBSIDIZED_CAMPAIGN)

    return Catalog(spark, {
        "fact_orders": fact_orders,
        "fact_orders_nested": lambda: order_shape(order_item_rows()),
        "order_item_rows": order_item_rows,
        "order_items_more": order_items_more,
        "dim_partner": dim_partner,
        "fact_wallet": fact_wallet,
        "fact_talon_coupons": fact_talon_coupons,
        "dim_talon_campaigns": dim_talon_campaigns,
        "order_log": order_log,
        "campaign_log_items": campaign_log_items,
        "campaign": campaign,
        "agg_user_lifecycle": users,
        "dim_user": users,
        "regiones_oficinas_kam": regions,
        "dim_city": dim_city,
        "dim_product": dim_product,
        "product": product,
        "dim_subsidized_product": dim_subsidized_product,
        "dim_subsidized_campaign": dim_subsidized_campaign,
    })
