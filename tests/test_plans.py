"""Plan checks: the report plan has no cartesian or nested-loop joins, no
Expand for distinct counts, never broadcasts the fact, and pushes the
country/date filters and column pruning into the Parquet scan."""

import re

import pytest

from cohortflow.operators.report import report
from cohortflow.sources.catalog import ParquetCatalog, frames_catalog
from cohortflow.sources.schemas import LOGICAL_SCHEMAS

from micro import PARAMS, tables


@pytest.fixture(scope="module")
def parquet_catalog(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("logical"))
    mem = frames_catalog(spark, tables())
    for name in LOGICAL_SCHEMAS:
        mem[name].write.mode("overwrite").parquet(f"{root}/{name}")
    return ParquetCatalog(spark, root)


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def broadcast_subtrees(text):
    lines = text.splitlines()
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            ind = len(line) - len(line.lstrip(" :+-"))
            sub = []
            for nxt in lines[i + 1:]:
                if len(nxt) - len(nxt.lstrip(" :+-")) <= ind:
                    break
                sub.append(nxt)
            out.append("\n".join(sub))
    return out


def test_report_plan_shape(parquet_catalog):
    df = report(parquet_catalog, PARAMS)
    text = plan_text(df)
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "Expand"):
        assert bad not in text, bad
    for sub in broadcast_subtrees(text):
        if "fact_orders" in sub:  # only aggregated fact data may be broadcast
            assert "HashAggregate" in sub
    assert len(df.collect()) == 10


def test_only_bounded_broadcast_without_size_estimates(spark, parquet_catalog):
    """With size-based broadcast off (what large inputs look like to the
    planner), the only fact-derived broadcast is the NULL-user guard, whose
    size is bounded by scopes x months."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        text = plan_text(report(parquet_catalog, PARAMS))
    finally:
        spark.conf.set(key, old)
    fact_bcasts = [s for s in broadcast_subtrees(text) if "fact_orders" in s]
    assert fact_bcasts
    for sub in fact_bcasts:
        assert "g_new" in sub and "g_react" in sub


def test_fact_scan_pushdown_and_pruning(spark, parquet_catalog):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    df = report(parquet_catalog, PARAMS)
    text = plan_text(df)
    scans = [ln for ln in text.splitlines() if "fact_orders" in ln and "FileScan" in ln]
    assert scans
    for s in scans:
        pushed = re.search(r"PushedFilters: \[(.*?)\]", s).group(1)
        assert "country_id" in pushed and "registered_date" in pushed
        schema = re.search(r"ReadSchema: (\S+)", s).group(1)
        assert "details" not in schema and "discounts" not in schema


def marked(cat, params):
    from cohortflow.operators.base import order_base
    from cohortflow.operators.report import marked_orders, order_rows
    months = params.report_months()
    return marked_orders(order_rows(order_base(cat, params, months[-1], params.range_end)), cat, params)


def without_broadcasts(spark, build):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        return plan_text(build())
    finally:
        spark.conf.set(key, old)


def test_counted_orders_scan_reads_only_reported_months(spark, parquet_catalog):
    """The history scan starts at history_start; the scan of the counted
    orders starts at the earliest reported month (pushed to the reader)."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    starts = lambda text: set(re.findall(r"GreaterThanOrEqual\(registered_date,(\d{4}-\d{2}-\d{2})\)", text))
    assert starts(plan_text(report(parquet_catalog, PARAMS))) == {str(PARAMS.history_start)}
    assert starts(plan_text(marked(parquet_catalog, PARAMS))) == {str(PARAMS.report_months()[-1])}


def test_order_level_has_no_window_and_no_exchange_of_raw_rows(spark, parquet_catalog):
    """With broadcasts off: one scan of the reported orders; what is dealt by order id is partial
    aggregates; orders and incentives meet in the aggregate, not in a join."""
    text = without_broadcasts(spark, lambda: marked(parquet_catalog, PARAMS))
    assert "Window" not in text and "Expand" not in text
    lines = text.splitlines()
    assert sum("FileScan" in ln and "fact_orders" in ln for ln in lines) == 1
    by_order = [i for i, ln in enumerate(lines) if "Exchange hashpartitioning(order_id" in ln]
    assert len(by_order) == 1
    assert "HashAggregate" in lines[by_order[0] + 1] and "partial_bit_or" in lines[by_order[0] + 1]
    assert "Window" not in without_broadcasts(spark, lambda: report(parquet_catalog, PARAMS))


def test_hot_order_id_is_one_row_a_task(spark):
    """20,000 rows of one id and of none become one row each; their side rows meet them without a join."""
    from cohortflow.operators.report import order_level, summarize, user_level
    cat = frames_catalog(spark, tables())
    base = spark.range(20_000).selectExpr(
        "CASE WHEN id % 2 = 0 THEN 1L END AS order_id", "7L AS user_id", "DATE'2023-03-05' AS d", "DATE'2023-03-01' AS m", "true AS ok",
        "1 AS has_voucher_discount", "5.0D AS shipping_amount_no_discount", "false AS with_logistics", "0 AS is_user_plus", "1L AS final_bits")
    m = order_level(base, cat, PARAMS.with_(verticals=("QC",)))
    assert m.count() == 2 and m.where("orders").count() == 1
    out = summarize(user_level(m, PARAMS.with_(verticals=("QC",))), by=("m", "vertical")).collect()
    assert [(r["q_user_totales"], r["q_orders_totales"], r["Vouchers_CRM"]) for r in out] == [(1, 1, 1)]


def test_month_partitions_are_pruned(spark, tmp_path):
    """A fact in folders by month: only the folders of the range are read."""
    from cohortflow.operators.base import MONTH_PARTITION, order_base
    from pyspark.sql import functions as F
    mem, root = frames_catalog(spark, tables()), str(tmp_path)
    for name in LOGICAL_SCHEMAS:
        out = mem[name]
        if name == "fact_orders":
            out.withColumn(MONTH_PARTITION, F.trunc("registered_date", "month")).write.partitionBy(MONTH_PARTITION).parquet(f"{root}/{name}")
        else:
            out.write.parquet(f"{root}/{name}")
    cat = ParquetCatalog(spark, root)
    assert sorted(map(tuple, report(cat, PARAMS).collect())) == sorted(map(tuple, report(mem, PARAMS).collect()))
    months = PARAMS.report_months()
    base = order_base(cat, PARAMS, months[-1], PARAMS.range_end)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    scan = next(ln for ln in plan_text(base).splitlines() if "FileScan" in ln and "fact_orders" in ln)
    assert MONTH_PARTITION in re.search(r"PartitionFilters: \[(.*?)\]", scan).group(1)
