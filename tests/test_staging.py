"""Staging: derived logical tables are written once and reused."""

import os
import uuid

import pytest

from cohortflow.operators.report import report
from cohortflow.params import DRIVER_PARAMS as P
from cohortflow.sources import staging

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def test_stage_is_reused(spark):
    a = staging.staged_catalog(spark, SF)
    b = staging.staged_catalog(spark, SF)
    assert a is b


def test_breaking_off_leaves_no_stage(spark, monkeypatch):
    """The marker is written last: a run that fails half-way is staged anew by the next one."""
    monkeypatch.setattr(staging, "ADAPTER_VERSION", staging.ADAPTER_VERSION + "-" + uuid.uuid4().hex)
    whole = staging.stage

    def breaks(spark, sf_dir, target):
        spark.range(3).write.parquet(f"{target}/fact_orders")
        raise OSError("lost")

    monkeypatch.setattr(staging, "stage", breaks)
    with pytest.raises(OSError):
        staging.staged_catalog(spark, SF)
    monkeypatch.setattr(staging, "stage", whole)
    cat = staging.staged_catalog(spark, SF)
    assert cat["fact_orders"].count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert report(cat, P).count() > 0


def test_defaults_only_where_unset(spark):
    """A setting of the running session survives; the caller's own wishes are set."""
    from cohortflow.session import get_session
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "7m")
    try:
        assert get_session().conf.get(key) == "7m"
        assert get_session(extra={key: "8m"}).conf.get(key) == "8m"
    finally:
        spark.conf.set(key, old)


def test_another_zone_is_refused(spark):
    from cohortflow.session import get_session
    spark.conf.set("spark.sql.session.timeZone", "America/Montevideo")
    try:
        with pytest.raises(RuntimeError):
            get_session()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_large_orders_come_in_chunks(spark, tmp_path):
    """One order with all line items takes several rows of bounded arrays; what is unnested stays."""
    from pyspark.sql import functions as F

    from cohortflow.operators.enrich import details, unnest_details
    from cohortflow.sources.tpch_adapter import driver_catalog
    for name in ("orders", "customer", "supplier", "part", "nation"):
        os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    key = F.when(F.col("l_linenumber") > 1, F.lit(1)).otherwise(F.col("l_orderkey")).cast("bigint")
    li.withColumn("l_orderkey", key).write.parquet(str(tmp_path / "lineitem.parquet"))
    whole, cut = driver_catalog(spark, str(tmp_path)), driver_catalog(spark, str(tmp_path), chunk=500)
    assert whole["order_items_more"].count() <= 2
    more, fact = cut["order_items_more"], cut["fact_orders_nested"]
    assert more.count() >= li.where("l_linenumber > 1").count() // 500
    for x in (more, fact):
        assert x.selectExpr("max(size(details)) AS n").first()["n"] <= 500
    assert fact.count() == whole["fact_orders_nested"].count()
    for f in (unnest_details, details):
        assert sorted(map(str, f(cut).collect())) == sorted(map(str, f(whole).collect()))


def test_work_folder_is_released(spark):
    from cohortflow.session import release, work_path, written
    path = work_path(spark).removeprefix("file:")
    df = written(spark.range(5), "numbers")
    assert df.count() == 5 and os.path.isdir(path)
    assert release(spark) and not os.path.exists(path)


def _driver_tables(spark, path, **rows):
    """Small driver tables of given rows; the rest is empty."""
    from cohortflow.sources.tpch_adapter import DRIVER_SCHEMAS
    for name, schema in DRIVER_SCHEMAS.items():
        spark.createDataFrame(rows.get(name, []), schema).write.parquet(f"{path}/{name}.parquet")


def test_fact_is_derived_with_few_shuffles(spark, tmp_path):
    """Line items and their counts go by order once, the orders by customer once and by order once."""
    from cohortflow.sources.tpch_adapter import driver_catalog
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "3k")      # only the table of large orders, which is empty, is below it
    try:
        cat = driver_catalog(spark, SF)
        plans = {n: cat[n]._jdf.queryExecution().executedPlan().toString() for n in ("fact_orders_nested", "order_items_more")}
    finally:
        spark.conf.set(key, old)
    assert plans["order_items_more"].count("Exchange hashpartitioning") == 1
    # orders by customer and by order, first orders, customers, both joined, line items
    assert plans["fact_orders_nested"].count("Exchange hashpartitioning") <= 6
    assert plans["fact_orders_nested"].count("Exchange hashpartitioning(l_orderkey") == 1


def test_derived_fact_of_odd_rows(spark, tmp_path):
    """Orders without customer or key, repeated customers and orders, null items: as the plain joins have them."""
    import datetime as dt

    from cohortflow.sources.tpch_adapter import driver_catalog
    day = [dt.datetime(1997, 1, d) for d in range(1, 10)]
    orders = [(1, 10, "F", 1.0, day[3], "1-URGENT"), (2, 10, "P", 1.0, day[2], "5-LOW"), (3, None, "F", 1.0, day[5], None),
              (4, None, "F", 1.0, day[4], "5-LOW"), (5, 11, "O", 1.0, day[1], None), (6, 12, None, 1.0, day[1], None),
              (None, 11, "F", 1.0, day[7], None), (1, 13, "F", 1.0, day[3], None), (7, 99, "F", 1.0, None, None)]
    customer = [(10, "a", 3, 0.0, "BUILDING"), (10, "b", 22, 0.0, None), (None, "c", 1, 0.0, "BUILDING"), (11, "d", None, 0.0, "X"),
                (12, "e", 1, 0.0, "BUILDING"), (50, "f", 1, 0.0, "BUILDING")]
    lines = [(1, 5, 8), (1, 6, 7), (2, None, 9), (4, 7, None), (None, 8, 1), (60, 1, 1)]
    discounts = [0.1, 0.0, None, 0.05, 0.1, 0.1]
    lineitem = [(o, p, s, 1, 1.0, 1.0, d, 0.0, "R", "O", day[0]) for (o, p, s), d in zip(lines, discounts)]
    _driver_tables(spark, str(tmp_path), orders=orders, customer=customer, lineitem=lineitem)

    confirmed = [o for o in orders if o[2] in ("F", "P")]
    least = {c: min((o[4] or dt.datetime.min, o[0] or -1) for o in confirmed if o[1] == c) for c in {o[1] for o in confirmed}}
    wanted = []
    for k, c, status, _, date, priority in orders:
        ok = status in ("F", "P")
        items = [(p, s, d) for (o, p, s), d in zip(lines, discounts) if o == k and k is not None]
        partner = min((s for _, s, _ in items if s is not None), default=None)
        for nation, segment in [(x[2], x[4]) for x in customer if x[0] == c and c is not None] or [(None, None)]:
            wanted.append((k, c, partner, date and date.date(), 3 if nation is not None and nation < 20 else 1, "CONFIRMED" if ok else "REJECTED",
                           ok and k is not None and (date or dt.datetime.min, k) == least[c], int(priority == "1-URGENT"),
                           0.0 if priority == "5-LOW" else 9.5, None if k is None else k % 2 == 0, int(segment == "BUILDING"),
                           sorted((str(p), str(None if d is None else d >= 0.09)) for p, _, d in items),
                           sorted(d for _, _, d in items if d is not None and d > 0)))
    for chunk in (4096, 1):
        cat = driver_catalog(spark, str(tmp_path), chunk=chunk)
        found, more = cat["fact_orders_nested"].collect(), cat["order_items_more"].collect()
        flat = sorted(str(r) for r in cat["fact_orders"].collect())
        assert flat == sorted(str(r) for r in cat["fact_orders_nested"].drop("details", "discounts").collect())
        got = []
        for r in found:
            rest = [m for m in more if m.order_id == r.order_id]
            dets = [d for x in (r, *rest) for d in x.details]
            got.append((r.order_id, r.user.id, r.restaurant.id, r.registered_date, r.country_id, r.order_status, r.data.firstSuccessful,
                        r.has_voucher_discount, r.shipping_amount_no_discount, r.with_logistics, r.is_user_plus,
                        sorted((str(d.product.product_id), str(d.is_subsidized)) for d in dets),
                        sorted(d.amount for x in (r, *rest) for d in x.discounts)))
        assert sorted(map(str, got)) == sorted(map(str, wanted))
        assert chunk == 1 or not more


def test_details_meet_the_product_chain_once(spark):
    """One join by product: right rows for repeated, unknown and missing products, one shuffle of the details."""
    from cohortflow.operators.enrich import enrich_product
    from cohortflow.sources.catalog import frames_catalog
    products, chain = [1, 1, 2, 3, None], [1, 2, 2, 4, None]
    orders = {100: [1, 2, None], 101: [3, 4], 102: [], 103: [1]}
    fact = [(o, None, None, None, 3, "CONFIRMED", None, 0, 0.0, True, 0, [((p,), True) for p in ps], []) for o, ps in orders.items()]
    cat = frames_catalog(spark, {"fact_orders": fact, "dim_product": [(p,) for p in products], "product": [(p,) for p in chain]})
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        out = enrich_product(cat)
        plan = out._jdf.queryExecution().executedPlan().toString()
        found = sorted(map(str, map(tuple, out.collect())))
    finally:
        spark.conf.set(key, old)
    wanted = [(o, p, d, r) for o, ps in orders.items() for p in ps or [None]
              for d in [x for x in products if p is not None and x == p] or [None]
              for r in [x for x in chain if d is not None and x == d] or [None]]
    assert found == sorted(map(str, wanted))
    assert plan.count("Exchange hashpartitioning") == 2
