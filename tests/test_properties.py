"""Properties of the report on the driver tables (sf0.001)."""

import os

import pytest
from pyspark.sql import functions as F

from cohortflow.operators.report import report
from cohortflow.params import DRIVER_PARAMS as P
from cohortflow.sources.tpch_adapter import driver_catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")

USER_METRICS = ["q_user_voucher", "Vouchers_CRM", "q_user_df0", "q_user_corporate",
                "q_user_banks", "q_user_plus"]


@pytest.fixture(scope="module")
def cat(spark):
    return driver_catalog(spark, SF)


@pytest.fixture(scope="module")
def rows(cat):
    return report(cat, P).collect()


def test_incentive_counts_bounded(rows):
    assert rows
    for r in rows:
        for c in USER_METRICS:
            assert r[c] <= r["q_user_totales"]
        assert r["q_user_totales"] <= r["q_orders_totales"]
        assert r["q_users_incentive"] <= r["q_orders_incentive"]


def test_months_are_additive(cat, rows):
    single = []
    for m in P.report_months():
        single += report(cat, P.with_(anchor_month=m, n_months=1)).collect()
    assert sorted(map(tuple, single)) == sorted(map(tuple, rows))


def test_strict_not_above_literal(cat, rows):
    strict = {(r[0], r[1], r[2]): r for r in report(cat, P.with_(strict_confirmed=True)).collect()}
    for r in rows:
        s = strict[(r[0], r[1], r[2])]
        assert s["q_users_incentive"] <= r["q_users_incentive"]
        assert s["q_orders_incentive"] <= r["q_orders_incentive"]


def test_segments_exclusive(spark):
    import __spark_entry__ as E
    seg = E.queries()["seg_labels"](spark, SF)
    dup = seg.groupBy("Month", "vertical", "user_id").count().where(F.col("count") > 1)
    assert dup.count() == 0


def test_repeating_rows_changes_nothing(spark, cat, rows):
    """Order rows and partner rows that come twice, as they are, change no count."""
    twice = cat.with_tables(fact_orders=cat["fact_orders"].union(cat["fact_orders"]),
                            dim_partner=cat["dim_partner"].union(cat["dim_partner"]))
    assert sorted(map(tuple, report(twice, P).collect())) == sorted(map(tuple, rows))
