"""Golden micro fixture: every edge case of the segment and incentive rules."""

import datetime as dt

import pytest

from cohortflow.operators.report import report
from cohortflow.sources.catalog import frames_catalog
from cohortflow.sources.schemas import METRIC_COLUMNS

from micro import PARAMS, expected, poison, tables

D = dt.date


def run(spark, params=PARAMS, **kw):
    cat = frames_catalog(spark, tables(**kw))
    out = {}
    for r in report(cat, params).collect():
        assert r["Month"] == "2023-03"
        out[(r["vertical"], r["user_type"])] = tuple(r[c] for c in METRIC_COLUMNS)
    return out


def test_base(spark):
    assert run(spark) == expected()


def test_poisoned_history(spark):
    assert run(spark, extra_orders=[poison(D(2022, 6, 1))]) == expected(poisoned=True)


def test_poisoned_last_month(spark):
    # NULL among last month's buyers empties Reactivados; it is also history,
    # so New Users is empty too: only Acquisition remains
    got = run(spark, extra_orders=[poison(D(2023, 2, 10))])
    assert got == expected(only_acq=True)


def test_poisoned_first_purchase(spark):
    got = run(spark, extra_orders=[poison(D(2023, 3, 10), first=True)])
    assert got == expected(poisoned=True)


def test_rejected_null_user_is_harmless(spark):
    assert run(spark, extra_orders=[poison(D(2022, 6, 10), status="REJECTED")]) == expected()


def test_ignore_null_users_option(spark):
    got = run(spark, PARAMS.with_(null_users="ignore"), extra_orders=[poison(D(2022, 6, 1))])
    assert got == expected()


def test_duplicate_side_rows_change_nothing(spark):
    assert run(spark, dup_side_rows=True) == expected()


def test_strict_confirmed_never_exceeds_literal(spark):
    lit = run(spark)
    strict = run(spark, PARAMS.with_(strict_confirmed=True))
    assert lit.keys() == strict.keys()
    for k in lit:
        for a, b in zip(strict[k], lit[k]):
            assert a <= b
    # user 5 (REJECTED order with voucher and plus) counts only in the literal form
    assert strict[("Pharmacy", "New Users")][8] == 2


@pytest.mark.parametrize("bad", [{"n_months": 0}, {"verticals": ("Nope",)}, {"null_users": "x"}])
def test_params_validated(bad):
    with pytest.raises(ValueError):
        PARAMS.with_(**bad)


def test_duplicate_order_rows_counted_once(spark):
    from micro import ORDERS
    dup = [r for r in ORDERS if r[0] in (2, 4, 11)]  # New Users / Reactivados orders, again
    assert run(spark, extra_orders=dup) == expected()
