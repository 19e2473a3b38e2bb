"""The incremental monthly rollup gives the same segments as the full run."""

import os
import uuid

import pytest

from cohortflow.operators.base import order_base
from cohortflow.operators.segments import segments
from cohortflow.params import DRIVER_PARAMS as P
from cohortflow.operators.report import report
from cohortflow.incremental.monthly_state import (RollupMismatch, months_to_refresh, read_rollup, report_from_rollup,
                                                  segments_from_rollup, update_month, update_months)
from cohortflow.sources.catalog import frames_catalog

from micro import PARAMS as MP, poison, tables

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.select("scope", "m", "user_id", "user_type", "users").collect())


def build(spark, cat, params, path):
    for m in months_to_refresh(params):
        update_month(cat, params, m, path)
    return segments_from_rollup(read_rollup(spark, path, params), params)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_rollup_equals_full_run_on_driver_tables(spark, tmp_path):
    from cohortflow.sources.staging import staged_catalog
    cat = staged_catalog(spark, SF)
    full = segments(order_base(cat, P, P.range_start, P.range_end), P)
    params = P.with_(n_months=2)
    inc = build(spark, cat, params, str(tmp_path / "rollup"))
    full2 = segments(order_base(cat, params, params.range_start, params.range_end), params)
    assert rows(inc) == rows(full2)
    assert len(rows(full)) > len(rows(full2)) > 0
    path = str(tmp_path / "rollup")
    got = sorted(map(tuple, report_from_rollup(cat, spark, params, path).collect()))
    assert got == sorted(map(tuple, report(cat, params).collect()))


def test_rollup_keeps_null_guards_and_rerun_is_idempotent(spark, tmp_path):
    import datetime as dt
    cat = frames_catalog(spark, tables(extra_orders=[poison(dt.date(2022, 6, 1))]))
    path = str(tmp_path / "rollup")
    inc = build(spark, cat, MP, path)
    full = segments(order_base(cat, MP, MP.range_start, MP.range_end), MP)
    assert rows(inc) == rows(full)
    update_month(cat, MP, MP.anchor, path)  # re-running a month replaces it
    assert rows(segments_from_rollup(read_rollup(spark, path, MP), MP)) == rows(full)


def test_other_parameters_are_refused(spark, tmp_path):
    cat = frames_catalog(spark, tables())
    path = str(tmp_path / "rollup")
    market = MP.with_(verticals=("Market", "QC"))
    build(spark, cat, market, path)
    with pytest.raises(RollupMismatch):
        read_rollup(spark, path, MP)                             # verticals the rollup has not
    with pytest.raises(RollupMismatch):
        read_rollup(spark, path, market.with_(country_id=1))
    with pytest.raises(RollupMismatch):
        read_rollup(spark, path, market.with_(n_months=40))      # months the rollup has not
    with pytest.raises(RollupMismatch):
        update_month(cat, MP, MP.anchor, path)
    one = market.with_(verticals=("QC",))
    full = segments(order_base(cat, one, one.range_start, one.range_end), one)
    assert rows(segments_from_rollup(read_rollup(spark, path, one), one)) == rows(full)


def test_a_month_that_becomes_empty_is_replaced(spark, tmp_path):
    from micro import ORDERS
    path = str(tmp_path / "rollup")
    build(spark, frames_catalog(spark, tables()), MP, path)
    less = tables()
    less["fact_orders"] = [r for r in less["fact_orders"] if r[3].strftime("%Y-%m") != "2022-12"]
    assert len(less["fact_orders"]) < len(ORDERS)
    cat = frames_catalog(spark, less)
    import datetime as dt
    update_month(cat, MP, dt.date(2022, 12, 1), path)
    full = segments(order_base(cat, MP, MP.range_start, MP.range_end), MP)
    assert rows(segments_from_rollup(read_rollup(spark, path, MP), MP)) == rows(full)


def jobs(spark, work):
    """The number of Spark jobs that ``work`` runs."""
    group = f"jobs-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_backfill_is_one_job_whatever_the_months(spark, tmp_path):
    """A backfill equals month-by-month updates, and its number of jobs does not grow with the months."""
    cat = frames_catalog(spark, tables())
    months = months_to_refresh(MP)
    one, two, few = (str(tmp_path / n) for n in ("one", "two", "few"))
    all_jobs = jobs(spark, lambda: update_months(cat, MP, months, one))
    few_jobs = jobs(spark, lambda: update_months(cat, MP, months[:2], few))
    assert all_jobs <= few_jobs + 1 < len(months)        # one more: the partner table of the first run
    for m in months:
        update_month(cat, MP, m, two)
    full = segments(order_base(cat, MP, MP.range_start, MP.range_end), MP)
    for path in (one, two):
        assert rows(segments_from_rollup(read_rollup(spark, path, MP), MP)) == rows(full)
    with pytest.raises(RollupMismatch):
        read_rollup(spark, few, MP)


def test_rollup_without_any_order(spark, tmp_path):
    cat, path = frames_catalog(spark, {}), str(tmp_path / "rollup")
    update_months(cat, MP, months_to_refresh(MP), path)
    assert read_rollup(spark, path, MP).count() == 0
    assert report_from_rollup(cat, spark, MP, path).count() == 0
