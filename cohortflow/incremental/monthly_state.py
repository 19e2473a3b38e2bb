"""Incremental monthly run: a per-month activity rollup instead of re-scanning history.

Every month the report needs each user's confirmed history since
``history_start`` -- about two years of orders. Production runs the report
monthly, so the history can be kept as a rollup with one row per
(scope, user, month): any order, any confirmed order, the last confirmed
date and a first-purchase flag. A new month then scans one month of orders,
replaces that month of the rollup, and labels segments from the rollup -- the
same conditional aggregates as the full run, over rollup rows (tens of times
fewer than orders).

Layout: ``path/v=<run>/m=YYYY-MM-DD`` holds one run's version of a month (a backfill
writes all its months in one job), and
``path/_rollup.json`` says for which country and verticals the rollup was built
and which version of each month is valid. The file is written last, so a month
that becomes empty is replaced like any other, a run that breaks off changes
nothing, and a reader with other parameters is refused instead of getting
wrong counts. The rollup keeps NULL user ids, so the ``NOT IN`` guards stay exact.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.base import order_base
from ..operators.report import report
from ..operators.segments import month_features, segments_from_features
from ..params import ReportParams, add_months, month_end
from ..sources.catalog import Catalog
from ..sources.staging import HadoopFS

ROLLUP_SCHEMA = "scope STRING, user_id BIGINT, conf BOOLEAN, ld DATE, first BOOLEAN"
STATE = "_rollup.json"


class RollupMismatch(ValueError):
    """The rollup was built for other parameters, or does not hold a month that is needed."""


def monthly_rollup(cat: Catalog, params: ReportParams, start: dt.date, end: dt.date) -> DataFrame:
    """(scope, user_id, m) -> conf, ld, first for orders in [start, end]."""
    base = order_base(cat, params, start, end)
    x = base.selectExpr("user_id", "m", "d", "ok", "first", "explode(seg_scopes) AS scope")
    return x.groupBy("scope", "user_id", "m").agg(
        F.expr("bool_or(ok) AS conf"),
        F.expr("max(CASE WHEN ok THEN d END) AS ld"),
        F.expr("bool_or(first) AS first"),
    ).select("scope", "user_id", "conf", "ld", "first", "m")


def _built_for(params: ReportParams) -> dict:
    return {"country_id": params.country_id, "verticals": sorted(params.verticals)}


def _state(spark: SparkSession, path: str) -> dict | None:
    fs = HadoopFS(spark)
    return json.loads(fs.read(f"{path}/{STATE}")) if fs.exists(f"{path}/{STATE}") else None


def _check(state: dict, params: ReportParams) -> None:
    want = _built_for(params)
    have = {k: state[k] for k in want}
    if have["country_id"] != want["country_id"] or not set(want["verticals"]) <= set(have["verticals"]):
        raise RollupMismatch(f"rollup was built for {have}, not for {want}")


def update_months(cat: Catalog, params: ReportParams, months: list[dt.date], path: str) -> None:
    """Recompute months of the rollup in one job and make their new versions valid at once.

    The job covers the orders from the first to the last of them (a backfill names all
    months) and writes one folder a month; the state file then names the new folder of
    every month, or none for a month without orders.
    """
    months = sorted({m.replace(day=1) for m in months})
    state = _state(cat.spark, path) or {**_built_for(params), "months": {}}
    if _built_for(params) != {k: state[k] for k in _built_for(params)}:
        raise RollupMismatch(f"rollup was built for {state}, not for {_built_for(params)}")
    version, seen = f"v={uuid.uuid4().hex}", Observation()
    rows = monthly_rollup(cat, params, months[0], month_end(months[-1])).where(F.col("m").isin(months))
    (rows.observe(seen, F.collect_set("m").alias("found")).write.partitionBy("m").parquet(f"{path}/{version}"))
    found = set(seen.get["found"])
    for m in months:
        state["months"][m.isoformat()] = f"{version}/m={m.isoformat()}" if m in found else None
    HadoopFS(cat.spark).write(f"{path}/{STATE}", json.dumps(state))


def update_month(cat: Catalog, params: ReportParams, month: dt.date, path: str) -> None:
    """Recompute one month of the rollup and make the new version the valid one."""
    update_months(cat, params, [month], path)


def read_rollup(spark: SparkSession, path: str, params: ReportParams) -> DataFrame:
    """The rollup months the report needs; refuses a rollup that cannot answer for ``params``."""
    state = _state(spark, path)
    if state is None:
        raise RollupMismatch(f"no rollup at {path}")
    _check(state, params)
    needed = [m.isoformat() for m in months_to_refresh(params)]
    missing = [m for m in needed if m not in state["months"]]
    if missing:
        raise RollupMismatch(f"rollup lacks {missing}")
    folders = [f"{path}/{state['months'][m]}" for m in needed if state["months"][m]]
    schema = ROLLUP_SCHEMA + ", m DATE"
    if not folders:
        return spark.createDataFrame([], schema)
    r = spark.read.schema(schema).option("basePath", path).parquet(*folders)
    return r.where(F.col("scope").isin(*params.verticals)).select("scope", "user_id", "conf", "ld", "first", "m")


def segments_from_rollup(rollup: DataFrame, params: ReportParams) -> DataFrame:
    """Same labels as ``segments(order_base(...))``, from rollup rows.

    History: a month before M whose last confirmed date is on or after
    ``history_start`` holds a confirmed order in [history_start, M).
    """
    return segments_from_features(rollup_features(rollup, params), params)


def rollup_features(rollup: DataFrame, params: ReportParams) -> DataFrame:
    """Per-(scope, user) month tests from rollup rows (see ``segments.month_features``)."""
    return month_features(rollup, params, ok="conf", first="first", confirmed_date="ld")


def report_from_rollup(cat: Catalog, spark: SparkSession, params: ReportParams,
                       path: str) -> DataFrame:
    """The full report reading only the reported months of orders plus the rollup."""
    return report(cat, params, features=rollup_features(read_rollup(spark, path, params), params))


def months_to_refresh(params: ReportParams) -> list[dt.date]:
    """All months the rollup must hold for ``params`` (oldest first)."""
    out, m = [], params.range_start.replace(day=1)
    while m <= params.anchor:
        out.append(m)
        m = add_months(m, 1)
    return out
