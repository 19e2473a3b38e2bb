"""The monthly segment x incentive report, all months and verticals in one job.

Plan (S = shuffle):
  fact[history_start, anchor] --join partner scopes--> --explode seg scopes-->
       activity bitmasks  [S1: partial agg by (scope, user)]  -> label masks
       (+ NULL-user guard row per scope, broadcast: bounded by the scopes)
  fact[reported months] --join partner scopes--> (order, user, month, cells)
       union incentives of the side tables (order, bits)
       --> one row per order id [S2: partial agg by order_id]
       --cells to rows--> user level [S3: partial agg by (scope, month, user, vertical)]
       --[S4: to (scope, user)] join label masks (no shuffle on that side)-->
       --label of the row's month--> sum by (month, vertical, type) [S5, S6, tiny]

Ten ``COUNT(DISTINCT CASE ...)`` become aggregates: one row per user per
(scope, month, vertical) with ``max`` of each flag, then sums. That avoids
Spark's ``Expand`` for many distinct aggregates and never holds a whole group
in memory.

Distinct orders: an order row is (order, user, month) and one BIGINT of cells:
CELL_BITS flags for every (scope, vertical) it counts in. Rows that repeat an
order id (other status, other partner, repeated partner rows) merge by
``bit_or``, and the side tables' rows merge in the same aggregate, so orders
and incentives need no join. All of it combines before the shuffle: an id on a
third of all rows is one row per task there. Rows without an order id count for
their users only: they are a group per user and month in the same aggregate.

The order level is written once (shared folder) and read by what follows; the
write also tells how many ids meet several users or months. Such ids cannot be
one row: they alone are read again, between their smallest and largest id,
reduced per (order, user, month) and joined to their incentives (both sides
plain tables, so the planner knows their size and a hot id's join can be split).
An id of several users counts once per (month, vertical, type): its order flags
travel in rows of their own (``oid`` set) and are reduced by id after the labels
are known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.periods import month_label
from ..functions.scopes import CELL_BITS, final_cells
from ..params import ReportParams
from ..session import written
from ..sources.catalog import Catalog
from ..sources.schemas import METRIC_COLUMNS
from .base import order_base
from .flags import BANK, CORPORATE, CRM, ROW_TERMS, incentive_rows
from .segments import activity, label_masks, label_sql, month_index_sql

# Flags of a cell. OK: confirmed; VOUCHER, DF0, PLUS: confirmed and so marked; FREE: marked df0 or plus in any status.
PRESENT, OK, VOUCHER, DF0, PLUS, FREE = (1 << i for i in range(CELL_BITS))
USER_SUMS = ("u_voucher", "u_crm", "u_df0", "u_corporate", "u_banks", "u_plus", "u_tot", "o_tot", "u_inc", "o_inc")


def order_rows(base: DataFrame) -> DataFrame:
    """order_id, user_id, m, cells of every order row in a reported scope."""
    t = ROW_TERMS
    flags = (f"{PRESENT}L + CASE WHEN ok THEN {OK}L + CASE WHEN {t['vou']} THEN {VOUCHER}L ELSE 0L END "
             f"+ CASE WHEN {t['df0']} THEN {DF0}L ELSE 0L END + CASE WHEN {t['plus']} THEN {PLUS}L ELSE 0L END ELSE 0L END "
             f"+ CASE WHEN {t['df0']} OR {t['plus']} THEN {FREE}L ELSE 0L END")
    return base.where("final_bits <> 0").selectExpr("order_id", "user_id", "m", f"final_bits * ({flags}) AS cells")


SHARED = "coalesce(user_id < last_user OR unknown AND user_id IS NOT NULL, false)"
SEVERAL = f"(m <> last_m OR {SHARED})"


def marked_orders(rows: DataFrame, cat: Catalog, params: ReportParams) -> DataFrame:
    """One row per order id (without one: per user and month): its least and last user and month, cells and incentives."""
    # rows without an id are a group per user and month: no group of all of them
    lone = [f"CASE WHEN order_id IS NULL THEN {c} END AS lone_{c.split('_')[0]}" for c in ("user_id", "m")]
    sides = incentive_rows(cat, params).selectExpr(
        "order_id", "CAST(NULL AS BIGINT) AS lone_user", "CAST(NULL AS DATE) AS lone_m", "CAST(NULL AS BIGINT) AS user_id",
        "CAST(NULL AS DATE) AS m", "0L AS cells", "inc", "false AS unknown")
    return (rows.selectExpr("order_id", *lone, "user_id", "m", "cells", "0 AS inc", "user_id IS NULL AS unknown").union(sides)
            .groupBy("order_id", "lone_user", "lone_m")
            .agg(*[F.expr(e) for e in ("min(user_id) AS user_id", "max(user_id) AS last_user", "min(m) AS m", "max(m) AS last_m",
                                       "bit_or(cells) AS cells", "bit_or(inc) AS inc", "bool_or(unknown) AS unknown")])
            .where("cells <> 0")         # an id without a row of orders comes from a side table only
            .selectExpr("order_id", "user_id", "m", "cells", "inc", f"{SEVERAL} AS several", f"{SHARED} AS shared"))


def order_level(base: DataFrame, cat: Catalog, params: ReportParams) -> DataFrame:
    """(user_id, m, cells, inc, users, orders, oid): one row per order, or per (order, user, month) of an id that has several.

    ``users`` and ``orders`` say whether the row counts for its user and as an
    order; ``oid`` is set where the order is one of several users.
    """
    rows, seen = order_rows(base), Observation()
    marked = written(marked_orders(rows, cat, params).observe(
        seen, F.expr("count_if(several) AS n"), F.expr("min(CASE WHEN several THEN order_id END) AS lo"),
        F.expr("max(CASE WHEN several THEN order_id END) AS hi")), "orders")
    single = marked.where("NOT several").selectExpr("user_id", "m", "cells", "inc", "true AS users", "order_id IS NOT NULL AS orders",
                                                    "CAST(NULL AS BIGINT) AS oid")
    found = seen.get
    if not found["n"]:
        return single
    several = written(marked.where("several").select("order_id", "inc", "shared"), "orders-several")
    again = (rows.where(F.col("order_id").between(found["lo"], found["hi"])).join(several, "order_id")
             .groupBy("order_id", "user_id", "m", "inc", "shared").agg(F.expr("bit_or(cells) AS cells"))
             .selectExpr("user_id", "m", "cells", "inc", "order_id", "shared", "explode(CASE WHEN shared THEN array(true, false) ELSE array(true) END) AS users")
             .selectExpr("user_id", "m", "cells", "inc", "users", "NOT shared OR NOT users AS orders",
                         "CASE WHEN NOT users THEN order_id END AS oid"))
    return single.union(again)


def user_level(orders: DataFrame, params: ReportParams) -> DataFrame:
    """(scope, m, user_id, vertical, oid) -> per-user 0/1 flags and order counts.

    ``oid`` is NULL but for the order counts of shared ids, one row each.
    """
    cells = ", ".join(f"named_struct('scope', '{s}', 'vertical', '{v}', 'b', shiftright(cells, {CELL_BITS * i}) & {(1 << CELL_BITS) - 1}L)"
                      for i, (s, v) in enumerate(final_cells(params.verticals)))
    x = orders.selectExpr("user_id", "m", "inc", "users", "orders", "oid", f"inline(array({cells}))").where("b <> 0")
    ok = f"b & {OK}L <> 0"
    if params.strict_confirmed:
        any_ = f"b & {VOUCHER | DF0 | PLUS}L <> 0 OR ({ok} AND inc <> 0)"
    else:  # AND binds tighter than OR: only the voucher term needs a CONFIRMED order
        any_ = f"b & {VOUCHER | FREE}L <> 0 OR inc <> 0"
    flags = {"voucher": f"b & {VOUCHER}L <> 0", "crm": f"{ok} AND inc & {CRM} <> 0", "df0": f"b & {DF0}L <> 0",
             "corporate": f"{ok} AND inc & {CORPORATE} <> 0", "banks": f"{ok} AND inc & {BANK} <> 0", "plus": f"b & {PLUS}L <> 0",
             "tot": ok, "inc": any_}
    counts = [f"CAST({'users' if n[0] == 'u' else 'orders'} AND ({flags[n[2:]]}) AS BIGINT) AS {n}" for n in USER_SUMS]
    return x.selectExpr("scope", "m", "user_id", "vertical", "oid", *counts).groupBy("scope", "m", "user_id", "vertical", "oid").agg(
        *[F.expr(f"{'max' if n[0] == 'u' else 'sum'}({n}) AS {n}") for n in USER_SUMS])


def summarize(users: DataFrame, by=("m", "vertical", "user_type")) -> DataFrame:
    """Sum per-user rows to the report grain with the report's column names.

    A NULL user id is no distinct user (``COUNT(DISTINCT ...)`` skips NULL),
    but its orders still count. A shared order id counts once per group.
    """
    parts = []
    for c in USER_SUMS:
        if c[0] == "u":
            parts.append(F.expr(f"sum(CASE WHEN user_id IS NOT NULL THEN {c} END) AS {c}"))
        else:
            parts.append(F.expr(f"CASE WHEN oid IS NULL THEN sum({c}) ELSE max({c}) END AS {c}"))
    sums = [F.expr(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {n}") for c, n in zip(USER_SUMS, METRIC_COLUMNS)]
    r = users.groupBy(*by, "oid").agg(*parts).groupBy(*by).agg(*sums)
    rest = [c for c in by if c != "m"]
    return r.select(month_label(F.col("m")).alias("Month"), *rest, *METRIC_COLUMNS)


def report_orders(cat: Catalog, params: ReportParams) -> DataFrame:
    """Order level of the reported months (NULL users dropped: never labelled)."""
    months = params.report_months()
    # the counted orders come from their own scan: its date range is only the
    # reported months, so the Parquet reader skips the rest of the history
    base = order_base(cat, params, months[-1], params.range_end)
    return order_level(base.where(F.col("m").isin(*months) & F.col("user_id").isNotNull()), cat, params)


def month_features_of(cat: Catalog, params: ReportParams) -> DataFrame:
    """Per-(scope, user) month tests from the order history since ``history_start``."""
    return activity(order_base(cat, params, params.range_start, params.range_end), params)


def report(cat: Catalog, params: ReportParams, features: DataFrame | None = None) -> DataFrame:
    """The full report: Month, vertical, user_type and the ten counts.

    ``features`` are precomputed per-(scope, user) month tests (for example
    from the monthly rollup of ``incremental.monthly_state``); without them the
    order history since ``history_start`` is scanned.
    """
    if features is None:
        features = month_features_of(cat, params)
    return summarize(labelled_users(cat, params, features))


def labelled_users(cat: Catalog, params: ReportParams, features: DataFrame) -> DataFrame:
    """User-level rows of the reported orders with the label of their month.

    The join is on (scope, user_id): the label side keeps the partitioning of
    the segment aggregate; the month's label is picked after the join.
    """
    return (user_level(report_orders(cat, params), params)
            .join(label_masks(features, params), ["scope", "user_id"], "inner")
            .selectExpr("*", f"{label_sql(params, month_index_sql(params, 'm'))} AS user_type")
            .where("user_type IS NOT NULL"))


def monthly_reports(cat: Catalog, params: ReportParams) -> list[DataFrame]:
    """One report per month, newest first, all from one history pass and one order level (their exchanges are reused)."""
    users = labelled_users(cat, params, month_features_of(cat, params))
    return [summarize(users.where(F.col("m") == F.lit(m))) for m in params.report_months()]


def scope_month_metrics(cat: Catalog, params: ReportParams) -> DataFrame:
    """The ten counts per (Month, vertical) over every month of the fact, no
    segmentation."""
    return summarize(user_level(order_level(order_base(cat, params, None, None), cat, params), params), by=("m", "vertical"))
