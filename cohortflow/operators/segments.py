"""User lifecycle segments per (scope, month): Acquisition, New Users, Reactivados.

Definitions (per scope, reported month M, country filter everywhere):

* Acquisition -- a CONFIRMED order in M flagged ``firstSuccessful``.
* New Users   -- any order in M (any status), no CONFIRMED order in
  ``[history_start, last day of M-1]``, and not Acquisition.
* Reactivados -- a CONFIRMED order in M, none in the previous calendar month,
  neither of the above.
Users with CONFIRMED orders in both M and M-1 (retained) get no label.

The original evaluates each (scope, month) with three uncorrelated ``NOT IN``
subqueries over the fact. Here all scopes and months come from one pass:
the reported months are parameters, so each month's membership tests are
bitmask aggregates of one ``groupBy(scope, user)`` (bit i = reported month i):

  any   an order in M              conf  a CONFIRMED order in M
  first a first purchase in M      hist  a CONFIRMED order in [history_start, M)
  prev  a CONFIRMED order in M-1

``bit_or`` aggregates combine map-side (partial aggregation), so a user who
owns a third of all orders still ships one row per task into the single
shuffle; no window, no sort, no self-join, and the aggregate stays five
columns wide whatever the number of months. A month's label is a CASE over
bits of the masks, evaluated after the report's join or per exploded month
where a long table is wanted.

``NOT IN`` semantics for NULL user ids are kept by two guard bitmasks per
scope taken from the NULL user's row of the same aggregate (one row per
scope, so the guard table is bounded by the number of scopes and broadcast
safely): a NULL id in the history set or the first-purchase set empties New
Users; a NULL id among last month's buyers empties Reactivados. NULL users
themselves never get a label (the report joins on equality).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import ReportParams

ACQUISITION = "Acquisition"
NEW_USERS = "New Users"
REACTIVATED = "Reactivados"


def _d(x) -> str:
    return f"DATE'{x.isoformat()}'"


# Month tests are bitmasks: bit i of word i // WORD is month i of the report
# (0 = anchor month, counting back). Five bit_or aggregates per 62 months
# keep the aggregate narrow (whole-stage codegen stays on) for any n_months.
WORD = 62
TESTS = ("any", "conf", "first", "hist", "prev")


def _words(params: ReportParams) -> range:
    return range((params.n_months + WORD - 1) // WORD)


def month_index_sql(params: ReportParams, col: str) -> str:
    """Months between the anchor month and month-start ``col`` (0 = anchor)."""
    return f"CAST(months_between({_d(params.anchor)}, {col}) AS INT)"


def _bit(idx: str, w: int, n: int) -> str:
    """The bit of month index ``idx`` in word ``w`` (0 when outside the report)."""
    lo, hi = w * WORD, min(n, (w + 1) * WORD)
    return f"CASE WHEN {idx} >= {lo} AND {idx} < {hi} THEN shiftleft(1L, {idx} - {lo}) ELSE 0L END"


def _below(idx: str, w: int, n: int) -> str:
    """Bits of all report months more recent than month index ``idx`` (indices < idx)."""
    lo, hi = w * WORD, min(n, (w + 1) * WORD)
    return f"shiftleft(1L, least(greatest({idx}, {lo}), {hi}) - {lo}) - 1L"


def month_features(rows: DataFrame, params: ReportParams, ok: str, first: str,
                   confirmed_date: str) -> DataFrame:
    """Group ``rows`` (scope, user_id, m, ...) by (scope, user_id) into five
    month-test bitmasks per word. ``ok``/``first``/``confirmed_date`` are SQL
    over ``rows``: order rows (date ``d``) or monthly rollup rows (last
    confirmed date ``ld``) both fit.

    any   an order in month i            conf  a CONFIRMED order in month i
    first a first purchase in month i    prev  a CONFIRMED order in month i+1's
                                               previous month (the month before i)
    hist  a CONFIRMED order on or after history_start, before month i
    """
    n, hs, idx = params.n_months, _d(params.history_start), month_index_sql(params, "m")
    aggs = []
    for w in _words(params):
        aggs += [f"bit_or({_bit(idx, w, n)}) AS any_{w}",
                 f"bit_or(CASE WHEN {ok} THEN {_bit(idx, w, n)} ELSE 0L END) AS conf_{w}",
                 f"bit_or(CASE WHEN {first} THEN {_bit(idx, w, n)} ELSE 0L END) AS first_{w}",
                 f"bit_or(CASE WHEN {ok} AND {confirmed_date} >= {hs} "
                 f"THEN {_below(idx, w, n)} ELSE 0L END) AS hist_{w}",
                 # a CONFIRMED order in month m is "last month" for month m + 1
                 f"bit_or(CASE WHEN {ok} THEN {_bit(f'({idx} - 1)', w, n)} ELSE 0L END) "
                 f"AS prev_{w}"]
    return rows.groupBy("scope", "user_id").agg(*[F.expr(a) for a in aggs])


def activity(base: DataFrame, params: ReportParams) -> DataFrame:
    """(scope, user_id) -> month-test bitmasks (see ``month_features``)."""
    x = base.selectExpr("user_id", "m", "d", "ok", "first", "explode(seg_scopes) AS scope")
    return month_features(x, params, ok="ok", first="first", confirmed_date="d")


def null_user_guards(act: DataFrame, params: ReportParams) -> DataFrame:
    """scope -> guard bitmasks from the NULL user id's row (one row per scope,
    so the table is bounded by the number of scopes)."""
    cols = []
    for w in _words(params):
        cols += [f"hist_{w} | first_{w} AS g_new_{w}",  # NULL in history / first-purchase set
                 f"prev_{w} AS g_react_{w}"]           # NULL among last month's buyers
    return act.where(F.col("user_id").isNull()).selectExpr("scope", *cols)


def label_masks(act: DataFrame, params: ReportParams) -> DataFrame:
    """(scope, user_id) -> month-test bitmasks plus the NULL guards of the scope.

    The row keeps the partitioning of the activity aggregate, so joining it
    on (scope, user_id) needs no further shuffle of this side.
    """
    a = act.where(F.col("user_id").isNotNull())
    words = list(_words(params))
    if params.null_users == "sql":
        a = a.join(F.broadcast(null_user_guards(act, params)), "scope", "left")
        guards = [f"coalesce(g_new_{w}, 0L) AS g_new_{w}" for w in words] + \
                 [f"coalesce(g_react_{w}, 0L) AS g_react_{w}" for w in words]
    else:
        guards = [f"0L AS g_new_{w}" for w in words] + [f"0L AS g_react_{w}" for w in words]
    masks = [f"{t}_{w}" for w in words for t in TESTS]
    return a.selectExpr("scope", "user_id", *masks, *guards)


def label_sql(params: ReportParams, idx: str) -> str:
    """Segment label of month index ``idx`` from the bitmasks (NULL = none)."""
    def b(name: str) -> str:
        if len(_words(params)) == 1:
            return f"(shiftright({name}_0, {idx}) & 1L) = 1L"
        arms = " ".join(f"WHEN {w} THEN {name}_{w}" for w in _words(params))
        return f"(shiftright(CASE {idx} DIV {WORD} {arms} END, {idx} % {WORD}) & 1L) = 1L"
    # acquisition = first purchase; new = an order, no history, no NULL guard;
    # reactivated = bought now, not last month, neither of the above
    return (f"CASE WHEN {b('first')} THEN '{ACQUISITION}' "
            f"WHEN {b('any')} AND NOT {b('hist')} AND NOT {b('g_new')} THEN '{NEW_USERS}' "
            f"WHEN {b('conf')} AND NOT {b('prev')} AND NOT {b('g_react')} THEN '{REACTIVATED}' END")


def confirmed_sql(params: ReportParams, idx: str) -> str:
    """1 when the user has a CONFIRMED order in month ``idx`` (the original's ``users``)."""
    arms = " ".join(f"WHEN {w} THEN conf_{w}" for w in _words(params))
    return f"shiftright(CASE {idx} DIV {WORD} {arms} END, {idx} % {WORD}) & 1L"


def segments(base: DataFrame, params: ReportParams) -> DataFrame:
    """Labelled (scope, m, user_id, user_type, users) for every reported month and scope."""
    return segments_from_features(activity(base, params), params)


def segments_from_features(act: DataFrame, params: ReportParams) -> DataFrame:
    x = label_masks(act, params).selectExpr(
        "*", f"explode(sequence(0, {params.n_months - 1})) AS i")
    return x.selectExpr(
        "scope", f"add_months({_d(params.anchor)}, -i) AS m", "user_id",
        f"{label_sql(params, 'i')} AS user_type",
        f"CAST({confirmed_sql(params, 'i')} AS BIGINT) AS users",
    ).where("user_type IS NOT NULL")
