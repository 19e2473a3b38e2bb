"""Micro golden fixture (FIXTURES.md F-C): 16 orders, each pinning one edge case."""

import datetime as dt

from cohortflow.params import ReportParams

D = dt.date
PARAMS = ReportParams(anchor_month=D(2023, 3, 1), n_months=1, history_start=D(2021, 1, 1),
                      country_id=3, as_of=D(1996, 4, 10))

C, R = "CONFIRMED", "REJECTED"

# order, user, partner, date, status, country, first, voucher, ship, logistics, plus
ORDERS = [
    (1, 1, 10, D(2023, 3, 5), C, 3, True, 1, 5.0, False, 0),
    (2, 2, 10, D(2023, 3, 6), C, 3, False, 0, 0.0, True, 0),
    (3, 3, 10, D(2022, 12, 10), C, 3, True, 0, 5.0, False, 0),
    (4, 3, 10, D(2023, 3, 7), C, 3, False, 0, 5.0, False, 0),
    (5, 4, 10, D(2023, 2, 28), C, 3, True, 0, 5.0, False, 0),
    (6, 4, 10, D(2023, 3, 1), C, 3, False, 0, 5.0, False, 0),
    (7, 5, 10, D(2023, 3, 8), R, 3, False, 1, 5.0, False, 1),
    (8, 6, 10, D(2022, 12, 11), C, 3, True, 0, 5.0, False, 0),
    (9, 6, 10, D(2023, 3, 9), R, 3, False, 0, 5.0, False, 0),
    (10, 7, 10, D(2020, 12, 31), C, 3, True, 0, 5.0, False, 0),
    (11, 7, 10, D(2023, 3, 31), C, 3, False, 0, 5.0, False, 0),
    (12, 8, 10, D(2023, 3, 10), C, 1, True, 0, 5.0, False, 0),
    (13, None, 10, D(2023, 3, 11), C, 3, False, 0, 5.0, False, 0),
    (14, 9, 99, D(2023, 3, 12), C, 3, True, 0, 5.0, False, 0),
    (15, 10, 11, D(2023, 3, 13), C, 3, True, 0, 5.0, False, 0),
    (16, 11, 12, D(2023, 3, 14), C, 3, True, 0, 5.0, False, 0),
]
DETAILS = {1: [1, 2]}


def order_row(o, user, partner, d, status, country, first, vou, ship, logi, plus):
    det = [((p,), None) for p in DETAILS.get(o, [])]
    return (o, (user,), (partner,), d, country, status, (first,), vou, ship, logi, plus, det, [])


def tables(extra_orders=(), dup_side_rows=False):
    orders = [order_row(*r) for r in list(ORDERS) + list(extra_orders)]
    coupons = [(1, 1, dt.datetime(2023, 3, 5, 10)), (1, 2, dt.datetime(2023, 3, 5, 11)),
               (4, 1, dt.datetime(1990, 1, 1))]
    wallet = [(2, "xCOOPx")]
    items = [(500, 100)]
    if dup_side_rows:
        coupons, wallet, items = coupons * 2, wallet * 3, items * 2
    return {
        "fact_orders": orders,
        "dim_partner": [
            (10, None, ("Pharmacy",), ("Farmacia",), 1, (1,)),
            (11, True, ("Pharmacy",), ("Farmacia",), 1, (1,)),
            (12, False, (None,), ("x",), 1, (1,)),
        ],
        "fact_wallet": wallet,
        "fact_talon_coupons": coupons,
        "dim_talon_campaigns": [(1, "A-LOCAL"), (2, "B-CENTRAL")],
        "order_log": [(100, 11)],
        "campaign_log_items": items,
        "campaign": [(500, "BankX")],
    }


def poison(d, status="CONFIRMED", first=False, order_id=17):
    return (order_id, None, 10, d, status, 3, first, 0, 5.0, False, 0)


ACQ_P = (1, 1, 0, 0, 0, 0, 1, 1, 1, 1)
NEW_P = (0, 0, 1, 1, 1, 0, 2, 2, 3, 3)
REA_P = (0, 0, 0, 0, 0, 0, 1, 1, 0, 0)
REA_POISONED = (0, 0, 1, 1, 1, 0, 3, 3, 2, 2)


def expected(poisoned=False, only_acq=False):
    rows = {}
    for v in ("Pharmacy", "Local Stores", "QC"):
        rows[(v, "Acquisition")] = (1, 1, 0, 0, 0, 0, 2, 2, 1, 1) if v == "QC" else ACQ_P
        if only_acq:
            continue
        if poisoned:
            rows[(v, "Reactivados")] = REA_POISONED
        else:
            rows[(v, "New Users")] = NEW_P
            rows[(v, "Reactivados")] = REA_P
    rows[("DMarts", "Acquisition")] = (0, 0, 0, 0, 0, 0, 1, 1, 0, 0)
    return rows
