"""Run parameters of the monthly lifecycle report.

Every value the original notebook hard-codes (anchor month, number of months,
history horizon, country, the 100-day coupon rule) is a field here, so one
Spark job can be re-run for another period or market without editing code.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

# Fixed values that must equal the original report: vertical names (in the
# order of the original run), the order status that counts as a purchase,
# the country the report is written for, and the coupon look-back in days.
VERTICALS = ("Local Stores", "QC", "Market", "Pharmacy", "Drinks", "DMarts", "Kiosks")
CONFIRMED = "CONFIRMED"
DEFAULT_COUNTRY_ID = 3
COUPON_LOOKBACK_DAYS = 100


@dataclass(frozen=True)
class ReportParams:
    """Parameters of one report run.

    anchor_month   latest month reported (any day of it; it is truncated to day 1)
    n_months       how many months, counting back from the anchor
    history_start  start of the "no purchase since" horizon for New Users
    country_id     country filter applied to every order
    as_of          day the report is "run"; coupons count if created after
                   ``as_of - COUPON_LOOKBACK_DAYS`` (default: today in UTC, the
                   zone the report's dates are kept in)
    verticals      which scopes to report
    strict_confirmed  if True the incentive columns require a CONFIRMED order
                   for every incentive (the original guards only the voucher term)
    null_users     'sql' reproduces NOT IN semantics for NULL user ids,
                   'ignore' drops NULL users without side effects
    campaign_item_key  column of the campaign log items that names the campaign
    """

    anchor_month: dt.date
    n_months: int = 5
    history_start: dt.date = dt.date(2021, 1, 1)
    country_id: int = DEFAULT_COUNTRY_ID
    as_of: dt.date | None = None
    verticals: tuple[str, ...] = field(default=VERTICALS)
    strict_confirmed: bool = False
    null_users: str = "sql"
    campaign_item_key: str = "id"

    def __post_init__(self) -> None:
        if self.n_months < 1:
            raise ValueError("n_months must be >= 1")
        unknown = set(self.verticals) - set(VERTICALS)
        if unknown:
            raise ValueError(f"unknown verticals: {sorted(unknown)}")
        if self.null_users not in ("sql", "ignore"):
            raise ValueError("null_users must be 'sql' or 'ignore'")

    # ---- derived dates (pure Python, used for SQL text and literals) ----
    @property
    def anchor(self) -> dt.date:
        return self.anchor_month.replace(day=1)

    def report_months(self) -> list[dt.date]:
        """First days of the reported months, newest first."""
        return [add_months(self.anchor, -i) for i in range(self.n_months)]

    @property
    def range_start(self) -> dt.date:
        """First day any query needs: history horizon or the month before the
        earliest reported month, whichever is earlier."""
        return min(self.history_start, add_months(self.report_months()[-1], -1))

    @property
    def range_end(self) -> dt.date:
        return month_end(self.anchor)

    @property
    def coupon_cutoff(self) -> dt.date:
        """Coupons count when ``DATE(created_at) > coupon_cutoff``."""
        as_of = self.as_of or dt.datetime.now(dt.timezone.utc).date()
        return as_of - dt.timedelta(days=COUPON_LOOKBACK_DAYS)

    def with_(self, **kw) -> "ReportParams":
        return replace(self, **kw)


def add_months(d: dt.date, n: int) -> dt.date:
    y, m = divmod(d.year * 12 + (d.month - 1) + n, 12)
    return dt.date(y, m + 1, 1)


def month_end(d: dt.date) -> dt.date:
    return add_months(d.replace(day=1), 1) - dt.timedelta(days=1)


# Parameters for the driver's synthetic tables (orders span 1995-01 .. 2001-08).
DRIVER_PARAMS = ReportParams(
    anchor_month=dt.date(1997, 6, 1),
    n_months=5,
    history_start=dt.date(1995, 6, 1),
    as_of=dt.date(1996, 4, 10),
)
