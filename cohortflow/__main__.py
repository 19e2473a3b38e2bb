"""Run the monthly report from the command line.

  python -m cohortflow --catalog ROOT --anchor 2023-03 --months 5 \\
      --history-start 2021-01-01 --out PATH [--format csv|parquet] [--as-of 2023-04-02]

ROOT holds one Parquet dataset per logical table (``ROOT/fact_orders``,
``ROOT/dim_partner``, ...). The CSV sink writes one file with a header, like
the original export; the Parquet sink is partitioned by Month.
"""

from __future__ import annotations

import argparse
import datetime as dt

from .params import VERTICALS, ReportParams


def parse_args(argv=None) -> argparse.Namespace:
    ap = argparse.ArgumentParser(prog="cohortflow", description=__doc__.splitlines()[0])
    ap.add_argument("--catalog", required=True, help="root folder of the logical tables")
    ap.add_argument("--anchor", required=True, help="latest reported month, YYYY-MM")
    ap.add_argument("--months", type=int, default=5)
    ap.add_argument("--history-start", default="2021-01-01")
    ap.add_argument("--country", type=int, default=3)
    ap.add_argument("--as-of", default=None, help="day the report is run (default: today)")
    ap.add_argument("--verticals", default=",".join(VERTICALS))
    ap.add_argument("--strict-confirmed", action="store_true")
    ap.add_argument("--null-users", choices=("sql", "ignore"), default="sql",
                    help="NOT IN semantics for NULL user ids, or drop them without effect")
    ap.add_argument("--out", required=True)
    ap.add_argument("--format", choices=("csv", "parquet"), default="csv")
    return ap.parse_args(argv)


def params_from(args: argparse.Namespace) -> ReportParams:
    day = dt.date.fromisoformat
    return ReportParams(
        anchor_month=day(args.anchor + "-01" if len(args.anchor) == 7 else args.anchor),
        n_months=args.months, history_start=day(args.history_start), country_id=args.country,
        as_of=day(args.as_of) if args.as_of else None,
        verticals=tuple(v.strip() for v in args.verticals.split(",") if v.strip()),
        strict_confirmed=args.strict_confirmed, null_users=args.null_users)


def main(argv=None, spark=None) -> str:
    from .operators.report import report
    from .session import get_session
    from .sources.catalog import ParquetCatalog
    from .sources.sinks import write_csv, write_parquet

    args = parse_args(argv)
    spark = spark or get_session()
    df = report(ParquetCatalog(spark, args.catalog), params_from(args))
    return (write_csv if args.format == "csv" else write_parquet)(df, args.out)


if __name__ == "__main__":
    print(main())
