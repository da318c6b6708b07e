"""Command line: ``python -m ticksmith.cli QUERY`` shows a query of the catalogue; some names are whole reports.

``--since DAY`` keeps rows from that day on, ``--date DAY`` those of one day, by the result's first date or time column.
``python -m ticksmith.cli report`` prints the newest trades, events and snapshots, ``analysis`` round trips, blocked
entries and equity figures, ``daily`` a line for each day.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticksmith import session
from ticksmith.functions import scalars as S
from ticksmith.operators import reports
from ticksmith.plans import catalog

REPORTS = {
    "report": ["latest_trips", "latest_log_rows", "reason_histogram"],
    "analysis": ["round_trip_stats", "reason_histogram", "equity_stats"],
    "daily": ["daily_summary"],
}


def dated(df: DataFrame, since: str | None, date: str | None) -> DataFrame:
    """The rows of the asked days; a result without a date or time column is left whole."""
    column = next((n for n, k in df.dtypes if k in ("date", "timestamp", "timestamp_ntz")), None)
    if column and since:
        df = df.where(S.since_day(F.col(column), since))
    if column and date:
        df = df.where(S.on_day(F.col(column), date))
    return df


def main(argv: list[str] | None = None) -> int:
    found = catalog.queries()
    parser = argparse.ArgumentParser(prog="ticksmith", description=__doc__)
    parser.add_argument("query", choices=sorted([*found, *REPORTS]))
    parser.add_argument("--sf-dir", default="/root/testdata/sf0.001")
    parser.add_argument("--rows", type=int, default=20, help="rows to print; the query itself is whole")
    parser.add_argument("--since", help="first day, YYYY-MM-DD")
    parser.add_argument("--date", help="the only day, YYYY-MM-DD")
    parser.add_argument("--master")
    parser.add_argument("--explain", action="store_true")
    args = parser.parse_args(argv)
    spark = session.build(args.master)
    for name in REPORTS.get(args.query, [args.query]):
        df = dated(found[name](spark, args.sf_dir), args.since, args.date)
        if args.query == "daily":
            df = df.orderBy("report_date").select(reports.summary_text().alias("summary"))
        print(name)
        df.explain("formatted") if args.explain else df.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
