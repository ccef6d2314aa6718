"""Row predicates that reach the scan as plain comparisons."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendspark.functions.scalars import moment

_UNITS = {"hours": "hours", "days": "days", "months": "months"}


def within(column: str | Column, as_of, unit: str, n: int) -> Column:
    """Strictly later than as_of minus n units (hours, days or months)."""
    if unit not in _UNITS:
        raise ValueError(f"unit must be one of {sorted(_UNITS)}")
    col = F.col(column) if isinstance(column, str) else column
    return col > moment(as_of) - F.expr(f"make_interval(0, {int(n) if unit == 'months' else 0}, 0, "
                                         f"{int(n) if unit == 'days' else 0}, "
                                         f"{int(n) if unit == 'hours' else 0}, 0, 0)")


def year_of(as_of: str | datetime | date) -> int:
    return as_of.year if isinstance(as_of, (datetime, date)) else int(str(as_of)[:4])


def in_year(column: str, as_of: str | datetime | date) -> Column:
    """Calendar year of as_of, written as a range so that partition pruning and
    row-group statistics apply."""
    year = year_of(as_of)
    return (F.col(column) >= F.lit(date(year, 1, 1))) & (F.col(column) <= F.lit(date(year, 12, 31)))


def both(conditions: list[Column]) -> Column:
    """AND of any number of conditions; none means true."""
    result = F.lit(True)
    for condition in conditions:
        result = result & condition
    return result
