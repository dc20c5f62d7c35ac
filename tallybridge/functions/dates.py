"""Date text and month arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_date(text: Column) -> Column:
    """The ledger spellings of a date; null where the text is none of them or no real day.

    ``YYYY-MM-DD`` with an optional time part, ``DD-MM-YYYY`` and ``DD.MM.YYYY``, and the
    statement's ``MM/DD/YYYY``.
    """
    t = F.trim(text)
    iso = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})(?:[T ].*)?$", 1)
    dmy = F.regexp_replace(F.regexp_extract(t, r"^(\d{1,2}[-.]\d{1,2}[-.]\d{4})$", 1), r"\.", "-")
    mdy = F.regexp_extract(t, r"^(\d{1,2}/\d{1,2}/\d{4})$", 1)
    return F.coalesce(
        F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd"),
        F.try_to_date(F.nullif(dmy, F.lit("")), "d-M-yyyy"),
        F.try_to_date(F.nullif(mdy, F.lit("")), "M/d/yyyy"),
    )


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_add(month: Column, n: int) -> Column:
    return month_of(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), n))


def month_end(month: Column) -> Column:
    return F.last_day(F.to_date(F.concat(month, F.lit("-01"))))


def last_full_month(day: Column) -> Column:
    """The last month ``day`` closes: its own on the month's last day, else the one before."""
    return F.when(F.last_day(day) == day, month_of(day)).otherwise(month_of(F.add_months(day, -1)))
