"""Partial dates. One reading takes the start of a period, the other its end; they are never mixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystone.functions.text import is_unreleased

FIRST_YEAR = 2013


def start_of_period(y: Column, m: Column, d: Column, as_of: Column) -> tuple[Column, Column]:
    """Date with missing parts as 1, and a label that keeps the precision. Null if invalid or after as_of."""
    text = F.format_string("%04d-%02d-%02d", y, F.coalesce(m, F.lit(1)), F.coalesce(d, F.lit(1)))
    date = F.when(y.isNotNull() & ~(m.isNull() & d.isNotNull()), F.try_to_date(text, "yyyy-MM-dd"))
    ok = date <= as_of
    label = F.when(m.isNull(), F.format_string("%04d", y)).when(d.isNull(), F.format_string("%04d-%02d", y, m)).otherwise(text)
    return F.when(ok, date), F.when(ok, label)


def qualifies(platform: Column, platforms: list[int], status: Column) -> Column:
    """Whether a date counts at all: on one of the platforms, and not of a status that means no release."""
    return F.coalesce(platform.isin(*platforms), F.lit(False)) & ~is_unreleased(status)


def end_of_period(human: Column, precision: Column, epoch: Column, y: Column, m: Column, as_of: Column, first_year: int = FIRST_YEAR) -> Column:
    """The last day a stated date can mean: exact text, epoch, quarter, year, then month. Null if in the future."""
    text = F.trim(F.coalesce(human, F.lit("")))
    exact = F.coalesce(F.try_to_date(F.when(text.rlike(r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"), text), "MMM d, yyyy"), F.try_to_date(F.when(text.rlike(r"^[A-Z][a-z]{2,} \d{1,2}, \d{4}$"), text), "MMMM d, yyyy"))
    quarter = F.regexp_extract(F.concat_ws(" ", text, precision), r"Q([1-4])", 1)
    month_end = lambda month: F.last_day(F.try_to_date(F.format_string("%04d-%02d-01", y, month), "yyyy-MM-dd"))
    known = (
        F.when(exact.isNotNull(), exact)
        .when((precision == "YYYYMMMMDD") & epoch.isNotNull(), F.to_date(F.timestamp_seconds(epoch)))
        .when(quarter != "", month_end(F.nullif(quarter, F.lit("")).cast("int") * 3))
        .when((precision == "YYYY") | text.rlike(r"^\d{4}$"), month_end(F.lit(12)))
        .otherwise(month_end(F.coalesce(m, F.lit(12))))
    )
    usable = y.isNotNull() & (y >= first_year) & ~text.rlike("(?i)tbd")
    return F.when(usable & (known <= as_of) & (known >= F.make_date(F.lit(first_year), F.lit(1), F.lit(1))), known)
