"""Dates arrive as ISO text; years leave as text tokens so that a missing date has a bucket."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_day(x: Column) -> Column:
    """A date from ISO text, NULL when blank or not a date."""
    return F.left(x, F.lit(10)).try_cast("date")


def year_token(day: Column, missing: str) -> Column:
    """The year as text, or ``missing`` (such as 'never' or 'blank') when there is no date."""
    return F.coalesce(F.year(day).cast("string"), F.lit(missing))


def is_year(token: Column) -> Column:
    return token.rlike("^[0-9]{4}$")
