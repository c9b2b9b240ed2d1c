"""Date expressions."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """Year-month-day text to a date; anything else, and impossible days, to null.

    A cast alone would also take a bare year or a trailing time; the pattern keeps those out
    and the pair is several times faster than a date format.
    """
    return F.when(text.rlike(r"\A\d{4}-\d{1,2}-\d{1,2}\z"), text.try_cast("date"))


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_start(month: Column) -> Column:
    return F.to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd")


def year_earlier(month: Column) -> Column:
    return month_of(F.add_months(month_start(month), -12))


def day(iso: str) -> Column:
    return F.to_date(F.lit(iso), "yyyy-MM-dd")
