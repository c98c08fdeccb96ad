"""Date and time functions as column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F


def date(y=None, m=None, d=None):
    return F.current_date() if y is None else F.make_date(y, m, d)


def datetime(y=None, m=None, d=None, h=None, mi=None, s=None):
    zero = F.lit(0)
    return F.localtimestamp() if y is None else F.make_timestamp_ntz(y, m, d, h if h is not None else zero, mi if mi is not None else zero, s if s is not None else zero)


def time():
    return F.date_format(F.current_timestamp(), "HH:mm:ss")


def seconds(t):
    """Seconds since midnight."""
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


day, month, year, gomonth, hour, minute, sec = F.dayofmonth, F.month, F.year, F.add_months, F.hour, F.minute, F.second


def quarter(d, first_month=1):
    """Quarter of a year that starts with first_month."""
    return F.floor(F.pmod(F.month(d) - first_month, F.lit(12)) / 3).cast("int") + 1


def week(d):
    return F.weekofyear(d)


def dow(d, first=1):
    """1 to 7; first: the day that counts as 1, itself 1 for Sunday."""
    return F.pmod(F.dayofweek(d) - first, F.lit(7)).cast("int") + 1


def cdow(d):
    return F.date_format(d, "EEEE")


def cmonth(d):
    return F.date_format(d, "MMMM")


def dmy(d):
    return F.date_format(d, "dd MMMM yyyy")


def mdy(d):
    return F.date_format(d, "MMMM dd, yyyy")


def ctod(s, fmt="MM/dd/yyyy"):
    return F.try_to_timestamp(s, F.lit(fmt)).cast("date")


def ctot(s, fmt="MM/dd/yyyy HH:mm:ss"):
    return F.try_to_timestamp(s, F.lit(fmt)).cast("timestamp_ntz")


def dtoc(d, fmt="MM/dd/yyyy"):
    return F.date_format(d, fmt)


def dtos(d):
    return F.date_format(d, "yyyyMMdd")


def dtot(d):
    return d.cast("timestamp_ntz")


def ttoc(t, fmt="MM/dd/yyyy HH:mm:ss"):
    return F.date_format(t, fmt)


def ttod(t):
    return t.cast("date")
