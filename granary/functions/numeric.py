"""Numeric, bit and financial functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


abs_, acos, asin, atan, atn2, cos, sin, tan, ceiling, floor = F.abs, F.acos, F.asin, F.atan, F.atan2, F.cos, F.sin, F.tan, F.ceil, F.floor
exp, log, log10, sqrt, pi, sign, rand, dtor, rtod, max_, min_ = F.exp, F.ln, F.log10, F.sqrt, F.pi, F.signum, F.rand, F.radians, F.degrees, F.greatest, F.least


def int_(x):
    """Toward zero."""
    return x.cast("bigint")


def round_(x, n=0):
    """Half up, on decimals, so binary fractions don't decide."""
    return F.round(x.cast("decimal(28,10)"), n)


def mod(a, b):
    """The result has the divisor's sign."""
    b = _c(b)
    return a - b * F.floor(a / b)


def float_(x):
    return x.cast("double")


def mton(x):
    return x.cast("double")


def ntom(x):
    return x.cast("decimal(19,4)")


def pv(payment, rate, n):
    """What n equal payments are worth now."""
    return _c(payment) * (1 - F.pow(1 + _c(rate), -_c(n))) / _c(rate)


def fv(payment, rate, n):
    return _c(payment) * (F.pow(1 + _c(rate), _c(n)) - 1) / _c(rate)


def payment(principal, rate, n):
    return _c(principal) * _c(rate) / (1 - F.pow(1 + _c(rate), -_c(n)))


def bitand(a, *more):
    for b in more:
        a = a.bitwiseAND(_c(b))
    return a


def bitor(a, *more):
    for b in more:
        a = a.bitwiseOR(_c(b))
    return a


def bitxor(a, *more):
    for b in more:
        a = a.bitwiseXOR(_c(b))
    return a


bitnot, bitlshift = F.bitwise_not, F.shiftleft


def bitrshift(a, n):
    return F.shiftrightunsigned(a, n)


def bittest(a, n):
    return F.getbit(a, F.lit(n)) == 1


def bitset(a, n):
    return a.bitwiseOR(F.lit(1 << n))


def bitclear(a, n):
    return a.bitwiseAND(F.lit(~(1 << n)))


def rgb(r, g, b):
    return _c(r) + 256 * _c(g) + 65536 * _c(b)
