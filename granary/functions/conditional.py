"""Null, conditional, type, array and path functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def iif(cond, yes, no):
    return F.when(cond, _c(yes)).otherwise(_c(no))


def icase(*args):
    """ICASE(c1, v1, c2, v2, ..., otherwise)."""
    out = F.lit(None) if len(args) % 2 == 0 else _c(args[-1])
    for i in range(len(args) // 2 * 2 - 2, -1, -2):
        out = F.when(args[i], _c(args[i + 1])).otherwise(out)
    return out


def nvl(x, other):
    return F.coalesce(x, _c(other))


def isnull(x):
    return x.isNull()


def empty(x, kind: T.DataType):
    """Blank strings, zeros, false and missing dates are empty; null is not, except as a date."""
    if isinstance(kind, T.StringType):
        return F.length(F.trim(F.regexp_replace(x, r"[\t\r\n]", " "))) == 0
    if isinstance(kind, T.NumericType):
        return x == 0
    if isinstance(kind, T.BooleanType):
        return ~x
    return x.isNull()


def evl(x, other, kind: T.DataType):
    return F.when(~F.coalesce(empty(x, kind), F.lit(False)), x).otherwise(_c(other))


def isblank(x, kind: T.DataType):
    """Never written: null, or a string of blanks. Storage alone could tell a blank from a zero."""
    return x.isNull() | (F.trim(x) == "") if isinstance(kind, T.StringType) else x.isNull()


def between(x, lo, hi):
    return x.between(_c(lo), _c(hi))


def inlist(x, *values):
    return x.isin(*values)


#: The letters of types.
_letters = [("string", "C"), ("char", "C"), ("boolean", "L"), ("date", "D"), ("timestamp", "T"), ("decimal(19,4)", "Y"), ("binary", "Q"), ("void", "X")]


def vartype(x):
    t = F.typeof(x)
    out = F.lit("N")
    for name, letter in reversed(_letters):
        out = F.when(t.startswith(name), letter).otherwise(out)
    return F.when(t.startswith("array") | t.startswith("struct") | t.startswith("map"), "O").otherwise(out)


def cast(x, kind: str):
    return x.try_cast(kind)


def evaluate(text: str):
    """A constant expression text; texts that differ by row aren't supported."""
    return F.expr(text)


# arrays; a matrix is an array in rows of `cols`

alen, asort = F.size, F.array_sort


def acopy(source, target, first, n, at):
    """target with n elements of source, from first, written from position at on."""
    return F.concat(F.slice(target, 1, at - 1), F.slice(source, first, n), F.slice(target, at + n, 2**31 - 1))


def adel(a, n):
    return F.filter(a, lambda x, i: i != n - 1)


def ains(a, n, value):
    return F.array_insert(a, n, _c(value))


def aelement(row, col, cols):
    return (_c(row) - 1) * cols + _c(col)


def asubscript(element, cols, which):
    """Row (1) or column (2) of an element's number."""
    e = _c(element) - 1
    return (F.floor(e / cols) if which == 1 else e % cols).cast("int") + 1


def ascan(a, value):
    return F.array_position(a, value)


# paths as texts, with either slash


def addbs(p):
    return F.when((p == "") | p.rlike(r"[\\/]$"), p).otherwise(F.concat(p, F.lit("\\")))


def justfname(p):
    return F.regexp_extract(p, r"([^\\/]*)$", 1)


def justpath(p):
    return F.regexp_replace(p, r"[\\/]?[^\\/]*$", "")


def justdrive(p):
    return F.regexp_extract(p, r"^([A-Za-z]:)", 1)


def justext(p):
    return F.regexp_extract(justfname(p), r"\.([^.]*)$", 1)


def juststem(p):
    return F.regexp_replace(justfname(p), r"\.[^.]*$", "")


def forceext(p, ext):
    return F.concat(F.regexp_replace(p, r"\.[^.\\/]*$", ""), F.lit(f".{ext}"))


def defaultext(p, ext):
    return F.when(justext(p) == "", F.concat(p, F.lit(f".{ext}"))).otherwise(p)


def forcepath(p, path):
    return F.concat(addbs(F.lit(path)), justfname(p))
