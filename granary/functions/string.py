"""String functions as column expressions. Positions count from 1; 0 means absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def asc(s):
    return F.ascii(s)


def at(sub, s, n=1):
    """Position of the n-th occurrence of sub, which is a literal, in s; 0 if there are fewer."""
    if n == 1:
        return F.locate(sub, s)
    before = F.substring_index(s, sub, n)
    return F.when(occurs(sub, s) >= n, F.length(before) + 1).otherwise(0)


def atc(sub, s, n=1):
    return at(sub.lower(), F.lower(s), n)


def rat(sub, s):
    """Position of the last occurrence."""
    back = F.locate(sub[::-1], F.reverse(s))
    return F.when(back > 0, F.length(s) - back - len(sub) + 2).otherwise(0)


def lines(s):
    return F.split(s, r"\r\n|\r|\n")


def atline(sub, s):
    """Number of the first line that holds sub; 0 if none does."""
    return F.array_position(F.transform(lines(s), lambda x: x.contains(sub)), True).cast("int")


def atcline(sub, s):
    return atline(sub.lower(), F.lower(s))


def ratline(sub, s):
    flags = F.transform(lines(s), lambda x: x.contains(sub))
    back = F.array_position(F.reverse(flags), True)
    return F.when(back > 0, F.size(flags) - back + 1).otherwise(0).cast("int")


def alltrim(s, chars=None):
    return F.trim(s) if chars is None else F.btrim(s, F.lit(chars))


def ltrim(s):
    return F.ltrim(s)


def rtrim(s):
    return F.rtrim(s)


def chr_(n):
    return F.chr(_c(n))


def chrtran(s, old, new):
    return F.translate(s, old, new)


def left(s, n):
    return F.left(s, _c(n))


def right(s, n):
    return F.right(s, _c(n))


def substr(s, start, n=None):
    return F.substring(s, start, 2**31 - 1 if n is None else n)


def stuff(s, start, n, new):
    return F.overlay(s, _c(new), start, n)


def length(s):
    return F.length(s)


def lower(s):
    return F.lower(s)


def upper(s):
    return F.upper(s)


def proper(s):
    return F.initcap(s)


def replicate(s, n):
    return F.repeat(s, _c(n))


def space(n):
    return F.repeat(F.lit(" "), _c(n))


def padl(s, n, ch=" "):
    return F.lpad(s, n, ch)


def padr(s, n, ch=" "):
    return F.rpad(s, n, ch)


def padc(s, n, ch=" "):
    """Centred; an odd blank goes to the right, and longer strings lose their end."""
    lead = F.floor((F.lit(n) - F.length(s)) / 2).cast("int")
    return F.when(F.length(s) >= n, F.left(s, F.lit(n))).otherwise(F.rpad(F.concat(F.repeat(F.lit(ch), F.greatest(lead, F.lit(0))), s), n, ch))


def occurs(sub, s):
    return ((F.length(s) - F.length(F.replace(s, F.lit(sub), F.lit("")))) / len(sub)).cast("int")


def strtran(s, old, new="", start=1, count=None):
    """Replace occurrences of old from the start-th on, count of them (all without it)."""
    if start == 1 and count is None:
        return F.replace(s, F.lit(old), F.lit(new))
    import re

    parts = F.split(s, re.escape(old))
    last = 2**31 - 1 if count is None else start + count - 1
    joined = F.transform(parts, lambda x, i: F.when(i == 0, x).when((i >= start) & (i <= last), F.concat(F.lit(new), x)).otherwise(F.concat(F.lit(old), x)))
    return F.array_join(joined, "")


def strextract(s, begin, end, n=1):
    """What stands between the n-th begin and the next end; empty if either is missing."""
    rest = F.when(occurs(begin, s) >= n, F.substring(s, at(begin, s, n) + F.lit(len(begin)), F.length(s))).otherwise("")
    return F.when(F.locate(end, rest) > 0, F.substring_index(rest, end, 1)).otherwise("")


def strconv(s, code):
    """7 lower, 8 upper, 13 to base 64, 14 from it, 15 to hexadecimal, 16 from it."""
    made = {7: lambda: F.lower(s), 8: lambda: F.upper(s), 13: lambda: F.base64(F.encode(s, "utf-8")), 14: lambda: F.decode(F.unbase64(s), "utf-8"), 15: lambda: F.hex(F.encode(s, "utf-8")), 16: lambda: F.decode(F.unhex(s), "utf-8")}
    if code not in made:
        raise ValueError(f"conversion {code} needs code pages; use codepages.convert")
    return made[code]()


def _pieces(s, delimiters):
    import re

    return F.filter(F.split(s, f"[{re.escape(delimiters)}]"), lambda x: x != "")


def getwordcount(s, delimiters=" \t\n\r"):
    return F.size(_pieces(s, delimiters))


def getwordnum(s, n, delimiters=" \t\n\r"):
    return F.coalesce(F.get(_pieces(s, delimiters), F.lit(n - 1)), F.lit(""))


def memlines(s):
    return F.when(F.length(s) == 0, 0).otherwise(F.size(lines(s)))


def mline(s, n):
    return F.coalesce(F.get(lines(s), F.lit(n - 1)), F.lit(""))


def alines(s):
    return lines(s)


def like(pattern, s):
    """Whole-string match of a pattern with `*` and `?`; like's own signs in it are taken literally."""
    p = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return s.like(p)


def soundex(s):
    return F.soundex(s)


def difference(a, b):
    """How many of the four signs of both sound codes are equal."""
    x, y = F.soundex(a), F.soundex(b)
    same = lambda i: (F.substring(x, i, 1) == F.substring(y, i, 1)).cast("int")
    return same(1) + same(2) + same(3) + same(4)


def isalpha(s):
    return s.rlike(r"^\p{L}")


def isdigit(s):
    return s.rlike("^[0-9]")


def islower(s):
    return s.rlike(r"^\p{Ll}")


def isupper(s):
    return s.rlike(r"^\p{Lu}")


def transform(x, picture=None):
    """As text; picture `@!` upper-cases, `9,999.99` groups digits with as many decimals as it has."""
    if picture is None:
        return x.cast("string")
    if picture == "@!":
        return F.upper(x.cast("string"))
    return F.format_number(x, len(picture.partition(".")[2]))


def textmerge(template, **values):
    """A static template: <<name>> takes the column of that name."""
    import re

    parts = re.split(r"<<(\w+)>>", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else values[p].cast("string") for i, p in enumerate(parts)])


def str_(n, width=10, decimals=0):
    """Right-justified digits; asterisks where they don't fit."""
    text = F.format_string(f"%.{decimals}f", n.cast("double"))
    return F.when(F.length(text) > width, F.repeat(F.lit("*"), F.lit(width))).otherwise(F.lpad(text, width, " "))


def val(s):
    """The number at the start of a text, 0 without one."""
    return F.coalesce(F.regexp_extract(s, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double"), F.lit(0.0))


def bintoc(n, width=4):
    return F.unhex(F.right(F.lpad(F.hex(n.cast("long")), 16, "0"), F.lit(2 * width)))


def ctobin(b):
    return F.conv(F.hex(b), 16, 10).cast("long")
