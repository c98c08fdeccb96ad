"""The scalar function library, by name. Each takes columns (and literals) and gives a column."""

from __future__ import annotations

from granary.functions import codepages, conditional, dates, numeric, string


def _public(module) -> dict:
    return {k.rstrip("_").upper(): v for k, v in vars(module).items() if callable(v) and not k.startswith("_") and k not in ("Column",) and getattr(v, "__module__", "").split(".")[0] in ("granary", "pyspark")}


FUNCTIONS = {k: v for m in (codepages, conditional, dates, numeric, string) for k, v in _public(m).items() if k not in ("LINES", "SQRT_")}
#: Other spellings: those that count characters do what the plain ones do, since strings here are of characters.
for other, name in {
    "LEN": "LENGTH", "LENC": "LENGTH", "AT_C": "AT", "ATCC": "ATC", "RATC": "RAT", "LEFTC": "LEFT", "RIGHTC": "RIGHT", "SUBSTRC": "SUBSTR", "STUFFC": "STUFF",
    "CHRTRANC": "CHRTRAN", "LIKEC": "LIKE", "TRIM": "RTRIM", "TYPE": "VARTYPE", "AMAX": "MAX", "AMIN": "MIN",
}.items():
    FUNCTIONS[other] = FUNCTIONS[name]
