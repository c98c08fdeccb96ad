"""The SELECT dialect, spelled out for Spark SQL.

What differs from Spark SQL is rewritten on tokens, so strings are never touched: TOP n and TOP n PERCENT, destinations
(INTO CURSOR, TABLE, ARRAY, TO FILE), `==`, `#`, `!=`, `.T.`/`.F.`/`.NULL.`/`.AND.`/`.OR.`/`.NOT.`, `a $ b`, `a ^ b` and `a ** b`
(powers, from the left), `+` and `-` beside a string literal (joining, and joining with the left side's blanks put last),
double-quoted and bracketed strings, NOT IN, and quantified comparisons. A bracket opens a string where an operand may
stand. TOP in an arm of a UNION limits that arm; ORDER BY at the end orders the whole. NOT IN becomes an anti join with
counts of the subquery's rows and nulls, so no side is broadcast whatever its size. Quantified comparisons become comparisons with the least or greatest value of the subquery (or IN), which are
computed once, instead of a join on an inequality. As in standard SQL, ANY over no rows is false, ALL over no rows is
true, and a null among the rows of ALL leaves no record.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_token = re.compile(r"\s+|'(?:[^']|'')*'|\"[^\"]*\"|\.(?:T|F|NULL|AND|OR|NOT)\.|\d+\.?\d*|[A-Za-z_]\w*|==|<>|!=|<=|>=|\*\*|.", re.I | re.S)
#: Words after which an operand stands, so that a bracket opens a string.
_leads = {"SELECT", "DISTINCT", "WHERE", "AND", "OR", "NOT", "LIKE", "IN", "THEN", "ELSE", "WHEN", "CASE", "BETWEEN", "ON", "HAVING", "BY", "AS", "ALL", "ANY", "SOME", "IS"}
_words = {".t.": "true", ".f.": "false", ".null.": "NULL", ".and.": "AND", ".or.": "OR", ".not.": "NOT", "==": "=", "#": "<>", "!=": "<>"}
_compare = {"=", "<>", "<", ">", "<=", ">="}


@dataclass
class Statement:
    sql: str
    into: tuple[str, str] | None = None  # kind, name
    percent: int | None = None


def _tokens(text: str) -> list[str]:
    out, at, last = [], 0, ""
    while at < len(text):
        t = _token.match(text, at)[0]
        operand = not last or last.upper() in _leads or not re.fullmatch(r"\w+|'.*'|[])]", last, re.S)
        if t == "[" and operand and "]" in text[at:]:
            t = text[at : text.index("]", at) + 1]
        at += len(t)
        if t[0] == '"' or t[0] == "[" and len(t) > 1:
            t = "'" + t[1:-1].replace("'", "''") + "'"
        out.append(_words.get(t.lower(), t))
        last = last if t.isspace() else t
    return out


def _next(ts: list[str], i: int) -> int:
    """The next token that isn't white space; len(ts) at the end."""
    while i < len(ts) and ts[i].isspace():
        i += 1
    return i


def _close(ts: list[str], i: int) -> int:
    """Where the parenthesis that opens at i closes."""
    depth = 0
    for k in range(i, len(ts)):
        depth += (ts[k] == "(") - (ts[k] == ")")
        if not depth:
            return k
    raise ValueError("a parenthesis isn't closed")


def _before(out: list[str]) -> int:
    """Where the operand begins that ends the tokens so far: names with dots, a call, a group, a literal."""
    i = len(out) - 1
    while out[i].isspace():
        i -= 1
    if out[i] == ")":
        depth = 0
        while True:
            depth += (out[i] == ")") - (out[i] == "(")
            if not depth:
                break
            i -= 1
        if i and re.fullmatch(r"[A-Za-z_]\w*", out[i - 1]):
            i -= 1
        return i
    while i >= 2 and out[i - 1] == ".":
        i -= 2
    return i


def _after(ts: list[str], i: int) -> int:
    """Where the operand that begins at i ends (exclusive)."""
    if ts[i] == "(":
        return _close(ts, i) + 1
    i += 1
    while i + 1 < len(ts) and ts[i] == ".":
        i += 2
    return _close(ts, i) + 1 if i < len(ts) and ts[i] == "(" else i


def _quantified(x: str, op: str, every: bool, sub: str) -> str:
    def one(what: str) -> str:
        return f"(SELECT {what} FROM ({sub}) AS q_(v_))"

    if not every:
        if op == "=":
            return f"{x} IN ({sub})"
        if op == "<>":
            return f"({x} <> {one('min(v_)')} OR {x} <> {one('max(v_)')})"
        return f"{x} {op} {one('min(v_)' if op[0] == '>' else 'max(v_)')}"
    if op == "<>":
        return _not_in(x, sub)
    tests = [f"{x} = {one('min(v_)')}", f"{x} = {one('max(v_)')}"] if op == "=" else [f"{x} {op} {one('max(v_)' if op[0] == '>' else 'min(v_)')}"]
    return f"({one('count(*)')} = 0 OR ({one('count(*) - count(v_)')} = 0 AND {' AND '.join(tests)}))"


def _not_in(x: str, sub: str) -> str:
    """True over no rows; else for an x that isn't null and isn't among rows without nulls."""

    def one(what: str) -> str:
        return f"(SELECT {what} FROM ({sub}) AS q_(v_))"

    return f"(NOT EXISTS (SELECT 1 FROM ({sub}) AS q_(v_) WHERE v_ = {x}) AND {one('count(*) - count(v_)')} = 0 AND ({x} IS NOT NULL OR {one('count(*)')} = 0))"


def _operand(ts: list[str], i: int) -> tuple[str, int]:
    """The operand that begins at i, with its sign, as Spark SQL, and where it ends."""
    sign = ""
    while ts[i] in "+-":
        sign, i = sign + ts[i], _next(ts, i + 1)
    end = _after(ts, i)
    if ts[i] == "(":
        return f"{sign}({translate(''.join(ts[i + 1 : end - 1])).sql})", end
    return sign + "".join(ts[i:end]), end


def _arms(ts: list[str]) -> list[tuple[str, list[str]]]:
    """(UNION or UNION ALL before it, tokens) of each arm, and (ORDER, tokens) for an order at the end of several."""
    arms: list[tuple[str, list[str]]] = [("", [])]
    depth = i = 0
    while i < len(ts):
        depth += (ts[i] == "(") - (ts[i] == ")")
        if not depth and ts[i].upper() == "UNION":
            follows = _next(ts, i + 1)
            every = follows < len(ts) and ts[follows].upper() == "ALL"
            arms.append(("UNION ALL" if every else "UNION", []))
            i = follows + 1 if every else i + 1
            continue
        if not depth and len(arms) > 1 and ts[i].upper() in ("ORDER", "INTO", "TO"):
            return [*arms, (ts[i].upper(), ts[i:])]
        arms[-1][1].append(ts[i])
        i += 1
    return arms


def _union(arms: list[tuple[str, list[str]]]) -> Statement:
    sql, tail = [], None
    for before, ts in arms:
        if before in ("ORDER", "INTO", "TO"):
            tail = translate("".join(ts), arms=False)
            sql.append(tail.sql)
            continue
        s = translate("".join(ts), arms=False)
        if s.percent is not None:
            raise ValueError("TOP n PERCENT in an arm of a UNION")
        limited = re.search(r" LIMIT \d+$", s.sql)
        sql.append(f"{before} {f'(SELECT * FROM ({s.sql}))' if limited else s.sql}".strip())
    return Statement(" ".join(sql).strip(), tail.into if tail else None)


def translate(text: str, arms: bool = True) -> Statement:
    ts, out, top, into, percent = _tokens(text.strip().rstrip(";")), [], None, None, False
    if arms and len(parts := _arms(ts)) > 1:
        return _union(parts)
    i = depth = 0
    while i < len(ts):
        t = ts[i]
        word = t.upper()
        depth += (t == "(") - (t == ")")
        if word == "TOP" and depth == 0 and re.fullmatch(r"\d+", ts[_next(ts, i + 1)]):
            i = _next(ts, i + 1)
            top, i = ts[i], i + 1
            if ts[_next(ts, i)].upper() == "PERCENT":
                percent, i = True, _next(ts, i) + 1
            continue
        if word in ("^", "**"):
            lo = _before(out)
            right, end = _operand(ts, _next(ts, i + 1))
            out[lo:] = [f"power({''.join(out[lo:]).strip()}, {right})"]
            i = end
            continue
        if t in ("+", "-") and out:
            follows = _next(ts, i + 1)
            lo = _before(out) if out[-1].strip() or len(out) > 1 else 0
            left = "".join(out[lo:]).strip()
            if ts[follows].startswith("'") or left.startswith("'") or left.startswith("concat("):
                right, end = _operand(ts, follows)
                joined = f"concat({left}, {right})" if t == "+" else f"concat(rtrim({left}), {right}, repeat(' ', length({left}) - length(rtrim({left}))))"
                out[lo:] = [joined]
                i = end
                continue
        if word == "NOT" and out:
            member = _next(ts, i + 1)
            opens = _next(ts, member + 1) if member < len(ts) and ts[member].upper() == "IN" else len(ts)
            if opens < len(ts) and ts[opens] == "(" and ts[_next(ts, opens + 1)].upper() == "SELECT":
                end = _close(ts, opens)
                lo = _before(out)
                out[lo:] = [_not_in("".join(out[lo:]).strip(), translate("".join(ts[opens + 1 : end])).sql)]
                i = end + 1
                continue
        if word in ("INTO", "TO") and depth == 0:
            i = _next(ts, i + 1)
            kind = ts[i].upper()
            i = _next(ts, i + 1)
            into, i = (kind, ts[i].strip("'") if kind not in ("PRINTER", "SCREEN") else ""), i + 1
            continue
        if word in ("READWRITE", "NOFILTER", "NOWAIT", "PLAIN", "NOCONSOLE") and depth == 0:
            i += 1
            continue
        if t == "$":
            lo = _before(out)
            needle = "".join(out[lo:]).strip()
            i = _next(ts, i + 1)
            end = _after(ts, i)
            out[lo:] = [f"contains({''.join(ts[i:end])}, {needle})"]
            i = end
            continue
        if t in _compare:
            q = _next(ts, i + 1)
            if q < len(ts) and ts[q].upper() in ("ANY", "SOME", "ALL"):
                p = _next(ts, q + 1)
                end = _close(ts, p)
                lo = _before(out)
                x = "".join(out[lo:]).strip()
                sub = translate("".join(ts[p + 1 : end])).sql
                out[lo:] = [_quantified(x, t, ts[q].upper() == "ALL", sub)]
                i = end + 1
                continue
        out.append(t)
        i += 1
    sql = re.sub(r"[ \t]+", " ", "".join(out)).strip()
    if percent:
        return Statement(sql, into, int(top))
    return Statement(f"{sql} LIMIT {top}" if top else sql, into)


def select(spark: SparkSession, text: str) -> DataFrame:
    """Run a statement; INTO CURSOR and INTO TABLE name the result as a view or write it as a table.

    TOP n PERCENT counts the rows first; a part of a row counts as one.
    """
    s = translate(text)
    df = spark.sql(s.sql)
    if s.percent is not None:
        df = df.limit(math.ceil(df.count() * s.percent / 100))
    if s.into and s.into[0] == "CURSOR":
        df.createOrReplaceTempView(s.into[1])
    elif s.into and s.into[0] in ("TABLE", "DBF"):
        df.write.mode("overwrite").saveAsTable(s.into[1])
        return spark.table(s.into[1])
    return df
