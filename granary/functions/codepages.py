"""Code-page conversions. The engine's own codecs lack most code pages, so these go through Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code-page marks in table headers, as far as tools agree on them.
MARKS = {0x00: None, 0x01: "cp437", 0x02: "cp850", 0x03: "cp1252", 0x7A: "gbk", 0xC8: "cp1250"}


def decode(raw: bytes, mark: int | None) -> str:
    """By the mark's codec; bytes that it rejects, and unknown marks, one character for each byte."""
    codec = MARKS.get(mark or 0)
    if codec:
        try:
            return raw.decode(codec)
        except UnicodeDecodeError:
            pass
    return raw.decode("latin-1")


def content_code_page(raw: bytes) -> int:
    """1252 for ASCII, 936 where strict GBK decodes, else 1252."""
    if raw.isascii():
        return 1252
    try:
        raw.decode("gbk")
    except UnicodeDecodeError:
        return 1252
    return 936


def cpconvert(source: str, target: str, s: Column) -> Column:
    """Text that was read by the target's codec although it was written in the source's."""

    @F.pandas_udf("string")
    def convert(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else t.encode(target, "replace").decode(source, "replace"))

    return convert(s)


def oemtoansi(s: Column) -> Column:
    return cpconvert("cp437", "cp1252", s)


def ansitooem(s: Column) -> Column:
    return cpconvert("cp1252", "cp437", s)


def code_page_of(content: Column) -> Column:
    @F.pandas_udf("int")
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else content_code_page(bytes(b)))

    return of(content)
