"""Copying tables out and in: text types, structures, XML, JSON, schema changes and saved variables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import commands as cmd

#: Types of COPY TO and APPEND FROM, as Spark's formats and options.
TYPES = {"csv": ("csv", {"header": "true"}), "delimited": ("csv", {"header": "false"}), "tab": ("csv", {"header": "false", "sep": "\t"}), "json": ("json", {}), "parquet": ("parquet", {})}


def copy_to(df: DataFrame, path: str, kind: str = "parquet", like: str | None = None, but: str | None = None, mask: Column | None = None) -> None:
    """COPY TO path TYPE kind FIELDS LIKE / EXCEPT FOR mask; `sdf` writes fixed-width lines. Every task writes its part."""
    out = cmd.fields(df if mask is None else df.where(mask), like, but)
    if kind == "sdf":
        width = {c: 20 if t == "string" else 12 for c, t in out.dtypes}
        out.select(F.concat(*[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), w, " ") for c, w in width.items()]).alias("value")).write.text(path)
        return
    if kind not in TYPES:
        raise ValueError(f"no such type: {kind}")
    form, options = TYPES[kind]
    out.write.format(form).options(**options).save(path)


def read_from(spark: SparkSession, path: str, kind: str, schema) -> DataFrame:
    if kind not in TYPES:
        raise ValueError(f"type {kind} can't be read back")
    form, options = TYPES[kind]
    return spark.read.format(form).options(**options).schema(schema).load(path)


def append_file(df: DataFrame, path: str, kind: str, mask: Column | None = None) -> DataFrame:
    """APPEND FROM path TYPE kind FOR mask, read with the table's own schema."""
    return cmd.append_from(df, read_from(df.sparkSession, path, kind, df.schema), mask)


def alter(df: DataFrame, add: dict[str, str] | None = None, change: dict[str, str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """ALTER TABLE ADD / ALTER / DROP: new fields are null, values that don't cast become null."""
    out = df.drop(*(drop or []))
    out = out.withColumns({c: F.col(c).try_cast(t) for c, t in (change or {}).items()}) if change else out
    return out.withColumns({c: F.lit(None).cast(t) for c, t in add.items()}) if add else out


def create_table(spark: SparkSession, name: str, ddl: str) -> DataFrame:
    """CREATE CURSOR name (ddl): an empty view."""
    df = spark.createDataFrame([], ddl)
    df.createOrReplaceTempView(name)
    return df


def save_variables(values: dict, like: str = "*") -> str:
    import fnmatch

    return json.dumps({k: v for k, v in values.items() if fnmatch.fnmatchcase(k.lower(), like.lower())}, default=str)


def restore_variables(text: str, additive: dict | None = None) -> dict:
    return {**(additive or {}), **json.loads(text)}


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def to_xml_rows(df: DataFrame, row: str = "row") -> DataFrame:
    return df.select(F.to_xml(F.struct(*df.columns), {"rowTag": row}).alias("xml"))


def from_xml_rows(df: DataFrame, ddl: str, column: str = "xml") -> DataFrame:
    return df.select(F.from_xml(column, ddl).alias("r")).select("r.*")


def updategram(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, action of records that were inserted, deleted or changed between two states of a table."""
    names = [c for c in before.columns if c != key]
    b = before.select(key, F.struct(*names).alias("_b"))
    a = after.select(key, F.struct(*names).alias("_a"))
    j = b.join(a, key, "full")
    action = F.when(F.col("_b").isNull(), "insert").when(F.col("_a").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "update")
    return j.select(key, action.alias("action")).where("action is not null")
