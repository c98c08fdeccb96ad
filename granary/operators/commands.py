"""Record commands as functions from DataFrames to DataFrames.

A table has a record number `_recno` (see ordering.with_recno) and a soft-delete flag `_deleted`. The source language's
own row semantics aren't published by what was studied; each decision below is ours and has its test.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.ordering import RECNO, sum_runs, with_recno

DELETED = "_deleted"


def as_table(df: DataFrame, *keys: str) -> DataFrame:
    """Attach record numbers in the order of keys, and no deletions."""
    return with_recno(df, *keys).withColumn(DELETED, F.lit(False))


# scopes and clauses


def scope_next(df: DataFrame, n: int, at: int = 1) -> DataFrame:
    """NEXT n: the record at the pointer and those that follow, n in all."""
    return df.where((F.col(RECNO) >= at) & (F.col(RECNO) < at + n))


def scope_rest(df: DataFrame, at: int) -> DataFrame:
    return df.where(F.col(RECNO) >= at)


def scope_record(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col(RECNO) == n)


def while_prefix(df: DataFrame, cond: Column) -> DataFrame:
    """WHILE cond: records before the first for which it isn't true; an aggregate, then a pushed-down filter."""
    first = df.where(~F.coalesce(cond, F.lit(False))).agg(F.min(RECNO).alias("m")).first().m
    return df if first is None else df.where(F.col(RECNO) < first)


def visible(df: DataFrame, deleted: bool = True) -> DataFrame:
    """SET DELETED ON hides deleted records."""
    return df.where(~F.col(DELETED)) if deleted else df


def set_key(df: DataFrame, key: str, low=None, high=None) -> DataFrame:
    """SET KEY TO RANGE low, high; either may be open."""
    out = df
    if low is not None:
        out = out.where(F.col(key) >= low)
    return out if high is None else out.where(F.col(key) <= high)


def fields(df: DataFrame, like: str | None = None, but: str | None = None) -> DataFrame:
    """FIELDS LIKE / EXCEPT skeletons (`*` and `?`), without regard to case; comma lists are allowed."""

    def hit(name: str, skeletons: str) -> bool:
        return any(fnmatch.fnmatchcase(name.lower(), s.strip().lower()) for s in skeletons.split(","))

    return df.select(*[f"`{c}`" for c in df.columns if (like is None or hit(c, like)) and not (but and hit(c, but))])


# movement


def locate(df: DataFrame, cond: Column, after: int = 0) -> DataFrame:
    """LOCATE FOR (after = 0) and CONTINUE (after = the record found last): one record or none."""
    return df.where(cond & (F.col(RECNO) > after)).orderBy(RECNO).limit(1)


def seek(df: DataFrame, key: str, value, near: bool = False, descending: bool = False) -> DataFrame:
    """SEEK: the first record of that key; NEAR: else the first beyond it in index order."""
    hit = (F.col(key) <= value if descending else F.col(key) >= value) if near else F.col(key) == value
    order = F.col(key).desc() if descending else F.col(key).asc()
    return df.where(hit).orderBy(order, RECNO).limit(1)


def go(df: DataFrame, where: str | int) -> DataFrame:
    """GO TOP, GO BOTTOM, GO n."""
    if where == "top":
        return df.orderBy(RECNO).limit(1)
    if where == "bottom":
        return df.orderBy(F.desc(RECNO)).limit(1)
    return scope_record(df, int(where))


def skip(df: DataFrame, at: int, n: int = 1) -> DataFrame:
    """SKIP n among the records that df shows, from record `at`; past either end: none."""
    if n == 0:
        return scope_record(df, at)
    ahead = df.where(F.col(RECNO) > at if n > 0 else F.col(RECNO) < at)
    order = F.col(RECNO) if n > 0 else F.desc(RECNO)
    reached = ahead.orderBy(order).limit(abs(n)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))  # abs(n) rows at most
    return reached.orderBy(F.desc(RECNO) if n > 0 else F.col(RECNO)).limit(1).where(F.col("_n") == abs(n)).drop("_n")


# changes


def replace(df: DataFrame, values: Mapping[str, Column], mask: Column | None = None) -> DataFrame:
    """REPLACE f WITH e ... FOR mask: all expressions see the old record."""
    yes = F.lit(True) if mask is None else F.coalesce(mask, F.lit(False))
    return df.withColumns({f: F.when(yes, e.cast(df.schema[f].dataType)).otherwise(F.col(f)) for f, e in values.items()})


def update_from(df: DataFrame, other: DataFrame, on: str, values: Mapping[str, Column], mask: Column | None = None) -> DataFrame:
    """UPDATE ... FROM other: records with a partner get the values; other has each key once (see first_by)."""
    o = other.withColumn("_hit", F.lit(True))
    yes = F.coalesce(F.col("_hit") if mask is None else F.col("_hit") & mask, F.lit(False))
    joined = df.join(o, on, "left")
    return joined.withColumns({f: F.when(yes, e.cast(df.schema[f].dataType)).otherwise(F.col(f)) for f, e in values.items()}).select(*df.columns)


def delete(df: DataFrame, mask: Column) -> DataFrame:
    return df.withColumn(DELETED, F.col(DELETED) | F.coalesce(mask, F.lit(False)))


def recall(df: DataFrame, mask: Column) -> DataFrame:
    return df.withColumn(DELETED, F.col(DELETED) & ~F.coalesce(mask, F.lit(False)))


def pack(df: DataFrame) -> DataFrame:
    """PACK: deleted records go, the others are numbered anew in their order."""
    return with_recno(df.where(~F.col(DELETED)).withColumnRenamed(RECNO, "_old"), "_old").drop("_old")


def zap(df: DataFrame) -> DataFrame:
    return df.limit(0)


def empty_value(t: T.DataType) -> Column:
    """What BLANK writes: empty strings, zeros, false; null for dates and others."""
    if isinstance(t, T.StringType):
        return F.lit("")
    if isinstance(t, T.NumericType):
        return F.lit(0).cast(t)
    if isinstance(t, T.BooleanType):
        return F.lit(False)
    return F.lit(None).cast(t)


def blank(df: DataFrame, names: list[str], mask: Column | None = None) -> DataFrame:
    return replace(df, {f: empty_value(df.schema[f].dataType) for f in names}, mask)


def insert_values(df: DataFrame, rows: list[tuple], names: list[str]) -> DataFrame:
    """INSERT INTO (names) VALUES: fields that aren't named get their empty values; _recno goes on from the last."""
    schema = T.StructType([df.schema[n] for n in names])
    new = df.sparkSession.createDataFrame(rows, schema)
    last = df.agg(F.max(RECNO)).first()[0] or 0 if RECNO in df.columns else 0
    cols = []
    for f in df.schema:
        if f.name in names:
            cols.append(F.col(f.name))
        elif f.name == RECNO:
            cols.append((F.row_number().over(Window.orderBy(*names)) + last).cast("long").alias(RECNO))  # some literal rows
        else:
            cols.append(empty_value(f.dataType).alias(f.name))
    return df.unionByName(new.select(*cols))


def insert_record(df: DataFrame, at: int, values: Mapping[str, object] | None = None, before: bool = False) -> DataFrame:
    """INSERT [BLANK] [BEFORE]: a record after (or before) record `at`; the records behind it move up by one."""
    number = at if before else at + 1
    given = values or {}
    fixed = {RECNO: F.lit(number).cast("long"), DELETED: F.lit(False)}
    cells = [(fixed[f.name] if f.name in fixed else F.lit(given[f.name]).cast(f.dataType) if f.name in given else empty_value(f.dataType)).alias(f.name) for f in df.schema]
    moved = df.withColumn(RECNO, F.col(RECNO) + (F.col(RECNO) >= number).cast("long"))
    return moved.unionByName(df.sparkSession.range(1).select(*cells))


def append_blank(df: DataFrame) -> DataFrame:
    """APPEND BLANK: a record of empty values at the end."""
    return insert_record(df, df.agg(F.max(RECNO)).first()[0] or 0)


def scan(df: DataFrame, body: Mapping[str, Column], mask: Column | None = None, until: Column | None = None) -> DataFrame:
    """SCAN FOR mask WHILE until ... ENDSCAN with a body of assignments that see their own record: one pass over all.

    WHILE ends the scan at the first record, of those that FOR shows, where it doesn't hold.
    """
    yes = F.lit(True) if mask is None else F.coalesce(mask, F.lit(False))
    if until is not None:
        stop = df.where(yes & ~F.coalesce(until, F.lit(False))).agg(F.min(RECNO).alias("_stop"))
        df = df.crossJoin(F.broadcast(stop))  # one row
        yes = yes & (F.col("_stop").isNull() | (F.col(RECNO) < F.col("_stop")))
    return replace(df, body, yes).drop("_stop")


def append_memo(df: DataFrame, field: str, path: str, mask: Column, overwrite: bool = False) -> DataFrame:
    """APPEND MEMO field FROM path: the file's bytes behind (or instead of) those of the records that the mask names."""
    content = df.sparkSession.read.format("binaryFile").load(path).agg(F.first("content").alias("_content"))  # one file
    out = df.crossJoin(F.broadcast(content))
    old = F.lit(b"") if overwrite else F.coalesce(F.col(field).cast("binary"), F.lit(b""))
    new = F.concat(old, "_content")
    return out.withColumn(field, F.when(F.coalesce(mask, F.lit(False)), new.cast(df.schema[field].dataType)).otherwise(F.col(field))).drop("_content")


def append_from(df: DataFrame, other: DataFrame, mask: Column | None = None) -> DataFrame:
    """APPEND FROM: fields of the same name are taken, others are null."""
    return df.unionByName((other if mask is None else other.where(mask)).select(*[c for c in other.columns if c in df.columns]), allowMissingColumns=True)


# rows as values


def scatter(df: DataFrame, names: list[str]) -> DataFrame:
    """SCATTER TO array: each record's fields as strings."""
    return df.withColumn("_memvars", F.array(*[F.col(n).cast("string") for n in names]))


def gather(df: DataFrame, names: list[str], array: str = "_memvars") -> DataFrame:
    """GATHER FROM array: fields by position, cast to the field's type; a shorter array leaves the others."""
    return df.withColumns({n: F.when(F.size(array) > i, F.get(array, F.lit(i)).cast(df.schema[n].dataType)).otherwise(F.col(n)) for i, n in enumerate(names)})


def structure(df: DataFrame) -> DataFrame:
    """COPY STRUCTURE EXTENDED: a row for each field."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema, 1)]
    return df.sparkSession.createDataFrame(rows, "field_no int, field_name string, field_type string, nullable boolean")


# aggregates


def calculate(df: DataFrame, value: str, rate: float | None = None) -> DataFrame:
    """CALCULATE AVG CNT MAX MIN SUM STD VAR (population) and NPV of a column in one row.

    NPV discounts the n-th record of the scope by (1 + rate) ** n, n = _recno counted from the scope's first.
    """
    x = F.col(value).cast("double")
    out = [F.avg(x).alias("avg"), F.count(F.lit(1)).alias("cnt"), F.max(value).alias("max"), F.min(value).alias("min"), F.sum(F.col(value).cast("decimal(18,4)")).cast("double").alias("sum"), F.stddev_pop(x).alias("std"), F.var_pop(x).alias("var")]
    if rate is not None:
        out.append(F.sum(x / F.pow(F.lit(1 + rate), F.col(RECNO).cast("double"))).alias("npv"))
    return df.agg(*out)


def sum_to(df: DataFrame, *exprs: Column, mask: Column | None = None) -> DataFrame:
    """SUM e1, e2 FOR mask TO v1, v2: one row, sums of nothing are 0."""
    rows = df if mask is None else df.where(mask)
    return rows.agg(*[F.coalesce(F.sum(e.cast("decimal(18,4)")), F.lit(0)).cast("double").alias(f"v{i}") for i, e in enumerate(exprs, 1)])


def count_to(df: DataFrame, mask: Column | None = None) -> DataFrame:
    """COUNT FOR mask TO v1."""
    return (df if mask is None else df.where(mask)).agg(F.count(F.lit(1)).alias("v1"))


def average_to(df: DataFrame, *exprs: Column, mask: Column | None = None) -> DataFrame:
    """AVERAGE e1, e2 FOR mask TO v1, v2: one row, averages of nothing are 0."""
    rows = df if mask is None else df.where(mask)
    return rows.agg(*[F.coalesce(F.avg(e.cast("double")), F.lit(0.0)).alias(f"v{i}") for i, e in enumerate(exprs, 1)])


def sort_to(df: DataFrame, path: str, *order: Column, names: list[str] | None = None) -> DataFrame:
    """SORT TO path ON keys FIELDS names: the records in that order, numbered anew by it when read again."""
    out = df.select(*names) if names else df
    out.orderBy(*order).write.parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def join_with(df: DataFrame, other: DataFrame, on: Column, path: str, names: list[str] | None = None) -> DataFrame:
    """JOIN WITH other TO path FOR on FIELDS names: the pairs, as a table of its own."""
    out = df.join(other, on)
    out = out.select(*names) if names else out
    out.write.parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def lookup(df: DataFrame, value: Column, found: DataFrame, ret: str, key: str, *order: str, name: str = "looked_up") -> DataFrame:
    """LOOKUP(ret, value, key): for each record of df the field of the first record found by key; empty without one."""
    first = first_by(found.select(ret, key, *[o for o in order if o not in (ret, key)]), key, *(order or (ret,)))
    side = first.select(F.col(key).alias("_key"), F.col(ret).alias(name), F.lit(True).alias("_hit"))
    out = df.join(side, value == F.col("_key"), "left").drop("_key")
    return out.withColumn(name, F.when(F.col("_hit"), F.col(name)).otherwise(empty_value(found.schema[ret].dataType))).drop("_hit")


def total_on(df: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """TOTAL ON key: one row for each run of CONSECUTIVE equal keys in record order, with the fields' sums."""
    runs = sum_runs(df, key, RECNO, [F.col(s).cast("decimal(18,4)") for s in sums])
    return runs.withColumnsRenamed({f"_s{i}": s for i, s in enumerate(sums)})


# relations


def first_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first record of each key (null too), by partial aggregates, so that frequent keys don't meet in one task."""
    rest = [c for c in df.columns if c != key]
    ranks = F.struct(*[F.col(o).isNotNull().alias(f"_{i}n") if k == 0 else F.col(o).alias(f"_{i}") for i, o in enumerate(order) for k in (0, 1)])
    first = df.groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), ranks).alias("_first"))
    return first.select(key, *[F.col("_first")[c].alias(c) for c in rest]).select(*[f"`{c}`" for c in df.columns])


def set_relation(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, *order: str) -> DataFrame:
    """SET RELATION: each parent with its first child, or with nulls."""
    return parent.join(first_by(child, child_key, *order), F.col(parent_key) == F.col(child_key), "left")


def set_skip(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """SET SKIP: each parent with all its children."""
    return parent.join(child, F.col(parent_key) == F.col(child_key), "left")


def index_on(df: DataFrame, *exprs: Column, mask: Column | None = None, unique: bool = False) -> DataFrame:
    """INDEX ON ... FOR mask UNIQUE: the records that the index holds; UNIQUE keeps each key's first record."""
    out = df if mask is None else df.where(mask)
    if not unique:
        return out
    row = F.struct(*[F.col(f"`{c}`") for c in out.columns])
    return out.groupBy(*[e.alias(f"_key{i}") for i, e in enumerate(exprs)]).agg(F.min_by(row, RECNO).alias("_first")).select("_first.*")
