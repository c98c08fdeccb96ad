"""Global order without a single-task window.

A total order over a large table is cut into buckets of key ranges, several for each shuffle partition. Bounds come
from a bounded sample of rows, read once, so a frequent key gets as many sampled rows as it has weight and the other
buckets stay even. Positions, running sums and neighbours are computed by windows
inside the buckets, and what crosses a bucket's edge is one row for each bucket, brought together on the driver. Bounds
and what the driver adds are literal arrays in the plan: a search or a lookup for each row, no expression for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows sampled for the bounds, and the most buckets.
SAMPLE, BUCKETS = 4096, 512
#: Buckets for each shuffle partition: hashed to partitions, many small ones lie more evenly.
PER_PARTITION = 4
#: Bits of the record numbers that share a bucket, where these numbers are the order.
SPAN_BITS = 16
RECNO = "_recno"


def _literals(values: list, kind: T.DataType) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(T.ArrayType(kind))


def _place(key: Column, bounds: list, kind: T.DataType) -> Column:
    """How many of the rising bounds are at most key; 0 for null. A binary search by falling powers of two."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    every = _literals(bounds, kind)
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(key >= F.get(every, at + step - 1), at + step).otherwise(at))
    return F.coalesce(found, F.lit(0))  # never null, which spares a filter that searches again and keeps shuffles alike


def bucketed(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """df with `_bucket`: rises with `key`; null keys are in bucket 0, as they sort first."""
    n = buckets or max(2, min(BUCKETS, PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    seen = df.select(F.col(key).alias("k")).where("k is not null").orderBy(F.rand(17)).limit(SAMPLE).select("k")
    keys = sorted(r.k for r in seen.collect())
    bounds = sorted({keys[len(keys) * i // n] for i in range(1, n)} - {keys[0]}) if keys else []
    return df.withColumn("_bucket", _place(F.col(key), bounds, df.schema[key].dataType))


def _by_bucket(values: dict, kind: T.DataType) -> Column:
    """Column: each row's bucket's value; null for buckets without one."""
    every = [values.get(b) for b in range(max(values, default=0) + 1)]
    return F.get(_literals(every, kind), F.col("_bucket"))


def _offsets(per_bucket: list) -> Column:
    """Column: the sum of a value over all earlier buckets. per_bucket: (bucket, value), one row each."""
    out, total = {}, 0
    for b, v in sorted(per_bucket):
        out[b] = total
        total += v or 0
    return _by_bucket(out, T.LongType())


def with_recno(df: DataFrame, *keys: str, name: str = RECNO) -> DataFrame:
    """Number the rows from 1 in the order of keys, which must be unique together."""
    b = bucketed(df, keys[0])
    counts = [(r["_bucket"], r["n"]) for r in b.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()]
    w = Window.partitionBy("_bucket").orderBy(*keys)
    return b.withColumn(name, F.row_number().over(w).cast("long") + _offsets(counts)).drop("_bucket")


def running_sum(df: DataFrame, value: Column, order: str, name: str) -> DataFrame:
    """Sum of value (whole numbers) over all rows up to each one in the order of a unique column."""
    b = bucketed(df.withColumn(name, value.cast("long")), order)
    sums = [(r["_bucket"], r["n"]) for r in b.groupBy("_bucket").agg(F.sum(name).alias("n")).collect()]
    w = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn(name, F.coalesce(F.sum(name).over(w), F.lit(0)) + _offsets(sums)).drop("_bucket")


def with_previous(df: DataFrame, value: str, order: str, name: str) -> DataFrame:
    """The value of the row before each one in the order of a unique column; null for the first."""
    b = bucketed(df, order)
    lasts = sorted(((r["_bucket"], r["v"]) for r in b.groupBy("_bucket").agg(F.max_by(value, order).alias("v")).collect()), key=lambda r: r[0])
    edge = _by_bucket({bucket: v for (_, v), (bucket, _) in zip(lasts, lasts[1:], strict=False)}, df.schema[value].dataType)
    w = Window.partitionBy("_bucket").orderBy(order)
    inside = F.lag(value).over(w)
    first = F.row_number().over(w) == 1
    return b.withColumn(name, F.when(first, edge).otherwise(inside)).drop("_bucket")


def groups_of_runs(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Number runs of equal key in order: a new number where the key differs from the row before."""
    p = with_previous(df, key, order, "_before")
    changed = (~F.col(key).eqNullSafe(F.col("_before"))).cast("long")
    return running_sum(p, changed, order, name).drop("_before")


def sum_runs(df: DataFrame, key: str, order: str, sums: list[Column]) -> DataFrame:
    """order, key, `_s0`...: one row for each run of equal keys in the order of a unique whole number.

    A run has its first number and the sums of its rows. Runs are summed inside buckets of 2 ** SPAN_BITS numbers, in one shuffle and
    without a job before it; only the first and the last run of each bucket then meet in one task, to be joined with their neighbours.
    """
    names = [f"_s{i}" for i in range(len(sums))]
    b = df.select(F.shiftright(F.col(order).cast("long"), SPAN_BITS).alias("_bucket"), F.col(order), F.col(key), *[c.alias(n) for c, n in zip(sums, names, strict=True)])
    w = Window.partitionBy("_bucket").orderBy(order)
    begins = F.lag(F.lit(True)).over(w).isNull() | ~F.col(key).eqNullSafe(F.lag(key).over(w))
    b = b.withColumns({"_begins": begins.cast("long"), "_last": F.lead(F.lit(True)).over(w).isNull()})
    b = b.withColumn("_run", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = b.groupBy("_bucket", "_run").agg(F.min(order).alias(order), F.first(key).alias(key), *[F.sum(n).alias(n) for n in names], F.max("_last").alias("_last"))
    edge = (F.col("_run") == 1) | F.col("_last")
    across = Window.orderBy("_bucket", "_run")  # two rows at most for each bucket
    goes_on = (F.col("_run") == 1) & F.lag(F.lit(True)).over(across).isNotNull() & F.col(key).eqNullSafe(F.lag(key).over(across))
    edges = parts.where(edge).withColumn("_begins", (~goes_on).cast("long"))
    edges = edges.withColumn("_joined", F.sum("_begins").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    whole = edges.groupBy("_joined").agg(F.min(order).alias(order), F.first(key).alias(key), *[F.sum(n).cast(parts.schema[n].dataType).alias(n) for n in names])
    return parts.where(~edge).select(order, key, *names).unionByName(whole.drop("_joined"))
