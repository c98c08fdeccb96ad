"""Ordered sequences and ranges: matching, comparison, changed ranges, as-of and range lookups, tiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# comparison of two ordered lists of sections; a section is struct<frames: array<string>, symbols: array<string>>


def sections_equal(a: Column, b: Column) -> Column:
    """Equal number of frames, equal frames, and symbols that are equal without regard to case."""
    low = lambda s: F.transform(s.getField("symbols"), F.lower)
    return (F.size(a.getField("frames")) == F.size(b.getField("frames"))) & (a.getField("frames") == b.getField("frames")) & (low(a) == low(b))


def first_difference(a: Column, b: Column) -> Column:
    """Why two sections differ: 'count', 'frame n' (from 0) or 'symbols'; null where they are equal."""
    fa, fb = a.getField("frames"), b.getField("frames")
    at = F.array_position(F.zip_with(fa, fb, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(F.size(fa) != F.size(fb), F.lit("count")).when(at > 0, F.concat(F.lit("frame "), (at - 1).cast("string"))).when(~sections_equal(a, b), F.lit("symbols"))


def ordered_match(left: Column, right: Column) -> Column:
    """Whether each non-empty left section meets an equal right section further on than its predecessor's.

    The cursor goes on by one candidate for each comparison and never back, so a left section that meets none uses up
    the rest. Without a non-empty left section: false. A fold over the right list, in the engine.
    """
    wanted = F.filter(left, lambda s: F.size(s.getField("frames")) > 0)
    step = lambda at, s: F.when((at < F.size(wanted)) & F.coalesce(sections_equal(F.get(wanted, at), s), F.lit(False)), at + 1).otherwise(at)
    met = F.aggregate(right, F.lit(0), step)
    return (F.size(wanted) > 0) & (met == F.size(wanted))


def bijection(left: Column, right: Column) -> Column:
    """Whether the non-empty sections of both sides are as many and equal one by one."""
    drop = lambda x: F.filter(x, lambda s: F.size(s.getField("frames")) > 0)
    a, b = drop(left), drop(right)
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(sections_equal(x, y), F.lit(False))), lambda ok: ok)


# runs


def changed_ranges(df: DataFrame, group: str, position: str, before: str, after: str) -> DataFrame:
    """group, start, end: maximal runs [start, end) of positions at which both sides have a value and the values differ,
    and, where one side is longer, the tail as a range of its own, never merged with a run that ends where it starts.

    One row for each position from 0; a null on one side means that side has ended.
    """
    both = F.col(before).isNotNull() & F.col(after).isNotNull()
    spots = df.where(both & (F.col(before) != F.col(after))).select(group, F.col(position).alias("p"))
    w = Window.partitionBy(group).orderBy("p")
    runs = spots.withColumn("island", F.col("p") - F.row_number().over(w)).groupBy(group, "island").agg(F.min("p").alias("start"), (F.max("p") + 1).alias("end")).drop("island")
    tails = df.where(~both).groupBy(group).agg(F.min(position).alias("start"), (F.max(position) + 1).alias("end"))
    return runs.select(group, F.col("start").cast("long"), F.col("end").cast("long")).unionByName(tails.select(group, F.col("start").cast("long"), F.col("end").cast("long")))


def byte_ranges(before: bytes, after: bytes) -> list[tuple[int, int]]:
    """changed_ranges of two byte strings, over arrays."""
    import numpy as np

    n = min(len(before), len(after))
    differ = np.frombuffer(before, np.uint8, n) != np.frombuffer(after, np.uint8, n)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], differ, [False]]).astype(np.int8)))
    out = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    return [*out, (n, max(len(before), len(after)))] if len(before) != len(after) else out


# lookups


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """left with `value` of right's row with the greatest `at` not above its own, in the same group; null where none is.

    One shuffle of both sides on the group and a running window; no pairs are made. Of right rows at the same place the
    greatest value counts, and a right row at the left row's place is seen by it.
    """
    names = left.columns
    r = right.select(F.col(by), F.col(at), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*names, value)


def owner_lookup(points: DataFrame, ranges: DataFrame, by: str, at: str, cell: int) -> DataFrame:
    """points with `owner`, the first range (by `order`) of the same group with start <= at < end; null: unowned.

    ranges: by, order, start, end, in whole numbers. Both sides are cut into cells of that width, so the join is an
    equality of (group, cell), and a long range repeats once for each cell that it crosses.
    """
    r = ranges.where("start < end").select(F.col(by).alias("_by"), "order", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / cell).cast("long"), F.floor((F.col("end") - 1) / cell).cast("long"))).alias("_cell"))
    p = points.withColumn("_id", F.monotonically_increasing_id()).withColumn("_at_cell", F.floor(F.col(at) / cell).cast("long"))
    inside = (F.col(by) == F.col("_by")) & (F.col("_at_cell") == F.col("_cell")) & (F.col("start") <= F.col(at)) & (F.col(at) < F.col("end"))
    joined = p.join(r, inside, "left")
    return joined.groupBy("_id", *points.columns).agg(F.min("order").alias("owner")).drop("_id")


def overlaps(df: DataFrame, group: str, order: str, start: str, end: str) -> DataFrame:
    """Entries that start before the end of the one before them, in their group's order."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("previous_end", F.lag(end).over(w)).where(F.col(start) < F.col("previous_end"))


def chain_prefix(df: DataFrame, group: str, order: str, start: str, end: str, limit: int) -> DataFrame:
    """Entries up to the first whose gap to the one before is above limit."""
    w = Window.partitionBy(group).orderBy(order)
    gap = F.coalesce((F.col(start) - F.lag(end).over(w) > limit).cast("int"), F.lit(0))
    run = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_gap", gap).withColumn("_cut", F.max("_gap").over(run)).where("_cut = 0").drop("_gap", "_cut")


def accepted(df: DataFrame, group: str, order: str, start: str, end: str, pool_start: int, limit: int) -> DataFrame:
    """group, entries, last_end, n_overlaps, accepted: at least one entry, none overlapping, tiling up to the pool."""
    w = Window.partitionBy(group).orderBy(order)
    over = F.coalesce((F.col(start) < F.lag(end).over(w)).cast("long"), F.lit(0))
    g = df.withColumn("_over", over).groupBy(group).agg(F.count(F.lit(1)).alias("entries"), F.max(end).alias("last_end"), F.sum("_over").alias("n_overlaps"))
    return g.withColumn("accepted", (F.col("n_overlaps") == 0) & (F.col("last_end") >= pool_start - limit))


def extents(df: DataFrame, group: str, at: str, size: Column) -> DataFrame:
    """df with `extent_end`: the next hit of the group, or the group's size."""
    return df.withColumn("extent_end", F.coalesce(F.lead(at).over(Window.partitionBy(group).orderBy(at)), size))


def first_seen(df: DataFrame, group: str, position: str, value: str) -> DataFrame:
    """group, values: distinct values in order of first appearance."""
    first = df.groupBy(group, value).agg(F.min(position).alias("p"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", F.col(value).alias("v")))), lambda s: s.getField("v")).alias("values"))


# byte tests


def payload_kind(content: Column, name: Column) -> Column:
    """The kind of a payload by ordered tests of its first bytes and its name; the first that holds counts."""
    head = lambda n: F.hex(F.substring(content, 1, n))
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    printable = F.hex(F.substring(content, 1, 64)).rlike(r"^(?:(?:[2-6][0-9A-F])|(?:7[0-9A-E])|(?:09)|(?:0A)|(?:0D))*$")
    # fixed values: magic bytes, suffixes and the kinds' names
    return (
        F.when(F.length(content) == 0, "empty")
        .when(head(3) == "FEF2EE", "encrypted")
        .when(head(4).isin("FEF2FF20", "FEF2FF22", "FEF2FF1F"), "standalone_module_magic")
        .when(ext.isin("fxp", "mpx", "qpx", "spx"), "compiled_without_module_magic")
        .when(ext.isin("sct", "vct", "frt", "mnt", "fpt", "pjt"), "memo_sidecar")
        .when(head(2) == "424D", "bmp")
        .when(head(1) == "30", "dbf_header")
        .when(printable, "text")
        .when(head(1) == "FC", "compiled_section_no_magic")
        .otherwise("other")
    )


def magic_hits(df: DataFrame, text: str, patterns: list[str]) -> DataFrame:
    """df with `offset` and `magic` for every non-overlapping hit of any pattern, in ascending order, from 0.

    The text is cut at the patterns, so offsets are sums of the pieces before; long texts stay one row until exploded.
    """
    import re

    union = "|".join(f"(?:{re.escape(p)})" for p in patterns)
    pieces = F.split(F.col(text), union)
    hits = F.regexp_extract_all(F.col(text), F.lit(f"({union})"), F.lit(1))
    # (place after the last hit, hits so far)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("offs"), F.lit(0).alias("i"))

    def step(acc: Column, hit: Column) -> Column:
        off = acc.getField("at") + F.length(F.get(pieces, acc.getField("i")))
        return F.struct((off + F.length(hit)).cast("long").alias("at"), F.concat(acc.getField("offs"), F.array(off.cast("long"))).alias("offs"), (acc.getField("i") + 1).alias("i"))

    offs = F.aggregate(hits, start, step).getField("offs")
    return df.withColumn("_hit", F.explode(F.arrays_zip(offs.alias("offset"), hits.alias("magic")))).withColumn("offset", F.col("_hit.offset")).withColumn("magic", F.col("_hit.magic")).drop("_hit")
