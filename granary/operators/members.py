"""Names, formats and membership of extracted files, as row expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.modules import MAGICS
from granary.sources.tables import MEMO_OF

#: What compiled files become, and the project types of files by suffix.
SOURCE_OF = {"fxp": "prg", "mpx": "mpr", "qpx": "prg", "spx": "prg"}


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def list_tree(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """filename, type, key, path of the files under path whose suffix has a type, in order of name. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    out = files.select(base_name(F.col("path")).alias("filename"), _lookup(types, suffix(F.col("path"))).alias("type"), F.left(F.upper(stem(F.col("path"))), F.lit(32)).alias("key"), "path", "length")
    return out.where("type is not null").orderBy("filename")


def input_format(path: Column, content: Column) -> Column:
    """fxp by suffix or magic, table, binary, or null for formats that aren't taken."""
    magic = F.hex(F.substring(content, 1, 4)).isin(*[m.hex().upper() for m in MAGICS])
    ext = suffix(path)
    return F.when((ext == "fxp") | magic, "fxp").when(ext.isin("scx", "vcx", "frx", "lbx"), "table").when(ext.isin("exe", "app"), "binary")


def output_name(name: Column, kind: Column) -> Column:
    """The base name; compiled members get their source's suffix."""
    compiled = kind == "compiled_without_module_magic"
    source = F.concat(stem(name), F.lit("."), F.coalesce(_lookup(SOURCE_OF, suffix(name)), F.lit("prg")))
    return F.when(compiled, source).otherwise(base_name(name))


def safe_name(name: Column, longest: int = 40) -> Column:
    """Letters, digits, dot, dash and underscore; others become underscores; cut."""
    return F.left(F.regexp_replace(base_name(name), r"[^A-Za-z0-9._-]", "_"), F.lit(longest))


def record_folder(number: Column, name: Column) -> Column:
    safe = safe_name(name)
    head = F.format_string("record_%04d", number)
    return F.when(safe == "", head).otherwise(F.concat(head, F.lit("_"), safe))


def is_startup(payload: Column, name: Column, kind: Column) -> Column:
    """A compiled program without magic that begins with four zero bytes."""
    return (kind == "compiled_without_module_magic") & (suffix(name) == "fxp") & (F.hex(F.substring(payload, 1, 4)) == "00000000")


def startup(entries: DataFrame) -> DataFrame:
    """Of entries (order, name, payload, kind) the first startup program's name."""
    return entries.where(is_startup(F.col("payload"), F.col("name"), F.col("kind"))).agg(F.min_by("name", "order").alias("startup"))


def side_files(entries: DataFrame) -> DataFrame:
    """table, memo of tables with exactly one memo entry: same stem, mapped suffix, without regard to case."""
    e = entries.select("name", F.lower(stem(F.col("name"))).alias("stem"), suffix(F.col("name")).alias("ext"))
    wanted = e.select(F.col("name").alias("table"), "stem", _lookup(MEMO_OF, F.col("ext")).alias("ext")).where("ext is not null")
    found = wanted.join(e.withColumnRenamed("name", "memo"), ["stem", "ext"])
    return found.groupBy("table").agg(F.count(F.lit(1)).alias("n"), F.first("memo").alias("memo")).where("n = 1").select("table", "memo")


def missing_members(members: DataFrame, present: DataFrame) -> DataFrame:
    """Members whose file name isn't among the present ones, without regard to case."""
    have = present.select(F.lower("filename").alias("_have")).distinct()
    return members.join(have, F.lower(F.col("filename")) == F.col("_have"), "left_anti")


def generated_project(template: DataFrame, members: DataFrame, startup_key: str) -> DataFrame:
    """filename, type, key, main: the template's rows, then missing members that aren't programs; main on the startup program."""
    new = missing_members(members, template).where("not (type = 'P' and lower(filename) like '%.prg')").select("filename", "type", "key")
    both = template.select("filename", "type", "key").unionByName(new)
    return both.withColumn("main", F.when(F.col("type") == "P", F.upper("key") == startup_key.upper()).otherwise(False))


def manifest(entries: DataFrame) -> DataFrame:
    """file, name, kind, landed, miss of container entries (file, name, payload): where each would be written, or why not."""
    from granary.operators.sequence import payload_kind

    kind = payload_kind(F.col("payload"), F.col("name"))
    named = entries.withColumn("kind", kind)
    miss = F.when(base_name(F.col("name")) == "", "empty name").when(F.col("kind") == "empty", "no payload")
    return named.withColumn("miss", miss).select("file", "name", "kind", F.when(F.col("miss").isNull(), output_name(F.col("name"), F.col("kind"))).alias("landed"), "miss")


def directory_totals(rows: DataFrame) -> DataFrame:
    """modules, lifted, verified over rows (modules, lifted, miss): some modules, all lifted, nothing missed."""
    t = rows.agg(F.coalesce(F.sum("modules"), F.lit(0)).alias("modules"), F.coalesce(F.sum("lifted"), F.lit(0)).alias("lifted"), F.count("miss").alias("misses"))
    return t.select("modules", "lifted", ((F.col("modules") > 0) & (F.col("lifted") == F.col("modules")) & (F.col("misses") == 0)).alias("verified"))
