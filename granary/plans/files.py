"""Table files, containers and modules: synthetic files are written to the shared folder and read back."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from granary.plans.base import Catalogue, load
from granary.session import shared_dir
from granary.sources import modules, tables

C = Catalogue()

NATION = [tables.Field("KEY", "N", 6), tables.Field("NAME", "C", 30), tables.Field("HOT", "L", 1), tables.Field("NOTE", "M", 4)]


def _nation_file(spark, sf_dir) -> str:
    n = load(spark, sf_dir, "nation")
    rows = n.select(F.col("n_nationkey").alias("KEY"), F.col("n_name").alias("NAME"), (F.col("n_regionkey") == 1).alias("HOT"), F.concat(F.lit("note on "), "n_name").alias("NOTE"), (F.col("n_nationkey") % 5 == 0).alias("_deleted"), (F.col("n_nationkey") + 1).cast("long").alias("_recno"))
    path = f"{shared_dir(spark, 'nation')}/nation.dbf"
    tables.write_table(rows, path, NATION)
    return path.rpartition("/")[0]


@C.add("SELECT n_nationkey + 1::BIGINT AS _recno, n_nationkey % 5 = 0 AS _deleted, n_nationkey::DOUBLE AS KEY, n_name AS NAME, n_regionkey = 1 AS HOT, 'note on ' || n_name AS NOTE FROM nation")
def dbf_scan(spark, sf_dir):
    t = tables.typed(tables.read_tables(spark, _nation_file(spark, sf_dir)), NATION)
    return t.select("_recno", "_deleted", F.col("KEY").cast("double").alias("KEY"), "NAME", "HOT", F.decode("NOTE", "UTF-8").alias("NOTE"))


@C.add("SELECT count(*) AS files, true AS same FROM (VALUES (1), (2)) t(x)")
def dbf_roundtrip(spark, sf_dir):
    """Written, read, written again: the same bytes."""
    first = _nation_file(spark, sf_dir)
    t = tables.typed(tables.read_tables(spark, first), NATION).withColumn("KEY", F.col("KEY").cast("int"))
    second = shared_dir(spark, "nation")
    tables.write_table(t, f"{second}/nation.dbf", NATION)
    files = spark.read.format("binaryFile").load([first, second]).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("digest"))
    by = files.groupBy("name").agg(F.count_distinct("digest").alias("n"))
    return by.agg(F.count(F.lit(1)).alias("files"), F.bool_and(F.col("n") == 1).alias("same"))


def make_module(texts: list[list[str]], symbols: list[str]) -> bytes:
    """A module whose sections hold source lines; the symbols follow the last one."""
    out = modules.MAGICS[0] + bytes(4)
    for lines in texts:
        body = b"".join(struct.pack("<H", len(t) + 4) + b"\x01" + t.encode("latin-1") + b"\x0a" for t in lines)
        out += b"\xfc" + struct.pack("<H", len(body) + 3) + body + modules.STOP
    names = b"".join(struct.pack("<H", len(s)) + s.encode("latin-1") for s in symbols)
    return out + b"\x55" + struct.pack("<H", len(symbols)) + names


def make_container(entries: list[tuple[str, bytes]]) -> bytes:
    """A container of named payloads; a name that ends one stored before points into it."""
    payload, spans, pool, offsets = b"", [], b"", {}
    for name, content in entries:
        spans.append((21 + len(payload), 21 + len(payload) + len(content)))
        payload += content
    for name, _ in entries:
        whole = next((n for n in offsets if n.endswith(name)), None)
        if whole is None:
            offsets[name] = len(pool)
            pool += name.encode("latin-1") + b"\0"
        else:
            offsets.setdefault(name, offsets[whole] + len(whole) - len(name))
    pool += b"\0"
    start = 21 + len(payload)
    head = modules.CONTAINER_MAGIC + b"\x02" + struct.pack("<HHIII", 1, 0, start + len(pool), start, len(entries))
    rows = b"".join(bytes([i % 256]) + struct.pack("<IIII", *spans[i], 0, offsets[name]) + bytes(8) for i, (name, _) in enumerate(entries))
    return head + payload + pool + rows + bytes(25)


def _containers(spark, sf_dir):
    """One container for each region: its nations as text resources, then a module of their names."""
    n = load(spark, sf_dir, "nation").orderBy("n_regionkey", "n_nationkey").collect()  # 25 rows
    path = shared_dir(spark, "containers")
    for region in sorted({r.n_regionkey for r in n}):
        names = [r.n_name for r in n if r.n_regionkey == region]
        entries = [(f"{x.lower()}.txt", f"about {x}".encode()) for x in names] + [("main.fxp", make_module([[f"? '{x}'" for x in names], []], names))]
        tables.put(spark, f"{path}/region{region}.app", make_container(entries))
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), "content")


@C.add("SELECT 'region' || n_regionkey || '.app' AS file, lower(n_name) || '.txt' AS name, 'about ' || n_name AS payload, true AS accepted FROM nation")
def container_directory(spark, sf_dir):
    e = modules.entry_rows(_containers(spark, sf_dir))
    return e.where(~F.col("name").endswith(".fxp")).select("file", "name", F.decode("payload", "UTF-8").alias("payload"), "accepted")


@C.add("SELECT 'region' || n_regionkey || '.app' AS file, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS stmt_ix, '? ''' || n_name || '''' AS text FROM nation")
def module_statements(spark, sf_dir):
    s = modules.statement_rows(_containers(spark, sf_dir)).where("known and text is not null")
    return s.select("file", "stmt_ix", "text")


@C.add("SELECT 'region' || n_regionkey || '.app' AS file, 'parsed' AS status, 2::BIGINT AS sections, count(*) AS statements, list(n_name ORDER BY n_nationkey) AS symbols FROM nation GROUP BY n_regionkey")
def module_hits(spark, sf_dir):
    """The container's own header is a hit without sections of its own; the module is the last one."""
    h = modules.hit_rows(_containers(spark, sf_dir))
    return h.where("sections > 0 and offset > 0").select("file", "status", "sections", "statements", "symbols")
