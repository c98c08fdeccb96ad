"""Fixed-width table files with memo side files: reading through Spark's own readers, and writing.

Files come in as `binaryFile` rows, so any store that Spark reads will do, and are cut into records in Arrow batches; the
format limits a file to 2 GB. Malformed headers are refused by name (FAILFAST) or give one row with the reason
(PERMISSIVE). Values are raw bytes unless `typed` asks for columns.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.codepages import MARKS, decode

#: Which memo file goes with which table.
MEMO_OF = {"scx": "sct", "vcx": "vct", "frx": "frt", "mnx": "mnt", "dbf": "fpt", "lbx": "lbt", "pjx": "pjt"}


class MalformedTable(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    length: int


@dataclass(frozen=True)
class Header:
    records: int
    size: int
    record: int
    mark: int
    fields: tuple[Field, ...]


HEAD = struct.Struct("<4xIHH")  # records, size of the header, size of a record


def header_fault(blob: bytes) -> str | None:
    """Why a file isn't a table, or None: what its header says must fit into its bytes."""
    have = len(blob)
    records, size, record = HEAD.unpack_from(blob) if have >= 32 else (0, 0, 0)
    faults = {
        f"{have} bytes are fewer than a header has": have < 32,
        f"a header of {size} bytes in a file of {have}": size < 32 or size > have,
        "records of no length": record == 0,
        f"{records} records of {record} bytes don't fit into {have - size}": records * record > have - size,
    }
    return next((text for text, holds in faults.items() if holds), None)


def read_header(blob: bytes) -> Header:
    fault = header_fault(blob)
    if fault:
        raise MalformedTable(fault)
    records, size, record = struct.unpack_from("<IHH", blob, 4)
    fields, at = [], 32
    while at + 32 <= len(blob) and blob[at] != 0x0D:
        fields.append(Field(blob[at : at + 11].partition(b"\0")[0].decode("latin-1"), chr(blob[at + 11]), blob[at + 16]))
        at += 32
    return Header(records, size, record, blob[29], tuple(fields))


def memo_payload(memo: bytes | None, block: int) -> bytes:
    """The payload of a memo block; empty for block 0, without a file, or past its end."""
    if not block or not memo or len(memo) < 8:
        return b""
    at = block * (struct.unpack_from(">H", memo, 6)[0] or 512)
    if at + 8 > len(memo):
        return b""
    return memo[at + 8 : at + 8 + struct.unpack_from(">I", memo, at + 4)[0]]


def records(blob: bytes, memo: bytes | None = None) -> Iterator[tuple[int, bool, dict[str, bytes]]]:
    """(number from 1, deleted, raw value of each field) of every record, deleted ones too."""
    h = read_header(blob)
    for i in range(h.records):
        rec = blob[h.size + i * h.record : h.size + (i + 1) * h.record]
        at, row = 1, {}
        for f in h.fields:
            raw, at = rec[at : at + f.length], at + f.length
            row[f.name] = memo_payload(memo, struct.unpack_from("<I", raw)[0] if len(raw) >= 4 else 0) if f.kind == "M" else raw
        yield i + 1, rec[:1] == b"*", row


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def table_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path, content, memo of every table file; the memo is the file of the same stem and mapped suffix, lower case first."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content").withColumn("stem", _stem(F.col("path"))).withColumn("ext", F.regexp_extract("path", r"\.([^./]*)$", 1))
    suffix = F.create_map(*[F.lit(x) for kv in MEMO_OF.items() for x in kv])
    tables = files.withColumn("side", F.try_element_at(suffix, F.lower("ext"))).where("side is not null")
    memos = files.where(F.lower("ext").isin(*MEMO_OF.values()))
    memos = memos.groupBy("stem", F.lower("ext").alias("side")).agg(F.max_by("content", "ext").alias("memo"))
    return tables.join(memos, ["stem", "side"], "left").select("path", "content", "memo")


def read_tables(spark: SparkSession, *paths: str, mode: str = "FAILFAST") -> DataFrame:
    """path, _recno, _deleted, values (map of raw bytes), code_page_mark, fault of all records of all tables."""
    out = pa.schema([("path", pa.string()), ("_recno", pa.int64()), ("_deleted", pa.bool_()), ("values", pa.map_(pa.string(), pa.binary())), ("code_page_mark", pa.int32()), ("fault", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)

        for b in batches:
            for path, blob, memo in zip(*b.columns, strict=True):
                path, blob, rows = path.as_py(), blob.as_py(), []
                fault = header_fault(blob)
                if fault:
                    if mode == "FAILFAST":
                        raise MalformedTable(f"{path}: {fault}")
                    yield batch([(path, None, None, None, None, fault)])
                    continue
                for n, deleted, row in records(blob, memo.as_py()):
                    rows.append((path, n, deleted, list(row.items()), blob[29], None))
                    if len(rows) == 2000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return table_files(spark, *paths).mapInArrow(run, "path string, _recno long, _deleted boolean, values map<string,binary>, code_page_mark int, fault string")


def typed(df: DataFrame, fields: list[Field], mark: int | None = None) -> DataFrame:
    """Columns for fields: text by code page without trailing blanks, numbers (blank: null), logicals (blank: null), memos as bytes.

    Text is read by its file's own code page mark, unless `mark` names another.
    """

    @F.pandas_udf("string")
    def by_mark(raw: pd.Series, mark: pd.Series) -> pd.Series:
        pairs = list(zip(raw, mark, strict=True))
        known = {p: decode(bytes(p[0]), p[1]).rstrip(" ") for p in {(b if b is None else bytes(b), m) for b, m in pairs} if p[0] is not None}
        return pd.Series([None if b is None else known[bytes(b), m] for b, m in pairs], dtype=object)

    def text(raw: Column) -> Column:
        return by_mark(raw, F.col("code_page_mark") if mark is None else F.lit(mark))

    cols = []
    for f in fields:
        raw = F.col("values")[f.name]
        if f.kind == "M":
            col = raw
        elif f.kind == "I":
            col = _int32(raw)
        elif f.kind == "N":
            col = F.trim(F.decode(raw, "ISO-8859-1")).try_cast("decimal(20,6)")
        elif f.kind == "L":
            ch = F.upper(F.decode(raw, "ISO-8859-1"))
            col = F.when(ch.isin("T", "Y"), True).when(ch.isin("F", "N"), False)
        else:
            col = text(raw)
        cols.append(col.alias(f.name))
    return df.select("path", "_recno", "_deleted", *cols)


def _int32(raw: Column) -> Column:
    """Four little-endian bytes as a signed number."""
    byte = lambda i: F.conv(F.hex(F.substring(raw, i + 1, 1)), 16, 10).cast("long")
    n = byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216
    return F.when(n >= 2**31, n - 2**32).otherwise(n).cast("int")


def code_records(df: DataFrame, live: bool = False) -> DataFrame:
    """path, _recno, name, source, code, _deleted of records that hold compiled code; live: without deleted ones."""
    v = F.col("values")
    magic = F.hex(F.substring(v["TAG2"], 1, 3)) == "FEF2FF"
    code = F.when(F.length(v["OBJCODE"]) > 0, v["OBJCODE"]).when(magic, v["TAG2"])
    rows = df.select("path", "_recno", F.trim(F.decode(F.coalesce(v["OBJNAME"], v["NAME"], F.lit(b"")), "ISO-8859-1")).alias("name"), v["METHODS"].alias("source"), code.alias("code"), "_deleted").where("code is not null")
    return rows.where("not _deleted") if live else rows


def project_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The header row and the entries of a project table."""
    kind = F.trim(F.decode(F.col("values")["TYPE"], "ISO-8859-1"))
    return df.where(kind == "H"), df.where(kind != "H")


# writing


def encoded(value, mark: int) -> bytes:
    """Text in a code page's bytes (bytes as they are); a character that it lacks is refused."""
    return value if isinstance(value, bytes) else str(value).encode(MARKS.get(mark) or "latin-1")


def encode_value(f: Field, value, mark: int = 3) -> bytes:
    """One field's bytes, refused where they don't fit: a number to the right, other values to the left, none as blanks."""
    if f.kind == "I":
        return struct.pack("<i", value or 0)
    kinds = {"L": lambda: b"T" if value else b"F", "N": lambda: str(value).encode("ascii").rjust(f.length)}
    raw = b"" if value is None or value == "" else kinds.get(f.kind, lambda: encoded(value, mark))()
    if len(raw) > f.length:
        raise ValueError(f"{value!r} takes {len(raw)} bytes, field {f.name} has {f.length}")
    return raw.ljust(f.length)


def table_bytes(fields: list[Field], rows: list[tuple[bool, dict]], mark: int = 3, block: int = 64) -> tuple[bytes, bytes | None]:
    """The table file and, with memo fields, its side file: each payload in its own, next free block."""
    memo = bytearray(max(512, block)) if any(f.kind == "M" for f in fields) else None
    body = []
    for deleted, row in rows:
        rec = [b"*" if deleted else b" "]
        for f in fields:
            value = row.get(f.name)
            if f.kind == "M":
                at = 0
                if value:
                    payload = encoded(value, mark)
                    at = len(memo) // block
                    memo += struct.pack(">II", 1, len(payload)) + payload
                    memo += bytes(-len(memo) % block)
                rec.append(struct.pack("<I", at).ljust(f.length, b"\0"))
            else:
                rec.append(encode_value(f, value, mark))
        body.append(b"".join(rec))
    if memo is not None:
        struct.pack_into(">I", memo, 0, len(memo) // block)
        struct.pack_into(">H", memo, 6, block)
    slots = b"".join(f.name.encode("latin-1")[:10].ljust(11, b"\0") + f.kind.encode() + bytes(4) + bytes([f.length]) + bytes(15) for f in fields)
    size, width = 32 + len(slots) + 1, 1 + sum(f.length for f in fields)
    head = bytes([0x30, 0, 0, 0]) + struct.pack("<IHH", len(rows), size, width) + bytes(17) + bytes([mark]) + bytes(2)
    return head + slots + b"\x0d" + b"".join(body) + b"\x1a", None if memo is None else bytes(memo)


class TableImage:
    """A table file and its memo file in memory, with edits that keep every byte they don't mean.

    Memo blocks are only ever added at the next free place; old ones stay, so other records that point to them do too.
    """

    def __init__(self, body: bytes, memo: bytes | None = None):
        self.header = read_header(body)
        self.body, self.memo = bytearray(body), None if memo is None else bytearray(memo)
        ends = np.cumsum([1, *[f.length for f in self.header.fields]]).tolist()
        self.places = {f.name: (f, at) for f, at in zip(self.header.fields, ends, strict=False)}

    def record(self, n: int) -> int:
        """Where record n (from 1) stands."""
        if not 1 <= n <= self.header.records:
            raise IndexError(f"record {n} of {self.header.records}")
        return self.header.size + (n - 1) * self.header.record

    def _block(self) -> int:
        return struct.unpack_from(">H", self.memo, 6)[0] or 512

    def pointer(self, n: int, name: str) -> int:
        return struct.unpack_from("<I", self.body, self.record(n) + self.places[name][1])[0]

    def append_memo(self, payload: bytes, kind: int = 1, block: int = 64) -> int:
        """The number of the new block that holds the payload."""
        if self.memo is None:
            self.memo = bytearray(struct.pack(">IHH", 1, 0, block).ljust(block, b"\0"))
        size = self._block()
        free = struct.unpack_from(">I", self.memo)[0] or 1
        entry = struct.pack(">II", kind, len(payload)) + payload
        blocks = -(-len(entry) // size)
        self.memo = self.memo.ljust(free * size, b"\0")
        self.memo[free * size : (free + blocks) * size] = entry.ljust(blocks * size, b"\0")
        struct.pack_into(">I", self.memo, 0, free + blocks)
        return free

    def set_field(self, n: int, name: str, value) -> None:
        """An empty memo is pointer 0; any other gets a new block."""
        f, at = self.places[name]
        at += self.record(n)
        if f.kind == "M":
            raw = struct.pack("<I", self.append_memo(encoded(value, self.header.mark)) if value else 0).ljust(f.length, b"\0")
        else:
            raw = encode_value(f, value, self.header.mark)
        self.body[at : at + f.length] = raw

    def append_clone(self, n: int, values: dict | None = None) -> int:
        """A copy of record n at the end, with memos in blocks of its own and other values for some fields; its number."""
        h, at = self.header, self.record(n)
        copy = bytes(self.body[at : at + h.record])
        end = h.size + h.records * h.record
        self.body[end:end] = copy
        self.header = Header(h.records + 1, h.size, h.record, h.mark, h.fields)
        struct.pack_into("<I", self.body, 4, h.records + 1)
        given = values or {}
        for f in h.fields:
            if f.kind == "M" and f.name not in given:
                given = {**given, f.name: memo_payload(self.memo and bytes(self.memo), self.pointer(n, f.name))}
        for name, value in given.items():
            self.set_field(h.records + 1, name, value)
        return h.records + 1

    def overwrite_memo(self, n: int, name: str, payload: bytes) -> bool:
        """Write over a memo's bytes in place, only if the payload is as long; whether it was."""
        block = self.pointer(n, name)
        if not block or len(memo_payload(bytes(self.memo or b""), block)) != len(payload):
            return False
        at = block * self._block() + 8
        self.memo[at : at + len(payload)] = payload
        return True

    def files(self) -> tuple[bytes, bytes | None]:
        return bytes(self.body), None if self.memo is None else bytes(self.memo)


def guard(path: str, protected: str | None) -> None:
    """Refuse destinations under a protected root."""
    if protected and f"{path.rstrip('/')}/".startswith(f"{protected.rstrip('/')}/"):
        raise ValueError(f"{path} lies under the protected root {protected}")


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Write one file through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    for i in range(0, len(content), 1 << 20):
        out.write(bytearray(content[i : i + (1 << 20)]))
    out.close()


def write_table(df: DataFrame, path: str, fields: list[Field], protected: str | None = None, most: int = 1_000_000) -> None:
    """Write a DataFrame (columns named as fields, perhaps _deleted and _recno) as one table file with its memo file.

    One file is one sequence of records, so the rows come to the driver; more than `most` are refused.
    """
    guard(path, protected)
    stem, _, ext = path.rpartition(".")
    rows = df.orderBy("_recno") if "_recno" in df.columns else df
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} records for one table file")
    names = set(df.columns)
    body, memo = table_bytes(fields, [(bool(r["_deleted"]) if "_deleted" in names else False, {f.name: r[f.name] for f in fields if f.name in names}) for r in got])
    put(df.sparkSession, path, body)
    if memo is not None and ext.lower() in MEMO_OF:
        put(df.sparkSession, f"{stem}.{MEMO_OF[ext.lower()]}", memo)
