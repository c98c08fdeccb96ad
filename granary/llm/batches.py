"""Bounded iteration over (id, text) Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.session import materialize

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Texts are handled in slices of about this many characters, so a batch of long texts stays small in memory.
SLICE_CHARS = 1_000_000
#: Bytes after which an Arrow batch takes no further row. An executor holds several copies of a batch for each task.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of about BATCH_BYTES in this session from now on, unless it has a bound of its own."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def _trim() -> None:
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


_held: dict = {}


def remembered(key: Hashable, make: Callable[[], Any]) -> Any:
    """make(), held over the tasks of a worker. A worker holds one such value; it goes when another key is asked for."""
    if key not in _held:
        forget()
        _held[key] = make()
    return _held[key]


def forget() -> None:
    """Drop the value that `remembered` holds, and give its memory back to the system."""
    if _held:
        _held.clear()
        gc.collect()
        _trim()


def released(run: Callable[..., Iterator[pa.RecordBatch]], remembers: bool = False) -> Callable[..., Iterator[pa.RecordBatch]]:
    """run, which gives its memory back to the system at its end: Python workers live on between stages.

    What earlier tasks have left in `remembered` goes before it starts, but where it `remembers` something itself.
    """

    @functools.wraps(run)
    def releasing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            if not remembers:
                forget()
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return releasing


def slices(batches: Iterator[pa.RecordBatch], chars: int = SLICE_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Lists of ids and of whole texts (null: empty), each of at most `chars` characters or of one text."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            t = t.as_py() or ""
            if texts and held + len(t) > chars:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i.as_py())
            texts.append(t)
            held += len(t)
        if texts:
            yield ids, texts


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the operators read; further columns, whatever their names, never reach Python."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "integer": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}

    def kind(t: T.DataType) -> pa.DataType:
        return pa.list_(kind(t.elementType)) if isinstance(t, T.ArrayType) else kinds[t.typeName()]

    return pa.schema([(f.name, kind(f.dataType)) for f in schema])


#: Up to so many ids are broadcast (8 bytes each); beyond, rows are joined by shuffles.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id isn't in `gone` (doc_id); all their columns."""
    gone = materialize(docs.sparkSession, gone.select(F.col("doc_id").alias("gone_id")), "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs[f"`{id_col}`"] == gone.gone_id, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def map_texts(df: DataFrame, ddl: str, start: Callable[[], Callable[[list, list[str]], list]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Run start()(ids, texts) -> columns over every row, in slices. `start` runs once for each task."""
    schema = T.StructType.fromDDL(ddl)

    @functools.partial(released, remembers=True)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, out = start(), arrow_schema(schema)
        for ids, texts in slices(batches):
            columns = work(ids, texts)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, out.types, strict=True)], schema=out)

    return id_text(df, id_col, text_col).mapInArrow(run, schema)
