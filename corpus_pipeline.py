"""The corpus pipeline: stages applied one after the other, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns the columns of
documents, but for the last, which returns the pieces of packed sequences. Stages decide on rows, not on ids: where a
stage needs a key, it numbers the rows, so rows with a null id or an id that others have too are judged by their own
text, and of repeated rows the dedup stages keep one. Null and empty texts are one text to exact dedup, which keeps one
of them; empty tables pass through; other columns are carried along. Stages that run Python bound the session's Arrow
batches by bytes, since all stages share the executors' memory.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import exact_dedup, near_dup, packing, quality, toxicity
from granary.llm.batches import small_batches, without
from granary.session import materialize

ROW = "_pipeline_row"
#: A path's scheme, which Spark spells in two ways.
SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:/+")


def _in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _read_as_is(docs: DataFrame) -> bool:
    """Whether docs are the rows of files, each once: a relation, perhaps filtered or with other columns."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with a number for each row, the same in every reading.

    Rows of Parquet files are numbered by their file's slot, of 2 ** 31, and their place in it (a salt is sought that
    gives each file a slot of its own); others are written with a number.
    """
    files = [SCHEME.sub("/", f) for f in docs.inputFiles()] if _read_as_is(docs) else []
    for salt in map(str, range(16)):
        slots = {xxhash.xxh64_intdigest(f"{f}{salt}".encode(), 42) % 2**31 for f in files}  # as xxhash64 in Spark
        if files and len(slots) == len(files):
            path = F.regexp_replace("_metadata.file_path", SCHEME.pattern, "/")
            slot = F.pmod(F.xxhash64(F.concat(path, F.lit(salt))), F.lit(2**31))
            try:
                return docs.withColumn(ROW, slot * F.lit(2**32) + F.col("_metadata.row_index"))
            except AnalysisException:  # files of another format
                break
    return materialize(spark, docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def _without(rows: DataFrame, gone: DataFrame, number: str = "doc_id") -> DataFrame:
    return without(rows, gone.select(F.col(number).alias("doc_id")), ROW).drop(ROW)


@_in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 6 predicts to be toxic go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, _labels(spark, sf_dir)))


@_in_small_batches
def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 8 rejects go."""
    rows = _numbered(spark, docs)
    return _without(rows, quality.classify(rows, _labels(spark, sf_dir), row_col=ROW).where("not kept"), "row")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one that operator 5 keeps stays."""
    rows = _numbered(spark, docs)
    return _without(rows, exact_dedup.deduplicate(rows, id_col=ROW, order_col="doc_id").where("not kept"))


@_in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of operator 2 stays."""
    rows = _numbered(spark, docs)
    return _without(rows, near_dup.near_duplicates(rows, id_col=ROW).where("not kept"))


@_in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of operator 1."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: Training, signatures and tokenizers aren't SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
