"""Exact deduplication by a streaming aggregation with disk-backed state (operator 5); DataFrame functions only.

1. Each row becomes a fingerprint: the digest of its text without white space, its length in code points, its id and
   a locator of its content (the file that it was read from). The fingerprints are written to the shared folder.
2. A stream over them keeps, for each digest and without expiry, the row that stays (most code points, then smallest
   id), its locator, and the number of rows. The state is RocksDB's, on the executors' disks, with its checkpoint in
   the shared folder: a lost executor's part is loaded again. A caller that names a folder for the state continues it:
   rows of a later batch meet those of all batches before.
3. The state is read back as a table and joined to the fingerprints; large groups were counted before any shuffle, and
   the join, of two thin sides, leaves splitting a hot digest to adaptive execution.
4. Hits are checked on full bytes: over the rows whose digest is met more than once, the least and the greatest
   normalised text of a digest, taken before the shuffle by partial aggregation, must be the same. A row of an earlier
   batch that stays takes part: its bytes are read again from where its locator points to. Where texts differ, the
   digest's rows in this batch are grouped by the text itself.

Defined results: null counts as the empty text, and empty texts form one group; a null id sorts after all others;
repeated rows count one by one and share keep_id (rows that are given several times, in one batch or in two, count as
often); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.session import materialize, shared_dir

#: Up to so many digests of groups are broadcast (40 bytes each); beyond, the rows are joined by shuffles.
BROADCAST_GROUPS = 100_000
WHITE = "\t\n\x0b\x0c\r "


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, digest, order_col: str | None = None) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        digest(normalised(text)).alias("digest"),
        F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("points"),
        F.input_file_name().alias("locator"),
        F.col(f"`{order_col or id_col}`").cast("long").alias("order"),
    )


def _stays() -> Column:
    """The row that stays, of the rows of a group: most code points, then least order (null last), then least id."""
    after = [(-F.coalesce(F.col(c), F.lit(2**63 - 1))).alias(f"by_{c}") for c in ("order", "doc_id")]
    return F.max(F.struct("points", *after, "doc_id", "locator"))


def keyed_state(spark: SparkSession, path: str, at: str, schema) -> DataFrame:
    """digest, keep_id, locator and group_size of every digest in the Parquet files at path, kept by a stream's state at `at`."""
    own = spark.newSession()
    for k, v in {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # else executors hold all states' native memory for minutes
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }.items():
        own.conf.set(k, v)
    stream = own.readStream.schema(schema).parquet(path).groupBy("digest").agg(_stays().alias("stays"), F.count(F.lit(1)).alias("group_size"))
    run = stream.writeStream.format("noop").outputMode("update").option("checkpointLocation", at).trigger(availableNow=True).start()
    run.awaitTermination()
    state = spark.read.format("statestore").load(at)
    value = state.schema["value"].dataType.fieldNames()
    stays, count = (F.col("value").getField(n) for n in value)
    return state.select(F.col("key.digest").alias("digest"), stays.getField("doc_id").alias("keep_id"), stays.getField("locator").alias("locator"), count.alias("group_size"))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, broadcast_groups: int = BROADCAST_GROUPS, state_dir: str | None = None, order_col: str | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    state_dir: a folder that all executors share, where the state is kept and continued; docs are then a batch of files
    in Parquet with the same columns as those before. order_col: what decides between texts of equal length instead of
    the id.
    """
    spark = docs.sparkSession
    prints = fingerprints(docs, id_col, text_col, digest, order_col)
    base = state_dir.rstrip("/") if state_dir else shared_dir(spark, "exact")
    path = f"{base}/fingerprints/{uuid.uuid4().hex}"
    prints.write.parquet(path)
    prints = spark.read.schema(prints.schema).parquet(path)
    if prints.isEmpty():
        return prints.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))
    state = materialize(spark, keyed_state(spark, f"{base}/fingerprints/*", f"{base}/state", prints.schema), "state")

    groups = state.where("group_size > 1").select("digest")
    few = groups.limit(broadcast_groups + 1).count() <= broadcast_groups
    text = normalised(F.col(f"`{text_col}`").cast("string"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("body"), F.coalesce(F.char_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("long").alias("points"), F.lit("").alias("locator"), F.col(f"`{order_col or id_col}`").cast("long").alias("order"))
    rows = rows.withColumn("digest", digest(F.col("body")))
    hits = rows.join(F.broadcast(groups) if few else groups, "digest", "left_semi").select("digest", "body")
    if state_dir:
        hits = hits.unionByName(_earlier(spark, state.where("group_size > 1"), id_col, text_col, digest))
    wrong = hits.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("most")).where("least <> most").select("digest")
    wrong = materialize(spark, wrong, "collisions")

    thin = prints.select("doc_id", "digest").join(state.select("digest", "keep_id", "group_size"), "digest")
    full = thin.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
    if wrong.isEmpty():
        return full
    # equal digests of different texts: group these rows by their text
    w = Window.partitionBy("digest", "body")
    split = rows.join(wrong, "digest", "left_semi").select(
        "doc_id",
        _stays().over(w).getField("doc_id").alias("keep_id"),
        F.count(F.lit(1)).over(w).alias("group_size"),
        F.col("digest").alias("text_sha256"),
    )
    split = split.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return full.join(wrong.select(F.col("digest").alias("text_sha256")), "text_sha256", "left_anti").select(*full.columns).unionByName(split)


def _earlier(spark: SparkSession, groups: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """digest and normalised text of the rows that stay, read from where their locators point to."""
    files = [r.locator for r in groups.select("locator").where("locator <> ''").distinct().collect()]  # at most one for each file
    if not files:
        return groups.where("false").select("digest", F.lit("").alias("body"))
    text = normalised(F.col(f"`{text_col}`").cast("string"))
    rows = spark.read.parquet(*files).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("body")).withColumn("digest", digest(F.col("body")))
    stay = groups.select("digest", "keep_id")
    return rows.join(stay, (rows.digest == stay.digest) & rows.doc_id.eqNullSafe(stay.keep_id), "left_semi").select("digest", "body")


#: The oracle for op5: the same result by window functions.
SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents
), s AS (SELECT doc_id, length(body) AS points, sha256(norm) AS text_sha256 FROM d)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS kept,
       text_sha256
FROM s
"""
