"""A content-addressed result cache: keys, lookups, and rows that may be stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_key(df: DataFrame, schema: str, identity: str, mode: str, name: Column, source: Column) -> DataFrame:
    """df with `key`: the digest of schema tag, identity, mode, NAME and source digest, so two names are two entries."""
    return df.withColumn("key", F.sha2(F.concat_ws("\n", F.lit(schema), F.lit(identity), F.lit(mode), name, F.sha2(source, 256)), 256))


def cacheable(source: Column) -> Column:
    """Sources that pull in others aren't cached."""
    return ~source.rlike(r"(?i)#\s*include|set\s+procedure")


def usable(stored: DataFrame, identity: str) -> DataFrame:
    """Entries of that identity with an error, or with a payload of the declared length."""
    whole = F.coalesce(F.length("payload") == F.col("length"), F.lit(False))
    return stored.where((F.col("identity") == identity) & (whole | F.col("error").isNotNull()))


def hits(wanted: DataFrame, stored: DataFrame, identity: str) -> DataFrame:
    return wanted.join(usable(stored, identity).select("key", "payload", "error").dropDuplicates(["key"]), "key")


def misses(wanted: DataFrame, stored: DataFrame, identity: str) -> DataFrame:
    return wanted.join(usable(stored, identity).select("key"), "key", "left_anti")


def receipt(wanted: DataFrame, stored: DataFrame, identity: str) -> DataFrame:
    """One row: files, hits, misses."""
    known = usable(stored, identity).select("key").distinct().withColumn("_hit", F.lit(1))
    return wanted.join(known, "key", "left").agg(F.count(F.lit(1)).alias("files"), F.count("_hit").alias("hits"), (F.count(F.lit(1)) - F.count("_hit")).alias("misses"))


def save(results: DataFrame, path: str, source: str = "source") -> None:
    """Append real outcomes (a payload or an error) of cacheable sources to the store."""
    real = results.where((F.col("payload").isNotNull() | F.col("error").isNotNull()) & cacheable(F.col(source)))
    real.select("key", "identity", F.length("payload").alias("length"), "payload", "error").write.mode("append").parquet(path)
