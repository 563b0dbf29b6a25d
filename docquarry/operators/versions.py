"""File versions: idempotent insertion, as-of lookup, retention, exact file deduplication and rebuild decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distinct_versions(log: DataFrame) -> DataFrame:
    """One row per (file_name, hash, ts): the one received first (ties: smallest version_id)."""
    rows = log.where("file_name is not null and hash is not null and ts is not null")
    cols = [c for c in log.columns if c not in ("file_name", "hash", "ts")]
    first = rows.groupBy("file_name", "hash", "ts").agg(F.min_by(F.struct(*cols), F.struct("received_at", "version_id")).alias("_row"))
    return first.select("file_name", "hash", "ts", "_row.*")


def insert_new(known: DataFrame, arriving: DataFrame, key: str = "hash") -> DataFrame:
    """Rows of ``arriving`` whose key is not known yet, once each (idempotent insertion)."""
    fresh = arriving.where(F.col(key).isNotNull()).dropDuplicates([key])
    return fresh.join(known.select(key), key, "left_anti")


def version_as_of(versions: DataFrame, targets: DataFrame) -> DataFrame:
    """(file_name, target, hash, ts): each file's last version at or before the target; null before its first one.

    ``targets``: file_name, target.
    """
    met = targets.join(versions.select("file_name", "hash", "ts"), "file_name", "left")
    past = F.when(F.col("ts") <= F.col("target"), F.struct("ts", "hash"))
    return met.groupBy("file_name", "target").agg(F.max(past).alias("v")).select("file_name", "target", F.col("v.hash").alias("hash"), F.col("v.ts").alias("ts"))


def expired_versions(versions: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """(file_name, hash, ts): versions older than ``days``, except the last one of each file."""
    last = W.partitionBy("file_name").orderBy(F.col("ts").desc(), F.col("hash").desc())
    rows = versions.withColumn("_n", F.row_number().over(last))
    return rows.where((F.col("_n") > 1) & (F.col("ts") < now - F.make_interval(days=F.lit(days)))).select("file_name", "hash", "ts")


def rebuild_decisions(versions: DataFrame, indexed: DataFrame) -> DataFrame:
    """(hash, decision) of every file hash: load where all its parts exist, rebuild where some are missing, else build.

    ``indexed``: hash, parts (number of index parts present, of ``needed``).
    """
    rows = versions.select("hash").distinct().join(indexed, "hash", "left")
    rule = F.when(F.coalesce("parts", F.lit(0)) == 0, "build").when(F.col("parts") < F.col("needed"), "rebuild").otherwise("load")
    return rows.select("hash", rule.alias("decision"))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, first_key, copies) of each document by the SHA-256 of its text; null texts go.

    Grouped by digest with partial counts; the texts themselves are never shuffled.
    """
    rows = docs.where(F.col(text).isNotNull()).select(key, F.sha2(F.col(text), 256).alias("hash"))
    first = rows.groupBy("hash").agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("copies"))
    return rows.join(first, "hash").select(key, "hash", "first_key", "copies")


def paragraph_cap(paras: DataFrame, key: str, cap: int = 2000) -> DataFrame:
    """The first ``cap`` paragraphs of each document, the bound of the pairwise similarity step."""
    return paras.where(F.col("para_pos") < cap)
