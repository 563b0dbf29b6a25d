"""Writers: chunk tables and lines, index tables, graphs, reports, logs and the index manifest."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.lexical import FileIndex, Index

PARTS = ("chunks", "postings", "vectors", "graph")


def write_chunks(chunks: DataFrame, path: str, form: str = "parquet") -> None:
    """Chunks by index_key, replacing what is there; ``form`` is parquet or json (lines)."""
    chunks.write.mode("overwrite").partitionBy("index_key").format(form).save(path)


def write_index(index: Index | FileIndex, path: str) -> None:
    """The tables of an index, one folder each; those of files with their vectors."""
    for f in fields(index):
        getattr(index, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")


def read_index(spark: SparkSession, path: str, kind: type[Index] | type[FileIndex] = Index) -> Index | FileIndex:
    return kind(*[spark.read.parquet(f"{path}/{f.name}") for f in fields(kind)])


def graph_json(nodes: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """(index_key, graph): each file's graph as JSON; nodes (with attrs where given) and mentions by id, edges by weight."""
    attrs = F.to_json("attrs") if "attrs" in nodes.columns else F.lit(None).cast("string")
    listed = F.array_sort(F.collect_list(F.struct("id", "label", "type", attrs.alias("attrs"))))  # maps have no order, their JSON has
    as_map = F.transform(listed, lambda x: F.struct(x["id"].alias("id"), x["label"].alias("label"), x["type"].alias("type"), F.from_json(x["attrs"], "map<string,string>").alias("attrs")))
    n = nodes.groupBy("index_key").agg(as_map.alias("nodes"))
    heavy = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "edge_pos", F.col("src").alias("from"), F.col("dst").alias("to"), "relation", "weight"))),
                        lambda e: F.struct(e["from"].alias("from"), e["to"].alias("to"), e["relation"].alias("relation"), e["weight"].alias("weight")))
    e = edges.groupBy("index_key").agg(heavy.alias("edges"))
    ids = mentions.groupBy("index_key", "node_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("ids"))
    m = ids.groupBy("index_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node_id", "ids")))).alias("entity_chunks"))
    rows = n.join(e, "index_key", "full_outer").join(m, "index_key", "full_outer")
    return rows.select("index_key", F.to_json(F.struct("nodes", "edges", "entity_chunks")).alias("graph"))


def write_report(report: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Log rows appended as JSON lines."""
    rows.write.mode("append").json(path)


def manifest(parts: DataFrame) -> DataFrame:
    """(index_key, parts, needed, complete): how many of the index parts of each key exist.

    ``parts``: index_key, part, present.
    """
    rows = parts.where(F.col("part").isin(*PARTS)).groupBy("index_key").agg(F.count_distinct(F.when(F.col("present"), F.col("part"))).cast("int").alias("parts"))
    return rows.withColumn("needed", F.lit(len(PARTS))).withColumn("complete", F.col("parts") == F.col("needed"))
