"""Readers: chunk lines, query sets, graph files, hash logs, pages and pluggable binary documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import strip

CHUNK_LINES = "pos int, chunk_id string, parent_id string, text string"
GRAPH = (
    "nodes array<struct<id:string,label:string,type:string,attrs:map<string,string>>>, "
    "edges array<struct<`from`:string,`to`:string,relation:string,weight:int>>, entity_chunks map<string,array<string>>"
)
PageReader = Callable[[bytes], list[tuple[str, int]]]  # text and number of images of each page


def read_chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of JSON-lines files; blank lines are skipped, rows keep their position."""
    return spark.read.schema(CHUNK_LINES).option("mode", "DROPMALFORMED").json(path)


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    """A query set that is a JSON array of strings or of objects, decided by its first element."""
    fields = "query string, expected_keywords array<string>, has_answer_in_doc boolean, answer_key_points array<string>, notes string"
    raw = spark.read.text(path, wholetext=True)
    plain = F.from_json("value", "array<string>")
    rows = raw.select(F.when(F.col("value").rlike(r"^\s*\[\s*\""), F.transform(plain, lambda q: F.to_json(F.struct(q.alias("query"))))).otherwise(plain).alias("rows"))
    return rows.select(F.explode("rows").alias("row")).select(F.from_json("row", fields).alias("q")).select("q.*")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, mentions) of graph files; index_key is the file's name up to the first point.

    Files in the older form, whose nodes are plain labels, get the labels as ids.
    """
    raw = spark.read.text(path, wholetext=True).withColumn("index_key", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:_semantic_graph)?\.[^/]*$", 1))
    old = F.col("value").rlike(r'"nodes"\s*:\s*\[\s*"')
    labels = F.from_json("value", "nodes array<string>")["nodes"]
    rows = raw.withColumn("g", F.from_json("value", GRAPH)).withColumn("old", old).withColumn("labels", labels)
    none = F.lit(None).cast("map<string,string>")
    fresh = F.transform("labels", lambda x: F.struct(x.alias("id"), x.alias("label"), F.lit(None).cast("string").alias("type"), none.alias("attrs")))
    nodes = rows.select("index_key", F.posexplode(F.when(F.col("old"), fresh).otherwise(F.col("g.nodes"))).alias("node_pos", "n")).select("index_key", "node_pos", "n.*")
    edges = rows.select("index_key", F.posexplode("g.edges").alias("edge_pos", "e")).select("index_key", "edge_pos", F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.relation", "e.weight")
    mentions = rows.select("index_key", F.explode("g.entity_chunks").alias("node_id", "ids")).select("index_key", "node_id", F.explode("ids").alias("chunk_id"))
    return nodes, edges, mentions


def read_hash_log(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, hash, ts) of a JSON version log, file_name -> versions; a corrupt file gives no rows."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<struct<hash:string,timestamp:string>>>").alias("m"))
    rows = raw.select(F.explode("m").alias("file_name", "v")).select("file_name", F.explode("v").alias("v"))
    return rows.select("file_name", "v.hash", F.try_to_timestamp("v.timestamp", F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"))


def html_text(html: Column) -> Column:
    """The text of an HTML page: scripts, styles and tags removed, blocks on lines of their own."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1\s*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<(br|/p|/div|/h[1-6]|/li|/tr)[^>]*>", "\n"), r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)[^\S\n]+", " "), r" ?\n ?", "\n")
    return strip(F.regexp_replace(t, r"\n{2,}", "\n"))


def join_pages(pages: DataFrame, key: str = "index_key") -> DataFrame:
    """(key, text): pages (key, page, text, n_images) in order; a page with images ends with a marker of them."""
    marked = F.when(
        F.col("n_images") > 0, F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"\n+$", ""), F.format_string("\n[图片：第%d页，共%d张]", "page", "n_images"))
    ).otherwise(F.coalesce("text", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("page", marked.alias("text"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))


def short_text_fallback(text: Column, ocr: Column, least: int = 100) -> Column:
    """(text, rejected): text of ``least`` characters or fewer is joined with what OCR read; still short ones are rejected."""
    both = F.when(F.length(strip(F.coalesce(text, F.lit("")))) > least, text).otherwise(strip(F.concat(F.coalesce(text, F.lit("")), F.lit("\n"), F.coalesce(ocr, F.lit("")))))
    return F.struct(both.alias("text"), (F.length(strip(both)) <= least).alias("rejected"))


_READERS: dict[str, PageReader] = {}


def register_reader(suffix: str, reader: PageReader) -> None:
    """Register how pages of files with a suffix such as .pdf are read."""
    _READERS[suffix.lower()] = reader


def reader_for(path: str) -> PageReader:
    """The reader for a path's suffix, without regard to case; ValueError for unknown ones."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in _READERS:
        raise ValueError(f"no reader for {suffix or path}")
    return _READERS[suffix]


def load_documents(spark: SparkSession, path: str, suffix: str = ".pdf", ocr: Callable[[bytes], str] | None = None) -> DataFrame:
    """(index_key, file_name, text, rejected) of binary documents: pages by the registered reader, OCR for short texts."""
    reader = reader_for("x" + suffix)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, name, content in zip(frame["index_key"], frame["file_name"], frame["content"]):
                try:
                    pages = reader(bytes(content))
                except Exception:
                    pages = []
                out += [(key, name, i + 1, text, images) for i, (text, images) in enumerate(pages)] or [(key, name, 1, "", 0)]
            yield pd.DataFrame(out, columns=["index_key", "file_name", "page", "text", "n_images"])

    def read_ocr(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"index_key": frame["index_key"], "ocr": [ocr(bytes(c)) if ocr else "" for c in frame["content"]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    files = files.select(F.sha2("content", 256).alias("index_key"), F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"), "content")
    pages = files.mapInPandas(run, "index_key string, file_name string, page int, text string, n_images int")
    names = files.groupBy("index_key").agg(F.min("file_name").alias("file_name"))
    scans = files.mapInPandas(read_ocr, "index_key string, ocr string").dropDuplicates(["index_key"])
    rows = join_pages(pages.dropDuplicates(["index_key", "page"])).join(names, "index_key").join(scans, "index_key", "left")
    return rows.select("index_key", "file_name", short_text_fallback(F.col("text"), F.col("ocr")).alias("r")).select("index_key", "file_name", "r.text", "r.rejected")
