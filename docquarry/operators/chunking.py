"""Parent blocks and child windows: title rules, regex and similarity splits, windows, ids, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry.functions.text import content_id, strip

# Lines that open a new parent block.
TITLE_PATTERNS = (r"(?U)^\s*#", r"(?U)^\s*第\s*[一二三四五六七八九十0-9]+\s*[章节部分条款]\s*", r"(?U)^\s*\d+(\.\d+)*\s+")


def is_title(line: Column, patterns: tuple[str, ...] = TITLE_PATTERNS) -> Column:
    """Whether a line opens a parent block: a pattern, or a full-width colon in at most forty characters."""
    rule = F.contains(line, F.lit("：")) & (F.length(line) <= 40)
    for p in patterns:
        rule = rule | line.rlike(p)
    return F.coalesce(rule & (line != ""), F.lit(False))


def _joined(rows: DataFrame, key: str) -> DataFrame:
    """Ordered paragraphs of each (key, parent_pos) joined by line breaks."""
    lines = F.array_sort(F.collect_list(F.struct("para_pos", "text")))
    out = rows.groupBy(key, "parent_pos").agg(strip(F.array_join(F.transform(lines, lambda x: x["text"]), "\n")).alias("text"))
    return out.where("text <> ''").select(key, "parent_pos", content_id(F.col("text"), 8).alias("parent_id"), "text")


def split_by_titles(paras: DataFrame, key: str = "index_key") -> DataFrame:
    """(key, parent_pos, parent_id, text): a title starts a new parent, except as the first paragraph."""
    order = W.partitionBy(key).orderBy("para_pos")
    opens = (is_title(F.col("text")) & (F.row_number().over(order) > 1)).cast("int")
    return _joined(paras.withColumn("_open", opens).withColumn("parent_pos", F.sum("_open").over(order)), key)


def similarity_breaks(vectors: DataFrame, key: str = "index_key", threshold: float | None = None) -> DataFrame:
    """(key, para_pos, similarity, parent_pos): a new parent where adjacent cosine falls below the threshold.

    The threshold is given, or mean minus half the population deviation of the key's adjacent similarities.  Vectors of
    zero length have similarity 0; a single paragraph is one parent.
    """
    order = W.partitionBy(key).orderBy("para_pos")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    before = F.lag("embedding").over(order)
    rows = vectors.withColumn("_before", before)
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.sqrt(dot(F.col("_before"), F.col("_before")))
    rows = rows.withColumn("similarity", F.when(F.col("_before").isNotNull(), F.coalesce(F.try_divide(dot(F.col("_before"), F.col("embedding")), norm), F.lit(0.0))))
    all_rows = W.partitionBy(key)
    level = F.lit(threshold) if threshold is not None else F.avg("similarity").over(all_rows) - 0.5 * F.stddev_pop("similarity").over(all_rows)
    opens = F.coalesce((F.col("similarity") < level).cast("int"), F.lit(0))
    rows = rows.withColumn("_open", opens)
    return rows.select(key, "para_pos", "similarity", F.sum("_open").over(order).cast("int").alias("parent_pos"))


def split_evenly(paras: DataFrame, key: str = "index_key") -> DataFrame:
    """(key, para_pos, parent_pos): two even parents up to six paragraphs, else three (where no vectors exist)."""
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    size = F.ceil(n / F.when(n <= 6, 2).otherwise(3))
    return paras.select(key, "para_pos", F.floor(F.col("para_pos") / size).cast("int").alias("parent_pos"))


def choose_split(regex_parents: DataFrame, similar_parents: DataFrame, key: str = "index_key", min_parents: int | None = None) -> DataFrame:
    """(key, regex_parents, similar_parents, strategy) for each key.

    Without ``min_parents`` the similarity split is taken where it gives more parents, else where the regex split gives
    fewer than max(1, min_parents).
    """
    a = regex_parents.groupBy(key).agg(F.count_distinct("parent_pos").cast("int").alias("regex_parents"))
    b = similar_parents.groupBy(key).agg(F.count_distinct("parent_pos").cast("int").alias("similar_parents"))
    both = a.join(b, key, "full_outer").na.fill(0, ["regex_parents", "similar_parents"])
    if min_parents is None:
        rule = F.when(F.col("similar_parents") > F.col("regex_parents"), "semantic_adaptive").otherwise("regex")
    else:
        rule = F.when(F.col("regex_parents") < max(1, int(min_parents)), "semantic_fixed_min").otherwise("regex")
    return both.withColumn("strategy", rule)


def char_windows(parents: DataFrame, key: str = "index_key", size: int = 220, overlap: int = 50) -> DataFrame:
    """(key, parent_pos, parent_id, child_pos, chunk_id, text): character windows of each non-blank parent.

    Windows start every max(1, size - overlap) characters up to the end of the text, so the last ones may lie inside
    the one before; blank windows go.
    """
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(step))
    windows = F.transform(starts, lambda i: strip(F.substring(F.col("text"), i + 1, F.lit(size))))
    rows = parents.where(strip(F.col("text")) != "").select(key, "parent_pos", "parent_id", F.posexplode(windows).alias("child_pos", "text"))
    rows = rows.where("text <> ''")
    return rows.select(key, "parent_pos", "parent_id", "child_pos", content_id(F.concat("parent_id", "text"), 12).alias("chunk_id"), "text")


def token_windows(parents: DataFrame, key: str = "index_key", size: int = 220, overlap: int = 50) -> DataFrame:
    """(key, parent_pos, parent_id, child_pos, chunk_id, text): windows of ``size`` tokens cut at token offsets.

    Tokens are single Han characters, words and marks.  The text of a window runs from its first to its last token;
    the last window is the first that reaches the end.  Offsets are running lengths of alternating tokens and gaps; a
    token goes to the one or two windows that hold it, and a window is the span of its tokens.
    """
    token = r"[\x{3400}-\x{9fff}]|[A-Za-z0-9_]+|(?U)[^\s]"
    step = max(1, size - overlap)
    group = [key, "parent_pos"]
    order = W.partitionBy(*group).orderBy("_i")
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"(?U)\\s+|{token}"), 0)
    rows = parents.select(*group, F.posexplode(pieces).alias("_i", "_s"))
    rows = rows.withColumn("_e", F.sum(F.length("_s")).over(order)).where(~F.col("_s").rlike(r"(?U)^\s"))
    rows = rows.withColumn("_n", F.row_number().over(order) - 1).withColumn("_c", F.count(F.lit(1)).over(W.partitionBy(*group)))
    low = F.greatest(F.lit(0), F.floor((F.col("_n") - size) / step) + 1).cast("int")
    last = F.greatest(F.ceil((F.col("_c") - size) / step), F.lit(0))
    high = F.least(F.floor(F.col("_n") / step), last).cast("int")
    rows = rows.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    spans = rows.select(*group, "_s", "_e", F.explode(F.sequence("_low", "_high")).alias("child_pos")).groupBy(*group, "child_pos")
    spans = spans.agg(F.min(F.col("_e") - F.length("_s")).alias("_from"), F.max("_e").alias("_to"))
    out = parents.join(spans, group)
    body = strip(F.substring(F.col("text"), (F.col("_from") + 1).cast("int"), (F.col("_to") - F.col("_from")).cast("int")))
    return out.select(key, "parent_pos", "parent_id", "child_pos", content_id(F.concat("parent_id", body), 12).alias("chunk_id"), body.alias("text"))


def parent_children(chunks: DataFrame, key: str = "index_key") -> DataFrame:
    """(key, parent_id, children): chunk ids of each parent in order of position."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "row_id", "chunk_id"))), lambda x: x["chunk_id"])
    return chunks.where("parent_id is not null").groupBy(key, "parent_id").agg(ids.alias("children"))


def chunk_statistics(chunks: DataFrame, key: str = "index_key") -> DataFrame:
    """Counts, lengths, quartiles (the element at floor(n * p) of the sorted lengths) and orphans of each key.

    Quartiles are exact without collecting lengths: rows are counted by length, and the quartile is the first length
    whose running count exceeds its place.
    """
    lengths = chunks.groupBy(key, F.length("text").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(key).orderBy("len").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(key)
    lengths = lengths.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(whole))

    def quartile(p: float, name: str) -> Column:
        place = F.least(F.floor(F.col("total") * p), F.col("total") - 1)
        return F.min(F.when(F.col("upto") > place, F.col("len"))).alias(name)

    shape = lengths.groupBy(key).agg(
        F.sum("n").alias("chunks"), F.round(F.sum(F.col("len") * F.col("n")) / F.sum("n"), 1).alias("avg_len"),
        F.min("len").alias("min_len"), F.max("len").alias("max_len"), quartile(0.25, "p25"), quartile(0.5, "p50"), quartile(0.75, "p75"),
    )
    family = chunks.groupBy(key).agg(
        F.count_distinct("parent_id").alias("parents"), F.count_if(F.col("parent_id").isNull()).alias("orphans"), F.count("parent_id").alias("_children")
    )
    per = F.coalesce(F.round(F.try_divide(F.col("_children").cast("double"), F.col("parents")), 1), F.lit(0.0)).alias("avg_children")
    return shape.join(family, key).select(key, "chunks", "parents", "avg_len", "min_len", "max_len", "p25", "p50", "p75", per, "orphans")
