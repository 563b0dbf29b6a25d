"""Evaluation of retrieval and generation, parameter sweeps and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry.functions.text import normalize_for_match
from docquarry.operators.gates import is_refusal


def first_hits(queries: DataFrame, results: DataFrame, top_k: int = 5) -> DataFrame:
    """(query_id, hit_rank, reciprocal_rank) of every query: the best rank whose text holds any expected keyword.

    ``queries``: query_id, expected_keywords; ``results``: query_id, rank, text.  Keywords and texts are compared in
    their normal form for matching; blank keywords never match; queries without a hit have null and 0.
    """
    words = queries.select("query_id", F.explode("expected_keywords").alias("word")).select("query_id", normalize_for_match(F.col("word")).alias("word")).where("word <> ''").distinct()
    shown = results.where(F.col("rank") <= top_k).select("query_id", "rank", normalize_for_match(F.col("text")).alias("text"))
    hit = shown.join(words, "query_id").where(F.contains("text", "word")).groupBy("query_id").agg(F.min("rank").alias("hit_rank"))
    rows = queries.select("query_id").join(hit, "query_id", "left")
    return rows.select("query_id", "hit_rank", F.coalesce(F.try_divide(F.lit(1.0), F.col("hit_rank")), F.lit(0.0)).alias("reciprocal_rank"))


def retrieval_report(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: total_queries, recall_at_k, mrr, hit_count, queries_with_answer, answer_recall (null without answers)."""
    rows = queries.select("query_id", "has_answer_in_doc").join(hits, "query_id", "left")
    hit, answered = F.col("hit_rank").isNotNull(), F.col("has_answer_in_doc") == F.lit(True)
    total = F.count(F.lit(1))
    with_answer = F.count_if(answered)
    return rows.agg(
        total.alias("total_queries"), F.coalesce(F.try_divide(F.count_if(hit).cast("double"), total), F.lit(0.0)).alias("recall_at_k"),
        F.coalesce(F.avg(F.coalesce("reciprocal_rank", F.lit(0.0))), F.lit(0.0)).alias("mrr"), F.count_if(hit).alias("hit_count"),
        with_answer.alias("queries_with_answer"), F.try_divide(F.count_if(hit & answered).cast("double"), with_answer).alias("answer_recall"),
    )


def generation_details(rows: DataFrame) -> DataFrame:
    """(query_id, refused, faithful, matched_points, match_rate) of answers.

    ``rows``: query_id, has_answer_in_doc, answer_key_points, answer.  Faithful is answering where the document answers and
    refusing where not, null where that is unknown; key points match without regard to case, and only in answers.
    """
    low = F.lower(F.coalesce("answer", F.lit("")))
    points = F.filter(F.coalesce("answer_key_points", F.array().cast("array<string>")), lambda p: p.isNotNull() & (p != ""))
    refused = is_refusal(F.col("answer"))
    matched = F.when(refused, F.array().cast("array<string>")).otherwise(F.filter(points, lambda p: F.contains(low, F.lower(p))))
    faithful = F.when(F.col("has_answer_in_doc").isNull(), None).when(F.col("has_answer_in_doc"), ~refused).otherwise(refused)
    rate = F.try_divide(F.size(matched).cast("double"), F.size(points))
    return rows.select("query_id", "has_answer_in_doc", refused.alias("refused"), faithful.alias("faithful"), matched.alias("matched_points"), rate.alias("match_rate"))


def generation_report(details: DataFrame) -> DataFrame:
    """One row: totals, refusals and faithfulness per class and overall (null where a class is empty)."""
    faithful = lambda cond: F.avg(F.when(cond, F.col("faithful").cast("int")))
    return details.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("refused").alias("refusals"),
        faithful(F.col("has_answer_in_doc") == F.lit(True)).alias("faithful_with_answer"), faithful(F.col("has_answer_in_doc") == F.lit(False)).alias("faithful_without_answer"),
        faithful(F.col("faithful").isNotNull()).alias("faithful_overall"), F.avg("match_rate").alias("avg_match_rate"),
    )


def full_report(retrieval: DataFrame, generation: DataFrame) -> DataFrame:
    """(part, metric, value): the two one-row reports as one table of numbers."""
    parts = [(n, r.unpivot([], r.columns, "metric", "value")) for n, r in (("retrieval", retrieval), ("generation", generation)) for r in [r.select(*[F.col(c).cast("double").alias(c) for c in r.columns])]]
    rows = [p.select(F.lit(n).alias("part"), "metric", "value") for n, p in parts]
    return rows[0].unionByName(rows[1])


def sweep_depths(queries: DataFrame, ranked: DataFrame, depths: list[int]) -> DataFrame:
    """(depth, recall, mrr, hit_count, is_best) of several candidate depths over one ranking; best by recall, then mrr, then depth.

    ``ranked``: query_id, rank, text, ranked to the greatest depth; repeated depths count once.
    """
    hits = first_hits(queries, ranked, max(depths)).join(F.broadcast(queries.sparkSession.createDataFrame([(d,) for d in sorted(set(depths))], "depth int")))  # few rows
    inside = F.coalesce(F.col("hit_rank") <= F.col("depth"), F.lit(False))
    rows = hits.groupBy("depth").agg(F.avg(inside.cast("int")).alias("recall"), F.avg(F.when(inside, F.col("reciprocal_rank")).otherwise(0.0)).alias("mrr"), F.count_if(inside).alias("hit_count"))
    order = W.partitionBy(F.lit(0)).orderBy(F.col("recall").desc(), F.col("mrr").desc(), "depth")  # one row per depth
    return rows.withColumn("is_best", F.row_number().over(order) == 1)


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """One row: files, parents, chunks, avg_len."""
    return chunks.agg(
        F.count_distinct("index_key").alias("files"), F.count_distinct("index_key", "parent_id").alias("parents"), F.count(F.lit(1)).alias("chunks"), F.round(F.avg(F.length("text")), 2).alias("avg_len")
    )
