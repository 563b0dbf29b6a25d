"""Candidate union, graph boost, min-max fusion, evidence types, reranking and result rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unite_candidates(lexical: DataFrame, dense: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, bm25_score, vector_score, cand_seq): full outer union, missing scores 0.

    Both inputs: query_id, key, score, rank.  Lexical hits come first in their order, then dense-only hits in theirs.
    """
    a = lexical.select("query_id", key, F.col("score").alias("bm25_score"), F.col("rank").alias("_a"))
    b = dense.select("query_id", key, F.col("score").alias("vector_score"), F.col("rank").alias("_b"))
    both = a.join(b, ["query_id", key], "full_outer")
    order = W.partitionBy("query_id").orderBy(F.col("_a").asc_nulls_last(), F.col("_b").asc_nulls_last(), key)
    return both.select(
        "query_id", key, F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"),
        F.row_number().over(order).alias("cand_seq"),
    )


def add_graph_hits(candidates: DataFrame, recalled: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Mark candidates that the graph recalled, and append the others with scores 0 in recall order.

    ``recalled``: query_id, key, seq.
    """
    hits = recalled.groupBy("query_id", key).agg(F.min("seq").alias("_seq"))
    rows = candidates.join(hits, ["query_id", key], "full_outer")
    order = W.partitionBy("query_id").orderBy(F.col("cand_seq").asc_nulls_last(), F.col("_seq").asc_nulls_last(), key)
    return rows.select(
        "query_id", key, F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"),
        F.col("_seq").isNotNull().alias("graph_boost"), F.row_number().over(order).alias("cand_seq"),
    )


def cap_candidates(candidates: DataFrame, cap: int | None = 50, group: str = "query_id") -> DataFrame:
    """The first ``cap`` candidates of each query in order of arrival; None keeps all."""
    if cap is None:
        return candidates
    order = W.partitionBy(group).orderBy("cand_seq")
    return candidates.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def min_max(score: Column, group: str) -> Column:
    """Score scaled to [0, 1] in its group; where all are equal 0 for zero, else 1; null scores stay null."""
    part = W.partitionBy(group)
    lo, hi = F.min(score).over(part), F.max(score).over(part)
    return F.when(score.isNull(), None).when(hi > lo, (score - lo) / (hi - lo)).when(hi == 0, 0.0).otherwise(1.0)


def evidence_type(bm25: Column, vector: Column, boosted: Column) -> Column:
    """direct for any positive score, related_context for graph hits without one, else weak."""
    direct = (F.coalesce(bm25, F.lit(0.0)) > 0) | (F.coalesce(vector, F.lit(0.0)) > 0)
    return F.when(direct, "direct").when(F.coalesce(boosted, F.lit(False)), "related_context").otherwise("weak")


def fuse(candidates: DataFrame, group: str = "query_id", weights: tuple[float, float] = (0.7, 0.3), boost: float = 0.3) -> DataFrame:
    """Adds norm_bm25, norm_vector, base_score (weighted sum), final_score (boosted by the graph) and evidence_type."""
    rows = candidates.withColumn("norm_bm25", min_max(F.coalesce("bm25_score", F.lit(0.0)), group))
    rows = rows.withColumn("norm_vector", min_max(F.coalesce("vector_score", F.lit(0.0)), group))
    rows = rows.withColumn("base_score", weights[0] * F.col("norm_bm25") + weights[1] * F.col("norm_vector"))
    rows = rows.withColumn("final_score", F.when(F.col("graph_boost"), F.col("base_score") * (1 + boost)).otherwise(F.col("base_score")))
    return rows.withColumn("evidence_type", evidence_type(F.col("bm25_score"), F.col("vector_score"), F.col("graph_boost")))


def final_top(fused: DataFrame, k: int = 5, group: str = "query_id") -> DataFrame:
    """The k best by final_score, ties by order of arrival, with their rank."""
    order = W.partitionBy(group).orderBy(F.col("final_score").desc(), "cand_seq")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank(fused: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None, top: int = 50, k: int = 5) -> DataFrame:
    """Rescore the ``top`` best with a pluggable scorer of (query, text) and keep the k best.

    Without a scorer, or where it fails on a batch, the order stays, rerank_score is 0 and rerank_used false.
    """
    head = final_top(fused, top)
    if scorer is None:
        rows = head.withColumn("rerank_score", F.lit(0.0)).withColumn("rerank_used", F.lit(False))
    else:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                try:
                    yield frame.assign(rerank_score=scorer(frame["query"], frame["text"]).astype(float), rerank_used=True)
                except Exception:
                    yield frame.assign(rerank_score=0.0, rerank_used=False)

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in head.schema.fields)
        rows = head.mapInPandas(run, f"{fields}, rerank_score double, rerank_used boolean")
    # one failed batch puts its whole query back into the fused order
    used = F.min(F.col("rerank_used").cast("int")).over(W.partitionBy("query_id")) == 1
    rows = rows.withColumn("rerank_used", used).withColumn("rerank_score", F.when(F.col("rerank_used"), F.col("rerank_score")).otherwise(0.0))
    order = W.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("rank").withColumnRenamed("_n", "rank")


def rank_changes(debug: DataFrame) -> DataFrame:
    """(run_id, row_id, base_rank, final_rank, moved, graph_lift) of each candidate row of a run."""
    base = W.partitionBy("run_id").orderBy(F.col("base_score").desc_nulls_last(), "row_id")
    final = W.partitionBy("run_id").orderBy(F.col("final_score").desc_nulls_last(), "row_id")
    rows = debug.select("run_id", "row_id", F.row_number().over(base).alias("base_rank"), F.row_number().over(final).alias("final_rank"),
                        (F.col("final_score") - F.col("base_score")).alias("graph_lift"))
    return rows.withColumn("moved", F.col("base_rank") - F.col("final_rank"))
