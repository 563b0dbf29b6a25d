"""Problem 5: one ranking per group from scores of different scales by reciprocal rank fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 60


def fused_ranking(
    rows: DataFrame,
    scores: Sequence[str] = ("bm25_score", "vector_score", "rerank_score", "final_score"),
    group: str = "run_id",
    item: str = "chunk_id",
    latest: str = "logged_at",
    k: int = K,
) -> DataFrame:
    """(group, item, fused, place): each item's sum of 1 / (k + rank) over the scores, and its place in the group.

    Ranks are per score, higher is better, ties share the better rank, null and NaN scores share the worst.  Of
    repeated (group, item) rows the one with the latest ``latest`` counts (ties: the greatest scores).  Equal sums are
    placed by the scores in order, then by the item.  Null groups or items are dropped; an empty table gives none.
    A group is one retrieval run; ranks are windows over its candidates, whose number the retrieval depth bounds, and
    repeated rows are reduced by a partial aggregate before the shuffle.
    """
    clean = [F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double")).alias(s) for s in scores]
    once = (
        rows.where(F.col(group).isNotNull() & F.col(item).isNotNull())
        .select(F.col(group), F.col(item), F.col(latest).alias("_latest"), *clean)
        .groupBy(group, item)
        .agg(F.max(F.struct("_latest", *scores)).alias("_row"))
        .select(group, item, *[F.col(f"_row.{s}").alias(s) for s in scores])
    )
    part = W.partitionBy(group)
    ranked = once.select(
        group, item, *scores, *[F.rank().over(part.orderBy(F.col(s).desc_nulls_last())).alias(f"_r{i}") for i, s in enumerate(scores)]
    )
    fused = ranked.withColumn("fused", sum((1.0 / (k + F.col(f"_r{i}")) for i in range(len(scores))), F.lit(0.0)))
    order = part.orderBy(F.col("fused").desc(), *[F.col(s).desc_nulls_last() for s in scores], F.col(item))
    return fused.select(group, item, "fused", F.row_number().over(order).alias("place"))
