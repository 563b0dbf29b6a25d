"""Problem 7: mixing sources to target shares of all tokens by capped water-filling.

A source may give at most ``max_repeat`` times its own tokens.  Sources whose target exceeds that are clamped there;
what they cannot give is spread over the others in proportion to their targets, until nothing more is clamped.  The
tokens granted to a source are whole repetitions of all its documents plus a seeded sample for the fractional rest.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.storage import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to the byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FINE = 16384  # hash buckets of a source; the sample's boundary is exact inside one bucket
_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counter(path: str = VOCABULARY) -> Callable[[Column], Column]:
    """Arrow UDF: number of tokens of a text in the public vocabulary at ``path``; null texts have 0."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(path).encode_ordinary
        for s in batches:
            yield s.map(lambda x: 0 if x is None else len(encode(x))).astype("int64")

    return count


def grant_tokens(sizes: DataFrame, weights: DataFrame, total: float | None = None) -> DataFrame:
    """Water-filling over sources: adds target_share, most, granted and capped to the rows of ``weights``.

    ``sizes``: source, size (bigint); ``weights``: source, target_share, max_repeat, one row per source (of repeated
    rows the largest counts); ``total``: the size of the mixture, by default that of all sources together.
    Null, negative or zero shares and null sources get nothing; a null max_repeat means once; a source without
    documents grants 0 and its share goes to the others.  Shares are scaled to sum to 1.
    """
    wanted = (
        weights.where("source is not null and target_share > 0")
        .groupBy("source")
        .agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeat", F.lit(1))).alias("max_repeat"))
    )
    every = W.partitionBy(F.lit(0))  # one row per source
    goal = F.lit(float(total)) if total is not None else F.sum("size").over(every).cast("double")
    rows = (
        wanted.join(sizes.withColumn("total", goal), "source", "left")
        .withColumn("total", F.coalesce(F.max("total").over(every), F.lit(0.0)))
        .withColumn("target_share", F.col("target_share") / F.sum("target_share").over(every))
        .withColumn("size", F.coalesce(F.col("size"), F.lit(0)).cast("bigint"))
        .withColumn("most", F.col("size").cast("double") * F.greatest("max_repeat", F.lit(0)))
        .withColumn("ratio", F.col("most") / F.col("target_share"))
    )
    # Sources are clamped in order of most / share: while the level that is left for the rest is above that ratio.
    order = W.partitionBy(F.lit(0)).orderBy("ratio", "source")
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    rows = (
        rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("target_share").over(rest))
        .withColumn("capped", F.col("ratio") <= F.col("level"))
        .withColumn("first_open", F.min(F.when(~F.col("capped"), F.struct("ratio", "source", "level"))).over(every)["level"])
    )
    return rows.select(
        "source",
        "target_share",
        "max_repeat",
        "size",
        "capped",
        F.when(F.col("capped"), F.col("most")).otherwise(F.col("first_open") * F.col("target_share")).alias("granted"),
    )


def mixture(documents: DataFrame, weights: DataFrame, size: Column, seed: int = 42, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, shares) of a mixture of ``total`` tokens (all tokens of ``documents`` where not given).

    ``documents``: doc_id, source, text; ``size`` computes the tokens of a row.  The selection has doc_id, source,
    tokens, repeats (>= 1, never above max_repeat); the shares have, for each source of ``weights``, target_share,
    reached_share, tokens (in the mixture), available (tokens of the source), repeats (mean), capped.  Documents of
    no listed source, or without tokens, are never drawn.  The fractional part of a source is drawn in the order of a
    seeded hash of doc_id, up to the document that reaches the grant: a histogram of hash buckets finds the bucket
    where the grant ends, so no source is ever sorted as a whole, however large its part of the table.
    """
    sized = materialize(
        documents.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            "source",
            size.cast("bigint").alias("tokens"),
            F.xxhash64(F.lit(seed).cast("bigint"), F.col("doc_id").cast("bigint")).alias("draw"),
        ).withColumn("bucket", F.pmod(F.shiftrightunsigned("draw", 40), F.lit(FINE)).cast("int")),
        "mix-sizes",
    )
    fine = sized.where("source is not null").groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens"))
    fine = materialize(fine, "mix-histogram")
    sizes = fine.groupBy("source").agg(F.sum("tokens").alias("size"))
    granted = grant_tokens(sizes, weights, total).where("size > 0")
    granted = (
        granted.withColumn("whole", F.least(F.floor(F.col("granted") / F.col("size") + 1e-12), F.col("max_repeat")).cast("int"))
        .withColumn("rest", F.greatest(F.col("granted") - F.col("whole") * F.col("size"), F.lit(0.0)))
        .withColumn("rest", F.when(F.col("whole") >= F.col("max_repeat"), F.lit(0.0)).otherwise(F.col("rest")))
    )
    granted = materialize(granted, "mix-grants")  # one row per source
    run = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # at most FINE rows each
    edge = (
        fine.join(granted.select("source", "rest"), "source")
        .withColumn("before", F.coalesce(F.sum("tokens").over(run), F.lit(0)))
        .where("before < rest")
        .groupBy("source")
        .agg(F.max_by(F.struct("bucket", "before"), "bucket").alias("edge"))
        .select("source", F.col("edge.bucket").alias("edge_bucket"), F.col("edge.before").alias("edge_before"))
    )
    drawn = sized.where("tokens > 0").join(F.broadcast(granted.join(edge, "source", "left")), "source")
    # only the documents of each source's boundary bucket are ordered
    inside = W.partitionBy("source").orderBy("draw", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    boundary = (
        drawn.where("bucket = edge_bucket")
        .withColumn("before", F.col("edge_before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .withColumn("extra", (F.col("before") < F.col("rest")).cast("int"))
        .drop("before")
    )
    others = drawn.where("edge_bucket is null or bucket <> edge_bucket").withColumn(
        "extra", F.coalesce((F.col("bucket") < F.col("edge_bucket")).cast("int"), F.lit(0))
    )
    selection = (
        others.unionByName(boundary)
        .withColumn("repeats", (F.col("whole") + F.col("extra")).cast("int"))
        .where("repeats > 0")
        .select("doc_id", "source", "tokens", "repeats")
    )
    selection = materialize(selection, "mix")
    reached = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    all_rows = W.partitionBy(F.lit(0))  # one row per source
    shares = (
        grant_tokens(sizes, weights, total)
        .join(reached, "source", "left")
        .withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("bigint"))
        .withColumn("reached_share", F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(all_rows)))
        .select(
            "source",
            "target_share",
            F.coalesce("reached_share", F.lit(0.0)).alias("reached_share"),
            "tokens",
            F.col("size").alias("available"),
            F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("size")), F.lit(0.0)).alias("repeats"),
            "capped",
        )
    )
    return selection, shares
