"""Dense vectors: hashing embedder, exact inner-product top-k, greedy similarity deduplication."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry.functions.text import tokens
from docquarry.storage import materialize

QUERY_BLOCK = 2048


def hash_embedding(rows: DataFrame, key: str, text: str = "text", dim: int = 16) -> DataFrame:
    """(key, slot, weight): the non-zero slots of a unit vector of hashed tokens, the offline default embedder.

    The slot of a token is taken from the first bits of its MD5, the sign from the next; texts whose signs cancel out,
    or without tokens, have no rows.
    """
    toks = rows.select(key, F.explode(tokens(F.col(text))).alias("tok"))
    bits = F.conv(F.left(F.md5("tok"), F.lit(8)), 16, 10).cast("bigint")
    signed = toks.select(key, F.pmod(bits, F.lit(dim)).cast("int").alias("slot"), F.when(F.shiftright(bits, 16) % 2 == 0, 1).otherwise(-1).alias("sign"))
    sums = signed.groupBy(key, "slot").agg(F.sum("sign").cast("double").alias("v")).where("v <> 0")
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return sums.join(norms, key).select(key, "slot", (F.col("v") / F.col("norm")).alias("weight"))


def dense_embedding(rows: DataFrame, key: str, text: str = "text", dim: int = 16) -> DataFrame:
    """(key, embedding): hash_embedding as arrays; rows without tokens are missing."""
    slots = hash_embedding(rows, key, text, dim).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "weight"))).alias("m"))  # at most dim entries
    return slots.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))


def _block_top(ids: np.ndarray, matrix: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(vec_id, embedding) batches -> (query, vec_id, score): the k best of each batch for each query of the block."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if not len(keys):
                continue
            scores = matrix @ flat.reshape(len(keys), -1).T
            order = np.lexsort((np.broadcast_to(keys, scores.shape), -scores), axis=1)[:, :k]
            q = np.repeat(ids, order.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(q), pa.array(keys[order].ravel()), pa.array(np.take_along_axis(scores, order, 1).ravel())], names=["query_id", "vec_id", "score"]
            )

    return top


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k greatest inner products of each query vector, ties by vec_id.

    ``vectors``: vec_id, embedding; ``queries``: query_id, embedding.  Null vectors are left out; vectors that are not of
    one length raise ValueError.  Queries are sent in blocks of ``QUERY_BLOCK`` (bounded); each batch of vectors keeps its own k best, so only
    k rows a batch and query are shuffled for the final ranking.
    """
    sizes = [vectors.where("embedding is not null").agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first(), queries.where("embedding is not null").agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()]
    found = {n for pair in sizes for n in pair if n is not None}
    if len(found) > 1:
        raise ValueError(f"vectors of {min(found)} to {max(found)} numbers")
    dim = found.pop() if found else 0
    good = vectors.where(F.size("embedding") == dim).select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    asked = queries.where(F.size("embedding") == dim).select(F.col("query_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    out = None
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).orderBy("query_id").collect()
        ids = np.array([r[0] for r in rows], np.int64)
        matrix = np.array([r[1] for r in rows], np.float64).reshape(len(rows), dim)
        part = good.mapInArrow(_block_top(ids, matrix, k), "query_id bigint, vec_id bigint, score double")
        out = part if out is None else out.unionByName(part)
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _similar(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(g, ids, vectors, ids, vectors) of two blocks -> (g, i, j) with i < j and cosine above the threshold."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                i, j = np.array(r["ids_a"], np.int64), np.array(r["ids_b"], np.int64)
                x = np.array(r["vecs_a"], np.float64).reshape(len(i), -1)
                y = np.array(r["vecs_b"], np.float64).reshape(len(j), -1)
                hit = (x @ y.T > threshold) & (i[:, None] < j[None, :])
                a, c = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([pa.array(i[a]), pa.array(j[c])], names=["i", "j"])

    return similar


def similar_vectors(vectors: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """(i, j): pairs of vectors, i < j, whose cosine is above ``threshold``, exactly.

    Vectors are packed into blocks of about ``block`` rows; every pair of blocks is one product of two matrices.  This
    is the exact method for the bounded number of paragraphs of a file; it compares all blocks by design.
    """
    dot = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    unit = vectors.where("embedding is not null").withColumn("_n", F.sqrt(dot)).where("_n > 0")
    unit = unit.select("vec_id", F.transform("embedding", lambda x: x.cast("double") / F.col("_n")).alias("v"))
    blocks = max(1, -(-unit.count() // block))
    packed = unit.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("blk")).agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
    packed = materialize(packed.select("blk", F.col("rows.vec_id").alias("ids"), F.flatten("rows.v").alias("vecs")), "vector-blocks")
    a = packed.select(F.explode(F.sequence("blk", F.lit(blocks - 1))).alias("other"), F.col("ids").alias("ids_a"), F.col("vecs").alias("vecs_a"), F.col("blk").alias("one"))
    b = packed.select(F.col("blk").alias("other"), F.col("ids").alias("ids_b"), F.col("vecs").alias("vecs_b"))
    both = a.join(b, "other")
    back = both.where("one <> other").select(F.col("ids_b").alias("ids_a"), F.col("vecs_b").alias("vecs_a"), F.col("ids_a").alias("ids_b"), F.col("vecs_a").alias("vecs_b"))
    pairs = both.select("ids_a", "vecs_a", "ids_b", "vecs_b").unionByName(back)
    return pairs.mapInArrow(_similar(threshold), "i bigint, j bigint")


def greedy_dedup(vectors: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(vec_id): vectors kept when each is dropped if its cosine with an earlier kept one is above ``threshold``.

    The sequential rule is settled in rounds: a vector is kept once all its earlier neighbours are dropped, and dropped
    once one of them is kept.  Every round settles at least the first open vector of each cluster.
    """
    links = materialize(similar_vectors(vectors, threshold), "similar-vectors")
    state = materialize(vectors.where("embedding is not null").select("vec_id", F.lit(0).alias("fate")), "dedup-state")  # 0 open, 1 kept, 2 dropped
    while True:
        before = links.join(state.select(F.col("vec_id").alias("i"), F.col("fate").alias("fate_i")), "i")
        seen = before.groupBy(F.col("j").alias("vec_id")).agg(F.max((F.col("fate_i") == 1).cast("int")).alias("kept"), F.min((F.col("fate_i") == 2).cast("int")).alias("gone"))
        fate = F.when(F.col("fate") > 0, F.col("fate")).when(F.coalesce("kept", F.lit(0)) == 1, 2).when(F.coalesce("gone", F.lit(1)) == 1, 1).otherwise(0)
        state = materialize(state.join(seen, "vec_id", "left").select("vec_id", fate.alias("fate")), "dedup-state")
        if state.where("fate = 0").isEmpty():
            return state.where("fate = 1").select("vec_id")
