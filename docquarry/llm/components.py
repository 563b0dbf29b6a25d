"""Connected components of a link table by alternating star contraction, never collected to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.storage import drop, materialize

_MAX_ROUNDS = 60


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of each batch by links to the batch's smallest member of each component."""
    for b in batches:
        u, v = b.column(0).to_numpy(), b.column(1).to_numpy()
        nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, c = flat[: len(u)], flat[len(u) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[c])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, c, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        k = np.nonzero(label != np.arange(len(nodes)))[0]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k]), pa.array(nodes[label[k]])], names=["u", "v"])


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``links``; the component is its smallest node.

    Null ends and self-links add nothing; repeated links count once; an empty table gives an empty result.  Links are
    first contracted within Arrow batches, then by alternating large-star and small-star rounds (O(log^2 n) of them),
    each written to the shared folder; links that are not settled after 60 rounds raise RuntimeError.  Hot nodes cost one partially aggregated minimum and an adaptively split join.
    """
    pairs = (
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v"))
        .mapInArrow(_local_stars, "u bigint, v bigint")
        .distinct()
    )
    edges = materialize(pairs, "links")
    before = None
    for _ in range(_MAX_ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop(edges)
        edges = new
        at = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if at == before:
            break
        before = at
    else:
        raise RuntimeError(f"components not settled after {_MAX_ROUNDS} rounds")
    # every node now points at the smallest of its component
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()
