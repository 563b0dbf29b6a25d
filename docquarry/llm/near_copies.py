"""Problem 2: near-duplicate texts by meet-in-the-middle ball hashing.

Texts are compared in their printed form (problem 1), by the share of their distinct character trigrams.

A fingerprint is a set of ``PLACES`` elements (place, symbol of four bits), each symbol taken from the least of the
text's trigrams under another hash; two texts of similarity J agree in a place with probability J + (1 - J) / 16.  The
distance of two fingerprints is the number of elements that stand in only one of them.  Every fingerprint emits all
variants with up to ``OUT`` elements taken out, which is half the radius of 2 * ``OUT``; so two fingerprints within the
radius (at most two places apart) meet in a common variant, and others do not.  To ship little, rows are shuffled
on the three blocks of a fingerprint, one of which two fingerprints within the radius share whole, and the variants are
formed in their bucket.  With p = J + (1 - J) / 16 a pair meets in one table with probability
p^10 + 10 p^9 (1 - p) + 45 p^8 (1 - p)^2, in one of ``TABLES`` independent ones with 0.967 at J = 0.70, 0.994 at 0.75
and 0.9995 at 0.80.

Colliding pairs are thinned in their bucket by a sketch of ``SKETCH`` bits over all trigrams (two of each minimum, so
that texts of one subject, which share a third of their trigrams, seldom pass), then the exact trigram similarity
decides.  The tables are taken one after the other, so that the wide sketches of only one lie in the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.components import connected_components
from docquarry.llm.print_forms import canonical
from docquarry.storage import materialize

TABLES = 6
PLACES = 10  # elements of a fingerprint, of four bits each
OUT = 2  # elements that a variant leaves out: half the radius
BLOCKS = ((0, 1, 2, 3), (4, 5, 6), (7, 8, 9))  # fingerprints that differ in at most OUT places agree in a block
SKETCH = 384  # bits over all trigrams that thin the candidates, two of each minimum
BINS = 128  # of each of two hash functions; TABLES * PLACES + SKETCH / 2 minima are used
SLACK = 3.0  # standard deviations allowed to the sketch distance: a pair at the threshold is lost with probability 0.001
SMALL_RUN = 48  # up to here all pairs of a run are compared by offsets, above in blocks
BLOCK = 2048  # members of a run that are compared with as many others at once
DENSE = 8  # near pairs a member from which a run links first and next members only; the rest follows (rest_of_runs)
ROWS_A_BUCKET = 16_000  # texts a bucket, so that a task stays of one size however large the table is
PAIRS_AT_ONCE = 512
CELLS = 1 << 16  # comparisons of sketches at once
WANTED = 1 << 20

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M3
    return h ^ (h >> np.uint64(32))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after the other, and the texts' lengths."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return data, np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))


def trigram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every trigram occurrence and the number of its text."""
    data, size = _codes(texts)
    doc = np.repeat(np.arange(len(texts)), size)
    if len(data) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = data.astype(np.uint64)
    h = _mix((c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]) * _M1)
    inside = doc[:-2] == doc[2:]
    return h[inside], doc[:-2][inside]


def minima(texts: list[str]) -> np.ndarray:
    """uint32 array (texts, 2 * BINS): minima over all distinct trigrams, in BINS bins of each of two hash functions."""
    n = len(texts)
    h, doc = trigram_hashes(texts)
    empty = np.uint32(0xFFFFFFFF)
    out = []
    for f in range(2):
        g = _mix((h + np.uint64(f + 1)) * _M1)
        low = np.full(n * BINS, empty, np.uint32)
        slot = ((g >> np.uint64(40)) * np.uint64(BINS) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(low, doc * BINS + slot, (g & np.uint64(0xFFFFFFFE)).astype(np.uint32))
        low = low.reshape(n, BINS)
        step = np.zeros((n, BINS), np.uint32)
        by = 1
        while by < BINS and (gap := low == empty).any():  # an empty bin borrows from the right, at doubling distances
            low, step = np.where(gap, np.roll(low, -by, 1), low), np.where(gap, np.roll(step, -by, 1) + np.uint32(by), step)
            by *= 2
        out.append(low + step * np.uint32(0x9E3779B1))
    return np.concatenate(out, 1)


def fingerprints(low: np.ndarray) -> np.ndarray:
    """uint64 array (texts, TABLES): the symbols of PLACES minima each."""
    symbol = (low[:, : TABLES * PLACES] * np.uint32(0x85EBCA6B) >> np.uint32(17) & np.uint32(15)).astype(np.uint64)
    return (symbol.reshape(len(low), TABLES, PLACES) << np.arange(0, 4 * PLACES, 4, dtype=np.uint64)).sum(2, dtype=np.uint64)


def sketches(low: np.ndarray) -> np.ndarray:
    """uint64 array (texts, SKETCH / 64): one bit of each of SKETCH / 2 other minima, then another bit of each."""
    low = low[:, TABLES * PLACES : TABLES * PLACES + SKETCH // 2] * np.uint32(0x85EBCA6B)
    bits = np.concatenate([(low >> np.uint32(k) & np.uint32(1)).astype(np.uint8) for k in (17, 18)], 1)
    return np.packbits(bits, axis=1).view(np.uint64)


def sketch_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of minima in which sketches differ; words are the last axis, the others broadcast."""
    half = SKETCH // 128
    out = np.bitwise_count((a[..., 0] ^ b[..., 0]) | (a[..., half] ^ b[..., half])).astype(np.int16)
    for i in range(1, half):
        out += np.bitwise_count((a[..., i] ^ b[..., i]) | (a[..., half + i] ^ b[..., half + i]))
    return out


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that arrays per character stay small."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def _form(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_id, text) -> (row_id, n, form, sig, sketch): number of characters, digest of the printed form, fingerprints."""
    for b in _slices(batches, 1000):
        texts = [canonical(x) for x in b.column(1).to_pylist()]
        low = minima(texts)
        sides = [[r.tobytes() for r in x] for x in (fingerprints(low), sketches(low))]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(x) for x in texts], pa.int32()), pa.array([_form(x) for x in texts], pa.binary()), *(pa.array(x, pa.binary()) for x in sides)],
            names=["row_id", "n", "form", "sig", "sketch"],
        )


def _mask(places: tuple[int, ...]) -> np.uint64:
    return np.uint64(sum(15 << 4 * p for p in places))


# of each block: itself, and the masks that leave out OUT of the other places
_HELD = np.array([_mask(b) for b in BLOCKS], np.uint64)
_KEPT = [
    np.array([~_mask(out) for out in combinations([p for p in range(PLACES) if p not in block], OUT)], np.uint64) for block in BLOCKS
]
_LOAD = np.uint64((1 << 4 * PLACES) - 1)
_WIDE = SKETCH // 8


def _pack(ids: np.ndarray, sketch: np.ndarray, bucket: np.ndarray, row: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(bucket, blob): a blob holds ids and sketches of a batch once, the number of rows of each, and the rows.

    ``bucket`` and ``row`` (code above the fingerprint, 48 bits) are arrays (ids, rows of each id).
    """
    who = np.repeat(np.arange(len(ids)), row.shape[1])
    bucket, row = bucket.ravel(), row.ravel()
    order = np.argsort(bucket * len(ids) + who, kind="stable")
    at, edge = np.unique(bucket[order], return_index=True)
    blobs = []
    for o in np.split(order, edge[1:]):
        n = np.bincount(who[o], minlength=len(ids))
        kept = np.flatnonzero(n)
        head = np.array([len(kept), len(o)], np.int64).tobytes()
        rows = np.ascontiguousarray(row[o].view(np.uint8).reshape(-1, 8)[:, :6])
        blobs.append(head + ids[kept].tobytes() + sketch[kept].tobytes() + n[kept].astype(np.uint8).tobytes() + rows.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, sketches and numbers of rows of the ids of a blob, and all rows."""
    n, rows = np.frombuffer(blob, np.int64, 2)
    ids = np.frombuffer(blob, np.int64, n, 16)
    sketch = np.frombuffer(blob, np.uint64, n * (SKETCH // 64), 16 + 8 * n).reshape(n, -1)
    at = 16 + (8 + _WIDE) * n
    many = np.frombuffer(blob, np.uint8, n, at)
    wide = np.zeros((rows, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8, rows * 6, at + n).reshape(rows, 6)
    return ids, sketch, many, wide.view(np.uint64).ravel()


def _emit(buckets: int, table: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(rep, sig, sketch) -> (bucket, blob): the fingerprint of ``table`` once for each of its blocks."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            if not len(ids):
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(len(ids), TABLES, 1)
            sketch = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(len(ids), -1)
            code = np.arange(TABLES * len(BLOCKS), dtype=np.uint64).reshape(TABLES, len(BLOCKS)) << np.uint64(4 * PLACES)
            sig, code = sig[:, [table]], code[[table]]
            bucket = _mix((sig & _HELD | code) * _M1) % np.uint64(buckets)
            yield _pack(ids, sketch, bucket.astype(np.int64).reshape(len(ids), -1), (sig | code).reshape(len(ids), -1), buckets)

    return emit


def _near(sketch: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return sketch_distance(sketch[a], sketch[b]) <= most


def _near_blocks(mine: np.ndarray, other: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of ``mine`` and j of ``other`` whose sketches are near, by j and then i; of one array only i < j."""
    within = mine is other
    mine, other = np.asfortranarray(mine), np.asfortranarray(other)  # whole columns are read
    step = max(1, CELLS // max(len(mine), 1))
    out = [np.zeros((0, 2), np.int64)]
    for lo in range(0, len(other), step):
        hi = min(lo + step, len(other))
        left = mine[: hi - 1] if within else mine
        j, i = np.nonzero(sketch_distance(other[lo:hi, None], left[None]) <= most)
        kept = i < j + lo if within else slice(None)
        out.append(np.stack([i[kept], j[kept] + lo], 1))
    return tuple(np.concatenate(out).T)


def _ends(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs sorted by j and i, the first and the last of each j."""
    new = np.r_[True, j[1:] != j[:-1]]
    kept = new | np.r_[new[1:], True]
    return i[kept], j[kept]


def _pairs_of_runs(
    key: np.ndarray, who: np.ndarray, sketch: np.ndarray, most: int, across: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b) within runs of equal keys that the sketches leave as candidates, and keys and members of open runs.

    All pairs of a run of up to BLOCK members are compared.  Where more than DENSE near pairs a member come out, only
    those of each member with its first and last near predecessor are given and the run stays open: all links that
    verified pairs leave out are found later (rest_of_runs).  So does a longer run, of which blocks are compared here;
    with ``across`` each block is compared with all before it too, so that only crowded runs stay open.
    """
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    out_a, out_b, open_runs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for by in range(1, SMALL_RUN):
        fits = (size > by) & (size <= SMALL_RUN)
        has = start[fits]
        if not len(has):
            break
        n = size[fits] - by
        i = np.repeat(has - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        a, b = who[i], who[i + by]
        near = _near(sketch, a, b, most)
        out_a.append(a[near])
        out_b.append(b[near])
    for s, n in zip(start[size > SMALL_RUN], size[size > SMALL_RUN]):
        dense = n > BLOCK and not across
        parts = [who[lo : min(lo + BLOCK, s + n)] for lo in range(s, s + n, BLOCK)]
        prints = [sketch[p] for p in parts]
        for x in range(len(parts)):
            i, j = _near_blocks(prints[x], prints[x], most)
            crowded = len(i) > DENSE * len(parts[x])
            dense = dense or crowded
            i, j = _ends(i, j) if crowded else (i, j)
            out_a.append(parts[x][i])
            out_b.append(parts[x][j])
        for x in range(1, len(parts)):
            if dense:
                break
            room = DENSE * len(parts[x])
            for y in range(x):
                i, j = _near_blocks(prints[y], prints[x], most)
                room -= len(i)
                dense = room < 0
                i, j = _ends(i, j) if dense else (i, j)
                out_a.append(parts[y][i])
                out_b.append(parts[x][j])
                if dense:
                    break
        if dense:
            open_runs.append(np.arange(s, s + n))
    at = np.concatenate([np.zeros(0, np.int64), *open_runs])
    return np.concatenate(out_a), np.concatenate(out_b), key[at], who[at]


def _meet(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bucket, blob) of whole buckets, sorted by bucket -> (a, b, run).

    Pairs that share a variant and whose sketches differ in at most ``most`` bits, once per bucket, with a null run;
    and the members a of each open run.
    """

    def solve(blobs: list[bytes]) -> pa.RecordBatch:
        ids, sketch, many, row = (np.concatenate(x) for x in zip(*map(_unpack, blobs)))
        who = np.repeat(np.arange(len(ids)), many)
        code = (row >> np.uint64(4 * PLACES)).astype(np.int64)
        row = row & _LOAD
        order = np.argsort(code, kind="stable")
        edge = np.searchsorted(code[order], np.arange(TABLES * len(BLOCKS) + 1))
        found, members = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        for c in np.unique(code):
            o = order[edge[c] : edge[c + 1]]
            for turn, kept in enumerate(_KEPT[c % len(BLOCKS)]):  # the variants that leave out the same places
                k = row[o] & kept
                by_key = np.argsort(k, kind="stable")
                k = k[by_key]
                twice = np.r_[k[1:] == k[:-1], False]
                twice[1:] |= k[1:] == k[:-1]
                if twice.any():
                    a, b, run, member = _pairs_of_runs(k[twice], who[o[by_key[twice]]], sketch, most, across=True)
                    found.append(np.stack([ids[a], ids[b]], 1))
                    name = _mix((run | np.uint64(int(c) * 64 + turn << 4 * PLACES)) * _M1).view(np.int64)
                    members.append(np.stack([ids[member], name], 1))
        both = np.concatenate(found)
        both, of = np.unique(np.stack([both.min(1), both.max(1)], 1) if len(both) else both, axis=0), np.concatenate(members)
        both = both[both[:, 0] != both[:, 1]]
        blank = lambda n: pa.nulls(n, pa.int64())
        a = pa.array(np.r_[both[:, 0], of[:, 0]])
        b, run = pa.concat_arrays([pa.array(both[:, 1].copy()), blank(len(of))]), pa.concat_arrays([blank(len(both)), pa.array(of[:, 1].copy())])
        return pa.RecordBatch.from_arrays([a, b, run], names=["a", "b", "run"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != at and held:
                    yield solve(held)
                    held = []
                at = bucket
                held.append(blob)
        if held:
            yield solve(held)

    return meet


def trigram_similarity(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Shared over all distinct character trigrams of each pair of printed forms; 0 where neither has a trigram."""
    n = len(a)
    ha, da = trigram_hashes(list(a))
    hb, db = trigram_hashes(list(b))

    def distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        first = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
        return h[first], doc[first]

    (ha, da), (hb, db) = distinct(ha, da), distinct(hb, db)
    h, doc = np.concatenate([ha, hb]), np.concatenate([da, db])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) if len(h) else np.zeros(0, bool)
    shared = np.bincount(doc[1:][same], minlength=n) if len(h) else np.zeros(n)
    total = np.bincount(da, minlength=n) + np.bincount(db, minlength=n) - shared
    return np.where(total > 0, shared / np.maximum(total, 1), 0.0)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _slices(batches, PAIRS_AT_ONCE):
        texts = [pd.Series([canonical(x) for x in b.column(i).to_pylist()]) for i in (2, 3)]
        sim = trigram_similarity(*texts)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim)], names=["a", "b", "similarity"])


def signed_rows(chunks: DataFrame, key: str = "row_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(row_id, form) of each non-null text, and (form, rep, n, sig, sketch) of each printed form; rep is its smallest key."""
    rows = chunks.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text"))
    signed = materialize(rows.mapInArrow(_sign, "row_id bigint, n int, form binary, sig binary, sketch binary"), "signed")
    first = signed.groupBy("form").agg(F.min("row_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    return signed.select("row_id", "form"), materialize(first, "print-forms")


def most_apart(threshold: float, slack: float | None) -> int:
    """The greatest distance of two sketches within ``slack`` standard deviations of what the threshold lets expect."""
    n, apart = SKETCH // 2, (1 - threshold) * 3 / 4
    return n if slack is None else int(n * apart + slack * float(np.sqrt(n * apart * (1 - apart))))


def ball_rows(forms: DataFrame, most: int) -> DataFrame:
    """(a, b, run), written: pairs of representatives whose balls meet, and the members a of the open runs.

    Shuffle files of one table go before the next (Spark removes them when the driver collects garbage).
    """
    rows = forms.where("n >= 3").select("rep", "sig", "sketch")
    parts = max(2, -(-rows.count() // ROWS_A_BUCKET))
    met = None
    for t in range(TABLES):
        blobs = rows.mapInArrow(_emit(parts, t), "bucket int, blob binary").repartitionById(parts, "bucket").sortWithinPartitions("bucket")
        mine = materialize(blobs.mapInArrow(_meet(most), "a bigint, b bigint, run bigint"), "met")
        del blobs
        forms.sparkSession._jvm.System.gc()
        met = mine if met is None else met.unionByName(mine)
    return met


def rest_of_runs(runs: DataFrame, links: DataFrame, forms: DataFrame, most: int) -> DataFrame:
    """(a, b): pairs of members of one run (run, id) that ``links`` leave in different components, thinned by sketch.

    The members outside a run's largest component are compared with all of its members, in blocks by hash of which
    every pair is a group of its own, so a hot run is spread.
    """
    comps = connected_components(links, "a", "b").select(F.col("node").alias("id"), "component")
    rows = runs.join(comps, "id", "left").select("run", "id", F.coalesce("component", "id").alias("component"))
    parts = rows.groupBy("run", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = parts.groupBy("run").agg(F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("main"))
    sizes = sizes.where("main.n < size").select(
        "run", F.col("main.component").alias("main"), F.ceil(F.col("size") / BLOCK).alias("all_blocks"), F.ceil((F.col("size") - F.col("main.n")) / BLOCK).alias("few_blocks")
    )
    rows = rows.join(sizes, "run").join(forms.select(F.col("rep").alias("id"), "sketch"), "id")

    def side(of: DataFrame, own: str, other: str, few: bool) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.col(own))
        return of.select(
            "run", "id", "component", "sketch", F.lit(few).alias("few"), block.alias(own), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias(other)
        )

    few = side(rows.where("component <> main"), "few_blocks", "all_blocks", True)
    both = few.unionByName(side(rows, "all_blocks", "few_blocks", False))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = frame[frame["few"]], frame[~frame["few"]]
        sides = [np.frombuffer(b"".join(x["sketch"]), np.uint64).reshape(-1, SKETCH // 64) for x in (left, right)]
        out = [np.zeros((0, 2), np.int64)]
        for n, (i, comp) in enumerate(zip(left["id"].to_numpy(), left["component"].to_numpy())):
            far = sketch_distance(sides[0][n], sides[1])
            j = right["id"].to_numpy()[(far <= most) & (right["component"].to_numpy() != comp)]
            out.append(np.stack([np.minimum(i, j), np.maximum(i, j)], 1))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b"])

    return both.groupBy("run", "few_blocks", "all_blocks").applyInPandas(compare, "a bigint, b bigint").distinct()


def similar_pairs(
    chunks: DataFrame, forms: DataFrame, threshold: float, key: str = "row_id", text: str = "text", slack: float | None = SLACK
) -> DataFrame:
    """(a, b, similarity): verified pairs of representatives with trigram similarity >= threshold.

    Open runs (see _pairs_of_runs) are finished after that: the members that are not in the run's main component are
    compared with all others, so that no link between components is left out.
    """
    most = most_apart(threshold, slack)
    met = ball_rows(forms, most)
    pairs = materialize(met.where("run is null").select("a", "b").distinct(), "near-pairs")
    links = verified_pairs(pairs, chunks, threshold, key, text)
    runs = met.where("run is not null").select("run", F.col("a").alias("id"))
    if runs.isEmpty():
        return links
    links = materialize(links, "near-links")
    rest = materialize(rest_of_runs(runs, links, forms, most), "near-rest")
    return links.unionByName(verified_pairs(rest, chunks, threshold, key, text))


def verified_pairs(near: DataFrame, chunks: DataFrame, threshold: float, key: str = "row_id", text: str = "text") -> DataFrame:
    """(a, b, similarity): the candidates of a written table whose texts have trigram similarity >= threshold."""
    texts = chunks.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    wanted = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
    # a table of at most WANTED cells, so of bounded size, keeps most other texts out of the shuffle
    cell = F.pmod(F.xxhash64("id"), F.lit(WANTED)).cast("int")
    cells = wanted.select(cell.alias("cell")).distinct()
    texts = texts.withColumn("cell", cell).join(F.broadcast(cells), "cell", "left_semi").drop("cell")
    texts = materialize(texts.join(wanted, "id", "left_semi"), "near-texts")
    sides = near.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return (
        sides.select("a", "b", "text_a", "text_b")
        .mapInArrow(_verify, "a bigint, b bigint, similarity double")
        .where(F.col("similarity") >= threshold)
    )


def copy_groups(
    chunks: DataFrame, threshold: float = 0.7, key: str = "row_id", text: str = "text", slack: float | None = SLACK
) -> DataFrame:
    """(row_id, group): every row with a non-null text; the group is the smallest row id it is linked to.

    Rows are linked when their printed forms are equal or share ``threshold`` of their distinct trigrams; links chain.
    Texts under three characters have no trigram and group only with exact copies.  Exact copies are one
    representative from the first stage on, so a text that fills a third of the table is compared once.  ``slack``
    None verifies every pair that meets, without thinning by sketch.
    """
    signed, forms = signed_rows(chunks, key, text)
    links = similar_pairs(chunks, forms, threshold, key, text, slack)
    comps = connected_components(links, "a", "b")
    groups = forms.select("form", "rep").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return signed.join(groups, "form").select("row_id", F.coalesce("component", "rep").alias("group"))


def copy_pairs(groups: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b): all pairs of rows of one group, smaller first."""
    kept = materialize(groups, "copy-groups")
    large = kept.groupBy("group").count().where("count > 1").select("group")
    members = materialize(kept.join(large, "group", "left_semi"), "copy-members")
    a = members.select("group", F.col("row_id").alias("row_id_a"))
    b = members.select("group", F.col("row_id").alias("row_id_b"))
    return a.join(b, "group").where("row_id_a < row_id_b").select("row_id_a", "row_id_b")
