"""Problem 6: passages of held-out evaluation items inside a large corpus.

Documents and items become streams of tokens (words, numbers, single Han characters) without case, punctuation, line
breaks or character forms.  Items are cut into windows at every position, documents into windows of the same size at
a stride that still meets an unedited passage; a window's SimHash has 64 bits.  Fingerprints are indexed by four
16-bit blocks, so every item window within Hamming distance 3 of a document window is found; items too short for such
windows are found by their five-token shingles, each of which is looked up in every document.  Document-item pairs
found so are verified exactly: the share of the item's shingles that the document holds, in long pieces only.  A
shingle loses weight with the number of documents that hold it without holding the item (domain phrases); documents
that hold the item do not count, however many they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.near_copies import _M1, _M2, _mix
from docquarry.llm.print_forms import canonical
from docquarry.storage import materialize

SHINGLE = 5
RADIUS = 3  # guaranteed by RADIUS + 1 blocks
BLOCKS = 4
WINDOW = {"han": 20, "word": 10}  # tokens
STRIDE = {"han": 4, "word": 2}
SHORT = 24  # items of fewer tokens may lie between the windows of a document, so they are found by their shingles
WHOLE = 0.5  # unweighted share of an item from which a document holds it, rather than phrases of it
COMMON = 0.01  # a shingle in more than this share of the documents, without its item, weighs nothing
COMMON_LEAST = 3.0
PIECE = 10  # shortest run of shared tokens (gaps up to a shingle closed) that counts; shorter items must be whole
SHARE = 0.38  # least weighted share of an item; scraps are below a fifth, cases above a half
CHARS_PER_PASS = 10_000_000  # characters of the items that are indexed and sent to the executors at once


def _classes() -> np.ndarray:
    """Token class of every BMP code point: 0 none, 1 letter, 2 digit, 3 Han."""
    table = np.zeros(0x10000, np.uint8)
    for cp in range(0x10000):
        c = chr(cp)
        if 0x3400 <= cp <= 0x9FFF or 0xF900 <= cp <= 0xFAFF:
            table[cp] = 3
        elif c.isdigit():
            table[cp] = 2
        elif c.isalpha():
            table[cp] = 1
    return table


_CLASS: np.ndarray | None = None


@dataclass
class Tokens:
    """Tokens of several texts: hash, class and number of the text of each."""

    hash: np.ndarray
    kind: np.ndarray
    doc: np.ndarray


def tokens_of(texts: list[str | None]) -> Tokens:
    """Tokens of the printed forms, without case; null and empty texts have none."""
    global _CLASS
    if _CLASS is None:
        _CLASS = _classes()
    low = [(canonical(t) or "").lower() for t in texts]
    data = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, low), np.int64, len(low))
    doc = np.repeat(np.arange(len(low), dtype=np.int32), size)
    kind = np.where(data < 0x10000, _CLASS[np.minimum(data, 0xFFFF)], 3).astype(np.uint8)
    kept = np.flatnonzero(kind)
    if not len(kept):
        return Tokens(np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int32))
    kind, doc, cp = kind[kept], doc[kept], data[kept]
    start = np.r_[True, (kind[1:] != kind[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(kept) > 1)] | (kind == 3)
    at = np.flatnonzero(start)
    place = np.arange(len(kept)) - np.repeat(at, np.diff(np.r_[at, len(kept)]))
    h = _mix((cp.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(21))) * _M1)
    return Tokens(_mix(np.add.reduceat(h, at) * _M2), kind[at], doc[at])


def shingles_of(t: Tokens) -> np.ndarray:
    """Hash of the five tokens from each position; 0 where they pass the end of the text."""
    n = len(t.hash)
    out = np.zeros(n, np.uint64)
    if n >= SHINGLE:
        m = n - SHINGLE + 1
        h = np.zeros(m, np.uint64)
        for i in range(SHINGLE):
            h = _mix((h + t.hash[i : i + m]) * _M1)
        out[:m] = np.where(t.doc[:m] == t.doc[SHINGLE - 1 :], h | np.uint64(1), np.uint64(0))
    return out


def windows_of(t: Tokens, stride: bool) -> tuple[np.ndarray, np.ndarray]:
    """SimHash and text number of the windows; at every position, or at the stride of the window's first token."""
    n = len(t.hash)
    if n < WINDOW["word"]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    step = STRIDE["word"] if stride else 1
    bits = np.unpackbits(t.hash.view(np.uint8).reshape(n, 8), axis=1)
    half = WINDOW["word"] // step
    if stride:
        m = n // step
        blocks = bits[: m * step].reshape(m, step, 64).sum(1, dtype=np.uint8)
    else:
        m, blocks = n, bits
    ten = np.zeros((m - half + 1, 64), np.uint8)
    for i in range(half):
        ten += blocks[i : i + m - half + 1]
    out_h, out_d = [], []
    for kind, width in WINDOW.items():
        every = (STRIDE[kind] // step) if stride else 1
        k = width // WINDOW["word"]
        last = m - half * k + 1
        if last <= 0:
            continue
        at = np.arange(0, last, every)
        first = at * step
        good = (t.doc[first] == t.doc[first + width - 1]) & ((t.kind[first] == 3) == (kind == "han"))
        at, first = at[good], first[good]
        total = ten[at].astype(np.int16)
        for i in range(1, k):
            total += ten[at + i * half]
        out_h.append(np.packbits(2 * total > width, axis=1).view(np.uint64).ravel())
        out_d.append(t.doc[first])
    return np.concatenate(out_h), np.concatenate(out_d)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b.astype(np.int64)


def _split(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return both >> 32, both & 0xFFFFFFFF


@dataclass
class Pieces:
    """Places of items that documents hold in long pieces: number of the (document, item) pair and shingle of each."""

    pair: np.ndarray
    shingle: np.ndarray
    flat: np.ndarray  # all places of the pairs' items, and where each pair's begin
    start: np.ndarray
    pairs: int

    def shares(self, weight: np.ndarray) -> np.ndarray:
        """Weighted share of the item of each pair that its document holds, as of ``covered``."""
        if not self.pairs:
            return np.zeros(0)
        total = np.bincount(np.repeat(np.arange(self.pairs), np.diff(self.start)), weight[self.flat], self.pairs)
        got = np.bincount(self.pair, weight[self.shingle], self.pairs)
        return np.where(total > 0, got / np.where(total > 0, total, 1.0), 0.0)


@dataclass
class ItemIndex:
    """Fingerprints of the item windows by block value, and the items' shingles."""

    ids: np.ndarray  # item ids by number
    prints: np.ndarray
    owner: np.ndarray
    order: list[np.ndarray]  # per block: windows by block value
    edge: list[np.ndarray]
    shingle: np.ndarray  # distinct, sorted
    spans: list[np.ndarray]  # per item: number of the shingle at each position
    short: np.ndarray  # short items by shingle number, and where each shingle's begin
    short_edge: np.ndarray
    distinct: np.ndarray  # distinct shingles of each item

    @staticmethod
    def build(ids: list[int], texts: list[str]) -> ItemIndex:
        t = tokens_of(texts)
        prints, owner = windows_of(t, stride=False)
        both = np.unique(np.stack([prints, owner.astype(np.uint64)], 1), axis=0) if len(prints) else np.zeros((0, 2), np.uint64)
        prints, owner = both[:, 0].copy(), both[:, 1].astype(np.int32)
        order, edge = [], []
        for b in range(BLOCKS):
            v = (prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)
            o = np.argsort(v, kind="stable")
            order.append(o)
            edge.append(np.searchsorted(v[o], np.arange(65537, dtype=np.uint64)))
        s = shingles_of(t)
        distinct = np.unique(s[s > 0])
        spans = [np.searchsorted(distinct, x[x > 0]) for x in (s[t.doc == i] for i in range(len(ids)))]
        size = np.bincount(t.doc, minlength=len(ids))
        own = [np.unique(x) for x in spans]
        mine = [np.stack([x, np.full(len(x), i)], 1) for i, x in enumerate(own) if size[i] < SHORT]
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *mine])
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        begin = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
        return ItemIndex(np.array(ids, np.int64), prints, owner, order, edge, distinct, spans, pairs[:, 1], begin, np.array([len(x) for x in own], np.int64))

    def pieces(self, doc: np.ndarray, item: np.ndarray, of: np.ndarray, held: np.ndarray) -> Pieces:
        """What each (document, item) shares; documents ``of`` hold the shingles ``held``, sorted by both."""
        size = np.array([len(x) for x in self.spans], np.int64)
        begin = np.r_[0, np.cumsum(size)]
        n = size[item]
        start = np.r_[0, np.cumsum(n)]
        pair = np.repeat(np.arange(len(item)), n)
        place = np.arange(start[-1]) - np.repeat(start[:-1], n)
        flat = np.concatenate([np.zeros(0, np.int64), *self.spans])[np.repeat(begin[item], n) + place]
        have, want = _join(of, held), _join(doc[pair], flat)
        k = np.minimum(np.searchsorted(have, want), max(len(have) - 1, 0))
        where = np.flatnonzero(have[k] == want) if len(have) else np.zeros(0, np.int64)
        if len(where):
            new = np.r_[True, (np.diff(where) > SHINGLE + 1) | (np.diff(pair[where]) > 0)]
            first, last = where[new], where[np.r_[new[1:], True]]
            long = last - first + SHINGLE >= np.minimum(PIECE, n[pair[first]] + SHINGLE - 1)
            where = where[long[np.cumsum(new) - 1]]
        return Pieces(pair[where], flat[where], flat, start, len(item))

    def short_candidates(self, doc: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, short item) where the document holds at least SHARE of the item's shingles."""
        lo = self.short_edge[held]
        n = self.short_edge[held + 1] - lo
        hit = np.flatnonzero(n)
        if not len(hit):
            return hit, hit
        lo, n = lo[hit], n[hit]
        item = self.short[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        both, times = np.unique(_join(np.repeat(doc[hit], n), item), return_counts=True)
        doc, item = _split(both)
        enough = times >= SHARE * self.distinct[item]
        return doc[enough], item[enough]

    def candidates(self, prints: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, item) with a window pair within RADIUS."""
        found = []
        for b in range(BLOCKS):
            v = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            lo = self.edge[b][v]
            n = self.edge[b][v + 1] - lo
            hit = np.flatnonzero(n)
            lo, n = lo[hit], n[hit]
            w = np.repeat(hit, n)
            i = self.order[b][np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(hit) else hit
            near = np.bitwise_count(prints[w] ^ self.prints[i]) <= RADIUS
            found.append(_join(doc[w[near]], self.owner[i[near]]))
        return _split(np.unique(np.concatenate(found)))


def _scan(index: ItemIndex) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) -> a row per document with candidates, and rows of the documents that shingles stand in.

    Columns: doc_id (null in rows of shingles), items and hits (numbers of candidate items and of shared shingles),
    shingle and n (documents of this task that hold the shingle but no item of it).
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(index.shingle), np.int64)
        same = np.ones(len(index.shingle))
        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                b = big.slice(lo, 1000)
                ids = b.column(0).to_numpy()
                t = tokens_of(b.column(1).to_pylist())
                if not len(t.hash) or not len(index.shingle):
                    continue
                s = shingles_of(t)
                k = np.minimum(np.searchsorted(index.shingle, s), len(index.shingle) - 1)
                at = np.flatnonzero(index.shingle[k] == s)
                of, held = _split(np.unique(_join(t.doc[at], k[at])))
                counts += np.bincount(held, minlength=len(counts))
                found = [_join(*index.candidates(*windows_of(t, stride=True))), _join(*index.short_candidates(of, held))]
                doc, item = _split(np.unique(np.concatenate(found)))
                pieces = index.pieces(doc, item, of, held)
                part = pieces.shares(same)
                pair = np.repeat(np.arange(len(doc)), np.diff(pieces.start))
                whole = (part >= WHOLE)[pair]
                mine = np.intersect1d(_join(doc[pair[whole]], pieces.flat[whole]), _join(of, held))
                counts -= np.bincount(_split(mine)[1], minlength=len(counts))
                doc, item = doc[part > 0], item[part > 0]  # the others share no piece, whatever their shingles weigh
                if not len(doc):
                    continue
                docs, start = np.unique(doc, return_index=True)
                items = np.split(item, start[1:])
                hits = [held[x:y] for x, y in zip(np.searchsorted(of, docs), np.searchsorted(of, docs, side="right"))]
                yield _batch(ids[docs], [x.tolist() for x in items], [x.tolist() for x in hits])
        seen = np.flatnonzero(counts)
        yield _batch(None, None, None, seen, counts[seen])

    return scan


_SCHEMA = "doc_id bigint, items array<int>, hits array<int>, shingle int, n bigint"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("items", pa.list_(pa.int32())), ("hits", pa.list_(pa.int32())), ("shingle", pa.int32()), ("n", pa.int64())]
)


def _batch(ids, items, hits, shingle=None, n=None) -> pa.RecordBatch:
    none = [None] * len(ids if ids is not None else shingle)
    cols = [none if c is None else c for c in (ids, items, hits, shingle, n)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def covered(span: np.ndarray, held: np.ndarray, weight: np.ndarray) -> float:
    """Weighted share of an item (its shingles' numbers by position) that the sorted ``held`` shingles cover.

    Gaps of less than a shingle (a changed word) are closed to judge the length of a piece; pieces under PIECE tokens
    (or under the whole of a shorter item) and shingles without weight add nothing.
    """
    w = weight[span]
    total = w.sum()
    if not len(span) or total <= 0:
        return 0.0
    at = np.minimum(np.searchsorted(held, span), max(len(held) - 1, 0))
    shared = held[at] == span if len(held) else np.zeros(len(span), bool)
    where = np.flatnonzero(shared)
    if not len(where):
        return 0.0
    run = np.cumsum(np.r_[True, np.diff(where) > SHINGLE + 1])
    first, last = where[np.r_[True, np.diff(run) > 0]], where[np.r_[np.diff(run) > 0, True]]
    long = (last - first + SHINGLE >= min(PIECE, len(span) + SHINGLE - 1))[run - 1]
    return float(w[where[long]].sum() / total)


def _judge(index: ItemIndex, weight: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            (doc, item), (of, held) = (
                (np.repeat(np.arange(len(ids)), np.diff(x.offsets.to_numpy())), x.flatten().to_numpy().astype(np.int64)) for x in (b.column(1), b.column(2))
            )
            part = index.pieces(doc, item, of, held).shares(weight)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[doc], index.ids[item], part)], names=["doc_id", "item_id", "share"])

    return judge


def leaked_items(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, share) for each document that holds a large part of an item.

    ``documents``: doc_id, text; ``items``: item_id, passage.  Null texts and passages, and passages under five tokens
    or made of domain phrases only, are never cases; repeated items each get their rows; empty tables give none.  Items
    are taken in blocks of about ``CHARS_PER_PASS`` characters, so that the index of a block, which is sent to the
    executors, and the counts of its shingles, which return, stay of one size; each block scans all documents.
    """
    rows = items.where(F.col("passage").isNotNull()).select(F.col("item_id").cast("bigint"), "passage")
    blocks = max(1, -(-(rows.agg(F.sum(F.length("passage"))).first()[0] or 0) // CHARS_PER_PASS))
    docs = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), "text")
    most = max(COMMON * docs.count(), COMMON_LEAST)
    out = None
    for block in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "passage").collect()
        index = ItemIndex.build([r[0] for r in mine], [r[1] for r in mine])
        scanned = materialize(docs.mapInArrow(_scan(index), _SCHEMA), "leak-scan")
        without = np.zeros(len(index.shingle))
        for shingle, n in scanned.where("shingle is not null").groupBy("shingle").agg(F.sum("n")).collect():
            without[shingle] = n
        weight = np.maximum(0.0, np.log((1 + most) / (1 + np.maximum(without, 0))))
        found = (
            scanned.where("doc_id is not null")
            .select("doc_id", "items", "hits")
            .mapInArrow(_judge(index, weight), "doc_id bigint, item_id bigint, share double")
            .where(F.col("share") >= share)
        )
        out = found if out is None else out.unionByName(found)
    return out
