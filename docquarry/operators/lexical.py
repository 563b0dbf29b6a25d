"""Inverted index and BM25 ranking, window expansion and parent texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry.functions.text import tokens
from docquarry.storage import materialize


def current_chunks(chunks: DataFrame) -> DataFrame:
    """The row indexed last (ties: the greatest row_id) of each (index_key, pos); null texts go.

    The latest row is an aggregate with map-side combination on fixed-size fields, not a window over whole texts.
    """
    rows = chunks.where(F.col("text").isNotNull())
    last = rows.groupBy("index_key", "pos").agg(F.max_by("row_id", F.struct("indexed_at", "row_id")).alias("row_id"))
    return rows.join(last.select("row_id"), "row_id", "left_semi")


@dataclass
class Index:
    """The tables of a lexical index over documents numbered by ``row_id``."""

    postings: DataFrame  # term, row_id, tf
    lengths: DataFrame  # row_id, dl
    terms: DataFrame  # term, df, idf
    corpus: DataFrame  # n, avgdl: one row


def build_index(chunks: DataFrame, epsilon: float = 0.25) -> Index:
    """Postings, lengths, inverse document frequencies (negative ones become epsilon times their mean) and totals.

    Texts are read and tokenized once: the postings are written to the shared folder and all other tables come from
    them.  Current chunks lie by row_id after their join, so their terms are counted where they are.  (An outer explode
    keeps the optimizer from inferring a filter that would tokenize every text twice.)
    """
    toks = chunks.select("row_id", F.explode_outer(tokens(F.col("text"))).alias("term"))
    counted = materialize(toks.groupBy("term", "row_id").agg(F.count("term").alias("tf")), "postings")
    lengths = counted.groupBy("row_id").agg(F.sum("tf").alias("dl"))
    corpus = materialize(lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")), "corpus")
    postings = counted.where("term is not null")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.join(F.broadcast(corpus.select("n"))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    raw = materialize(raw, "terms")
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw"))
    terms = raw.join(F.broadcast(mean)).select("term", "df", idf.alias("idf"))  # one row
    return Index(postings, lengths, terms, corpus)


@dataclass
class Kinds:
    """Queries by the index terms they hold: those of equal terms and counts have equal scores, and are scored once."""

    members: DataFrame  # kind, query_ids (array)
    weights: DataFrame  # kind, no, w
    words: DataFrame  # term, no


def query_kinds(index: Index, queries: DataFrame) -> Kinds:
    """The kinds of the queries; repeated query terms count each time.  Queries without index terms are one kind."""
    number = F.monotonically_increasing_id()
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    known = materialize(asked.join(index.terms.select("term", "idf"), "term"), "asked-terms")
    words = materialize(known.select("term", "idf").distinct().withColumn("no", number), "query-words")
    lists = known.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "qtf"))).alias("terms"))
    lists = queries.select("query_id").distinct().join(lists, "query_id", "left")
    kinds = materialize(lists.groupBy("terms").agg(F.collect_list("query_id").alias("query_ids")).withColumn("kind", number), "query-kinds")
    weights = kinds.select("kind", F.inline("terms")).join(words, "term").select("kind", "no", (F.col("qtf") * F.col("idf")).alias("w"))
    return Kinds(kinds.select("kind", "query_ids"), weights, words.select("term", "no"))


def _gains(index: Index, kinds: Kinds, k1: float, b: float) -> DataFrame:
    """(row_id, gains): the terms of queries in each document that has any, array of (no, gain)."""
    wanted = index.postings.join(kinds.words, "term").select("row_id", "no", "tf")
    sized = wanted.join(index.lengths, "row_id").join(F.broadcast(index.corpus.select("avgdl")))  # one row
    tf = F.col("tf")
    gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return sized.groupBy("row_id").agg(F.collect_list(F.struct("no", gain.alias("gain"))).alias("gains"))


class _Scorer:
    """Scores of blocks of documents against all kinds of queries, from the weights sorted by term."""

    KINDS, CELLS = 1 << 16, 1 << 22  # most kinds and cells (8 bytes each) of a block of scores

    def __init__(self, kinds: np.ndarray, kind: np.ndarray, no: np.ndarray, w: np.ndarray):
        self.kinds = kinds  # numbers of the kinds; kind: places in them
        self.blocks = []
        for first in range(0, len(kinds), self.KINDS):
            own = np.flatnonzero((kind >= first) & (kind < first + self.KINDS))
            own = own[np.argsort(no[own], kind="stable")]
            terms, starts = np.unique(no[own], return_index=True)
            self.blocks.append((first, min(self.KINDS, len(kinds) - first), terms, np.append(starts, len(own)), kind[own] - first, w[own]))
        self.docs = max(16, self.CELLS // max(1, min(len(kinds), self.KINDS)))

    def scores(self, batch: pa.RecordBatch, seen: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
        """(first kind, row_ids, scores by kind and document, where a term is shared) of blocks of the batch."""
        for at in range(0, batch.num_rows, self.docs):
            part = batch.slice(at, self.docs)
            rows, lists = part.column("row_id").to_numpy(zero_copy_only=False), part.column("gains")
            flat = lists.flatten()
            doc = np.repeat(np.arange(len(rows)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            no, gain = flat.field("no").to_numpy(zero_copy_only=False), flat.field("gain").to_numpy(zero_copy_only=False)
            order = np.argsort(no, kind="stable")
            doc, gain = doc[order], gain[order]
            held, starts = np.unique(no[order], return_index=True)
            starts = np.append(starts, len(order))
            for first, size, terms, spans, kind, w in self.blocks:
                found = np.zeros((size, len(rows)))
                shared = np.zeros((size, len(rows)), bool) if seen else None
                for i, t in zip(*np.intersect1d(held, terms, assume_unique=True, return_indices=True)[1:]):
                    where = np.ix_(kind[spans[t] : spans[t + 1]], doc[starts[i] : starts[i + 1]])
                    found[where] += w[spans[t] : spans[t + 1], None] * gain[None, starts[i] : starts[i + 1]]
                    if seen:
                        shared[where] = True
                yield first, rows, found, shared


def _scorer(kinds: Kinds) -> _Scorer:
    """The weights of all kinds, on the driver: 24 bytes a term and kind of query."""
    names = kinds.members.select("kind").toArrow().column("kind").to_numpy()
    got = kinds.weights.toArrow()
    names = np.sort(names)
    return _Scorer(names, np.searchsorted(names, got.column("kind").to_numpy()), got.column("no").to_numpy(), got.column("w").to_numpy())


def _of_queries(rows: DataFrame, kinds: Kinds) -> DataFrame:
    """``rows`` of kinds for each query of the kind; this product is not shuffled (8 bytes a query are broadcast)."""
    return rows.join(F.broadcast(kinds.members), "kind").withColumn("query_id", F.explode("query_ids")).drop("kind", "query_ids")


def bm25_scores(index: Index, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, row_id, score) of every query and document that share a term; repeated query terms count each time.

    Documents meet the kinds of queries in blocks on arrays, so only postings of query terms are shuffled; the result
    itself grows with the product of queries and documents.
    """
    kinds = query_kinds(index, queries)
    shared = queries.sparkSession.sparkContext.broadcast(_scorer(kinds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in batches:
            for first, rows, found, seen in scorer.scores(batch, True):
                kind, doc = np.nonzero(seen)
                for i in range(0, len(kind), 1 << 18):
                    x, y = kind[i : i + (1 << 18)], doc[i : i + (1 << 18)]
                    yield pa.record_batch([pa.array(scorer.kinds[x + first]), pa.array(rows[y]), pa.array(found[x, y])], ["kind", "row_id", "score"])

    rows = _gains(index, kinds, k1, b).mapInArrow(score, "kind bigint, row_id bigint, score double")
    return _of_queries(rows, kinds).select("query_id", "row_id", "score")


def top_chunks(index: Index, queries: DataFrame, chunks: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, row_id, score, rank): the k best of each query, ties (at nine digits) by (index_key, pos, row_id).

    The ranking is complete: documents without a term of the query have score 0.  Each task scores a range of the
    documents in order of their place and keeps k rows of each kind of query; only those are shuffled.
    """
    place = ["index_key", "pos", "row_id"]
    kinds = query_kinds(index, queries)
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(_scorer(kinds))
    docs = chunks.select(*place).join(_gains(index, kinds, k1, b), "row_id", "left")
    docs = docs.repartitionByRange(2 * spark.sparkContext.defaultParallelism, *place).sortWithinPartitions(*place).select("row_id", "gains")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, n = shared.value, 0
        top = np.full((len(scorer.kinds), k), -np.inf)  # best first
        ids, seq = np.zeros(top.shape, np.int64), np.zeros(top.shape, np.int64)
        for batch in batches:
            last = None
            for first, rows, found, _ in scorer.scores(batch, False):
                if last is not None and first == 0:
                    n += last
                last = len(rows)
                worst = top[first : first + len(found), -1]
                # a later document of equal score stands behind the ones kept; the margin is for rounding
                for q in np.flatnonzero((found.max(axis=1, initial=-np.inf) > worst - 1e-9)):
                    s = found[q]
                    near = np.flatnonzero(s > worst[q] - 1e-9)
                    if len(near) > 8 * k and np.isneginf(worst[q]):
                        near = near[np.sort(np.argsort(-np.round(s[near], 9), kind="stable")[:k])]
                    own = first + q
                    value = np.concatenate([top[own], np.round(s[near], 9)])
                    order = np.argsort(-value, kind="stable")[:k]
                    top[own] = value[order]
                    ids[own], seq[own] = np.concatenate([ids[own], rows[near]])[order], np.concatenate([seq[own], n + near])[order]
            n += last or 0
        kind, at = np.nonzero(top > -np.inf)
        if len(kind):
            base = TaskContext.get().partitionId() << 40
            for i in range(0, len(kind), 1 << 16):
                x, y = kind[i : i + (1 << 16)], at[i : i + (1 << 16)]
                yield pa.record_batch([pa.array(scorer.kinds[x]), pa.array(ids[x, y]), pa.array(top[x, y] + 0.0), pa.array(seq[x, y] + base)], ["kind", "row_id", "score", "place"])

    found = docs.mapInArrow(best, "kind bigint, row_id bigint, score double, place bigint")
    order = W.partitionBy("kind").orderBy(F.col("score").desc(), "place")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return _of_queries(found, kinds).select("query_id", "row_id", "score", "rank")


@dataclass
class FileIndex:
    """The tables of the indexes of many files: every file is a corpus of its own, as it is searched."""

    postings: DataFrame  # index_key, term, row_id, tf
    lengths: DataFrame  # row_id, dl
    terms: DataFrame  # index_key, term, idf
    corpus: DataFrame  # index_key, n, avgdl
    places: DataFrame  # index_key, row_id, pos, chunk_id, parent_id
    vectors: DataFrame  # index_key, row_id, pos, embedding (null: 0)


def build_file_index(chunks: DataFrame, vectors: DataFrame, epsilon: float = 0.25) -> FileIndex:
    """Postings, lengths, inverse document frequencies and totals by file, and the places and vectors of the chunks.

    ``chunks``: current chunks; ``vectors``: row_id, embedding (a chunk without one scores 0).  All
    statistics come from one written table of postings; a hot file is spread by term and row.
    """
    places = chunks.select("index_key", "row_id", "pos", "chunk_id", "parent_id")
    toks = chunks.select("index_key", "row_id", F.explode_outer(tokens(F.col("text"))).alias("term"))
    counted = materialize(toks.groupBy("index_key", "term", "row_id").agg(F.count("term").alias("tf")), "file-postings")
    lengths = materialize(counted.groupBy("index_key", "row_id").agg(F.sum("tf").alias("dl")), "file-lengths")
    corpus = lengths.groupBy("index_key").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    postings = counted.where("term is not null")
    df = postings.groupBy("index_key", "term").agg(F.count(F.lit(1)).alias("df"))
    raw = materialize(df.join(corpus, "index_key").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "file-terms")
    mean = raw.groupBy("index_key").agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw"))
    terms = raw.join(mean, "index_key").select("index_key", "term", idf.alias("idf"))
    dense = places.select("index_key", "row_id", "pos").join(vectors, "row_id", "left")
    return FileIndex(postings, lengths.select("row_id", "dl"), terms, corpus, places, dense)


def file_bm25_top(index: FileIndex, searches: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, row_id, score, rank): the k best chunks of each search in its own file, ties by position.

    ``searches``: query_id, index_key, query.  A search with fewer than k hits is filled with the first chunks of its
    file at score 0, as a complete ranking of the file would hold them.
    """
    asked = searches.select("query_id", "index_key", F.explode(tokens(F.col("query"))).alias("term"))
    asked = asked.groupBy("query_id", "index_key", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weighted = asked.join(index.terms, ["index_key", "term"]).select("query_id", "index_key", "term", (F.col("qtf") * F.col("idf")).alias("w"))
    hits = index.postings.join(weighted, ["index_key", "term"]).join(index.lengths, "row_id").join(index.corpus.select("index_key", "avgdl"), "index_key")
    tf = F.col("tf")
    gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scores = hits.groupBy("query_id", "row_id").agg(F.round(F.sum(F.col("w") * gain), 9).alias("score"))
    scores = materialize(scores, "file-scores")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "pos", "row_id")
    places = index.places.select("index_key", "row_id", "pos")
    scored = scores.join(places.drop("index_key"), "row_id")
    in_file = W.partitionBy("index_key").orderBy("pos", "row_id")
    first = places.withColumn("_n", F.row_number().over(in_file)).where(F.col("_n") <= k).drop("_n")
    zeros = searches.select("query_id", "index_key").join(first, "index_key").join(scores.select("query_id", "row_id"), ["query_id", "row_id"], "left_anti")
    every = scored.select("query_id", "row_id", "pos", "score").unionByName(zeros.select("query_id", "row_id", "pos", F.lit(0.0).alias("score")))
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "row_id", "score", "rank")


def file_dense_top(index: FileIndex, searches: DataFrame, k: int) -> DataFrame:
    """(query_id, row_id, score, rank): the k greatest inner products of each search in its own file, ties by position.

    ``searches``: query_id, index_key, embedding.  The search in a file is exhaustive, as a flat index does it; only k
    rows a task and search are shuffled for the ranking.
    """
    pairs = index.vectors.join(searches.select("query_id", "index_key", F.col("embedding").alias("_q")), "index_key")
    dot = F.aggregate(F.zip_with("embedding", "_q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "pos", "row_id")
    scored = pairs.select("query_id", "row_id", "pos", F.round(F.coalesce(dot, F.lit(0.0)), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "row_id", "score", "rank")


def expand_windows(chunks: DataFrame, reach: int = 2) -> DataFrame:
    """(row_id, window_text): each chunk with its neighbours within ``reach`` positions of the same parent.

    A chunk without parent has its own text.  Neighbours meet in an equi-join on (index_key, parent, position), so a
    file that holds a third of the table is spread over its positions.
    """
    own = chunks.select("row_id", "index_key", "parent_id", "pos", "text")
    asks = own.where("parent_id is not null").select("row_id", "index_key", "parent_id", F.explode(F.expr(f"sequence(pos - {reach}, pos + {reach})")).alias("pos"))
    near = asks.join(own.drop("row_id"), ["index_key", "parent_id", "pos"])
    lines = F.array_sort(F.collect_list(F.struct("pos", "text")))  # at most 2 * reach + 1 rows
    windows = near.groupBy("row_id").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("window_text"))
    return own.select("row_id", "text").join(windows, "row_id", "left").select("row_id", F.coalesce("window_text", "text").alias("window_text"))


def parent_texts(chunks: DataFrame) -> DataFrame:
    """(index_key, parent_id, n, text): the texts of each parent's chunks in order, joined by line breaks."""
    lines = F.array_sort(F.collect_list(F.struct("pos", "text")))
    rows = chunks.where("parent_id is not null").groupBy("index_key", "parent_id")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))
