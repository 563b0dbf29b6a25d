"""Whole retrieval plans: from raw documents to chunks, and from queries to fused results."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.config import DEFAULTS, Config
from docquarry.functions.text import paragraphs
from docquarry.operators import chunking, evaluate, fusion, graph, lexical, vector
from docquarry.storage import materialize


def chunk_documents(docs: DataFrame, key: str = "doc_id", config: Config = DEFAULTS) -> DataFrame:
    """(key, parent_pos, parent_id, child_pos, chunk_id, text): documents cleaned, split by titles and windowed."""
    paras = paragraphs(docs, key, most=config.max_sentence_chars).where(F.col("para_pos") < config.max_paragraphs)
    return chunking.char_windows(chunking.split_by_titles(paras, key), key, config.chunk_size, config.chunk_overlap)


Embedder = Callable[[DataFrame, str, str], DataFrame]  # (rows, key column, text column) -> key, embedding


def file_index(chunks: DataFrame, embed: Embedder = vector.dense_embedding, config: Config = DEFAULTS) -> lexical.FileIndex:
    """The index that hybrid_topk searches, of current chunks; see sinks.write_index for saving it."""
    return lexical.build_file_index(chunks, materialize(embed(chunks.select("row_id", "text"), "row_id", "text"), "vectors"), config.bm25_epsilon)


def expanded_searches(searches: DataFrame, nodes: DataFrame, edges: DataFrame, synonyms: DataFrame | None, config: Config = DEFAULTS) -> DataFrame:
    """The searches with their query expanded by the labels within graph_hop_depth hops and by synonyms of its labels.

    Terms that the query holds already are left out, repeated ones count once; the order of terms is alphabetical.
    """
    hops = graph.multi_hop(searches, nodes, edges, config.graph_hop_depth)
    words = None if hops is None else hops.select("query_id", F.col("label").alias("word"))
    if synonyms is not None:
        more = graph.label_matches(searches, nodes).join(synonyms, "label").select("query_id", "word")
        words = more if words is None else words.unionByName(more)
    if words is None:
        return searches
    fresh = words.distinct().join(searches.select("query_id", "query"), "query_id").where("word <> '' and not contains(query, word)")
    joined = fresh.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("word")), " ").alias("_words"))
    return searches.join(joined, "query_id", "left").withColumn("query", F.concat_ws(" ", "query", "_words")).drop("_words")


def hybrid_topk(
    searches: DataFrame, index: lexical.FileIndex, nodes: DataFrame, edges: DataFrame, mentions: DataFrame,
    synonyms: DataFrame | None = None, embed: Embedder = vector.dense_embedding, config: Config = DEFAULTS,
) -> DataFrame:
    """(query_id, rank, chunk_id, parent_id, scores, graph_boost, graph_fallback_used, evidence_type) of every search.

    ``searches``: query_id (one a search), index_key (the file searched), query.  BM25 gets the expanded query, the
    dense search the query as asked; both give their candidate_top_k best of the file, a chunk outside the dense ones
    has vector score 0.  Chunks recalled by the graph under its quotas are boosted, and appended where they are new.
    The first 50 candidates in order of arrival are scaled, weighted and ranked; ties keep the order of arrival.
    ``graph_fallback_used`` tells that the file has no graph.
    """
    asked = searches.select("query_id", "index_key", "query")
    wide = materialize(expanded_searches(asked, nodes, edges, synonyms, config), "expanded")
    lexical_hits = lexical.file_bm25_top(index, wide, config.candidate_top_k, config.bm25_k1, config.bm25_b)
    own = asked.join(embed(asked, "query_id", "query"), "query_id", "left")
    dense_hits = lexical.file_dense_top(index, own, config.candidate_top_k)
    # copies of one chunk within a file share its id, and stand where the first of them stands
    named = index.places.select("row_id", "chunk_id")
    once = lambda hits: hits.join(named, "row_id").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
    candidates = fusion.unite_candidates(once(lexical_hits), once(dense_hits))
    recalled = graph.recall_with_quotas(
        graph.entity_recall(asked, nodes, mentions, index.places), config.graph_max_chunks_per_entity, config.graph_max_chunks_per_parent
    )
    candidates = fusion.add_graph_hits(candidates, recalled.select("query_id", "chunk_id", "seq"))
    kept = materialize(fusion.cap_candidates(candidates), "candidates")
    fused = fusion.fuse(kept, weights=(config.bm25_weight, config.vector_weight), boost=config.graph_boost)
    fused = fused.withColumn("final_score", F.round("final_score", 9)).join(asked.select("query_id", "index_key"), "query_id")
    top = fusion.final_top(fused, config.final_top_k)
    parents = index.places.groupBy("index_key", "chunk_id").agg(F.max_by("parent_id", F.struct("pos", "row_id")).alias("parent_id"), F.min_by("row_id", F.struct("pos", "row_id")).alias("row_id"))
    graphs = nodes.select("index_key").union(mentions.select("index_key")).distinct().withColumn("_graph", F.lit(True))
    return top.join(parents, ["index_key", "chunk_id"]).join(graphs, "index_key", "left").withColumn("graph_fallback_used", F.col("_graph").isNull()).drop("_graph")


def with_context(results: DataFrame, chunks: DataFrame, reach: int = 2) -> DataFrame:
    """``results`` (with row_id) with chunk_text, and text: the chunk with its neighbours of the same parent."""
    files = chunks.join(results.select(F.col("index_key")).distinct(), "index_key", "left_semi")
    windows = lexical.expand_windows(files, reach).join(files.select("row_id", F.col("text").alias("chunk_text")), "row_id")
    return results.join(windows.withColumnRenamed("window_text", "text"), "row_id")


def tuned_depths(
    queries: DataFrame, searches: DataFrame, chunks: DataFrame, index: lexical.FileIndex, nodes: DataFrame, edges: DataFrame, mentions: DataFrame,
    depths: list[int], synonyms: DataFrame | None = None, embed: Embedder = vector.dense_embedding, config: Config = DEFAULTS,
) -> list[dict]:
    """One report for each candidate depth, of searches run anew at that depth, with seconds; the best one is marked.

    ``queries``: query_id, expected_keywords, has_answer_in_doc of the searches.  Best is the greatest recall, then the
    greatest mean reciprocal rank, then the shortest time.
    """
    reports = []
    for depth in depths:
        began = time.perf_counter()
        found = hybrid_topk(searches, index, nodes, edges, mentions, synonyms, embed, replace(config, candidate_top_k=depth))
        hits = evaluate.first_hits(queries, with_context(found, chunks).select("query_id", "rank", F.col("chunk_text").alias("text")), config.final_top_k)
        row = evaluate.retrieval_report(queries, hits).first().asDict()
        took = time.perf_counter() - began
        reports.append({"candidate_top_k": depth, "final_top_k": config.final_top_k, **row, "elapsed_seconds": round(took, 3), "avg_ms_per_query": round(1000 * took / max(1, row["total_queries"]), 2)})
    best = max(reports, key=lambda r: (r["recall_at_k"], r["mrr"], -r["avg_ms_per_query"]), default=None)
    return [r | {"is_best": r is best} for r in reports]
