"""Queries of the retrieval operators over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry.config import DEFAULTS, Config
from docquarry.functions import text as tx
from docquarry.operators import chunking, evaluate, fusion, gates, graph, lexical, service, vector, versions
from docquarry.plans import retrieval
from docquarry.plans.reference_oracles import ORACLES  # noqa: F401
from docquarry.sources import loaders, sinks
from docquarry.sources.tables import read_table, spread
from docquarry.storage import materialize
from docquarry.streaming.limiter import hourly_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


class Tables:
    """The tables of one folder, and the rows derived from them that several queries start from."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = read_table(self.spark, self.folder, name)
        return spread(df) if name in ("chunks", "documents") else df

    @property
    def current(self) -> DataFrame:
        return lexical.current_chunks(self.chunks)

    @property
    def asked(self) -> DataFrame:
        return self.test_queries1.where("query is not null")

    @property
    def edges(self) -> DataFrame:
        return graph.clean_edges(self.graph_edges)

    @property
    def candidates(self) -> DataFrame:
        """Candidate rows of the retrieval runs, the one logged last of repeated ones, numbered in order of arrival."""
        last = W.partitionBy("run_id", "chunk_id").orderBy(F.col("logged_at").desc(), F.col("row_id").desc())
        rows = self.debug_info.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
        return rows.withColumn("cand_seq", F.row_number().over(W.partitionBy("run_id").orderBy("row_id")))

    @property
    def results(self) -> DataFrame:
        """The five best candidates of every run with their texts; the run is the query."""
        order = W.partitionBy("run_id").orderBy(F.col("final_score").desc_nulls_last(), "row_id")
        top = self.candidates.withColumn("rank", F.row_number().over(order)).where("rank <= 5")
        first = self.current.groupBy("index_key", "chunk_id").agg(F.min_by("text", F.struct("pos", "row_id")).alias("text"))
        return top.join(first.withColumnRenamed("index_key", "file_hash"), ["file_hash", "chunk_id"], "left")

    @property
    def runs(self) -> DataFrame:
        """(query_id, query, ...) of every run, the run's number standing for the query."""
        run = self.debug_info.groupBy("run_id").agg(F.min("query_id").alias("query_id"))
        return run.join(self.test_queries1, "query_id").where("query is not null").drop("query_id").withColumnRenamed("run_id", "query_id")


def _by_run(results: DataFrame) -> DataFrame:
    return results.drop("query_id").withColumnRenamed("run_id", "query_id")


# text ----------------------------------------------------------------------------------------------------------------
@query
def nfkc_norm(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).chunks.select("row_id", tx.nfkc(F.col("text")).alias("norm"))


@query
def cjk_space_collapse(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).chunks.select("row_id", tx.collapse_han_spaces(F.col("text")).alias("collapsed"))


@query
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).documents.select("doc_id", tx.clean_basic(F.col("text")).alias("clean"))


@query
def split_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = Tables(spark, d).documents.select("doc_id", tx.clean_basic(F.col("text")).alias("c"))
    return rows.select("doc_id", F.posexplode(tx.split_paragraphs(F.col("c"))).alias("k", "text")).select("doc_id", "text", F.length("text").alias("n"))


@query
def pack_sentences(spark: SparkSession, d: str) -> DataFrame:
    return tx.paragraphs(Tables(spark, d).documents, "doc_id")


@query
def normalize_for_match(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).test_queries1.select("query_id", tx.normalize_for_match(F.col("query")).alias("norm"))


@query
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).test_queries1.select("query_id", tx.normalize_text(F.col("query")).alias("norm"))


@query
def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).chunks.select("row_id", tx.tokens(F.col("text")).alias("toks"))


@query
def content_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = Tables(spark, d).test_queries1
    return rows.select("query_id", tx.content_terms(F.col("query")).alias("terms"), tx.content_terms(F.col("query"), tx.ANSWER_STOP_WORDS).alias("answer_terms"))


@query
def term_coverage(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    rows = _by_run(t.results).join(t.runs.select("query_id", "query"), "query_id").withColumn("_n", tx.normalize_text(F.col("text")))
    return rows.select("query_id", "chunk_id", F.round(tx.term_coverage(tx.content_terms(F.col("query")), F.col("_n")), 6).alias("coverage"))


@query
def keyword_enrich(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).asked.select("query_id", tx.enriched_keywords(F.col("query")).alias("keywords"))


# dedup and chunking --------------------------------------------------------------------------------------------------
@query
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return versions.exact_duplicates(Tables(spark, d).documents)


@query
def para_cap(spark: SparkSession, d: str) -> DataFrame:
    paras = tx.paragraphs(Tables(spark, d).documents, "doc_id")
    return versions.paragraph_cap(paras, "doc_id", 3).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query
def similar_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vector.similar_vectors(Tables(spark, d).embeddings, 0.35)


@query
def semantic_dedup(spark: SparkSession, d: str) -> DataFrame:
    return vector.greedy_dedup(Tables(spark, d).embeddings, 0.35)


@query
def title_predicate(spark: SparkSession, d: str) -> DataFrame:
    lines = Tables(spark, d).chunks.select("row_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.groupBy("row_id").agg(F.count_if(chunking.is_title(F.col("line"))).alias("titles"), F.count(F.lit(1)).alias("lines"))


@query
def parent_split_regex(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_by_titles(tx.paragraphs(Tables(spark, d).documents, "doc_id"), "doc_id")


def _vector_paragraphs(t: Tables) -> DataFrame:
    order = W.partitionBy("label").orderBy("vec_id")
    return t.embeddings.withColumn("para_pos", (F.row_number().over(order) - 1).cast("int"))


@query
def parent_split_semantic(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.similarity_breaks(_vector_paragraphs(Tables(spark, d)), "label")
    return rows.select("label", "para_pos", F.round("similarity", 6).alias("similarity"), "parent_pos")


@query
def parent_split_even(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_evenly(tx.paragraphs(Tables(spark, d).documents, "doc_id"), "doc_id")


@query
def parent_strategy(spark: SparkSession, d: str) -> DataFrame:
    paras = tx.paragraphs(Tables(spark, d).documents, "doc_id")
    return chunking.choose_split(chunking.split_by_titles(paras, "doc_id"), chunking.split_evenly(paras, "doc_id"), "doc_id")


@query
def char_windows(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.chunk_documents(Tables(spark, d).documents)


@query
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunking.token_windows(chunking.split_by_titles(tx.paragraphs(Tables(spark, d).documents, "doc_id"), "doc_id"), "doc_id")


@query
def parent_children(spark: SparkSession, d: str) -> DataFrame:
    return chunking.parent_children(Tables(spark, d).current)


@query
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_statistics(Tables(spark, d).current)


@query
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.corpus_statistics(Tables(spark, d).current)


# lexical and vector --------------------------------------------------------------------------------------------------
@query
def current_chunks(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).current.select("row_id", "index_key", "pos", "chunk_id")


@query
def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    return lexical.build_index(Tables(spark, d).current).postings


@query
def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    return lexical.build_index(Tables(spark, d).current).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def _ranked(t: Tables, k: int) -> DataFrame:
    return lexical.top_chunks(lexical.build_index(t.current), t.asked, t.current, k)


@query
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return lexical.bm25_scores(lexical.build_index(t.current), t.asked).withColumn("score", F.round("score", 6))


@query
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(Tables(spark, d), 5).withColumn("score", F.round("score", 6))


@query
def window_expand(spark: SparkSession, d: str) -> DataFrame:
    return lexical.expand_windows(Tables(spark, d).current)


@query
def parent_text(spark: SparkSession, d: str) -> DataFrame:
    return lexical.parent_texts(Tables(spark, d).current)


@query
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    rows = vector.hash_embedding(Tables(spark, d).current, "row_id")
    return rows.withColumn("weight", F.round("weight", 6))


@query
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = Tables(spark, d).embeddings
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.vector_topk(vectors, asked, 5).withColumn("score", F.round("score", 5))


# graph ---------------------------------------------------------------------------------------------------------------
@query
def rule_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.rule_entities(Tables(spark, d).current).select("row_id", "ord", "label", "type")


@query
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.register_nodes(graph.rule_entities(Tables(spark, d).current))


@query
def graph_mentions(spark: SparkSession, d: str) -> DataFrame:
    entities = graph.rule_entities(Tables(spark, d).current)
    return graph.register_mentions(entities, graph.register_nodes(entities)).groupBy("index_key", "node_id").agg(F.count(F.lit(1)).alias("chunks"))


@query
def graph_edge_defaults(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).edges


@query
def graph_edges_registered(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    order = F.regexp_extract("id", "([0-9]+)$", 1).cast("int")
    nodes = t.semantic_graph.where("label is not null").groupBy("index_key", "label").agg(F.min(F.struct(order.alias("o"), "id")).alias("f"))
    nodes = nodes.select("index_key", "label", F.col("f.id").alias("node_id"), F.col("f.o").alias("first_pos"))
    names = t.semantic_graph.select("index_key", "id", "label")
    a, b = names.toDF("index_key", "src", "from_label"), names.toDF("index_key", "dst", "to_label")
    relations = t.graph_edges.join(a, ["index_key", "src"]).join(b, ["index_key", "dst"]).withColumn("pos", F.col("edge_pos"))
    return graph.register_edges(relations, nodes)


@query
def query_entities(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return graph.label_matches(t.asked, t.semantic_graph)


@query
def multi_hop(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return graph.multi_hop(t.asked, t.semantic_graph, t.edges).withColumn("score", F.round("score", 6))


@query
def entity_recall(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return graph.entity_recall(t.asked, t.semantic_graph, t.entity_chunks, t.current)


@query
def entity_recall_quotas(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return graph.recall_under_quotas(t.asked, t.semantic_graph, t.entity_chunks, t.current)


@query
def neighbor_expand(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return graph.neighbour_labels(t.asked, t.semantic_graph, t.edges)


@query
def synonym_expand(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    # synonyms of a label: the other labels of the node's type in the same file that start alike
    names = t.semantic_graph.where("length(label) >= 2").select("label").distinct()
    words = names.select("label", F.lower("label").alias("word")).union(names.select("label", F.upper("label"))).where("word <> label")
    return graph.expand_query(t.asked, t.semantic_graph, words)


@query
def chunk_labels(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return graph.chunk_labels(t.semantic_graph, t.entity_chunks)


@query
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return graph.graph_summary(t.semantic_graph, t.edges, t.entity_chunks)


# fusion --------------------------------------------------------------------------------------------------------------
@query
def hybrid_candidates(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    ranked = lambda c: W.partitionBy("run_id").orderBy(F.col(c).desc_nulls_last(), "row_id")
    side = lambda c: t.candidates.where(f"{c} > 0").select(F.col("run_id").alias("query_id"), "chunk_id", F.col(c).alias("score"), F.row_number().over(ranked(c)).alias("rank")).where("rank <= 10")
    return fusion.unite_candidates(side("bm25_score"), side("vector_score"))


@query
def candidate_cap(spark: SparkSession, d: str) -> DataFrame:
    return fusion.cap_candidates(Tables(spark, d).candidates, 20, "run_id").select("run_id", "row_id", "cand_seq")


@query
def minmax_norm(spark: SparkSession, d: str) -> DataFrame:
    rows = Tables(spark, d).candidates
    return rows.select("run_id", "row_id", F.round(fusion.min_max(F.col("bm25_score"), "run_id"), 6).alias("bm25"), F.round(fusion.min_max(F.col("vector_score"), "run_id"), 6).alias("vector"))


@query
def fuse_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = Tables(spark, d).candidates.drop("norm_bm25", "norm_vector", "base_score", "final_score", "evidence_type")
    fused = fusion.fuse(rows, "run_id")
    return fused.select("run_id", "row_id", F.round("base_score", 6).alias("base_score"), F.round("final_score", 6).alias("final_score"), "evidence_type")


@query
def fused_top(spark: SparkSession, d: str) -> DataFrame:
    rows = Tables(spark, d).candidates.drop("norm_bm25", "norm_vector", "base_score", "final_score", "evidence_type")
    fused = fusion.fuse(rows, "run_id").withColumn("final_score", F.round("final_score", 9))
    return fusion.final_top(fused, 5, "run_id").select("run_id", "row_id", "rank")


@query
def evidence_type(spark: SparkSession, d: str) -> DataFrame:
    kind = fusion.evidence_type(F.col("bm25_score"), F.col("vector_score"), F.col("graph_boost"))
    return Tables(spark, d).debug_info.select("row_id", kind.alias("kind"))


@query
def rank_delta(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rank_changes(Tables(spark, d).candidates).withColumn("graph_lift", F.round("graph_lift", 6))


@query
def safe_rerank(spark: SparkSession, d: str) -> DataFrame:
    rows = Tables(spark, d).candidates.drop("query_id", "rerank_score", "rerank_used").withColumnRenamed("run_id", "query_id")
    return fusion.rerank(rows).select("query_id", "row_id", "rank", "rerank_score", "rerank_used")


def _hybrid(t: Tables, config: Config = DEFAULTS) -> DataFrame:
    """Every recorded run searched anew: its query in its file."""
    searches = t.debug_info.groupBy("run_id").agg(F.min("query_id").alias("asked"), F.min("file_hash").alias("index_key"))
    searches = searches.join(t.asked.select(F.col("query_id").alias("asked"), "query"), "asked").select(F.col("run_id").alias("query_id"), "index_key", "query")
    searches = materialize(searches, "searches")
    chunks = materialize(t.current.join(searches.select("index_key").distinct(), "index_key", "left_semi"), "searched")
    names = t.semantic_graph.where("length(label) >= 2").select("label").distinct()
    words = names.select("label", F.lower("label").alias("word")).union(names.select("label", F.upper("label"))).where("word <> label")
    found = retrieval.hybrid_topk(searches, retrieval.file_index(chunks, config=config), t.semantic_graph, t.edges, t.entity_chunks, words, config=config)
    return retrieval.with_context(found, chunks)


@query
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = _hybrid(Tables(spark, d))
    return rows.select(
        "query_id", "rank", "chunk_id", "parent_id", F.round("bm25_score", 6).alias("bm25_score"), F.round("vector_score", 6).alias("vector_score"), F.round("final_score", 6).alias("final_score"),
        "graph_boost", "graph_fallback_used", "evidence_type", F.md5("text").alias("text_md5"), F.md5("chunk_text").alias("chunk_md5"),
    )


# gates ---------------------------------------------------------------------------------------------------------------
@query
def gate_sufficiency(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return gates.sufficiency_gate(t.runs.select("query_id", "query"), _by_run(t.results))


@query
def gate_confidence(spark: SparkSession, d: str) -> DataFrame:
    return gates.confidence_gate(Tables(spark, d).results)


@query
def query_facets(spark: SparkSession, d: str) -> DataFrame:
    return gates.query_facets(Tables(spark, d).asked)


@query
def evidence_windows(spark: SparkSession, d: str) -> DataFrame:
    return gates.evidence_windows(Tables(spark, d).current)


@query
def gate_direct(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return gates.direct_gate(t.runs.select("query_id", "query"), _by_run(t.results))


@query
def finance_claims(spark: SparkSession, d: str) -> DataFrame:
    rows = Tables(spark, d).current
    return rows.select("row_id", gates.finance_claims(F.col("text")).alias("c")).select("row_id", "c.*")


def _answers(t: Tables) -> DataFrame:
    """A first-passage answer for every run: the text in first place, or a refusal where none is."""
    context = service.concat_context(_by_run(t.results), "query_id", 600)
    first = _by_run(t.results).where("rank = 1").select("query_id", F.col("text").alias("first"))
    rows = t.runs.join(context, "query_id", "left").join(first, "query_id", "left")
    return rows.withColumn("answer", F.coalesce("first", F.lit(gates.REFUSAL))).withColumn("context", F.coalesce("context", F.lit("")))


@query
def claim_support(spark: SparkSession, d: str) -> DataFrame:
    rows = _answers(Tables(spark, d)).withColumn("_n", tx.normalize_text(F.col("context")))
    return rows.select("query_id", gates.unsupported_claims(F.col("answer"), F.col("_n")).alias("unsupported"))


@query
def answer_support(spark: SparkSession, d: str) -> DataFrame:
    rows = _answers(Tables(spark, d)).withColumn("_n", tx.normalize_text(F.col("answer")))
    return rows.select("query_id", gates.answer_supported(tx.content_terms(F.col("query")), F.col("answer"), F.col("_n")).alias("supported"))


@query
def refusal_detect(spark: SparkSession, d: str) -> DataFrame:
    return _answers(Tables(spark, d)).select("query_id", gates.is_refusal(F.col("answer")).alias("refused"))


@query
def answer_decision(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    results = materialize(_by_run(t.results), "results")
    # queries that no run has searched stand for searches without results
    idle = t.asked.join(t.debug_info.select("query_id").distinct(), "query_id", "left_anti").select((-1 - F.col("query_id")).alias("query_id"), "query")
    asked = materialize(t.runs.select("query_id", "query").unionByName(idle), "asked")
    answers = _answers(t).select("query_id", "context", F.col("answer").alias("raw_answer"))
    rows = asked.join(answers, "query_id", "left").select("query_id", "query", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("raw_answer", F.lit(gates.REFUSAL)).alias("raw_answer"))
    rows = materialize(rows, "answers")
    passed = lambda df, name: df.select("query_id", F.col("passed").alias(name))
    rows = rows.join(passed(gates.sufficiency_gate(asked, results), "sufficient"), "query_id")
    rows = rows.join(passed(gates.confidence_gate(results, "query_id", queries=asked), "confident"), "query_id")
    rows = rows.join(passed(gates.direct_gate(asked, results), "direct"), "query_id").withColumn("results_given", F.lit(True))
    return gates.decide_answers(rows).select("query_id", "step", F.md5("answer").alias("answer_md5"))


@query
def clean_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = Tables(spark, d).asked
    raw = F.to_json(F.struct(F.col("has_answer_in_doc").alias("answerable"), F.col("query").alias("answer")))
    return rows.select("query_id", gates.clean_answer(raw).alias("answer"))


@query
def prompt_text(spark: SparkSession, d: str) -> DataFrame:
    return _answers(Tables(spark, d)).select("query_id", gates.prompt_text(F.col("query"), F.col("context")).alias("prompt"))


# evaluation ----------------------------------------------------------------------------------------------------------
@query
def retrieval_eval_detail(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return evaluate.first_hits(t.runs, _by_run(t.results)).select("query_id", F.coalesce("hit_rank", F.lit(0)).alias("hit_rank"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query
def retrieval_eval(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    report = evaluate.retrieval_report(t.runs, evaluate.first_hits(t.runs, _by_run(t.results)))
    return report.withColumns({c: F.round(c, 6) for c in ("recall_at_k", "mrr", "answer_recall")})


@query
def generation_eval_detail(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluate.generation_details(_answers(Tables(spark, d)))
    return rows.select("query_id", "refused", F.coalesce(F.col("faithful").cast("int"), F.lit(-1)).alias("faithful"), "matched_points", F.round("match_rate", 6).alias("match_rate"))


@query
def generation_eval(spark: SparkSession, d: str) -> DataFrame:
    report = evaluate.generation_report(evaluate.generation_details(_answers(Tables(spark, d))))
    return report.withColumns({c: F.round(c, 6) for c in report.columns if c not in ("total", "refusals")})


@query
def full_report(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    found = evaluate.retrieval_report(t.runs, evaluate.first_hits(t.runs, _by_run(t.results)))
    report = evaluate.full_report(found, evaluate.generation_report(evaluate.generation_details(_answers(t))))
    return report.withColumn("value", F.round("value", 6))


@query
def tune_topk(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    rows = evaluate.sweep_depths(t.runs, _by_run(t.results), [1, 2, 3, 5, 5])
    return rows.withColumns({c: F.round(c, 6) for c in ("recall", "mrr")})


# versions and service ------------------------------------------------------------------------------------------------
@query
def distinct_versions(spark: SparkSession, d: str) -> DataFrame:
    return versions.distinct_versions(Tables(spark, d).version_log).select("version_id", "file_name", "hash", "ts")


@query
def version_asof(spark: SparkSession, d: str) -> DataFrame:
    log = versions.distinct_versions(Tables(spark, d).version_log)
    targets = log.groupBy("file_name").agg(F.max("ts").alias("last")).select("file_name", (F.col("last") - F.expr("interval 30 days")).alias("target"))
    return versions.version_as_of(log, targets)


@query
def version_retention(spark: SparkSession, d: str) -> DataFrame:
    log = versions.distinct_versions(Tables(spark, d).version_log)
    return versions.expired_versions(log, F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"), 7)


@query
def hash_upsert(spark: SparkSession, d: str) -> DataFrame:
    log = Tables(spark, d).version_log
    first = log.where("file_name is not null and hash is not null").groupBy("file_name").agg(F.min_by("hash", F.struct("ts", "version_id")).alias("hash"))
    known = first.select("hash").distinct()
    return versions.insert_new(known, log.select("hash"))


@query
def rebuild_decision(spark: SparkSession, d: str) -> DataFrame:
    log = Tables(spark, d).version_log
    here = [log.select(F.col("hash").alias("index_key"), F.lit(p).alias("part"), F.col(c).isNotNull().alias("present")) for p, c in (("chunks", "index_path"), ("postings", "bm25_path"), ("graph", "graph_path"))]
    parts = here[0].union(here[1]).union(here[2]).union(log.select(F.col("hash"), F.lit("vectors"), F.col("index_path").isNotNull()))
    return versions.rebuild_decisions(log, sinks.manifest(parts.where("index_key is not null")).withColumnRenamed("index_key", "hash"))


@query
def parse_request(spark: SparkSession, d: str) -> DataFrame:
    rows = Tables(spark, d).test_queries1
    extra = F.element_at(F.array(*map(F.lit, ["", ', "max_tokens": 0', ', "max_tokens": "12", "top_k": -3', ', "top_k": "z", "model": "m"', ', "max_tokens": 1001', ', "max_tokens": "x"', ', "model": 7'])), (F.col("query_id") % 7 + 1).cast("int"))
    quoted = F.concat(F.lit('"'), F.replace("query", F.lit('"'), F.lit(" ")), F.lit('"'))
    body = F.concat(F.lit('{"query": '), F.coalesce(quoted, F.lit("null")), extra, F.lit("}"))
    return service.parse_requests(rows.select(F.col("query_id").alias("request_id"), body.alias("payload"))).na.fill(0, ["max_tokens", "top_k", "error_code"])


@query
def context_concat(spark: SparkSession, d: str) -> DataFrame:
    return service.concat_context(_by_run(Tables(spark, d).results), "query_id", 600)


@query
def response_shape(spark: SparkSession, d: str) -> DataFrame:
    rows = context_concat(spark, d).withColumn("r", service.response_json(F.col("context"), F.col("chunk_ids"), F.lit(None).cast("string")))
    return rows.select("query_id", service.gateway_view(F.col("r")).alias("v")).select("query_id", F.md5("v.answer").alias("answer_md5"), F.col("v.n_context").alias("n_context"))


@query
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return service.rate_limit(Tables(spark, d).events, limit=5, window_seconds=6 * 3600.0)


@query
def hourly_requests(spark: SparkSession, d: str) -> DataFrame:
    return hourly_counts(Tables(spark, d).events).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


# sources and sinks ---------------------------------------------------------------------------------------------------
@query
def page_join(spark: SparkSession, d: str) -> DataFrame:
    pages = Tables(spark, d).current.select("index_key", (F.col("pos") + 1).alias("page"), "text", (F.col("pos") % 3).cast("int").alias("n_images"))
    return loaders.join_pages(pages)


@query
def short_text_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = Tables(spark, d).chunks.select("row_id", loaders.short_text_fallback(F.col("text"), F.col("chunk_id"), 150).alias("r"))
    return rows.select("row_id", "r.text", "r.rejected")


@query
def html_text(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("<html><script>x=1<2</script><p>"), F.replace("text", F.lit("\n"), F.lit("<br/>")), F.lit("</p>&amp;<b>end</b></html>"))
    return Tables(spark, d).documents.select("doc_id", loaders.html_text(page).alias("text"))


@query
def graph_export(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    rows = sinks.graph_json(t.semantic_graph, t.edges, t.entity_chunks)
    kind = "nodes array<struct<id:string,label:string,type:string,attrs:map<string,string>>>, edges array<struct<from:string,to:string,relation:string,weight:int>>, entity_chunks map<string,array<string>>"
    rows = materialize(rows.select("index_key", F.from_json("graph", kind).alias("g")), "graphs")
    none = F.lit(None)
    nodes = rows.select("index_key", F.explode("g.nodes").alias("x")).select("index_key", F.lit("node").alias("part"), "x.id", F.col("x.label").alias("a"), F.col("x.type").alias("b"), F.coalesce(F.size("x.attrs"), F.lit(-1)).alias("n"))
    edges = rows.select("index_key", F.explode("g.edges").alias("x")).select("index_key", F.lit("edge").alias("part"), F.col("x.from").alias("id"), F.col("x.to").alias("a"), F.col("x.relation").alias("b"), F.col("x.weight").alias("n"))
    links = rows.select("index_key", F.explode("g.entity_chunks").alias("id", "ids")).select("index_key", F.lit("mention").alias("part"), "id", F.explode("ids").alias("a"), none.cast("string").alias("b"), F.lit(0).alias("n"))
    return nodes.unionByName(edges).unionByName(links)
