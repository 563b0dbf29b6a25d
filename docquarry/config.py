"""Parameters of the retrieval pipeline with their defaults, overridable by environment or Spark settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    """All knobs of chunking, retrieval, graph recall, gates and retention."""

    chunk_size: int = 220
    chunk_overlap: int = 50
    max_sentence_chars: int = 200
    max_paragraphs: int = 2000
    semantic_threshold: float | None = None
    min_parent_count: int | None = None
    dedup_similarity: float = 0.85
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    bm25_weight: float = 0.7
    vector_weight: float = 0.3
    candidate_top_k: int = 50
    rerank_top_k: int = 50
    final_top_k: int = 5
    graph_hop_depth: int = 2
    graph_boost: float = 0.3
    graph_max_chunks_per_entity: int = 3
    graph_max_chunks_per_parent: int = 2
    min_query_coverage: float = 0.30
    min_answer_coverage: float = 0.50
    min_context_chars: int = 80
    min_confidence: float = 0.35
    min_top1_rerank: float = -3.0
    min_top1_final: float = 0.05
    max_related_ratio: float = 0.80
    direct_coverage: float = 0.35
    direct_hits: int = 2
    direct_window_chars: int = 420
    enforce_answerability: bool = True
    direct_gate: bool = True
    uncertain_policy: str = "warn"
    high_risk: bool = False
    domain_profile: str = "general"
    retention_days: int = 7
    rate_limit: int = 5
    rate_window_seconds: float = 1.0


def _parsed(kind: str, raw: str) -> object:
    if kind.startswith("bool"):
        return raw.strip().lower() in {"1", "true", "yes", "on"}
    if kind.startswith("int"):
        return int(raw)
    if kind.startswith("float"):
        return float(raw)
    return raw


def load_config(spark: SparkSession | None = None) -> Config:
    """Defaults, overridden by DOCQUARRY_<NAME> in the environment, then by spark.docquarry.<name>."""
    found: dict[str, object] = {}
    for f in fields(Config):
        raw = os.environ.get("DOCQUARRY_" + f.name.upper())
        if spark is not None:
            raw = spark.conf.get(f"spark.docquarry.{f.name}", raw)
        if raw is not None:
            found[f.name] = _parsed(str(f.type), raw)
    return replace(Config(), **found)


DEFAULTS = Config()
