"""Queries of the training-data operators over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import leaks, mixing, name_links, near_copies, print_forms, ranking, scan_noise, spam_pages
from docquarry.sources.tables import read_table, spread

Query = Callable[[SparkSession, str], DataFrame]


def _texts(spark: SparkSession, d: str) -> DataFrame:
    chunks = spread(read_table(spark, d, "chunks").select("row_id", "text"))
    asked = read_table(spark, d, "test_queries1")
    return print_forms.keyed_texts({"chunks": (chunks, "row_id", "text"), "test_queries1": (asked, "query_id", "query")})


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "chunks").select("row_id", "text"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "documents").select("doc_id", "source", "text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return print_forms.look_alike_pairs(_texts(spark, d))


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("src", "key", print_forms.canonical_text(F.col("text")).alias("form"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.copy_pairs(near_copies.copy_groups(_chunks(spark, d)))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.copy_groups(_chunks(spark, d))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "semantic_graph").select("node_key", "label", "type"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return name_links.entity_pairs(name_links.entity_links(_nodes(spark, d)))


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    return name_links.entity_links(_nodes(spark, d))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "chunks").select("row_id", "index_key", "text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.noise_kinds(_pages(spark, d))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.repaired_texts(_pages(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_ranking(spark, d).where("place = 1").select("run_id", "chunk_id")


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranking.fused_ranking(read_table(spark, d, "debug_info"))
    return ranked.select("run_id", "chunk_id", F.round("fused", 9).alias("fused"), "place")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_shares(spark, d).select("doc_id", "item_id").distinct()


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(_documents(spark, d).select("doc_id", "text"), read_table(spark, d, "eval_items"))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    size = mixing.token_counter()(F.col("text"))
    return mixing.mixture(_documents(spark, d), read_table(spark, d, "source_weights"), size)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


def p7_grants_chars(spark: SparkSession, d: str) -> DataFrame:
    sizes = read_table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("size"))
    granted = mixing.grant_tokens(sizes, read_table(spark, d, "source_weights"))
    return granted.select("source", "max_repeat", "size", "capped", F.round("granted", 3).alias("granted"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam_pages.spam_pages(_documents(spark, d))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return spam_pages.spam_shares(_documents(spark, d))


_RANKED = """
with once as (
  select run_id, chunk_id, bm25_score, vector_score, rerank_score, final_score from (
    select *, row_number() over (partition by run_id, chunk_id order by logged_at desc, bm25_score desc nulls last,
      vector_score desc nulls last, rerank_score desc nulls last, final_score desc nulls last) rn from debug_info
    where run_id is not null and chunk_id is not null) where rn = 1),
ranks as (
  select *, rank() over (partition by run_id order by bm25_score desc nulls last) r0,
    rank() over (partition by run_id order by vector_score desc nulls last) r1,
    rank() over (partition by run_id order by rerank_score desc nulls last) r2,
    rank() over (partition by run_id order by final_score desc nulls last) r3 from once),
fused as (select *, 0.0::double + 1.0::double/(60+r0) + 1.0::double/(60+r1) + 1.0::double/(60+r2) + 1.0::double/(60+r3) fused from ranks),
ranked as (select run_id, chunk_id, round(fused, 9) fused, cast(row_number() over (partition by run_id order by fused desc,
  bm25_score desc nulls last, vector_score desc nulls last, rerank_score desc nulls last, final_score desc nulls last,
  chunk_id) as integer) place from fused)
"""

ORACLES = {
    "p5_found": _RANKED + "select run_id, chunk_id from ranked where place = 1",
    "p5_ranking": _RANKED + "select run_id, chunk_id, fused, place from ranked",
    "p7_grants_chars": """
with recursive wanted as (
  select w.source, w.target_share / sum(w.target_share) over () share, w.max_repeat,
    cast(coalesce(s.size, 0) as bigint) size, coalesce(s.size, 0) * w.max_repeat::double most
  from source_weights w left join (select source, sum(n_chars) size from documents group by source) s on w.source = s.source),
total as (select sum(n_chars)::double total from documents where source is not null),
fill as (
  select 0 step, []::varchar[] capped, (select total from total) left_over, 1.0::double open_share
  union all
  select step + 1, list_concat(capped, new), left_over - lost, open_share - gone from (
    select f.step, f.capped, f.left_over, f.open_share,
      (select coalesce(list(source), []) from wanted w where not list_contains(f.capped, w.source) and most <= left_over / open_share * share) new,
      (select coalesce(sum(most), 0) from wanted w where not list_contains(f.capped, w.source) and most <= left_over / open_share * share) lost,
      (select coalesce(sum(share), 0) from wanted w where not list_contains(f.capped, w.source) and most <= left_over / open_share * share) gone
    from fill f where step < 20) where len(new) > 0),
last as (select * from fill order by step desc limit 1)
select w.source, w.max_repeat, w.size, list_contains(l.capped, w.source) capped,
  round(case when list_contains(l.capped, w.source) then most else l.left_over / l.open_share * share end, 3) granted
from wanted w cross join last l
""",
}

QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        p1_found, p1_canonical, p2_found, p2_groups, p3_found, p3_entities, p4_found, p4_repaired, p5_found, p5_ranking, p6_found, p6_shares,
        p7_mix, p7_shares, p7_grants_chars, p8_found, p8_shares,
    )
}
