"""DuckDB SQL of the retrieval queries, over whole tables."""

from __future__ import annotations

from docquarry.functions.text import ANSWER_STOP_WORDS, KEYWORD_STOP_WORDS, SYNONYMS
from docquarry.operators.gates import ASPECTS, COMPARISON, FILLER, METRICS, OBJECTS, REFUSALS, WARNING
from docquarry.operators.graph import TECH_TERMS
from docquarry.plans import sql_text as q

CAND = """cand as (select *, row_number() over (partition by run_id order by row_id)::int cand_seq from (
  select *, row_number() over (partition by run_id, chunk_id order by logged_at desc, row_id desc) rn from debug_info) where rn = 1)"""
RESULTS = f"""{q.CURRENT}, {CAND},
firsts as (select index_key, chunk_id, arg_min(text, (pos, row_id)) as text from cur group by all),
results as (select t.* exclude (query_id, rn), run_id query_id, f.text from (select *, row_number() over (partition by run_id order by final_score desc nulls last, row_id)::int rank from cand) t
  left join firsts f on f.index_key = t.file_hash and f.chunk_id = t.chunk_id where rank <= 5),
runs as (select r.run_id query_id, query, expected_keywords, has_answer_in_doc, answer_key_points from (select run_id, min(query_id) qid from debug_info group by 1) r
  join test_queries1 t on t.query_id = r.qid where query is not null)"""
EDGES = "edges as (select distinct index_key, edge_pos, src, dst, coalesce(nullif(trim(relation), ''), 'related_to') relation, coalesce(weight, 1) weight from graph_edges where src <> '' and dst <> '')"
IDLE = """runs as (select * from runs0 union all select -1 - query_id, query, expected_keywords, has_answer_in_doc, answer_key_points from test_queries1
  where query is not null and query_id not in (select query_id from debug_info where query_id is not null))"""
MATCHED = f"{q.ASKED}, matched as (select distinct a.query_id, n.index_key, n.id, n.label from asked a join semantic_graph n on length(n.label) >= 2 and contains(a.query, n.label))"
ENTITIES = f"""{q.CURRENT},
ents0 as (select row_id, index_key, pos, chunk_id, {q.distinct_in_order(f"list_concat(list_filter({q.words(TECH_TERMS)}, lambda t: contains(lower(text), lower(t))), list_filter({q.tokens('text')}, lambda t: length(t) >= 2 and regexp_matches(t, '[a-zA-Z\\x{{4e00}}-\\x{{9fff}}]')))")} l from cur),
ents as (select row_id, index_key, pos, chunk_id, (generate_subscripts(l, 1) - 1)::int ord, unnest(l) label, 'CONCEPT' as type from ents0)"""
NODES = ENTITIES + """,
firsts as (select index_key, trim(label) label, min((pos, ord, row_id)) f from ents where trim(label) <> '' group by all),
nodes as (select index_key, format('e_{:03d}', row_number() over (partition by index_key order by f, label)) node_id, label, 'CONCEPT' as type, f[1] first_pos from firsts)"""
RUN_SCORES = CAND + """,
norm as (select *, coalesce(bm25_score, 0) b, coalesce(vector_score, 0) v from cand),
scaled as (select *, case when max(b) over w > min(b) over w then (b - min(b) over w) / (max(b) over w - min(b) over w) when max(b) over w = 0 then 0 else 1 end nb,
  case when max(v) over w > min(v) over w then (v - min(v) over w) / (max(v) over w - min(v) over w) when max(v) over w = 0 then 0 else 1 end nv from norm window w as (partition by run_id)),
fused as (select *, 0.7::double * nb + 0.3::double * nv base, (0.7::double * nb + 0.3::double * nv) * case when graph_boost then 1.3::double else 1 end final from scaled)"""
DIRECT = "(lower(coalesce(evidence_type, '')) in ('direct', 'direct_evidence') or coalesce(bm25_score, 0) > 0 or coalesce(vector_score, 0) > 0 or coalesce(rerank_score, 0) > 0 or coalesce(final_score, 0) > 0)"
RELATED = "lower(coalesce(evidence_type, '')) in ('related_context', 'graph_only')"
CONTEXT = "contexts as (select query_id, left(string_agg(coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank), 600) context, list(chunk_id order by rank) chunk_ids from results group by query_id)"
ANSWERS = RESULTS + ", " + CONTEXT + f""",
answers as (select r.*, coalesce(c.context, '') context, coalesce(f.text, {q.text(REFUSALS[0])}) answer from runs r left join contexts c using (query_id)
  left join (select query_id, text from results where rank = 1) f using (query_id))"""
REFUSED = f"len(list_filter({q.words(REFUSALS)}, lambda p: contains(answer, p))) > 0"
SUFFICIENT = RESULTS + f""",
seen as (select query_id, count(*) topk_count, count(*) filter ({DIRECT}) direct_count, count(*) filter ({RELATED}) related_count,
  {q.strip("string_agg(coalesce(text, ''), chr(10) || chr(10) order by rank)")} ctx from results group by query_id),
suff0 as (select r.query_id, coalesce(topk_count, 0) topk_count, length(coalesce(ctx, '')) context_chars, {q.terms("query")} t, {q.normal("ctx")} n, coalesce(direct_count, 0) direct_count, coalesce(related_count, 0) related_count from runs r left join seen s using (query_id)),
suff1 as (select *, {q.coverage("t", "n")} cov from suff0),
suff as (select query_id, topk_count, context_chars, round(cov, 4) query_coverage, direct_count, related_count,
  list_filter([case when topk_count = 0 then 'empty_topk' end, case when direct_count = 0 then 'no_direct_evidence' end, case when context_chars < 80 then 'context_too_short' end, case when cov < 0.3 then 'low_query_coverage' end], lambda x: x is not null) reasons from suff1)"""
CONFIDENT = """,
srcs as (select query_id, max(n) m from (select query_id, coalesce(nullif(source_file, ''), nullif(file_hash, ''), 'single-document') s, count(*) n from results group by all) group by 1),
pars as (select query_id, max(n) m, sum(n) s from (select query_id, parent_id, count(*) n from results where nullif(parent_id, '') is not null group by all) group by 1),
ones as (select query_id, coalesce(rerank_used, false) u, coalesce(rerank_score, 0) r, coalesce(final_score, 0) f from results where rank = 1),
twos as (select query_id, coalesce(rerank_used, false) u, coalesce(rerank_score, 0) r, coalesce(final_score, 0) f from results where rank = 2),
conf0 as (select g.query_id, n, dr, rr, case when o.u then o.r else o.f end top1, o.u used,
  case when o.u then 1 / (1 + exp(-greatest(-20, least(20, o.r)))) else greatest(0, least(1, o.f)) end part,
  case when t.query_id is null then 1 when o.u and t.u then abs(o.r - t.r) else abs(o.f - t.f) end gap, s.m::double / n src, coalesce(p.m::double / p.s, 0) par
  from (select query_id, count(*) n, avg((""" + DIRECT + """)::int) dr, avg((""" + RELATED + """)::int) rr from results group by 1) g
  join ones o using (query_id) left join twos t using (query_id) join srcs s using (query_id) left join pars p using (query_id)),
conf1 as (select *, greatest(0, least(1, 0.35::double * dr + 0.25::double * part + 0.15::double * greatest(0, least(1, gap / 0.15::double)) + 0.15::double * case when src >= 0.4 then 1 else 0.5 end + 0.10::double * (1 - rr)
  - case when n >= 3 and par >= 0.8 then 0.15::double else 0 end)) val from conf0),
conf as (select query_id, n "rows", round(top1, 4) top1_score, round(gap, 4) top1_top2_gap, round(dr, 4) direct_ratio, round(rr, 4) related_ratio, round(src, 4) top_source_ratio, round(par, 4) top_parent_ratio, round(val, 4) retrieval_confidence,
  list_filter([case when top1 < case when used then -3.0 else 0.05 end then 'low_top1_score' end, case when dr <= 0 then 'no_direct_evidence' end, case when rr >= 0.8 then 'too_much_related_context' end, case when val < 0.35 then 'low_retrieval_confidence' end], lambda x: x is not null) reasons from conf1)"""


def facets(source: str) -> str:
    ascii_ = "'[a-z0-9][a-z0-9_.+-]*'"
    known = " union all ".join(f"select query_id, {i} o, {q.text(o)} t from f0 where " + (f"regexp_matches(n, '(^|[^a-z0-9]){o}([^a-z0-9]|$)')" if o.isascii() else f"contains(n, '{o}')") for i, o in enumerate(OBJECTS))
    return f"""f0 as (select query_id, {q.normal("query")} n, list_filter({q.terms("query")}, lambda t: not list_contains({q.words(FILLER)}, t)) terms from {source}),
known as (select query_id, list(t order by o) k from ({known}) group by 1),
f1 as (select f.query_id, n, terms, {q.distinct_in_order(f"list_concat(coalesce(k, []::varchar[]), list_filter(terms, lambda t: regexp_full_match(t, {ascii_})))")} object_terms,
  list_filter({q.words(ASPECTS)}, lambda a: contains(n, a)) hard_aspect_terms, len(list_filter({q.words(COMPARISON)}, lambda m: contains(n, m))) > 0 is_comparison from f0 f left join known using (query_id)),
facets as (select query_id, terms, object_terms, {q.distinct_in_order(f"list_concat(hard_aspect_terms, list_filter(terms, lambda t: length(t) >= 2 and not regexp_full_match(t, {ascii_}) and not list_contains(object_terms, t)))")} aspect_terms, hard_aspect_terms, is_comparison from f1)"""


def windows(source: str, key: str) -> str:
    ends = "。！？!?；;"
    return f"""w0 as (select {key}, text, {q.strip("text")} whole, regexp_extract_all(text, '[^{ends}\\n]*[{ends}]|[^{ends}\\n]+') p from {source}),
w1 as (select {key}, generate_subscripts(p, 1) i, unnest(p) s from w0),
w2 as (select {key}, i, {q.strip("s")} s from w1),
w3 as (select * from w2 where s <> ''),
w4 as (select * from w3 union all select {key}, 1, whole from w0 anti join w3 using ({key}) where whole <> ''),
w5 as (select {key}, i, piece, {q.strip("substr(s, piece * 273 + 1, 420)")} s from (select {key}, i, s, unnest(range(0, greatest(ceil((length(s) - 420) / 273.0)::bigint, 0) + 1)) piece from w4)),
w6 as (select {key}, row_number() over (partition by {key} order by i, piece) - 1 pos, s from w5 where s <> ''),
wins as (select {key}, pos::int window_pos, {q.strip(f"left({q.strip('concat_ws(chr(32), lag(s) over w, s, lead(s) over w)')}, 840)")} as "window" from w6 window w as (partition by {key} order by pos))"""


DIRECT_GATE = f""", {facets("runs")},
direct_rows as (select struct_pack(a := query_id, b := rank) k, text from results where {DIRECT} and text is not null),
{windows("direct_rows", "k")},
hits0 as (select k.a query_id, k.b rank, window_pos, "window", {q.normal('"window"')} n from wins),
hits1 as (select h.*, f.* exclude (query_id) from hits0 h join facets f using (query_id)),
hits as (select *, len(list_filter(terms, lambda t: contains(n, t))) th, len(list_filter(object_terms, lambda t: contains(n, t))) oh, len(list_filter(aspect_terms, lambda t: contains(n, t))) ah, len(list_filter(hard_aspect_terms, lambda t: contains(n, t))) hh from hits1),
rated as (select *, th + 1.5::double * oh + 1.25::double * ah + 1.75::double * hh + {q.coverage("terms", "n")} score from hits),
best as (select * from (select *, row_number() over (partition by query_id order by score desc, rank, window_pos) rn from rated) where rn = 1),
gated as (select f.query_id, round(score, 4) best_score, "window" best_window, coalesce(th, 0)::int term_hits, greatest(2, case when len(f.terms) > 0 then ceil(len(f.terms) * 0.35::double) else 0 end)::int min_hits, b.query_id is null none, f.is_comparison cmp, len(f.object_terms) no, oh, len(f.hard_aspect_terms) nh, hh
  from facets f left join best b using (query_id)),
direct_gate as (select query_id, best_score, best_window, term_hits, min_hits, case when none then ['no_direct_evidence_windows'] else list_filter([case when term_hits < min_hits then 'low_direct_term_hits' end,
  case when cmp and no >= 2 and oh < 2 then 'missing_comparison_objects' end, case when nh > 0 and hh = 0 then 'missing_question_aspect' end], lambda x: x is not null) end reasons from gated)"""
VERSIONS = "vers as (select * from (select *, row_number() over (partition by file_name, hash, ts order by received_at, version_id) rn from version_log where file_name is not null and hash is not null and ts is not null) where rn = 1)"
_SYN = "[" + ", ".join(f"struct_pack(k := {q.text(k)}, w := {q.words(v)})" for k, v in SYNONYMS.items()) + "]"
_HIT_RANKS = RESULTS + f""",
kw as (select distinct query_id, w from (select query_id, {q.match_form("k")} w from (select query_id, unnest(expected_keywords) k from runs)) where w <> ''),
shown as (select query_id, rank, {q.match_form("text")} n from results where text is not null),
hit as (select s.query_id, min(rank) hit_rank from shown s join kw on kw.query_id = s.query_id and contains(n, w) group by 1),
hits as (select r.query_id, r.has_answer_in_doc, hit_rank, coalesce(1.0::double / hit_rank, 0) rr from runs r left join hit using (query_id))"""
_GEN = ANSWERS + f""",
gen as (select query_id, has_answer_in_doc, {REFUSED} refused, case when has_answer_in_doc is null then null when has_answer_in_doc then not ({REFUSED}) else {REFUSED} end faithful,
  case when {REFUSED} then []::varchar[] else list_filter(coalesce(answer_key_points, []::varchar[]), lambda p: p is not null and p <> '' and contains(lower(answer), lower(p))) end matched_points,
  len(list_filter(coalesce(answer_key_points, []::varchar[]), lambda p: p is not null and p <> '')) points from answers),
genr as (select query_id, has_answer_in_doc, refused, faithful, matched_points, case when points > 0 then len(matched_points)::double / points end match_rate from gen)"""
_DOT = "list_dot_product(e::double[], f::double[])"
_YEAR, _AMOUNT = r"(?:19|20)[0-9]{2}" + q.SPACE + "*年?", r"(?i)[0-9]+(?:\.[0-9]+)?" + q.SPACE + "*(?:亿元|万元|元|亿|万|%|％|pct|百分点|倍)"
_COMPANY, _RISK = r"[\x{4e00}-\x{9fff}A-Za-z0-9]{2,30}(?:股份有限公司|有限公司|集团|公司|银行|证券|科技)", r"[\x{4e00}-\x{9fff}]{2,12}风险"


def _found(pattern: str, x: str) -> str:
    return f"coalesce(list_sort(list_distinct(regexp_extract_all({x}, {q.text(pattern)}))), []::varchar[])"


def _claims(x: str) -> dict[str, str]:
    return {"companies": _found(_COMPANY, x), "metrics": f"list_filter({q.words(METRICS)}, lambda m: contains({x}, m))", "years": _found(_YEAR, x), "amounts": _found(_AMOUNT, x), "risks": _found(_RISK, x)}


ORACLES = {
    "nfkc_norm": f"select row_id, {q.nfkc('text')} norm from chunks",
    "cjk_space_collapse": f"select row_id, {q.collapse('text')} collapsed from chunks",
    "clean_text": f"select doc_id, {q.clean('text')} clean from documents",
    "split_paragraphs": f"with {q.PARAGRAPHS} select doc_id, t as text, length(t)::int n from paras",
    "pack_sentences": f"with recursive {q.PACKED} select * from numbered",
    "normalize_for_match": f"select query_id, {q.match_form('query')} norm from test_queries1",
    "normalize_text": f"select query_id, {q.normal('query')} norm from test_queries1",
    "tokenize_terms": f"select row_id, {q.tokens('text')} toks from chunks",
    "content_terms": f"select query_id, {q.terms('query')} terms, {q.terms('query', ANSWER_STOP_WORDS)} answer_terms from test_queries1",
    "term_coverage": f"with {RESULTS}, n as (select r.query_id, r.chunk_id, {q.terms('u.query')} t, {q.normal('r.text')} n from results r join runs u using (query_id)) select query_id, chunk_id, round({q.coverage('t', 'n')}, 6) coverage from n",
    "keyword_enrich": f"""with {q.ASKED}, w0 as (select query_id, query, list_filter(regexp_extract_all(query, '[a-zA-Z0-9]+|[\\x{{4e00}}-\\x{{9fa5}}]{{2,}}'), lambda w: not list_contains({q.words(KEYWORD_STOP_WORDS)}, w)) a,
  list_filter(regexp_extract_all(query, '[a-zA-Z0-9]+|[\\x{{4e00}}-\\x{{9fa5}}]'), lambda w: not list_contains({q.words(KEYWORD_STOP_WORDS)}, w)) b from asked),
words as (select query_id, unnest(case when len(a) > 0 then a else b end) w from w0),
syn as (select generate_subscripts(s, 1) o, unnest(s) e from (select {_SYN} s)),
near as (select query_id, w, o, e, (contains(e.k, lower(w)) or list_contains(e.w, lower(w))) exact from words join syn on contains(e.k, lower(w)) or len(list_filter(e.w, lambda s: contains(s, lower(w)) or contains(lower(w), s))) > 0),
pick as (select query_id, e from (select *, row_number() over (partition by query_id, w order by exact desc, o) rn from near) where rn = 1),
found as (select query_id, w from words union select query_id, unnest(e.w) from pick union select query_id, unnest(e.w) from asked join syn on len(list_filter(e.w, lambda s: contains(lower(query), s))) > 0),
lists as (select query_id, list_sort(list(w)) k from found group by 1)
select a.query_id, case when k is null then [left(query, 2)] else k end keywords from asked a left join lists using (query_id)""",
    "exact_dedup": "select doc_id, sha256(text) hash, min(doc_id) over (partition by text) first_key, count(*) over (partition by text) copies from documents where text is not null",
    "para_cap": f"with recursive {q.PACKED} select doc_id, least(count(*), 3) n from numbered group by 1",
    "similar_vectors": f"with u as (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings), n as (select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) e from u) select a.vec_id i, b.vec_id j from n a join n b on a.vec_id < b.vec_id where list_dot_product(a.e, b.e) > 0.35",
    "title_predicate": f"with l as (select row_id, unnest(string_split(text, chr(10))) as text from chunks) select row_id, count(*) filter (text <> '' and {q.TITLE}) titles, count(*) lines from l group by 1",
    "parent_split_regex": f"with recursive {q.PARENTS} select * from parent_rows",
    "parent_split_semantic": f"""with p as (select label, (row_number() over (partition by label order by vec_id) - 1)::int para_pos, embedding::double[] e, lag(embedding::double[]) over (partition by label order by vec_id) f from embeddings),
s as (select label, para_pos, {_DOT} / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f))) s from p),
b as (select *, avg(s) over (partition by label) - 0.5 * stddev_pop(s) over (partition by label) t from s)
select label, para_pos, round(s, 6) similarity, sum(coalesce((s < t)::int, 0)) over (partition by label order by para_pos)::int parent_pos from b""",
    "parent_split_even": f"with recursive {q.PACKED} select doc_id, para_pos, floor(para_pos / ceil(count(*) over (partition by doc_id) / case when count(*) over (partition by doc_id) <= 6 then 2.0 else 3.0 end))::int parent_pos from numbered",
    "parent_strategy": f"""with recursive {q.PARENTS},
even as (select doc_id, floor(para_pos / ceil(count(*) over (partition by doc_id) / case when count(*) over (partition by doc_id) <= 6 then 2.0 else 3.0 end))::int p from numbered),
a as (select doc_id, count(*)::int regex_parents from parent_rows group by 1), b as (select doc_id, count(distinct p)::int similar_parents from even group by 1)
select doc_id, coalesce(regex_parents, 0)::int regex_parents, coalesce(similar_parents, 0)::int similar_parents, case when coalesce(similar_parents, 0) > coalesce(regex_parents, 0) then 'semantic_adaptive' else 'regex' end strategy from a full join b using (doc_id)""",
    "char_windows": f"""with recursive {q.PARENTS},
wins as (select doc_id, parent_pos, parent_id, (k / 170)::int child_pos, {q.strip("substr(text, k + 1, 220)")} as text from (select *, unnest(range(0, length(text), 170)) k from parent_rows))
select doc_id, parent_pos, parent_id, child_pos, left(sha256(parent_id || text), 12) chunk_id, text from wins where text <> ''""",
    "token_windows": f"""with recursive {q.PARENTS},
pieces as (select doc_id, parent_pos, parent_id, text, generate_subscripts(p, 1) i, unnest(p) s from (select *, regexp_extract_all(text, '\\s+|[\\x{{3400}}-\\x{{9fff}}]|[A-Za-z0-9_]+|[^\\s]') p from parent_rows)),
spans as (select *, sum(length(s)) over (partition by doc_id, parent_pos order by i) e from pieces),
tok as (select doc_id, parent_pos, parent_id, text, e - length(s) st, e en, row_number() over (partition by doc_id, parent_pos order by i) - 1 n from spans where not regexp_matches(s, '^\\s')),
cnt as (select doc_id, parent_pos, parent_id, text, count(*) c from tok group by all),
win as (select *, unnest(range(0, greatest(ceil((c - 220) / 170.0)::int, 0) + 1)) k from cnt),
cut as (select w.doc_id, w.parent_pos, w.parent_id, w.k::int child_pos, {q.strip("substr(w.text, a.st::int + 1, (b.en - a.st)::int)")} as text from win w join tok a on a.doc_id = w.doc_id and a.parent_pos = w.parent_pos and a.n = k * 170
  join tok b on b.doc_id = w.doc_id and b.parent_pos = w.parent_pos and b.n = least(k * 170 + 220, c) - 1)
select doc_id, parent_pos, parent_id, child_pos, left(sha256(parent_id || text), 12) chunk_id, text from cut""",
    "parent_children": f"with {q.CURRENT} select index_key, parent_id, list(chunk_id order by pos, row_id, chunk_id) children from cur where parent_id is not null group by all",
    "chunk_stats": f"""with {q.CURRENT},
l as (select index_key, list_sort(list(length(text))) l, count(*) chunks, round(avg(length(text)), 1) avg_len, min(length(text))::int min_len, max(length(text))::int max_len, count(distinct parent_id) parents, count(*) filter (parent_id is null) orphans, count(parent_id) k from cur group by 1)
select index_key, chunks, parents, avg_len, min_len, max_len, l[least(floor(chunks * 0.25)::int, chunks - 1) + 1]::int p25, l[least(floor(chunks * 0.5)::int, chunks - 1) + 1]::int p50, l[least(floor(chunks * 0.75)::int, chunks - 1) + 1]::int p75,
  case when parents > 0 then round(k::double / parents, 1) else 0.0 end avg_children, orphans from l""",
    "corpus_stats": f"with {q.CURRENT} select count(distinct index_key) files, count(distinct case when parent_id is not null then index_key || parent_id end) parents, count(*) chunks, round(avg(length(text)), 2) avg_len from cur",
    "current_chunks": f"with {q.CURRENT} select row_id, index_key, pos, chunk_id from cur",
    "bm25_postings": f"with {q.CURRENT}, {q.INDEX} select term, row_id, tf from postings",
    "bm25_idf": f"with {q.CURRENT}, {q.INDEX} select term, df, round(idf, 6) idf from terms",
    "bm25_scores": f"with {q.CURRENT}, {q.ASKED}, {q.SCORES} select query_id, row_id, round(score, 6) score from scores",
    "bm25_topk": f"with {q.CURRENT}, {q.ASKED}, {q.topk(5)} select query_id, row_id, round(score, 6) score, rank from top",
    "window_expand": f"""with {q.CURRENT} select a.row_id, coalesce(string_agg(b.text, chr(10) order by b.pos), any_value(a.text)) window_text
from cur a left join cur b on a.index_key = b.index_key and a.parent_id = b.parent_id and b.pos between a.pos - 2 and a.pos + 2 group by a.row_id""",
    "parent_text": f"with {q.CURRENT} select index_key, parent_id, count(*) n, string_agg(text, chr(10) order by pos, text) as text from cur where parent_id is not null group by all",
    "hash_embed": f"""with {q.CURRENT}, t as (select row_id, ('0x' || left(md5(tok), 8))::bigint h from (select row_id, unnest({q.tokens("text")}) tok from cur)),
s as (select row_id, (h % 16)::int slot, sum(case when (h >> 16) % 2 = 0 then 1 else -1 end)::double v from t group by all having v <> 0)
select row_id, slot, round(v / sqrt(sum(v * v) over (partition by row_id)), 6) weight from s""",
    "vector_topk": f"select * from (select query_id, vec_id, round(s, 5) score, row_number() over (partition by query_id order by s desc, vec_id)::int rank from (select a.vec_id query_id, b.vec_id, list_dot_product(a.embedding::double[], b.embedding::double[]) s from embeddings a cross join embeddings b where a.vec_id % 100 = 0)) where rank <= 5",
    "rule_entities": f"with {ENTITIES} select row_id, ord, label, type from ents",
    "graph_nodes": f"with {NODES} select * from nodes",
    "graph_mentions": f"with {NODES} select e.index_key, node_id, count(distinct chunk_id) chunks from ents e join nodes n on n.index_key = e.index_key and n.label = trim(e.label) group by all",
    "graph_edge_defaults": f"with {EDGES} select * from edges",
    "graph_edges_registered": """with nodes as (select index_key, label, arg_min(id, (regexp_extract(id, '([0-9]+)$', 1)::int, id)) node_id, min(regexp_extract(id, '([0-9]+)$', 1)::int) first_pos from semantic_graph where label is not null group by all),
rel as (select e.index_key, e.edge_pos pos, a.label fl, b.label tl, e.relation from graph_edges e join semantic_graph a on a.index_key = e.index_key and a.id = e.src join semantic_graph b on b.index_key = e.index_key and b.id = e.dst)
select r.index_key, x.node_id src, y.node_id dst, trim(relation) relation, count(*)::int weight from rel r join nodes x on x.index_key = r.index_key and x.label = fl join nodes y on y.index_key = r.index_key and y.label = tl
where trim(coalesce(relation, '')) <> '' and x.first_pos <= pos and y.first_pos <= pos group by all""",
    "query_entities": f"with {MATCHED} select * from matched",
    "entity_recall": f"""with {q.CURRENT}, {MATCHED}, f as (select index_key, chunk_id, min((pos, parent_id)) spot from cur group by all),
r as (select distinct m.query_id, m.index_key, m.id, e.chunk_id, spot from matched m join entity_chunks e on e.index_key = m.index_key and e.node_id = m.id join f on f.index_key = e.index_key and f.chunk_id = e.chunk_id)
select query_id, index_key, id, chunk_id, spot[1] pos, spot[2] parent_id, row_number() over (partition by query_id, index_key, id order by spot[1], chunk_id)::int entity_rank from r""",
    "entity_recall_quotas": f"""with recursive {q.CURRENT}, {MATCHED}, f as (select index_key, chunk_id, min((pos, parent_id)) spot from cur group by all),
rec as (select distinct m.query_id, m.index_key, m.id, e.chunk_id, spot from matched m join entity_chunks e on e.index_key = m.index_key and e.node_id = m.id join f on f.index_key = e.index_key and f.chunk_id = e.chunk_id),
seq as (select query_id, index_key, id, chunk_id, coalesce(spot[2], '') parent, row_number() over (partition by query_id, index_key order by id, spot[1], chunk_id) n from rec),
fold as (
  select query_id, index_key, 0::bigint n, []::varchar[] picked, []::varchar[] parents, '' ent, 0 taken from (select distinct query_id, index_key from seq)
  union all
  select query_id, index_key, n, case when ok then list_append(picked, chunk_id) else picked end, case when ok then list_append(parents, parent) else parents end, id, before + ok::int from (
    select f.query_id, f.index_key, e.n, f.picked, f.parents, e.id, e.chunk_id, e.parent, case when e.id = f.ent then f.taken else 0 end before,
      not list_contains(f.picked, e.chunk_id) and case when e.id = f.ent then f.taken else 0 end < 3 and (e.parent = '' or len(list_filter(f.parents, lambda p: p = e.parent)) < 2) ok
    from fold f join seq e on e.query_id = f.query_id and e.index_key = f.index_key and e.n = f.n + 1))
select query_id, index_key, unnest(picked) chunk_id, generate_subscripts(picked, 1)::int seq from (select query_id, index_key, arg_max(picked, n) picked from fold group by all)""",
    "multi_hop": f"""with {MATCHED}, {EDGES},
ways as (select index_key, src "at", dst "to", weight, edge_pos, 0 back from edges union all select index_key, dst, src, weight, edge_pos, 1 from edges),
h1a as (select m.query_id, m.index_key, b."to" id, weight::double score, [m.id] path, edge_pos, back from matched m join ways b on b.index_key = m.index_key and b."at" = m.id
  where not exists (select 1 from matched x where x.query_id = m.query_id and x.index_key = m.index_key and x.id = b."to")),
h1 as (select * from (select *, row_number() over (partition by query_id, index_key, id order by path, edge_pos, back, score) rn from h1a) where rn = 1),
h1l as (select h.*, n.label, coalesce(length(n.label) >= 2 and not contains(a.query, n.label), false) good, list_concat(path, [format('{{:08d}}', edge_pos), h.id]) p2 from h1 h left join semantic_graph n on n.index_key = h.index_key and n.id = h.id join asked a using (query_id)),
h2a as (select m.query_id, m.index_key, b."to" id, m.score * weight * 0.7::double score, p2 path, b.edge_pos, b.back from h1l m join ways b on b.index_key = m.index_key and b."at" = m.id where good
  and not exists (select 1 from matched x where x.query_id = m.query_id and x.index_key = m.index_key and x.id = b."to") and not exists (select 1 from h1 x where x.query_id = m.query_id and x.index_key = m.index_key and x.id = b."to")),
h2 as (select * from (select *, row_number() over (partition by query_id, index_key, id order by path, edge_pos, back, score) rn from h2a) where rn = 1)
select query_id, index_key, id, label, round(score, 6) score from h1l where good
union all select h.query_id, h.index_key, h.id, n.label, round(score, 6) from h2 h join semantic_graph n on n.index_key = h.index_key and n.id = h.id join asked a on a.query_id = h.query_id where length(n.label) >= 2 and not contains(a.query, n.label)""",
    "neighbor_expand": f"""with {MATCHED}, {EDGES},
e as (select e.*, a.label sl, b.label dl from edges e left join semantic_graph a on a.index_key = e.index_key and a.id = e.src left join semantic_graph b on b.index_key = e.index_key and b.id = e.dst),
f as (select query_id, e.index_key, edge_pos, dl label, weight, 0 way from e join matched m on m.index_key = e.index_key and m.id = e.src union all select query_id, e.index_key, edge_pos, sl, weight, 1 from e join matched m on m.index_key = e.index_key and m.id = e.dst),
g as (select f.* from f join asked a using (query_id) where length(label) >= 2 and not contains(a.query, label)),
h as (select * from (select *, row_number() over (partition by query_id, index_key, edge_pos order by way, label, weight) rn from g) where rn = 1),
b as (select query_id, index_key, label, max(weight) weight from h group by all)
select * from (select *, row_number() over (partition by query_id, index_key order by weight desc, label)::int rank from b) where rank <= 2""",
    "synonym_expand": f"""with {MATCHED}, syn as (select distinct label, word from (select label, unnest([lower(label), upper(label)]) word from semantic_graph where length(label) >= 2) where word <> label),
w as (select distinct m.query_id, word from matched m join syn using (label) join asked a on a.query_id = m.query_id where not contains(a.query, word)),
l as (select query_id, string_agg(word, ' ' order by word) s from w group by 1)
select a.query_id, case when s is null then query else query || ' ' || s end expanded_query from asked a left join l using (query_id)""",
    "chunk_labels": """with r as (select distinct e.index_key, e.chunk_id, n.label from entity_chunks e join semantic_graph n on n.index_key = e.index_key and n.id = e.node_id where n.label is not null)
select index_key, chunk_id, list(label order by label) labels from (select *, row_number() over (partition by index_key, chunk_id order by label) k from r) where k <= 12 group by all""",
    "graph_summary": f"""with {EDGES}, n as (select index_key, count(distinct id) nodes from semantic_graph group by 1), e as (select index_key, count(*) edges, sum(weight)::bigint total_weight from edges group by 1), m as (select index_key, count(distinct chunk_id) covered_chunks from entity_chunks group by 1)
select index_key, coalesce(nodes, 0) nodes, coalesce(edges, 0) edges, coalesce(covered_chunks, 0) covered_chunks, coalesce(total_weight, 0) total_weight from n full join e using (index_key) full join m using (index_key)""",
    "hybrid_candidates": f"""with {CAND}, a as (select * from (select run_id, chunk_id, bm25_score s, row_number() over (partition by run_id order by bm25_score desc, row_id) r from cand where bm25_score > 0) where r <= 10),
b as (select * from (select run_id, chunk_id, vector_score s, row_number() over (partition by run_id order by vector_score desc, row_id) r from cand where vector_score > 0) where r <= 10),
j as (select coalesce(a.run_id, b.run_id) query_id, coalesce(a.chunk_id, b.chunk_id) chunk_id, coalesce(a.s, 0) bm25_score, coalesce(b.s, 0) vector_score, a.r ar, b.r br from a full join b on a.run_id = b.run_id and a.chunk_id = b.chunk_id)
select query_id, chunk_id, bm25_score, vector_score, row_number() over (partition by query_id order by ar nulls last, br nulls last, chunk_id)::int cand_seq from j""",
    "candidate_cap": f"with {CAND} select run_id, row_id, cand_seq from cand where cand_seq <= 20",
    "minmax_norm": f"""with {CAND} select run_id, row_id, round(case when bm25_score is null then null when max(bm25_score) over w > min(bm25_score) over w then (bm25_score - min(bm25_score) over w) / (max(bm25_score) over w - min(bm25_score) over w) when max(bm25_score) over w = 0 then 0 else 1 end, 6) bm25,
  round(case when vector_score is null then null when max(vector_score) over w > min(vector_score) over w then (vector_score - min(vector_score) over w) / (max(vector_score) over w - min(vector_score) over w) when max(vector_score) over w = 0 then 0 else 1 end, 6) vector from cand window w as (partition by run_id)""",
    "fuse_scores": f"with {RUN_SCORES} select run_id, row_id, round(base, 6) base_score, round(final, 6) final_score, case when b > 0 or v > 0 then 'direct' when coalesce(graph_boost, false) then 'related_context' else 'weak' end evidence_type from fused",
    "fused_top": f"with {RUN_SCORES} select run_id, row_id, rank from (select run_id, row_id, row_number() over (partition by run_id order by round(final, 9) desc, cand_seq)::int rank from fused) where rank <= 5",
    "evidence_type": "select row_id, case when coalesce(bm25_score, 0) > 0 or coalesce(vector_score, 0) > 0 then 'direct' when coalesce(graph_boost, false) then 'related_context' else 'weak' end kind from debug_info",
    "rank_delta": f"with {CAND}, r as (select run_id, row_id, row_number() over (partition by run_id order by base_score desc nulls last, row_id)::int base_rank, row_number() over (partition by run_id order by final_score desc nulls last, row_id)::int final_rank, round(final_score - base_score, 6) graph_lift from cand) select *, base_rank - final_rank moved from r",
    "safe_rerank": f"with {CAND} select * from (select run_id query_id, row_id, row_number() over (partition by run_id order by final_score desc, cand_seq)::int rank, 0.0::double rerank_score, false rerank_used from cand) where rank <= 5",
    "hybrid_topk": f"""with recursive {q.CURRENT}, {q.ASKED}, {EDGES},
srch as (select run_id sid, min(query_id) qid, min(file_hash) index_key from debug_info group by 1),
s as (select sid, index_key, query from srch join asked on asked.query_id = srch.qid),
matched as (select distinct s.sid, n.index_key, n.id, n.label from s join semantic_graph n on n.index_key = s.index_key and length(n.label) >= 2 and contains(s.query, n.label)),
ways as (select index_key, src "at", dst "to", weight, edge_pos, 0 back from edges union all select index_key, dst, src, weight, edge_pos, 1 from edges),
h1a as (select m.sid, m.index_key, b."to" id, weight::double score, [m.id] path, edge_pos, back from matched m join ways b on b.index_key = m.index_key and b."at" = m.id where not exists (select 1 from matched x where x.sid = m.sid and x.id = b."to")),
h1 as (select * from (select *, row_number() over (partition by sid, id order by path, edge_pos, back, score) rn from h1a) where rn = 1),
h1l as (select h.*, n.label, coalesce(length(n.label) >= 2 and not contains(s.query, n.label), false) good from h1 h left join semantic_graph n on n.index_key = h.index_key and n.id = h.id join s using (sid)),
h2 as (select distinct m.sid, m.index_key, b."to" id from h1l m join ways b on b.index_key = m.index_key and b."at" = m.id where good
  and not exists (select 1 from matched x where x.sid = m.sid and x.id = b."to") and not exists (select 1 from h1 x where x.sid = m.sid and x.id = b."to")),
syn as (select distinct label, word from (select label, unnest([lower(label), upper(label)]) word from semantic_graph where length(label) >= 2) where word <> label),
extra as (select sid, label word from h1l where good union select h.sid, n.label from h2 h join semantic_graph n on n.index_key = h.index_key and n.id = h.id where length(n.label) >= 2 union select sid, word from matched join syn using (label)),
qtoks as (select sid, unnest({q.tokens("query")}) term from s union all select sid, unnest({q.tokens("word")}) from extra join s using (sid) where word <> '' and not contains(query, word)),
qterms as (select sid, term, count(*) qtf from qtoks group by all),
toks as (select c.row_id, c.index_key, {q.tokens("text")} t from cur c where index_key in (select index_key from s)),
lens as (select row_id, index_key, len(t) dl from toks),
corpus as (select index_key, count(*) n, avg(dl) avgdl from lens group by 1),
postings as (select index_key, term, row_id, count(*) tf from (select index_key, row_id, unnest(t) term from toks) group by all),
raws as (select index_key, term, ln(n - df + 0.5) - ln(df + 0.5) raw from (select index_key, term, count(*) df from postings group by all) join corpus using (index_key)),
idfs as (select index_key, term, case when raw < 0 then 0.25 * avg(raw) over (partition by index_key) else raw end idf from raws),
scores as (select s.sid, p.row_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) score from s join qterms using (sid) join idfs i on i.index_key = s.index_key and i.term = qterms.term
  join postings p on p.index_key = s.index_key and p.term = qterms.term join lens l on l.row_id = p.row_id join corpus c on c.index_key = s.index_key group by all),
bm as (select * from (select s.sid, c.row_id, c.chunk_id, round(coalesce(score, 0), 9) score, row_number() over (partition by s.sid order by round(coalesce(score, 0), 9) desc, c.pos, c.row_id) r from s join cur c on c.index_key = s.index_key left join scores x on x.sid = s.sid and x.row_id = c.row_id) where r <= 50),
cv0 as (select row_id, ('0x' || left(md5(tok), 8))::bigint h from (select row_id, unnest(t) tok from toks)),
cv1 as (select row_id, (h % 16)::int slot, sum(case when (h >> 16) % 2 = 0 then 1 else -1 end)::double v from cv0 group by all having v <> 0),
cv as (select row_id, slot, v / sqrt(sum(v * v) over (partition by row_id)) w from cv1),
qv0 as (select sid, ('0x' || left(md5(tok), 8))::bigint h from (select sid, unnest({q.tokens("query")}) tok from s)),
qv1 as (select sid, (h % 16)::int slot, sum(case when (h >> 16) % 2 = 0 then 1 else -1 end)::double v from qv0 group by all having v <> 0),
qv as (select sid, slot, v / sqrt(sum(v * v) over (partition by sid)) w from qv1),
dots as (select s.sid, c.row_id, sum(k.w * q.w) vs from s join cur c on c.index_key = s.index_key join cv k on k.row_id = c.row_id join qv q on q.sid = s.sid and q.slot = k.slot group by all),
dn as (select * from (select s.sid, c.row_id, c.chunk_id, round(coalesce(vs, 0), 9) vs, row_number() over (partition by s.sid order by round(coalesce(vs, 0), 9) desc, c.pos, c.row_id) r from s join cur c on c.index_key = s.index_key left join dots d on d.sid = s.sid and d.row_id = c.row_id) where r <= 50),
spots as (select index_key, chunk_id, min((pos, parent_id)) spot from cur group by all),
rec as (select distinct m.sid, m.id, e.chunk_id, spot from matched m join entity_chunks e on e.index_key = m.index_key and e.node_id = m.id join spots f on f.index_key = e.index_key and f.chunk_id = e.chunk_id),
seq as (select sid, id, chunk_id, coalesce(spot[2], '') parent, row_number() over (partition by sid order by id, spot[1], chunk_id) n from rec),
fold as (
  select sid, 0::bigint n, []::varchar[] picked, []::varchar[] parents, '' ent, 0 taken from (select distinct sid from seq)
  union all
  select sid, n, case when ok then list_append(picked, chunk_id) else picked end, case when ok then list_append(parents, parent) else parents end, id, before + ok::int from (
    select f.sid, e.n, f.picked, f.parents, e.id, e.chunk_id, e.parent, case when e.id = f.ent then f.taken else 0 end before,
      not list_contains(f.picked, e.chunk_id) and case when e.id = f.ent then f.taken else 0 end < 3 and (e.parent = '' or len(list_filter(f.parents, lambda p: p = e.parent)) < 2) ok
    from fold f join seq e on e.sid = f.sid and e.n = f.n + 1)),
hit as (select sid, unnest(picked) chunk_id, generate_subscripts(picked, 1) g from (select sid, arg_max(picked, n) picked from fold group by 1)),
a as (select sid, chunk_id, max(score) b, min(r) br from bm group by all), v as (select sid, chunk_id, max(vs) v, min(r) vr from dn group by all),
u as (select coalesce(a.sid, v.sid) sid, coalesce(a.chunk_id, v.chunk_id) chunk_id, coalesce(b, 0) b, coalesce(v, 0) v, br, vr from a full join v on a.sid = v.sid and a.chunk_id = v.chunk_id),
j0 as (select coalesce(u.sid, hit.sid) sid, coalesce(u.chunk_id, hit.chunk_id) chunk_id, coalesce(b, 0) b, coalesce(v, 0) v, g is not null boost, br, vr, g from u full join hit on u.sid = hit.sid and u.chunk_id = hit.chunk_id),
j as (select * from (select *, row_number() over (partition by sid order by br nulls last, vr nulls last, g nulls last, chunk_id) cand_seq from j0) where cand_seq <= 50),
n as (select *, case when max(b) over w > min(b) over w then (b - min(b) over w) / (max(b) over w - min(b) over w) when max(b) over w = 0 then 0 else 1 end nb, case when max(v) over w > min(v) over w then (v - min(v) over w) / (max(v) over w - min(v) over w) when max(v) over w = 0 then 0 else 1 end nv from j window w as (partition by sid)),
f as (select *, round((0.7::double * nb + 0.3::double * nv) * case when boost then 1.3::double else 1 end, 9) final from n),
top as (select * from (select *, row_number() over (partition by sid order by final desc, cand_seq)::int rank from f) where rank <= 5),
own as (select index_key, chunk_id, max((pos, row_id, parent_id)) last_row, min((pos, row_id)) spot from cur group by all),
ctx as (select c.row_id, c.text, coalesce(string_agg(o.text, chr(10) order by o.pos), any_value(c.text)) window_text from cur c left join cur o on o.index_key = c.index_key and o.parent_id = c.parent_id and o.pos between c.pos - 2 and c.pos + 2 where c.index_key in (select index_key from s) group by 1, 2)
select t.sid query_id, rank, t.chunk_id, own.last_row[3] parent_id, round(b, 6) bm25_score, round(v, 6) vector_score, round(final, 6) final_score, boost graph_boost,
  s.index_key not in (select index_key from semantic_graph union select index_key from entity_chunks) graph_fallback_used, case when b > 0 or v > 0 then 'direct' when boost then 'related_context' else 'weak' end evidence_type,
  md5(ctx.window_text) text_md5, md5(ctx.text) chunk_md5
from top t join s using (sid) join own on own.index_key = s.index_key and own.chunk_id = t.chunk_id join ctx on ctx.row_id = own.spot[2]""",
    "gate_sufficiency": f"with {SUFFICIENT} select *, len(reasons) = 0 passed from suff",
    "gate_confidence": f"with {RESULTS}{CONFIDENT} select query_id run_id, * exclude (query_id), len(reasons) = 0 passed from conf",
    "query_facets": f"with {q.ASKED}, {facets('asked')} select * from facets",
    "evidence_windows": f"with {q.CURRENT}, {windows('cur', 'row_id')} select * from wins",
    "gate_direct": f"with {RESULTS}{DIRECT_GATE} select *, len(reasons) = 0 passed from direct_gate",
    "finance_claims": f"with {q.CURRENT} select row_id, {', '.join(f'{v} "{k}"' for k, v in _claims('text').items())} from cur",
    "claim_support": f"""with {ANSWERS}, n as (select query_id, {q.normal("context")} n, list_concat({', '.join(_claims('answer').values())}) c from answers)
select query_id, list_filter(c, lambda x: not contains(n, regexp_replace(lower(x), '{q.SPACE}+', '', 'g'))) unsupported from n""",
    "answer_support": f"with {ANSWERS}, n as (select query_id, answer, {q.terms('query')} t, {q.normal('answer')} n from answers) select query_id, ({REFUSED}) or {q.coverage('t', 'n')} >= 0.5 supported from n",
    "refusal_detect": f"with {ANSWERS} select query_id, {REFUSED} refused from answers",
    "answer_decision": f"""with {SUFFICIENT}{CONFIDENT}{DIRECT_GATE}, {CONTEXT},
answers as (select r.*, coalesce(c.context, '') context, coalesce(f.text, {q.text(REFUSALS[0])}) answer from runs r left join contexts c using (query_id) left join (select query_id, text from results where rank = 1) f using (query_id)),
n as (select a.query_id, context, answer, ({REFUSED}) refused, {q.terms("query")} t, {q.normal("answer")} n, len(s.reasons) = 0 ok1, coalesce(len(c.reasons) = 0, false) ok2, len(d.reasons) = 0 ok3 from answers a join suff s using (query_id) left join conf c using (query_id) join direct_gate d using (query_id)),
d as (select *, case when not ok1 or not ok2 then 1 when not (refused or {q.coverage("t", "n")} >= 0.5) then 6 when not ok3 and not refused then 8 else 9 end step from n)
select query_id, step, md5(case when step in (1, 6) then {q.text(REFUSALS[0])} when step = 8 then {q.text(WARNING)} || chr(10) || chr(10) || answer else answer end) answer_md5 from d""".replace("runs as (select r.run_id", "runs0 as (select r.run_id").replace("where query is not null),\nseen", f"where query is not null), {IDLE},\nseen", 1),
    "prompt_text": f"with {ANSWERS} select query_id, '只依据资料回答，资料不足时回答“' || {q.text(REFUSALS[0])} || '”。' || chr(10) || chr(10) || '资料：' || chr(10) || left(context, 2000) || chr(10) || chr(10) || '问题：' || query prompt from answers",
    "retrieval_eval_detail": f"with {_HIT_RANKS} select query_id, coalesce(hit_rank, 0)::int hit_rank, round(rr, 6) reciprocal_rank from hits",
    "retrieval_eval": f"""with {_HIT_RANKS} select count(*) total_queries, round(count(hit_rank)::double / count(*), 6) recall_at_k, round(avg(rr), 6) mrr, count(hit_rank) hit_count, count(*) filter (has_answer_in_doc) queries_with_answer,
  round(count(hit_rank) filter (has_answer_in_doc)::double / count(*) filter (has_answer_in_doc), 6) answer_recall from hits""",
    "generation_eval_detail": f"with {_GEN} select query_id, refused, coalesce(faithful::int, -1)::int faithful, matched_points, round(match_rate, 6) match_rate from genr",
    "generation_eval": f"""with {_GEN} select count(*) total, count(*) filter (refused) refusals, round(avg(case when has_answer_in_doc then faithful::int end), 6) faithful_with_answer, round(avg(case when not has_answer_in_doc then faithful::int end), 6) faithful_without_answer,
  round(avg(faithful::int), 6) faithful_overall, round(avg(match_rate), 6) avg_match_rate from genr""",
    "full_report": f"""with {_HIT_RANKS.replace(RESULTS, ANSWERS)}, {_GEN.replace(ANSWERS + ",", "", 1)},
r as (select count(*)::double total_queries, count(hit_rank)::double / count(*) recall_at_k, avg(rr) mrr, count(hit_rank)::double hit_count, (count(*) filter (has_answer_in_doc))::double queries_with_answer,
  count(hit_rank) filter (has_answer_in_doc)::double / count(*) filter (has_answer_in_doc) answer_recall from hits),
g as (select count(*)::double total, (count(*) filter (refused))::double refusals, avg(case when has_answer_in_doc then faithful::int end) faithful_with_answer, avg(case when not has_answer_in_doc then faithful::int end) faithful_without_answer,
  avg(faithful::int) faithful_overall, avg(match_rate) avg_match_rate from genr)
select 'retrieval' part, name metric, round(value, 6) value from (unpivot r on *) union all select 'generation', name, round(value, 6) from (unpivot g on *)""",
    "tune_topk": f"""with {_HIT_RANKS}, d as (select unnest([1, 2, 3, 5]) depth), s as (select depth, round(avg(coalesce(hit_rank <= depth, false)::int), 6) recall, round(avg(case when hit_rank <= depth then rr else 0 end), 6) mrr, count(*) filter (hit_rank <= depth) hit_count from d cross join hits group by 1)
select depth, recall, mrr, hit_count, row_number() over (order by recall desc, mrr desc, depth) = 1 is_best from s""",
    "distinct_versions": f"with {VERSIONS} select version_id, file_name, hash, ts from vers",
    "version_asof": f"with {VERSIONS}, t as (select file_name, max(ts) - interval 30 day target from vers group by 1) select t.file_name, target, max((ts, hash)) filter (ts <= target)[2] hash, max(ts) filter (ts <= target) ts from t join vers v using (file_name) group by t.file_name, target",
    "version_retention": f"with {VERSIONS}, r as (select *, row_number() over (partition by file_name order by ts desc, hash desc) n from vers) select file_name, hash, ts from r where n > 1 and ts < timestamp '2025-01-01' - interval 7 day",
    "hash_upsert": "select distinct hash from version_log where hash is not null and hash not in (select arg_min(hash, (ts, version_id)) from version_log where file_name is not null and hash is not null group by file_name)",
    "rebuild_decision": """with p as (select hash, (max(index_path) is not null)::int * 2 + (max(bm25_path) is not null)::int + (max(graph_path) is not null)::int n from version_log where hash is not null group by 1)
select h.hash, case when coalesce(n, 0) = 0 then 'build' when n < 4 then 'rebuild' else 'load' end decision from (select distinct hash from version_log) h left join p on p.hash = h.hash""",
    "parse_request": """with r as (select query_id request_id, query, query_id % 7 k from test_queries1), c as (select request_id, k, replace(query, '"', ' ') q, coalesce(replace(query, '"', ' ') <> '', false) ok,
  case k when 1 then 0 when 2 then 12 when 4 then 1001 when 5 then null else 600 end t from r),
d as (select *, case when not ok then 'Field `query` is required' when t is null then 'Field `max_tokens` must be int' when t not between 1 and 1000 then 'Field `max_tokens` must be in [1, 1000]' end error from c)
select request_id, case when error is null then q end query, case when error is null then t else 0 end::int max_tokens, case when error is null then 5 else 0 end::int top_k, case when error is null and k = 3 then 'm' end model, case when error is not null then 40001 else 0 end::int error_code, error from d""",
    "context_concat": f"with {RESULTS}, {CONTEXT} select * from contexts",
    "response_shape": f"with {RESULTS}, {CONTEXT} select query_id, md5(replace(context, '\\n', chr(10))) answer_md5, len(chunk_ids)::int n_context from contexts",
    "hourly_requests": "select strftime(ts, '%Y-%m-%d %H') as hour, event_type, count(*) n from events group by all",
    "page_join": f"""with {q.CURRENT}, p as (select index_key, pos, case when pos % 3 > 0 then regexp_replace(text, '\\n+$', '') || chr(10) || '[图片：第' || (pos + 1) || '页，共' || (pos % 3) || '张]' else text end t from cur)
select index_key, string_agg(t, chr(10) order by pos) as text from p group by 1""",
    "short_text_fallback": f"""with s as (select row_id, text, case when length({q.strip("coalesce(text, '')")}) > 150 then text else {q.strip("coalesce(text, '') || chr(10) || coalesce(chunk_id, '')")} end t from chunks)
select row_id, t as text, length({q.strip("t")}) <= 150 rejected from s""",
    "html_text": f"""with p0 as (select doc_id, '<html><script>x=1<2</script><p>' || replace(text, chr(10), '<br/>') || '</p>&amp;<b>end</b></html>' t from documents),
p1 as (select doc_id, regexp_replace(regexp_replace(t, '(?is)<script[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style[^>]*>.*?</style\\s*>', ' ', 'g') t from p0),
p2 as (select doc_id, regexp_replace(regexp_replace(t, '(?i)<(br|/p|/div|/h[1-6]|/li|/tr)[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g') t from p1),
p3 as (select doc_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') t from p2),
p4 as (select doc_id, regexp_replace(regexp_replace(t, '[ \\t\\r\\f\\x0b\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g') t from p3)
select doc_id, {q.strip("regexp_replace(t, '\\n{2,}', chr(10), 'g')")} as text from p4""",
    "clean_answers": f"""with {q.ASKED}, a as (select query_id, has_answer_in_doc h, {q.strip(q.nfkc("query"))} t from asked),
b as (select query_id, h, regexp_replace(regexp_replace(t, '^\\s*["''{{]+', ''), '["''}}]+\\s*$', '') t from a),
c as (select query_id, h, regexp_replace(t, '\\n?\\s*["'']?[0-9]+\\s*([^"\\n]{{2,20}})["'']?\\s*:', chr(10) || chr(10) || '\\1:', 'g') t from b)
select query_id, case when h = false then {q.text(REFUSALS[0])} else {q.strip("regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g')")} end answer from c""",
    "graph_export": f"""with {EDGES} select index_key, 'node' part, id, label a, type b, coalesce(cardinality(attrs)::int, -1) n from semantic_graph
union all select index_key, 'edge', src, dst, relation, weight from edges union all select distinct index_key, 'mention', node_id, chunk_id, null, 0 from entity_chunks""",
    "semantic_dedup": """with recursive u as (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings where embedding is not null),
n as (select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) e from u),
near as materialized (select b.vec_id, list(a.vec_id) l from n a join n b on a.vec_id < b.vec_id where list_dot_product(a.e, b.e) > 0.35 group by 1),
o as materialized (select vec_id, coalesce(l, []::bigint[]) l, row_number() over (order by vec_id) k from u left join near using (vec_id)),
fold as (select 0::bigint k, []::bigint[] kept union all select o.k, case when list_has_any(kept, l) then kept else list_append(kept, vec_id) end from fold f join o on o.k = f.k + 1)
select unnest(kept) vec_id from (select arg_max(kept, k) kept from fold)""",
    "rate_limit": """with recursive o as (select event_id, user_id, epoch_us(ts) t, row_number() over (partition by user_id order by ts, event_id) k from events),
fold as (
  select null::bigint event_id, user_id, 0::bigint k, []::bigint[] held, false ok from (select distinct user_id from o)
  union all
  select event_id, user_id, k, case when length(now) < 5 then list_append(now, t) else now end, length(now) < 5 from (
    select o.event_id, o.user_id, o.k, o.t, list_filter(f.held, lambda x: o.t - x <= 21600000000) now from fold f join o on o.user_id = f.user_id and o.k = f.k + 1))
select event_id, ok accepted from fold where k > 0""",
}
