"""SQL building blocks of the comparison queries: Unicode normalisation and the text rules in DuckDB's dialect."""

from __future__ import annotations

import unicodedata

from docquarry.functions.text import MATCH_PUNCTUATION, SENTENCE_ENDS, STOP_WORDS

HAN = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{ff00}-\x{ffef}"
SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOKEN = r"[\x{4e00}-\x{9fff}]{2,}|[a-zA-Z0-9][a-zA-Z0-9_.+-]*"


def _single() -> tuple[str, str]:
    """Characters whose NFKC form is one other character and which NFC alone leaves, and these forms (built by rule)."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0xA0, 0x10000) if not 0xD800 <= c < 0xE000]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1 and unicodedata.normalize("NFC", a) == a]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def nfkc(x: str) -> str:
    """NFKC of the expression ``x`` (single-character forms, Latin ligatures and the ellipsis)."""
    for many in "ﬀﬁﬂﬃﬄ…":
        x = f"replace({x}, '{many}', '{unicodedata.normalize('NFKC', many)}')"
    a, b = _single()
    return f"nfc_normalize(translate({x}, {text(a)}, {text(b)}))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def collapse(x: str) -> str:
    for _ in range(2):
        x = f"regexp_replace({x}, '([{HAN}])[ \\t]([{HAN}])', '\\1\\2', 'g')"
    return x


def clean(x: str) -> str:
    t = f"regexp_replace({collapse(f'replace({nfkc(x)}, chr(0), chr(32))')}, '[ \\t\\f\\x0b\\x{{85}}\\x{{1680}}\\x{{2028}}\\x{{2029}}]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(f"regexp_replace({t}, '[^\\x09\\x0A\\x0D\\x20-\\x7E{HAN}\\x{{2000}}-\\x{{206f}}]', '', 'g')")


def match_form(x: str) -> str:
    t = f"lower({strip(nfkc(f'coalesce({x}, {text(str())})'))})"
    t = collapse(f"regexp_replace({t}, {text(MATCH_PUNCTUATION)}, '', 'g')")
    return strip(f"regexp_replace({t}, '{SPACE}+', ' ', 'g')")


def normal(x: str) -> str:
    return f"regexp_replace(lower({nfkc(f'coalesce({x}, {text(str())})')}), '{SPACE}+', '', 'g')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '{TOKEN}')"


def words(values: list[str]) -> str:
    return "[" + ", ".join(map(text, values)) + "]::varchar[]"


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def terms(x: str, stop: list[str] = STOP_WORDS) -> str:
    low = f"list_transform({tokens(x)}, lambda t: lower(t))"
    kept = f"list_filter({low}, lambda t: not list_contains({words(stop)}, t) and (length(t) >= 2 or regexp_full_match(t, '[a-z0-9]+')))"
    return distinct_in_order(kept)


def coverage(terms_: str, normal_text: str) -> str:
    return f"case when len({terms_}) = 0 then 1.0::double else len(list_filter({terms_}, lambda t: contains({normal_text}, t)))::double / len({terms_}) end"


CURRENT = """cur as (select * exclude (rn) from (select *, row_number() over (partition by index_key, pos order by indexed_at desc, row_id desc) rn
  from chunks where text is not null) where rn = 1)"""
ASKED = "asked as (select * from test_queries1 where query is not null)"
PARAGRAPHS = f"""cleaned as (select doc_id, {clean("text")} c from documents),
paras0 as (select doc_id, generate_subscripts(p, 1) k, unnest(p) t from (select doc_id, string_split_regex(c, '\\n{SPACE}*\\n') p from cleaned)),
paras1 as (select doc_id, k, {strip(f"regexp_replace({strip('t')}, '{SPACE}*\\n{SPACE}*', ' ', 'g')")} t from paras0),
paras as (select * from paras1 where t <> '')"""
PACKED = PARAGRAPHS + f""",
seg0 as (select doc_id, k, generate_subscripts(p, 1) i, unnest(p) s from (select doc_id, k,
  regexp_extract_all(t, '[^{SENTENCE_ENDS}]*[{SENTENCE_ENDS}]|[^{SENTENCE_ENDS}]+') p from paras where length(t) > 200)),
seg1 as (select doc_id, k, i, {strip(strip(f"regexp_replace(s, '[{SENTENCE_ENDS}]$', '')") + f" || regexp_extract(s, '[{SENTENCE_ENDS}]$')")} s from seg0),
seg as (select doc_id, k, row_number() over (partition by doc_id, k order by i) i, s from seg1 where s <> ''),
walk as (
  select doc_id, k, 1::bigint i, s buf, 0 part from seg where i = 1
  union all
  select w.doc_id, w.k, n.i, case when length(w.buf) + length(n.s) + 1 <= 200 then {strip("w.buf || ' ' || n.s")} else n.s end,
    w.part + (length(w.buf) + length(n.s) + 1 > 200)::int
  from walk w join seg n on n.doc_id = w.doc_id and n.k = w.k and n.i = w.i + 1),
packed as (
  select doc_id, k, 0 part, t from paras where length(t) <= 200
  union all select doc_id, k, part, arg_max(buf, i) t from walk group by doc_id, k, part),
numbered as (select doc_id, (row_number() over (partition by doc_id order by k, part) - 1)::int para_pos, t as text from packed where t <> '')"""
TITLE = f"(regexp_matches(text, '^\\s*#') or regexp_matches(text, '^\\s*第\\s*[一二三四五六七八九十0-9]+\\s*[章节部分条款]\\s*') or regexp_matches(text, '^\\s*[0-9]+(\\.[0-9]+)*\\s+') or (contains(text, '：') and length(text) <= 40))"
PARENTS = PACKED + f""",
opened as (select *, sum((({TITLE}) and rn > 1)::int) over (partition by doc_id order by para_pos) parent_pos
  from (select *, row_number() over (partition by doc_id order by para_pos) rn from numbered)),
parents as (select doc_id, parent_pos::bigint parent_pos, {strip("string_agg(text, chr(10) order by para_pos)")} as text from opened group by doc_id, parent_pos),
parent_rows as (select doc_id, parent_pos, left(sha256(text), 8) parent_id, text from parents where text <> '')"""
INDEX = f"""toks as (select row_id, {tokens("text")} t from cur),
lens as (select row_id, len(t) dl from toks),
corpus as (select count(*) n, avg(dl) avgdl from lens),
postings as (select term, row_id, count(*) tf from (select row_id, unnest(t) term from toks) group by all),
dfs as (select term, count(*) df from postings group by term),
raws as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) raw from dfs, corpus),
terms as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from raws) else raw end idf from raws)"""
SCORES = INDEX + f""",
qterms as (select query_id, term, count(*) qtf from (select query_id, unnest({tokens("query")}) term from asked) group by all),
scores as (select query_id, p.row_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) score
  from qterms q join terms t using (term) join postings p using (term) join lens l on l.row_id = p.row_id, corpus group by all)"""


def topk(k: int) -> str:
    return SCORES + f""",
every as (select q.query_id, c.row_id, c.index_key, c.pos, coalesce(s.score, 0.0) score from asked q cross join cur c left join scores s on s.query_id = q.query_id and s.row_id = c.row_id),
top as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, index_key, pos, row_id)::int rank from every) where rank <= {k})"""
