"""String functions: normalisation, cleaning, sentence packing, terms, coverage, ids."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes, punctuation and stop words of the text rules.
HAN = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{ff00}-\x{ffef}"
DROPPED = r"[^\x09\x0A\x0D\x20-\x7E\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{ff00}-\x{ffef}\x{2000}-\x{206f}]"
MATCH_PUNCTUATION = r"[.,!?;:，。！？；：“”‘’（）()【】\[\]<>《》]"
SENTENCE_ENDS = "。！？；;.!?"
TOKEN = r"[\x{4e00}-\x{9fff}]{2,}|[a-zA-Z0-9][a-zA-Z0-9_.+-]*"
STOP_WORDS = "什么 怎么 如何 哪个 哪些 是否 是不是 可以 能够 需要 以及 还是 这个 那个 一个 请问 为什么 多少".split()
ANSWER_STOP_WORDS = "什么 怎么 如何 哪个 哪些 是否 是不是 可以 能够 需要 以及 还是 这个 那个 一下 请问 为什么 多少".split()


@F.pandas_udf(T.StringType())
def _nfkc_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: x if x.isascii() else unicodedata.normalize("NFKC", x), na_action="ignore").astype(object)


def nfkc(text: Column) -> Column:
    """Unicode NFKC (no built-in exists); null stays null."""
    return _nfkc_udf(text)


def collapse_han_spaces(text: Column) -> Column:
    """Drop a single space or tab between two Han or full-width characters."""
    return F.regexp_replace(text, f"(?<=[{HAN}])[ \\t](?=[{HAN}])", "")


def strip(text: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_basic(text: Column, dropped: str = DROPPED) -> Column:
    """Normalise, collapse spaces and blank lines, and drop characters outside the allowed classes."""
    t = F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), r"\x00", " ")
    t = F.regexp_replace(collapse_han_spaces(t), r"(?U)[^\S\r\n]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), dropped, ""))


def split_paragraphs(clean: Column) -> Column:
    """Paragraphs of a cleaned text: parted by blank lines, inner line breaks become spaces, empty ones go."""
    parts = F.transform(F.split(clean, r"\n(?U)\s*\n"), lambda p: strip(F.regexp_replace(strip(p), r"(?U)\s*\n\s*", " ")))
    return F.filter(parts, lambda p: p != "")


def pack_sentences(text: Column, most: int = 200) -> Column:
    """Cut a text over ``most`` characters at sentence ends and pack the pieces greedily, joined by a space."""
    pieces = F.regexp_extract_all(text, F.lit(f"[^{SENTENCE_ENDS}]*[{SENTENCE_ENDS}]|[^{SENTENCE_ENDS}]+"), 0)
    pieces = F.transform(pieces, lambda p: strip(F.concat(strip(F.regexp_replace(p, f"[{SENTENCE_ENDS}]$", "")), F.regexp_extract(p, f"[{SENTENCE_ENDS}]$", 0))))
    pieces = F.filter(pieces, lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, piece: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(piece) + 1 <= most
        return F.when(
            fits, F.struct(acc["done"].alias("done"), strip(F.concat(acc["open"], F.lit(" "), piece)).alias("open"))
        ).otherwise(
            F.struct(F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"), piece.alias("open"))
        )

    packed = F.aggregate(pieces, start, add, lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))
    return F.when(F.length(text) <= most, F.filter(F.array(text), lambda x: x != "")).otherwise(packed)


def paragraphs(docs: DataFrame, key: str, text: str = "text", most: int = 200) -> DataFrame:
    """(key, para_pos, text): cleaned, packed paragraphs of each document in order."""
    # cleaned once in its own projection; the nested functions below read the column
    cleaned = docs.select(key, clean_basic(F.col(text)).alias("_clean"))
    parts = F.flatten(F.transform(split_paragraphs(F.col("_clean")), lambda p: pack_sentences(p, most)))
    return cleaned.select(key, F.posexplode(parts).alias("para_pos", "text"))


def normalize_for_match(text: Column) -> Column:
    """NFKC, lower case, without punctuation, spaces collapsed; null becomes empty."""
    t = F.lower(strip(nfkc(F.coalesce(text, F.lit("")))))
    t = collapse_han_spaces(F.regexp_replace(t, MATCH_PUNCTUATION, ""))
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    """NFKC, lower case, without white space; null becomes empty."""
    return F.regexp_replace(F.lower(nfkc(F.coalesce(text, F.lit("")))), r"(?U)\s+", "")


def tokens(text: Column) -> Column:
    """Default tokens: runs of two or more Han characters, and Latin or digit words; case is kept."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0)


def content_terms(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Distinct lower-cased tokens in order, without stop words and single non-alphanumeric characters.

    The tokens are ASCII or Han, which NFKC leaves as they are, so no normalisation is needed here.
    """
    low = F.transform(tokens(text), F.lower)
    kept = F.filter(low, lambda t: ~t.isin(*stop) & ((F.length(t) >= 2) | t.rlike("^[a-z0-9]+$")) & ~t.rlike(r"(?U)^[\W_]+$"))
    return F.array_distinct(kept)


def term_coverage(terms: Column, normal_text: Column) -> Column:
    """Share of ``terms`` contained in the text of :func:`normalize_text`; 1.0 for no terms."""
    hit = F.filter(terms, lambda t: F.contains(normal_text, F.lower(t)))
    return F.when(F.size(terms) == 0, 1.0).otherwise(F.size(hit) / F.size(terms))


def content_id(text: Column, length: int) -> Column:
    """The first ``length`` hex digits of SHA-256."""
    return F.left(F.sha2(text, 256), F.lit(length))


# Synonyms and stop words for the enrichment of test queries.
SYNONYMS = {
    "rag": ["检索增强", "检索", "rag", "retrieval augmented generation"],
    "微调": ["fine-tuning", "sft", "微调", "finetune", "lora", "全量微调", "指令微调", "prompt tuning"],
    "向量库": ["向量数据库", "milvus", "weaviate", "chroma", "qdrant", "向量", "vector database"],
    "agent": ["智能体", "agent", "多智能体", "工作流", "单智能体", "multi-agent"],
    "图谱": ["graphrag", "知识图谱", "图", "实体", "关系", "全局检索", "局部检索"],
    "切割": ["分块", "切块", "切割", "chunk", "滑动窗口", "重叠", "文档切割", "递归字符"],
    "召回": ["召回", "检索", "recall", "重排序", "rerank", "混合检索", "向量检索", "关键词检索", "bm25"],
    "评估": ["评估", "评测", "ragas", "忠诚度", "相关性", "mrr", "recall", "指标"],
    "记忆": ["记忆", "上下文", "memory", "短期记忆", "长期记忆", "kv cache"],
    "调用": ["调用", "function calling", "工具调用", "mcp", "skill", "意图识别"],
    "幻觉": ["幻觉", "hallucination", "瞎编", "胡说八道"],
    "推理": ["推理", "加速", "vllm", "量化", "剪枝", "蒸馏", "模型压缩"],
    "改写": ["改写", "query改写", "hyde", "拆解", "decomposition", "step-back"],
    "大模型": ["大模型", "llm", "模型", "deepseek", "openai"],
}
KEYWORD_STOP_WORDS = "的 是 了 吗 呢 啊 怎么 什么 到底 哪个 好 可以 能 有哪些 为什么 为啥 如何 是不是 和 与 在 里 用 做 对 把 去 有 没".split()


def enriched_keywords(query: Column) -> Column:
    """Sorted keywords of a query with the synonyms of the first matching entry of each, and of entries in the query.

    A keyword matches an entry whose key contains it or whose synonyms list it, else the first entry with a synonym
    that contains it or is contained.  A query without any keyword falls back to its first two characters.
    """
    entries = F.array(*[
        F.struct(F.lit(k).alias("key"), F.array(*map(F.lit, v)).alias("words")) for k, v in SYNONYMS.items()
    ])
    words = F.filter(F.regexp_extract_all(query, F.lit(r"[a-zA-Z0-9]+|[\x{4e00}-\x{9fa5}]{2,}"), 0), lambda w: ~w.isin(*KEYWORD_STOP_WORDS))
    single = F.filter(F.regexp_extract_all(query, F.lit(r"[a-zA-Z0-9]+|[\x{4e00}-\x{9fa5}]"), 0), lambda w: ~w.isin(*KEYWORD_STOP_WORDS))
    words = F.when(F.size(words) > 0, words).otherwise(single)

    def of(word: Column) -> Column:
        low = F.lower(word)
        exact = F.filter(entries, lambda e: F.contains(e["key"], low) | F.array_contains(e["words"], low))
        near = F.filter(entries, lambda e: F.exists(e["words"], lambda s: F.contains(s, low) | F.contains(low, s)))
        best = F.coalesce(F.try_element_at(exact, F.lit(1)), F.try_element_at(near, F.lit(1)))["words"]
        return F.coalesce(best, F.array().cast("array<string>"))

    inside = F.flatten(F.transform(F.filter(entries, lambda e: F.exists(e["words"], lambda s: F.contains(F.lower(query), s))), lambda e: e["words"]))
    found = F.array_sort(F.array_distinct(F.concat(words, F.flatten(F.transform(words, of)), inside)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.left(query, F.lit(2))))
