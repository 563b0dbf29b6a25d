"""Answerability gates over result rows: sufficiency, confidence, direct evidence, claims and refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.config import DEFAULTS, Config
from docquarry.functions.text import content_terms, nfkc, normalize_text, strip, term_coverage

# Refusal phrases, finance vocabulary, query facets.
REFUSAL = "根据现有资料无法回答该问题"
REFUSALS = [REFUSAL, "无法回答", "无法提供", "资料中没有", "现有资料无法", "没有足够信息", "没有直接", "资料中未", "未能找到"]
METRICS = "营业收入 营收 收入 净利润 归母净利润 毛利率 现金流 经营活动现金流 资产负债率 负债率 研发投入 研发费用 风险 合规 减值".split()
FILLER = "如果 为了 一个 这个 那个 请问 能否 能不能 是不是 是否 哪个 哪些 什么 怎么 如何 多少 到底 一下 可以 能够 进行 介绍 说明 讲讲 举个 例子 请".split()
COMPARISON = "哪个 哪一个 还是 相比 比较 对比 区别 不同 差异 更 好 优于 高于 低于 快 慢".split()
ASPECTS = (
    "成本 维护 更新 动态知识 响应速度 速度 延迟 幻觉 准确性 可靠 适用场景 场景 效果 优点 缺点 风险 流程 步骤 原理 作用 用途 指标 评估 "
    "忠实度 召回 召回率 准确率 上下文 嵌入 编码 检索 生成 图谱 关系 实体 金额 收入 利润 毛利率 现金流"
).split()
OBJECTS = "rag graphrag ragas bert openai bm25 faiss mcp llm 微调 向量 大模型 知识图谱 图数据库".split()
YEAR = r"(?:19|20)[0-9]{2}(?U)\s*年?"
AMOUNT = r"(?i)[0-9]+(?:\.[0-9]+)?(?U)\s*(?:亿元|万元|元|亿|万|%|％|pct|百分点|倍)"
COMPANY = r"[\x{4e00}-\x{9fff}A-Za-z0-9]{2,30}(?:股份有限公司|有限公司|集团|公司|银行|证券|科技)"
RISK = r"[\x{4e00}-\x{9fff}]{2,12}风险"
_ASCII_TERM = "^[a-z0-9][a-z0-9_.+-]*$"


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def is_direct() -> Column:
    """Whether a result row is direct evidence: by type, or by any positive score."""
    typed = F.lower(F.coalesce("evidence_type", F.lit(""))).isin("direct", "direct_evidence")
    scores = [F.coalesce(F.col(c), F.lit(0.0)) > 0 for c in ("bm25_score", "vector_score", "rerank_score", "final_score")]
    return typed | scores[0] | scores[1] | scores[2] | scores[3]


def is_related() -> Column:
    return F.lower(F.coalesce("evidence_type", F.lit(""))).isin("related_context", "graph_only")


def _reasons(*rules: tuple[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]), lambda r: r.isNotNull())


def sufficiency_gate(queries: DataFrame, results: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """(query_id, topk_count, context_chars, query_coverage, direct_count, related_count, reasons, passed).

    ``queries``: query_id, query; ``results``: query_id, rank, text, evidence_type and scores.  Queries without results
    fail with empty_topk among the reasons.
    """
    lines = F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text"))))
    seen = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("topk_count"), F.count_if(is_direct()).alias("direct_count"), F.count_if(is_related()).alias("related_count"),
        strip(F.array_join(F.transform(lines, lambda x: x["text"]), "\n\n")).alias("_context"),
    )
    rows = queries.select("query_id", "query").join(seen, "query_id", "left").na.fill(0, ["topk_count", "direct_count", "related_count"]).na.fill("", ["_context"])
    rows = rows.withColumn("_normal", normalize_text(F.col("_context"))).withColumn("_terms", content_terms(F.col("query")))
    rows = rows.withColumn("_coverage", term_coverage(F.col("_terms"), F.col("_normal"))).withColumn("context_chars", F.length("_context"))
    reasons = _reasons(
        ("empty_topk", F.col("topk_count") == 0), ("no_direct_evidence", F.col("direct_count") == 0),
        ("context_too_short", F.col("context_chars") < config.min_context_chars), ("low_query_coverage", F.col("_coverage") < config.min_query_coverage),
    )
    return rows.select(
        "query_id", "topk_count", "context_chars", F.round("_coverage", 4).alias("query_coverage"), "direct_count", "related_count", reasons.alias("reasons")
    ).withColumn("passed", F.size("reasons") == 0)


def confidence_gate(results: DataFrame, group: str = "run_id", rank: str = "rank", config: Config = DEFAULTS, queries: DataFrame | None = None) -> DataFrame:
    """(group, rows, top1_score, top1_top2_gap, direct_ratio, related_ratio, top_source_ratio, top_parent_ratio, retrieval_confidence, reasons, passed).

    With ``queries`` (group), those without results fail with empty_topk and zeros.
    """
    rows = results.withColumn("_source", F.coalesce(F.nullif("source_file", F.lit("")), F.nullif("file_hash", F.lit("")), F.lit("single-document")))
    rows = rows.withColumn("_parent", F.nullif("parent_id", F.lit(""))).withColumn("_used", F.coalesce("rerank_used", F.lit(False)))
    rows = rows.withColumn("_rerank", F.coalesce("rerank_score", F.lit(0.0))).withColumn("_final", F.coalesce("final_score", F.lit(0.0)))
    sources = rows.groupBy(group, "_source").count().groupBy(group).agg(F.max("count").alias("_top_source"))
    parents = rows.where("_parent is not null").groupBy(group, "_parent").count().groupBy(group).agg(F.max("count").alias("_top_parent"), F.sum("count").alias("_parents"))
    pick = lambda n: F.max(F.when(F.col(rank) == n, F.struct("_used", "_rerank", "_final")))
    seen = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(is_direct().cast("int")).alias("direct_ratio"), F.avg(is_related().cast("int")).alias("related_ratio"), pick(1).alias("_one"), pick(2).alias("_two")
    )
    seen = seen.join(sources, group).join(parents, group, "left")
    one, two = F.col("_one"), F.col("_two")
    top1 = F.when(one["_used"], one["_rerank"]).otherwise(one["_final"])
    part = F.when(one["_used"], 1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), one["_rerank"]))))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), one["_final"])))
    gap = F.when(two.isNull(), 1.0).when(one["_used"] & two["_used"], F.abs(one["_rerank"] - two["_rerank"])).otherwise(F.abs(one["_final"] - two["_final"]))
    seen = seen.withColumn("_top1", top1).withColumn("_gap", gap)
    seen = seen.withColumn("_source", F.col("_top_source") / F.col("rows")).withColumn("_parent", F.coalesce(F.try_divide(F.col("_top_parent").cast("double"), F.col("_parents")), F.lit(0.0)))
    crowded = F.when((F.col("rows") >= 3) & (F.col("_parent") >= 0.8), 0.15).otherwise(0.0)
    value = (
        0.35 * F.col("direct_ratio") + 0.25 * part + 0.15 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_gap") / 0.15))
        + 0.15 * F.when(F.col("_source") >= 0.4, 1.0).otherwise(0.5) + 0.10 * (1 - F.col("related_ratio")) - crowded
    )
    seen = seen.withColumn("_value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
    low = F.when(one["_used"], F.col("_top1") < config.min_top1_rerank).otherwise(F.col("_top1") < config.min_top1_final)
    reasons = _reasons(
        ("low_top1_score", low), ("no_direct_evidence", F.col("direct_ratio") <= 0),
        ("too_much_related_context", F.col("related_ratio") >= config.max_related_ratio), ("low_retrieval_confidence", F.col("_value") < config.min_confidence),
    )
    seen = seen.select(
        group, "rows", F.round("_top1", 4).alias("top1_score"), F.round("_gap", 4).alias("top1_top2_gap"), F.round("direct_ratio", 4).alias("direct_ratio"),
        F.round("related_ratio", 4).alias("related_ratio"), F.round("_source", 4).alias("top_source_ratio"), F.round("_parent", 4).alias("top_parent_ratio"),
        F.round("_value", 4).alias("retrieval_confidence"), reasons.alias("reasons"),
    )
    if queries is not None:
        seen = queries.select(group).distinct().join(seen, group, "left")
        seen = seen.withColumn("reasons", F.coalesce("reasons", F.array(F.lit("empty_topk")))).na.fill(0)
    return seen.withColumn("passed", F.size("reasons") == 0)


def query_facets(queries: DataFrame) -> DataFrame:
    """(query_id, terms, object_terms, aspect_terms, hard_aspect_terms, is_comparison) of each query."""
    rows = queries.select("query_id", F.col("query"), normalize_text(F.col("query")).alias("_q"), content_terms(F.col("query")).alias("_t"))
    rows = rows.withColumn("terms", F.filter("_t", lambda t: ~t.isin(*FILLER)))
    ascii_object = lambda t: F.rlike(F.col("_q"), F.concat(F.lit("(?<![a-z0-9])"), t, F.lit("(?![a-z0-9])")))
    known = F.filter(words(OBJECTS), lambda t: F.when(t.rlike(_ASCII_TERM), ascii_object(t)).otherwise(F.contains("_q", t)))
    rows = rows.withColumn("object_terms", F.array_distinct(F.concat(known, F.filter("terms", lambda t: t.rlike(_ASCII_TERM)))))
    rows = rows.withColumn("hard_aspect_terms", F.filter(words(ASPECTS), lambda a: F.contains("_q", a)))
    soft = F.filter("terms", lambda t: (F.length(t) >= 2) & ~t.rlike(_ASCII_TERM) & ~F.array_contains("object_terms", t))
    rows = rows.withColumn("aspect_terms", F.array_distinct(F.concat("hard_aspect_terms", soft)))
    return rows.select("query_id", "terms", "object_terms", "aspect_terms", "hard_aspect_terms", F.exists(words(COMPARISON), lambda m: F.contains("_q", m)).alias("is_comparison"))


def evidence_parts(text: Column, most: int = 420) -> Column:
    """Sentences of a text; longer ones are cut into overlapping pieces of ``most`` characters."""
    stride = max(120, int(most * 0.65))
    ends = "。！？!?；;"
    parts = F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"[^{ends}\\n]*[{ends}]|[^{ends}\\n]+"), 0), strip), lambda p: p != "")
    parts = F.when((F.size(parts) == 0) & (strip(text) != ""), F.array(strip(text))).otherwise(parts)
    last = lambda p: F.greatest(F.ceil((F.length(p) - most) / stride), F.lit(0)).cast("int")
    cut = lambda p: F.filter(F.transform(F.sequence(F.lit(0), last(p)), lambda k: strip(F.substring(p, k * stride + 1, F.lit(most)))), lambda x: x != "")
    return F.flatten(F.transform(parts, cut))


def evidence_windows(rows: DataFrame, key: str = "row_id", most: int = 420) -> DataFrame:
    """(key, window_pos, window): each part with the ones before and after, at most twice ``most`` characters."""
    held = rows.select(key, evidence_parts(F.col("text"), most).alias("_parts"))
    held = held.select(key, "_parts", F.posexplode("_parts").alias("window_pos", "_part"))
    around = F.concat_ws(" ", F.try_element_at("_parts", F.when(F.col("window_pos") > 0, F.col("window_pos")).otherwise(F.size("_parts") + 1)), F.col("_part"), F.try_element_at("_parts", F.col("window_pos") + 2))
    return held.select(key, "window_pos", strip(F.left(strip(around), F.lit(2 * most))).alias("window"))


def direct_gate(queries: DataFrame, results: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """(query_id, best_score, best_window, term_hits, min_hits, reasons, passed): the best evidence window of each query.

    ``results``: query_id, rank, text, evidence_type and scores; only direct rows give windows, ties go to the earliest.
    """
    facets = query_facets(queries)
    need = F.greatest(F.lit(config.direct_hits), F.when(F.size("terms") > 0, F.ceil(F.size("terms") * config.direct_coverage)).otherwise(0)).cast("int")
    # the key of a window: where it stands among the results of its query
    direct = results.where(is_direct()).select(F.struct("query_id", "rank").alias("at"), "text")
    windows = evidence_windows(direct, "at", config.direct_window_chars).select("at.query_id", "at.rank", "window_pos", "window")
    seen = windows.withColumn("_w", normalize_text(F.col("window"))).join(facets, "query_id")
    hits = lambda c: F.size(F.filter(c, lambda t: F.contains("_w", t)))
    seen = seen.withColumn("term_hits", hits("terms")).withColumn("object_hits", hits("object_terms")).withColumn("hard_hits", hits("hard_aspect_terms"))
    score = F.col("term_hits") + 1.5 * F.col("object_hits") + 1.25 * hits("aspect_terms") + 1.75 * F.col("hard_hits") + term_coverage(F.col("terms"), F.col("_w"))
    seen = seen.withColumn("score", score)
    best = seen.groupBy("query_id").agg(F.max_by(F.struct("score", "window", "term_hits", "object_hits", "hard_hits"), F.struct("score", -F.col("rank"), -F.col("window_pos"))).alias("b"))
    rows = facets.withColumn("min_hits", need).join(best, "query_id", "left")
    none = F.col("b").isNull()
    reasons = F.when(none, F.array(F.lit("no_direct_evidence_windows"))).otherwise(_reasons(
        ("low_direct_term_hits", F.col("b.term_hits") < F.col("min_hits")),
        ("missing_comparison_objects", F.col("is_comparison") & (F.size("object_terms") >= 2) & (F.col("b.object_hits") < 2)),
        ("missing_question_aspect", (F.size("hard_aspect_terms") > 0) & (F.col("b.hard_hits") == 0)),
    ))
    return rows.select(
        "query_id", F.round("b.score", 4).alias("best_score"), F.col("b.window").alias("best_window"), F.coalesce("b.term_hits", F.lit(0)).alias("term_hits"), "min_hits", reasons.alias("reasons")
    ).withColumn("passed", F.size("reasons") == 0)


def finance_claims(text: Column) -> Column:
    """Years, amounts, companies and risks (sorted, distinct) and metrics (in table order) of a text."""
    found = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(p), 0)))
    metrics = F.filter(words(METRICS), lambda m: F.contains(text, m))
    return F.struct(found(COMPANY).alias("companies"), metrics.alias("metrics"), found(YEAR).alias("years"), found(AMOUNT).alias("amounts"), found(RISK).alias("risks"))


def unsupported_claims(answer: Column, normal_context: Column) -> Column:
    """Finance claims of an answer that the context of :func:`normalize_text` does not hold."""
    c = finance_claims(answer)
    claims = F.concat(c["companies"], c["metrics"], c["years"], c["amounts"], c["risks"])
    return F.filter(claims, lambda x: ~F.contains(normal_context, F.regexp_replace(F.lower(x), r"(?U)\s+", "")))


def is_refusal(answer: Column) -> Column:
    """Whether any refusal phrase stands in the answer; null is none."""
    return F.exists(words(REFUSALS), lambda p: F.contains(F.coalesce(answer, F.lit("")), p))


def answer_supported(question_terms: Column, answer: Column, normal_answer: Column, least: float = DEFAULTS.min_answer_coverage) -> Column:
    """Refusals pass; other answers must hold ``least`` of the terms."""
    return is_refusal(answer) | (term_coverage(question_terms, normal_answer) >= least)


WARNING = "以下回答的直接证据不足，请谨慎参考："


def decide_answers(rows: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """(query_id, step, answer) by the first rule that holds.

    ``rows``: query_id, query, context, results_given, sufficient, confident, direct (booleans of the gates) and raw_answer
    (null where no generator ran).
    """
    gates = F.lit(config.enforce_answerability)
    given = F.col("results_given")
    weak = given & gates & (~F.col("sufficient") | ~F.col("confident"))
    indirect = given & gates & F.lit(config.direct_gate) & ~F.col("direct")
    strict = config.high_risk or config.uncertain_policy == "reject"
    rows = rows.withColumn("_context", normalize_text(F.col("context"))).withColumn("_terms", content_terms(F.col("query"))).withColumn("_answer", normalize_text(F.col("raw_answer")))
    thin = ~given & gates & ((strip(F.coalesce("context", F.lit(""))) == "") | (term_coverage(F.col("_terms"), F.col("_context")) < config.min_query_coverage))
    poor = gates & ~answer_supported(F.col("_terms"), F.col("raw_answer"), F.col("_answer"), config.min_answer_coverage)
    finance = config.high_risk or config.domain_profile == "finance"
    unproved = gates & F.lit(finance) & ~is_refusal(F.col("raw_answer")) & (F.size(unsupported_claims(F.col("raw_answer"), F.col("_context"))) > 0)
    warn = indirect & F.lit(config.uncertain_policy == "warn") & ~is_refusal(F.col("raw_answer")) & ~F.startswith("raw_answer", F.lit(WARNING))
    step = (
        F.when(weak, 1).when(indirect & F.lit(strict), 2).when(thin, 4).when(F.col("raw_answer").isNull(), 5).when(poor, 6).when(unproved, 7).when(warn, 8).otherwise(9)
    )
    rows = rows.withColumn("step", step)
    answer = F.when(F.col("step").isin(1, 2, 4, 6, 7), REFUSAL).when(F.col("step") == 5, F.col("context")).when(F.col("step") == 8, F.concat(F.lit(WARNING + "\n\n"), "raw_answer")).otherwise(F.col("raw_answer"))
    return rows.select("query_id", "step", answer.alias("answer"))


def clean_answer(raw: Column) -> Column:
    """The answer text of a generator's raw output: JSON payload, answer marker, quotes and numbering removed."""
    t = strip(nfkc(F.coalesce(raw, F.lit(""))))
    payload = F.from_json(F.regexp_extract(t, r"(?s)\{.*\}", 0), "answerable boolean, answer string")
    parsed = strip(F.coalesce(payload["answer"], F.lit("")))
    marked = F.when(t.rlike(r"(?is)(^|\n)answer:"), strip(F.regexp_replace(t, r"(?is)^(?:answer:|.*?\nanswer:)", ""))).otherwise(t)
    body = F.when((parsed != "") & (parsed != t), parsed).otherwise(marked)
    # What is stripped from an answer, in this order.
    for pattern, by in ((r"(?U)^\s*[\"'{]+", ""), (r"(?U)[\"'}]+\s*$", ""), (r"(?is)^\s*answerable\s*:.*?\n+", ""),
                        (r"\n?\s*[\"']?[0-9]+\s*([^\"\n]{2,20})[\"']?\s*:", "\n\n$1:"), (r"\n{3,}", "\n\n")):
        body = F.regexp_replace(body, pattern, by)
    return F.when(payload["answerable"] == False, REFUSAL).otherwise(strip(body))  # noqa: E712


def prompt_text(question: Column, context: Column, most: int = 2000) -> Column:
    """The generator's prompt: instructions, the context cut to ``most`` characters, the question."""
    return F.format_string("只依据资料回答，资料不足时回答“%s”。\n\n资料：\n%s\n\n问题：%s", F.lit(REFUSAL), F.left(F.coalesce(context, F.lit("")), F.lit(most)), question)

