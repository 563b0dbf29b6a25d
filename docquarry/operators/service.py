"""Service rows: request validation, context assembly, responses and the sliding-window rate limit."""

from __future__ import annotations

import json
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits and error codes of the protocol.
INVALID, LIMITED, INTERNAL = 40001, 40002, 50001
SEPARATOR = "\n\n---\n\n"


def parse_requests(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """(request_id, query, max_tokens, top_k, model, error_code, error) of JSON payloads.

    max_tokens is 600 by default and must be an integer in [1, 1000]; a bad or non-positive top_k is 5; a model that is
    no string is null; a payload that is no object, or without a query string, is invalid.
    """
    body = F.from_json(F.col(payload), "map<string,string>")
    raw = lambda name: F.try_element_at("_m", F.lit(name))
    kind = lambda name: F.get_json_object(F.col(payload), f"$.{name}")
    quoted = lambda name: F.col(payload).rlike(rf'"{name}"\s*:\s*"')
    has_query = quoted("query") & (F.coalesce(raw("query"), F.lit("")) != "")
    number = lambda name: F.expr(f"try_cast(trim(try_element_at(_m, '{name}')) as double)")
    whole = lambda name: F.when(quoted(name), F.expr(f"try_cast(trim(try_element_at(_m, '{name}')) as int)")).otherwise(F.expr(f"try_cast(try_cast(trim(try_element_at(_m, '{name}')) as double) as int)"))
    rows = rows.withColumn("_m", body)
    given = F.map_contains_key("_m", "max_tokens")
    tokens_ = F.when(given, whole("max_tokens")).otherwise(600)
    rows = rows.withColumn("_tokens", tokens_).withColumn("_top", F.when(F.map_contains_key("_m", "top_k"), whole("top_k")).otherwise(5))
    error = (
        F.when(F.col("_m").isNull() | kind("query").isNull() & ~has_query & F.col("_m").isNull(), "Invalid JSON object")
        .when(~has_query, "Field `query` is required").when(F.col("_tokens").isNull(), "Field `max_tokens` must be int")
        .when(~F.col("_tokens").between(1, 1000), "Field `max_tokens` must be in [1, 1000]")
    )
    rows = rows.withColumn("error", error)
    ok = F.col("error").isNull()
    return rows.select(
        "request_id", F.when(ok, raw("query")).alias("query"), F.when(ok, F.col("_tokens")).alias("max_tokens"),
        F.when(ok, F.when(F.coalesce(F.col("_top"), F.lit(5)) > 0, F.coalesce(F.col("_top"), F.lit(5))).otherwise(5)).alias("top_k"),
        F.when(ok & quoted("model"), raw("model")).alias("model"), F.when(~ok, INVALID).alias("error_code"), "error",
    )


def concat_context(results: DataFrame, group: str, most: Column | int) -> DataFrame:
    """(group, context, chunk_ids): texts in rank order joined by the separator, cut to ``most`` characters; all ids stay.

    ``results``: group, rank, chunk_id, text; a group is one query's final results.
    """
    lines = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.coalesce("text", F.lit("")).alias("text"))))
    rows = results.groupBy(group).agg(lines.alias("_l"))
    limit = F.lit(most) if isinstance(most, int) else most
    return rows.select(group, F.left(F.array_join(F.transform("_l", lambda x: x["text"]), SEPARATOR), limit).alias("context"), F.transform("_l", lambda x: x["chunk_id"]).alias("chunk_ids"))


def response_json(text: Column, context_ids: Column, model: Column, service: str = "docquarry") -> Column:
    """The completion response as JSON, without the fields that depend on the clock."""
    choice = F.struct(F.lit(0).alias("index"), text.alias("text"), context_ids.alias("context"))
    return F.to_json(F.struct(F.coalesce(F.nullif(model, F.lit("")), F.lit(service)).alias("model"), F.lit("text_completion").alias("object"), F.array(choice).alias("choices")))


def gateway_view(response: Column) -> Column:
    """(answer, n_context) of a response: the first choice, with escaped line breaks undone."""
    body = F.from_json(response, "choices array<struct<text:string,context:array<string>>>")["choices"]
    first = F.try_element_at(body, F.lit(1))
    return F.struct(F.replace(F.coalesce(first["text"], F.lit("")), F.lit("\\n"), F.lit("\n")).alias("answer"), F.coalesce(F.size(first["context"]), F.lit(0)).alias("n_context"))


def accept(times: list[float], limit: int, window: float, held: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Sliding-window decisions for times in order, and the accepted times still in the window afterwards."""
    recent = deque(held or [])
    out = []
    for t in times:
        while recent and t - recent[0] > window:
            recent.popleft()
        ok = len(recent) < limit
        if ok:
            recent.append(t)
        out.append(ok)
    return out, list(recent)


def rate_limit(requests: DataFrame, key: str = "user_id", limit: int = 5, window_seconds: float = 1.0) -> DataFrame:
    """(event_id, accepted): at most ``limit`` accepted requests of a key in any window; rejected ones do not count.

    ``requests``: event_id, ts and the key.  The state of a key is its accepted times in the window, and its requests
    are read in order of (ts, event_id) as a stream of Arrow batches sorted by Spark, so a key of any length is never
    held whole.
    """

    def run(frames):
        at, held = None, []
        for frame in frames:
            flags = []
            for k, t in zip(frame["k"].tolist(), frame["t"].tolist()):
                if k != at:
                    at, held = k, []
                ok, held = accept([t], limit, window_seconds, held)
                flags.append(ok[0])
            yield pd.DataFrame({"event_id": frame["event_id"], "accepted": flags})

    rows = requests.select("event_id", F.col(key).cast("string").alias("k"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return rows.repartition("k").sortWithinPartitions("k", "t", "event_id").mapInPandas(run, "event_id bigint, accepted boolean")


def complete(payload: str, retrieve, generate=None) -> dict:
    """One request through validation, retrieval and generation; ``retrieve(query, top_k)`` gives dicts of chunk_id and text."""
    try:
        body = json.loads(payload)
    except ValueError:
        body = None
    if not isinstance(body, dict) or not isinstance(body.get("query"), str) or not body["query"]:
        return {"error": {"code": INVALID, "message": "Field `query` is required" if isinstance(body, dict) else "Invalid JSON object"}}
    try:
        most = int(body.get("max_tokens", 600))
    except (TypeError, ValueError):
        return {"error": {"code": INVALID, "message": "Field `max_tokens` must be int"}}
    if not 1 <= most <= 1000:
        return {"error": {"code": INVALID, "message": "Field `max_tokens` must be in [1, 1000]"}}
    try:
        top = int(body.get("top_k", 5))
    except (TypeError, ValueError):
        top = 5
    found = retrieve(body["query"], top if top > 0 else 5)
    context = SEPARATOR.join(r["text"] for r in found)[:most]
    text = generate(body["query"], context) if generate else context
    model = body["model"] if isinstance(body.get("model"), str) and body["model"] else "docquarry"
    return {"model": model, "object": "text_completion", "choices": [{"index": 0, "text": text, "context": [r["chunk_id"] for r in found]}]}
