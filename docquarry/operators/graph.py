"""Entity graph: building, query matching, expansion, recall with quotas, introspection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry.functions.text import tokens
from docquarry.storage import materialize

# Gazetteer of technical terms.
TECH_TERMS = "RAG GraphRAG BM25 FAISS OCR Tesseract spaCy PyMuPDF SentenceTransformer all-MiniLM-L6-v2 高血压 糖尿病".split()


def rule_entities(chunks: DataFrame) -> DataFrame:
    """(row_id, index_key, pos, chunk_id, ord, label, type): gazetteer terms, then tokens of two letters or more.

    Terms match without regard to case; tokens need a letter.  Every label counts once a chunk; the type is CONCEPT.
    """
    low = F.lower("text")
    terms = F.filter(F.array(*map(F.lit, TECH_TERMS)), lambda t: F.contains(low, F.lower(t)))
    words = F.filter(tokens(F.col("text")), lambda t: (F.length(t) >= 2) & t.rlike(r"\p{L}"))
    labels = F.array_distinct(F.concat(terms, words))
    return chunks.select("row_id", "index_key", "pos", "chunk_id", F.posexplode(labels).alias("ord", "label")).withColumn("type", F.lit("CONCEPT"))


def register_nodes(entities: DataFrame) -> DataFrame:
    """(index_key, node_id, label, type, first_pos): one node per trimmed label, numbered by first appearance.

    The first type wins, blank ones become CONCEPT; blank labels go.  Numbers come from a window over each file's
    distinct labels.
    """
    rows = entities.withColumn("label", F.trim("label")).where("label <> ''")
    firsts = rows.groupBy("index_key", "label").agg(F.min(F.struct("pos", "ord", "row_id", "type")).alias("first"))
    order = W.partitionBy("index_key").orderBy("first.pos", "first.ord", "first.row_id", "label")
    kind = F.coalesce(F.nullif(F.trim("first.type"), F.lit("")), F.lit("CONCEPT"))
    return firsts.select(
        "index_key", F.format_string("e_%03d", F.row_number().over(order)).alias("node_id"), "label", kind.alias("type"), F.col("first.pos").alias("first_pos")
    )


def register_mentions(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """(index_key, node_id, chunk_id): distinct."""
    rows = entities.select("index_key", F.trim("label").alias("label"), "chunk_id")
    return rows.join(nodes.select("index_key", "label", "node_id"), ["index_key", "label"]).select("index_key", "node_id", "chunk_id").distinct()


def register_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(index_key, src, dst, relation, weight): counted relations between labels registered up to their chunk.

    ``relations``: index_key, pos, from_label, to_label, relation; blank relations and unknown labels go.
    """
    known = nodes.select("index_key", "label", "node_id", "first_pos")
    a = known.toDF("index_key", "from_label", "src", "first_a")
    b = known.toDF("index_key", "to_label", "dst", "first_b")
    rows = relations.select("index_key", "pos", "from_label", "to_label", "relation").where(F.trim(F.coalesce("relation", F.lit(""))) != "")
    rows = rows.join(a, ["index_key", "from_label"]).join(b, ["index_key", "to_label"]).where("first_a <= pos and first_b <= pos")
    return rows.groupBy("index_key", "src", "dst", F.trim("relation").alias("relation")).agg(F.count(F.lit(1)).cast("int").alias("weight"))


def clean_edges(edges: DataFrame) -> DataFrame:
    """Edges with defaults (relation related_to, weight 1), repeated rows once; order by edge_pos."""
    rows = edges.where("src is not null and dst is not null and src <> '' and dst <> ''")
    rows = rows.select(
        "index_key", F.col("edge_pos"), "src", "dst", F.coalesce(F.nullif(F.trim("relation"), F.lit("")), F.lit("related_to")).alias("relation"), F.coalesce("weight", F.lit(1)).alias("weight")
    )
    return rows.distinct()


def query_labels(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, label): labels of two characters or more contained in a query, case-sensitively, each once.

    Texts and labels are compared once each, however many queries ask the text and files hold the label.  A label meets
    the texts that hold its first (up to four) characters in an equi-join; no text meets all labels.  Queries with an
    index_key meet the labels of that file only, and keep it in the result.
    """
    own = [c for c in ("index_key",) if c in queries.columns]

    def starts(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("query") - (n - 1), F.lit(1))), lambda i: F.substring(F.col("query"), i, F.lit(n)))

    parts = F.flatten(F.array(*[starts(n) for n in (2, 3, 4)]))
    texts = queries.where(F.length("query") >= 2).select(*own, "query").distinct()
    labels = nodes.where(F.length("label") >= 2).select(*own, "label").distinct()
    asks = texts.select(*own, "query", F.explode(F.array_distinct(parts)).alias("_start"))
    named = labels.select(*own, "label", F.left("label", F.least(F.length("label"), F.lit(4))).alias("_start"))
    pairs = asks.join(named, ["_start", *own]).where(F.contains("query", "label")).select(*own, "query", "label")
    return queries.select("query_id", *own, "query").join(pairs, [*own, "query"]).select("query_id", *own, "label").distinct()


def label_matches(queries: DataFrame, nodes: DataFrame, parts: int = 16) -> DataFrame:
    """(query_id, index_key, id, label): the entities whose label is in a query, see :func:`query_labels`.

    The result has a row for every query and file that share a label, so it grows with the product of both tables.  It
    is joined last and not shuffled again; files are dealt to ``parts`` parts, so that a label of many files is spread.
    """
    hits = query_labels(queries, nodes)
    named = nodes.where(F.length("label") >= 2).select("index_key", "id", "label").distinct()
    if "index_key" in queries.columns:
        return named.join(hits, ["index_key", "label"]).select("query_id", "index_key", "id", "label")
    named = named.withColumn("_part", F.pmod(F.xxhash64("index_key"), F.lit(parts)).cast("int"))
    wide = hits.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return named.join(wide, ["label", "_part"]).select("query_id", "index_key", "id", "label")


@dataclass
class Cases:
    """What queries match in files, each set of labels of a file once: graph results depend on nothing else."""

    labels: DataFrame  # case, index_key, labels (sorted)
    askers: DataFrame  # case, kinds (or query_ids: array)
    members: DataFrame | None  # kind, query_id

    def matched(self, nodes: DataFrame) -> DataFrame:
        """(case, index_key, id): the entities of each case."""
        named = nodes.where(F.length("label") >= 2).select("index_key", "id", "label")
        return self.labels.select("case", "index_key", F.explode("labels").alias("label")).join(named, ["index_key", "label"]).select("case", "index_key", "id").distinct()

    def asked(self, rows: DataFrame) -> DataFrame:
        """``rows`` of cases as rows of all queries that have the case; this product is not shuffled."""
        rows = rows.join(self.askers, "case")
        if self.members is None:
            return rows.withColumn("query_id", F.explode("query_ids")).drop("case", "query_ids")
        return rows.withColumn("kind", F.explode("kinds")).drop("case", "kinds").join(F.broadcast(self.members), "kind").drop("kind")  # 16 bytes a query


def label_cases(queries: DataFrame, nodes: DataFrame) -> Cases:
    """The cases of :func:`query_labels`; queries of equal labels are one kind, and kinds meet the files once.

    The kinds' labels are broadcast to the nodes, which lie by file, so what a kind matches in a file is not shuffled.
    """
    number = F.monotonically_increasing_id()
    if "index_key" in queries.columns:
        own = query_labels(queries, nodes).groupBy("query_id", "index_key").agg(F.array_sort(F.collect_list("label")).alias("labels"))
        cases = materialize(own.groupBy("index_key", "labels").agg(F.collect_list("query_id").alias("query_ids")).withColumn("case", number), "cases")
        return Cases(cases.select("case", "index_key", "labels"), cases.select("case", "query_ids"), None)
    lists = query_labels(queries, nodes).groupBy("query_id").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    kinds = materialize(lists.groupBy("labels").agg(F.collect_list("query_id").alias("query_ids")).withColumn("kind", number), "kinds")
    spark = nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    named = nodes.where(F.length("label") >= 2).select("index_key", "label").distinct().repartition(parts, "index_key")
    met = named.join(F.broadcast(kinds.select("kind", F.explode("labels").alias("label"))), "label")  # labels of queries only
    files = met.groupBy("index_key", "kind").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    cases = files.groupBy("index_key", "labels").agg(F.collect_list("kind").alias("kinds")).withColumn("case", number)
    cases = materialize(cases, "cases")
    return Cases(cases.select("case", "index_key", "labels"), cases.select("case", "kinds"), kinds.select("kind", F.explode("query_ids").alias("query_id")))


def multi_hop(queries: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(query_id, index_key, id, label, score): entities within ``depth`` hops of the matched ones, first visit wins.

    Edges count both ways; the score is that of the node before times the weight times 0.7 ** (hops of the node
    before).  Neighbours whose label is under two characters or in the query are visited, but not expanded.  Of several
    ways into a node in one hop the one from the earliest frontier node, then the earliest edge, counts.  Hops are made
    once for each case of matched labels; a label of the file is in a query where it is among those of the case.
    """
    cases = label_cases(queries, nodes)
    both = edges.select("index_key", F.col("src").alias("at"), F.col("dst").alias("to"), "weight", "edge_pos", F.lit(0).alias("back")).unionByName(
        edges.select("index_key", F.col("dst").alias("at"), F.col("src").alias("to"), "weight", "edge_pos", F.lit(1).alias("back"))
    )
    labels = nodes.select("index_key", F.col("id").alias("to"), "label")
    keys = ["case", "index_key"]
    frontier = cases.matched(nodes).select(*keys, "id", F.lit(1.0).alias("score"), F.array(F.col("id")).alias("path"))
    visited = frontier.select(*keys, "id")
    found = None
    for hop in range(depth):
        step = frontier.join(both, (frontier.index_key == both.index_key) & (frontier.id == both["at"])).select(
            frontier["case"], frontier.index_key, F.col("to"), (F.col("score") * F.col("weight") * 0.7**hop).alias("score"), "path", "edge_pos", "back"
        )
        step = step.join(visited.withColumnRenamed("id", "to"), [*keys, "to"], "left_anti")
        first = step.groupBy(*keys, "to").agg(F.min(F.struct("path", "edge_pos", "back", "score")).alias("way"))
        first = first.join(labels, ["index_key", "to"], "left").join(cases.labels, keys)
        order = F.concat("way.path", F.array(F.format_string("%08d", "way.edge_pos"), F.col("to")))
        first = first.select(*keys, F.col("to").alias("id"), "label", F.col("way.score").alias("score"), order.alias("path"),
                             ((F.length("label") >= 2) & ~F.array_contains("labels", F.col("label"))).alias("good"))
        first = materialize(first, "hop")
        visited = visited.unionByName(first.select(*keys, "id"))
        frontier = first.where("good").select(*keys, "id", "score", "path")
        part = first.where("good").select(*keys, "id", "label", "score")
        found = part if found is None else found.unionByName(part)
    return None if found is None else cases.asked(found).select("query_id", "index_key", "id", "label", "score")


def _recalled(cases: Cases, nodes: DataFrame, mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(case, index_key, id, chunk_id, pos, parent_id, entity_rank): the chunks of the entities of every case.

    The rank is the entity's own, so chunks are ranked before they meet the cases.
    """
    matched = cases.matched(nodes)
    first = chunks.groupBy("index_key", "chunk_id").agg(F.min(F.struct("pos", "parent_id")).alias("at"))
    rows = mentions.select("index_key", F.col("node_id").alias("id"), "chunk_id").distinct().join(matched.select("index_key", "id").distinct(), ["index_key", "id"], "left_semi")
    order = W.partitionBy("index_key", "id").orderBy("at.pos", "chunk_id")
    rows = rows.join(first, ["index_key", "chunk_id"]).withColumn("entity_rank", F.row_number().over(order))
    return matched.join(rows, ["index_key", "id"]).select("case", "index_key", "id", "chunk_id", F.col("at.pos").alias("pos"), F.col("at.parent_id").alias("parent_id"), "entity_rank")


def entity_recall(queries: DataFrame, nodes: DataFrame, mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, index_key, id, chunk_id, pos, parent_id, entity_rank): distinct chunks of the matched entities, in order."""
    cases = label_cases(queries, nodes)
    rows = cases.asked(_recalled(cases, nodes, mentions, chunks))
    return rows.select("query_id", "index_key", "id", "chunk_id", "pos", "parent_id", "entity_rank")


def recall_with_quotas(recalled: DataFrame, per_entity: int = 3, per_parent: int = 2, key: str = "query_id") -> DataFrame:
    """(query_id, index_key, chunk_id, seq): recalled chunks under quotas per entity and per parent, in selection order.

    Entities in order of id, chunks in order of position; a chunk already selected does not use up its entity's quota.
    A quota of 0 or less is none.  The fold is sequential by meaning; a group is what one query (or ``key``) matches in
    one file.
    """
    parent = F.coalesce("parent_id", F.lit(""))
    order = F.array_sort(F.collect_list(F.struct("id", "entity_rank", "chunk_id", parent.alias("parent"))))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("picked"), none.alias("parents"), F.lit("").alias("entity"), F.lit(0).alias("taken"))

    def step(s: Column, x: Column) -> Column:
        before = F.when(s["entity"] == x["id"], s["taken"]).otherwise(F.lit(0))
        ok = ~F.array_contains(s["picked"], x["chunk_id"])
        if per_entity > 0:
            ok = ok & (before < per_entity)
        if per_parent > 0:
            ok = ok & ((x["parent"] == "") | (F.size(F.filter(s["parents"], lambda p: p == x["parent"])) < per_parent))
        return F.struct(
            F.when(ok, F.concat(s["picked"], F.array(x["chunk_id"]))).otherwise(s["picked"]).alias("picked"),
            F.when(ok, F.concat(s["parents"], F.array(x["parent"]))).otherwise(s["parents"]).alias("parents"),
            x["id"].alias("entity"), (before + ok.cast("int")).alias("taken"),
        )

    folded = recalled.groupBy(key, "index_key").agg(order.alias("rows")).select(key, "index_key", F.aggregate("rows", start, step)["picked"].alias("picked"))
    return folded.select(key, "index_key", F.posexplode("picked").alias("_n", "chunk_id")).select(key, "index_key", "chunk_id", (F.col("_n") + 1).alias("seq"))


def recall_under_quotas(queries: DataFrame, nodes: DataFrame, mentions: DataFrame, chunks: DataFrame, per_entity: int = 3, per_parent: int = 2) -> DataFrame:
    """(query_id, index_key, chunk_id, seq): :func:`recall_with_quotas` of :func:`entity_recall`, folded once a case."""
    cases = label_cases(queries, nodes)
    picked = recall_with_quotas(_recalled(cases, nodes, mentions, chunks), per_entity, per_parent, "case")
    return cases.asked(picked).select("query_id", "index_key", "chunk_id", "seq")


def neighbour_labels(queries: DataFrame, nodes: DataFrame, edges: DataFrame, top: int = 2) -> DataFrame:
    """(query_id, index_key, label, weight, rank): the heaviest neighbours of matched entities whose label is not in the query.

    The far end of an edge is its target where the source matches and the target qualifies, else its source where the
    target matches.  Ties go by label.  Neighbours are ranked once for each case of matched labels.
    """
    cases = label_cases(queries, nodes)
    hit = cases.matched(nodes)
    named = nodes.select("index_key", "id", "label")
    src, dst = named.toDF("index_key", "src", "src_label"), named.toDF("index_key", "dst", "dst_label")
    rows = edges.join(src, ["index_key", "src"], "left").join(dst, ["index_key", "dst"], "left")
    forward = rows.join(hit.withColumnRenamed("id", "src"), ["index_key", "src"]).select("case", "index_key", "edge_pos", F.col("dst_label").alias("label"), "weight", F.lit(0).alias("way"))
    backward = rows.join(hit.withColumnRenamed("id", "dst"), ["index_key", "dst"]).select("case", "index_key", "edge_pos", F.col("src_label").alias("label"), "weight", F.lit(1).alias("way"))
    far = forward.unionByName(backward).join(cases.labels.select("case", "labels"), "case").where((F.length("label") >= 2) & ~F.array_contains("labels", F.col("label")))
    far = far.groupBy("case", "index_key", "edge_pos").agg(F.min(F.struct("way", "label", "weight")).alias("f")).select("case", "index_key", "f.label", "f.weight")
    best = far.groupBy("case", "index_key", "label").agg(F.max("weight").alias("weight"))
    order = W.partitionBy("case", "index_key").orderBy(F.col("weight").desc(), "label")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return cases.asked(best).select("query_id", "index_key", "label", "weight", "rank")


def expand_query(queries: DataFrame, nodes: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query_id, expanded_query): the query with the synonyms of the labels in it that it does not hold yet, sorted.

    ``synonyms``: label, word.
    """
    words = query_labels(queries, nodes).join(synonyms, "label").join(queries.select("query_id", "query"), "query_id")
    words = words.where(~F.contains("query", "word")).groupBy("query_id").agg(F.array_sort(F.collect_set("word")).alias("words"))
    rows = queries.select("query_id", "query").join(words, "query_id", "left")
    return rows.select("query_id", F.when(F.col("words").isNull(), F.col("query")).otherwise(F.concat_ws(" ", "query", F.array_join("words", " "))).alias("expanded_query"))


def chunk_labels(nodes: DataFrame, mentions: DataFrame, limit: int = 12) -> DataFrame:
    """(index_key, chunk_id, labels): the sorted labels mentioned in each chunk, at most ``limit``."""
    rows = mentions.distinct().join(nodes.select("index_key", F.col("id").alias("node_id"), "label"), ["index_key", "node_id"]).where("label is not null")
    order = W.partitionBy("index_key", "chunk_id").orderBy("label")
    rows = rows.select("index_key", "chunk_id", "label").distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
    return rows.groupBy("index_key", "chunk_id").agg(F.array_sort(F.collect_list("label")).alias("labels"))


def graph_summary(nodes: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """(index_key, nodes, edges, covered_chunks, total_weight) of each file's graph."""
    n = nodes.groupBy("index_key").agg(F.count_distinct("id").alias("nodes"))
    e = edges.groupBy("index_key").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("total_weight"))
    m = mentions.groupBy("index_key").agg(F.count_distinct("chunk_id").alias("covered_chunks"))
    rows = n.join(e, "index_key", "full_outer").join(m, "index_key", "full_outer")
    return rows.na.fill(0).select("index_key", "nodes", "edges", "covered_chunks", "total_weight")


def extract_with(chunks: DataFrame, extractor, batch: int = 5) -> DataFrame:
    """(row_id, entities, relations): a pluggable extractor over batches, halved down to single texts on failure.

    ``extractor`` takes a list of texts and returns one dict (entities: label and type; relations: from_label, to_label,
    relation) for each; a text that fails alone has null lists.
    """

    def resilient(texts: list[str]) -> list[dict | None]:
        try:
            got = extractor(texts)
            if not isinstance(got, list) or len(got) != len(texts):
                raise ValueError("one result a text is needed")
            return got
        except Exception:
            if len(texts) == 1:
                return [None]
            half = len(texts) // 2
            return resilient(texts[:half]) + resilient(texts[half:])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            got = [r for i in range(0, len(texts), batch) for r in resilient(texts[i : i + batch])]
            yield pd.DataFrame({
                "row_id": frame["row_id"],
                "entities": [r and [(e.get("label"), e.get("type")) for e in r.get("entities", [])] for r in got],
                "relations": [r and [(x.get("from_label"), x.get("to_label"), x.get("relation")) for x in r.get("relations", [])] for r in got],
            })

    schema = "row_id bigint, entities array<struct<label:string,type:string>>, relations array<struct<from_label:string,to_label:string,relation:string>>"
    return chunks.select("row_id", "text").mapInPandas(run, schema)
