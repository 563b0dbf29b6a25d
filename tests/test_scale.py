"""Products of queries and files: whole results, without a shuffle of the product."""

from docquarry.operators import graph, lexical

NODES = "index_key string, id string, label string"
ASKED = "query_id bigint, query string"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_label_matches_end_in_a_join(spark):
    nodes = spark.createDataFrame([(f"f{i}", "A", "实体A") for i in range(40)] + [("f1", "A", "实体"), ("f1", "B", "实体A"), ("f1", "A", "实体A"), ("f1", "C", "体"), ("f1", None, None)], NODES)
    asked = spark.createDataFrame([(1, "问实体A吗"), (2, "问实体A吗"), (3, "实体"), (4, None), (5, "问")], ASKED)
    got = graph.label_matches(asked, nodes)
    rows = [tuple(r) for r in got.collect()]
    extra = [("f1", "A", "实体"), ("f1", "B", "实体A")]
    assert sorted(rows) == sorted([(q, f"f{i}", "A", "实体A") for q in (1, 2) for i in range(40)] + [(q, *e) for q in (1, 2) for e in extra] + [(3, "f1", "A", "实体")])
    plan = plan_of(got)  # repeated rows go before the product, not after it
    assert 0 <= plan.index("Join") < plan.index("Aggregate")


def test_synonyms_need_no_files(spark):
    nodes = spark.createDataFrame([("f", "A", "abc"), ("g", "A", "abc")], NODES)
    asked = spark.createDataFrame([(1, "say abc"), (2, "none")], ASKED)
    words = spark.createDataFrame([("abc", "ABC")], "label string, word string")
    got = graph.expand_query(asked, nodes, words)
    assert sorted(map(tuple, got.collect())) == [(1, "say abc ABC"), (2, "none")]
    assert not any("index_key" in line for line in plan_of(got).splitlines() if "LogicalRDD" not in line)


GRAPH = [("f", "A", "aa"), ("f", "A", "bb"), ("f", "B", "cc"), ("f", "C", "dd"), ("g", "A", "aa"), ("g", "B", "zz")]
TEXTS = [(1, "aa bb"), (2, "aa bb"), (3, "cc and aa"), (4, "zz"), (5, "nothing"), (6, None)]


def test_quotas_are_folded_once_a_case(spark):
    nodes, asked = spark.createDataFrame(GRAPH, NODES), spark.createDataFrame(TEXTS, ASKED)
    mentions = spark.createDataFrame([("f", "A", f"c{i}") for i in range(6)] + [("f", "B", "c0"), ("f", "B", "c9"), ("g", "B", "c1")], "index_key string, node_id string, chunk_id string")
    places = [("f", f"c{i}", i, "P" if i < 3 else None) for i in range(6)] + [("f", "c9", 9, "P"), ("g", "c1", 0, "")]
    chunks = spark.createDataFrame(places, "index_key string, chunk_id string, pos int, parent_id string")
    got = graph.recall_under_quotas(asked, nodes, mentions, chunks)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted([(q, "f", c, n) for q in (1, 2, 3) for n, c in enumerate(["c0", "c1", "c3"], 1)] + [(4, "g", "c1", 1)])
    assert "Pandas" not in plan_of(got)


def chunk_table(spark, texts):
    return spark.createDataFrame([(i, "f", i, t) for i, t in enumerate(texts)], "row_id bigint, index_key string, pos int, text string")


def test_top_chunks_rank_negative_scores_behind_zero(spark):
    chunks = chunk_table(spark, ["tt", "tt", ""])  # the only term is in most documents
    asked = spark.createDataFrame([(1, "tt"), (2, "tt"), (3, "other"), (4, "")], ASKED)
    got = lexical.top_chunks(lexical.build_index(chunks), asked, chunks, 2)
    rows = {(r["query_id"], r["rank"]): (r["row_id"], r["score"] < 0) for r in got.collect()}
    assert rows == {(q, r): v for q in (1, 2) for r, v in ((1, (2, False)), (2, (0, True)))} | {(q, r): (r - 1, False) for q in (3, 4) for r in (1, 2)}


def test_scores_are_not_shuffled(spark):
    chunks = chunk_table(spark, ["aa bb aa", "bb cc", "", "dd", "ee"])
    asked = spark.createDataFrame([(1, "aa bb"), (2, "bb aa"), (3, "bb bb"), (4, "zz"), (5, "")], ASKED)
    got = lexical.bm25_scores(lexical.build_index(chunks), asked)
    rows = {(r["query_id"], r["row_id"]): r["score"] for r in got.collect()}
    assert set(rows) == {(q, d) for q in (1, 2, 3) for d in (0, 1)} and rows[1, 0] == rows[2, 0] and rows[3, 1] > rows[1, 1]
    plan = plan_of(got)
    assert "Aggregate" not in plan[: plan.index("MapInArrow")]


def test_recall_ranks_once_an_entity(spark):
    nodes, asked = spark.createDataFrame(GRAPH, NODES), spark.createDataFrame(TEXTS, ASKED)
    mentions = spark.createDataFrame([("f", "A", "c2"), ("f", "A", "c1"), ("f", "A", "c1"), ("g", "B", "c1")], "index_key string, node_id string, chunk_id string")
    chunks = spark.createDataFrame([("f", "c1", 4, "P"), ("f", "c1", 1, None), ("f", "c2", 2, "P"), ("g", "c1", 0, "")], "index_key string, chunk_id string, pos int, parent_id string")
    got = graph.entity_recall(asked, nodes, mentions, chunks)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=str) == sorted([(q, "f", "A", *x) for q in (1, 2, 3) for x in (("c1", 1, None, 1), ("c2", 2, "P", 2))] + [(4, "g", "B", "c1", 0, "", 1)], key=str)
    assert "query_id" not in "".join(line for line in plan_of(got).splitlines() if "Window" in line)


EDGES = "index_key string, edge_pos int, src string, dst string, relation string, weight int"


def test_neighbours_are_ranked_once_a_case(spark):
    nodes, asked = spark.createDataFrame(GRAPH, NODES), spark.createDataFrame(TEXTS, ASKED)
    edges = spark.createDataFrame([("f", 0, "A", "B", "r", 2), ("f", 1, "C", "A", "r", 3), ("g", 0, "A", "B", "r", 1)], EDGES)
    got = graph.neighbour_labels(asked, nodes, edges)
    rows = [tuple(r) for r in got.collect()]
    want = [(q, "f", *x) for q in (1, 2) for x in (("dd", 3, 1), ("cc", 2, 2))] + [(3, "f", "dd", 3, 1), (3, "f", "bb", 2, 2)]
    assert sorted(rows) == sorted(want + [(q, "g", "zz", 1, 1) for q in (1, 2, 3)] + [(4, "g", "aa", 1, 1)])
    assert "query_id" not in "".join(line for line in plan_of(got).splitlines() if "Window" in line)


def test_hops_are_made_once_a_case(spark, monkeypatch):
    nodes, asked = spark.createDataFrame(GRAPH, NODES), spark.createDataFrame(TEXTS, ASKED)
    edges = spark.createDataFrame([("f", 0, "A", "C", "r", 2), ("f", 1, "C", "B", "r", 3)], EDGES)
    written, keep = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.append((name, got := keep(df, name))) or got)
    rows = [tuple(r) for r in graph.multi_hop(asked, nodes, edges).collect()]
    want = [(q, "f", *x) for q in (1, 2) for x in (("C", "dd", 2.0), ("B", "cc", 4.2))] + [(3, "f", "C", "dd", 2.0)]
    assert sorted((*r[:4], round(r[4], 6)) for r in rows) == sorted(want)
    assert [got.count() for name, got in written if name == "hop"] == [2, 1]  # queries 1 and 2 are one case
