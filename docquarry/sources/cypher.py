"""Graph store over Cypher as a Spark data source; the driver package is optional and imported on the executors only."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# part -> (schema, read statement, write statement); rows belong to one index_key, which is also the unit of a read task
PARTS = {
    "nodes": (
        "index_key string, id string, label string, type string",
        "MATCH (n:Entity {index_key: $key}) RETURN n.index_key AS index_key, n.id AS id, n.label AS label, n.type AS type ORDER BY id",
        "UNWIND $rows AS r MERGE (n:Entity {index_key: r.index_key, id: r.id}) SET n.label = r.label, n.type = r.type",
    ),
    "edges": (
        "index_key string, src string, dst string, relation string, weight int",
        "MATCH (a:Entity {index_key: $key})-[e:RELATED]->(b:Entity) RETURN a.index_key AS index_key, a.id AS src, b.id AS dst, "
        "coalesce(e.relation, 'related_to') AS relation, coalesce(e.weight, 1) AS weight ORDER BY weight DESC",
        "UNWIND $rows AS r MATCH (a:Entity {index_key: r.index_key, id: r.src}), (b:Entity {index_key: r.index_key, id: r.dst}) "
        "MERGE (a)-[e:RELATED {relation: r.relation}]->(b) SET e.weight = r.weight",
    ),
    "mentions": (
        "index_key string, node_id string, chunk_id string",
        "MATCH (n:Entity {index_key: $key})-[:MENTIONED_IN]->(c:Chunk) RETURN n.index_key AS index_key, n.id AS node_id, c.id AS chunk_id",
        "UNWIND $rows AS r MATCH (n:Entity {index_key: r.index_key, id: r.node_id}) "
        "MERGE (c:Chunk {index_key: r.index_key, id: r.chunk_id}) MERGE (n)-[:MENTIONED_IN]->(c)",
    ),
}


def connect(options: dict):
    """A driver for options uri, user, password; ``module`` names another package with the same interface (tests)."""
    import importlib

    module = importlib.import_module(options.get("module", "neo4j"))
    return module.GraphDatabase.driver(options["uri"], auth=(options.get("user", ""), options.get("password", "")))


class CypherReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in self.options["keys"].split(",") if k]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        schema, statement, _ = PARTS[self.options["part"]]
        names = [c.split()[0] for c in schema.split(", ")]
        with connect(self.options) as driver, driver.session() as session:
            for record in session.run(statement, key=partition.value):
                yield tuple(record[n] for n in names)


class CypherWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.options = options

    def write(self, rows: Iterator) -> WriterCommitMessage:
        _, _, statement = PARTS[self.options["part"]]
        with connect(self.options) as driver, driver.session() as session:
            batch: list[dict] = []
            for row in rows:
                batch.append(row.asDict())
                if len(batch) == 1000:
                    session.run(statement, rows=batch)
                    batch = []
            if batch:
                session.run(statement, rows=batch)
        return WriterCommitMessage()


class CypherSource(DataSource):
    """format("cypher") with options part (nodes, edges, mentions), uri, keys (comma-separated) and credentials."""

    @classmethod
    def name(cls) -> str:
        return "cypher"

    def schema(self) -> str:
        return PARTS[self.options["part"]][0]

    def reader(self, schema) -> DataSourceReader:
        return CypherReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return CypherWriter(dict(self.options))


def read_part(spark: SparkSession, part: str, keys: list[str], **options: str) -> DataFrame:
    """One part of the graphs of ``keys``."""
    spark.dataSource.register(CypherSource)
    return spark.read.format("cypher").options(part=part, keys=",".join(keys), **options).load()


def write_part(rows: DataFrame, part: str, **options: str) -> None:
    """Write one part; existing nodes and relations are merged, so a repeated task changes nothing."""
    rows.sparkSession.dataSource.register(CypherSource)
    names = [c.split()[0] for c in PARTS[part][0].split(", ")]
    rows.select(*names).write.format("cypher").options(part=part, **options).mode("append").save()
