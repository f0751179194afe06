"""Statements, contracts and manifests made from the rows of orders, a text for each, and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalogue.standins import read
from weft.functions.text import json_object, looks_like_sql, properties
from weft.operators.reports import orphans
from weft.sources import contracts, manifests, sqltext

N, C = "o_orderkey", "o_custkey"


def _texts(spark: SparkSession, sf: str, *templates: str) -> DataFrame:
    """(n, c, t) for each order: its key, its customer's, and a text, by turns of one template and the next. In a text #n
    stands for the key, #c for the customer's, #9 for that modulo 9."""
    pick = F.lit(None).cast("string")
    for i, template in enumerate(templates):
        pick = F.when(F.col(N) % len(templates) == i, F.lit(template)).otherwise(pick)
    filled = F.replace(F.replace(F.replace(pick, F.lit("#n"), F.col(N).cast("string")), F.lit("#c"), F.col(C).cast("string")), F.lit("#9"), (F.col(C) % 9).cast("string"))
    return read(spark, sf, "orders").select(F.col(N).alias("n"), F.col(C).alias("c"), filled.alias("t"))


SQL = (
    "INSERT INTO day#9 (day, total#9) SELECT o.day, sum(x) FROM orders#c o JOIN items i ON i.oid = o.id",
    "CREATE TABLE IF NOT EXISTS T#n (id BIGINT PRIMARY KEY, price DECIMAL(10, 2) CHECK (price > (0)), f#9 BIGINT REFERENCES o#9(id), CONSTRAINT u UNIQUE (id, f#9)); CREATE TABLE z#n (id BIGINT);",
    "UPDATE c#c SET name = 'x' WHERE id IN (SELECT id FROM gone#9); DELETE FROM gone#9",
    'CREATE VIEW "Best#n" AS SELECT * FROM day#9',
    "",
)


def sql_lineage(spark, sf):
    return _texts(spark, sf, *SQL).select("n", F.inline(sqltext.lineage(F.col("t"))))


def sql_columns(spark, sf):
    return _texts(spark, sf, *SQL).select("n", F.explode(sqltext.written_columns(F.col("t"))).alias("column"))


def fk_edges(spark, sf):
    return sqltext.foreign_keys(_texts(spark, sf, *SQL).select(F.col("t").alias("sql")))[1]


def orphan_tables(spark, sf):
    tables, keys = sqltext.foreign_keys(_texts(spark, sf, *SQL).select(F.col("t").alias("sql")))
    return orphans(tables, keys, tables.filter("false").select(F.col("table").alias("resource_id")))


def proto_rpc(spark, sf):
    text = 'syntax = "proto3"; service S#n { rpc Place#9 (Order) returns (Ack); rpc Cancel(Id) returns (Ack); } message Order { string id = 1; } service Stock { rpc Count (Id) returns (N); }'
    return _texts(spark, sf, text).select("n", F.explode(contracts.grpc_methods(F.col("t"))).alias("method"))


def graphql_fields(spark, sf):
    text = "type Query {\n  order#n(id: ID!): Order\n  orders: [Order]\n}\ntype Order { id: ID }\ntype Mutation {\n  place#9(input: New): Order\n}"
    return _texts(spark, sf, text).select("n", F.explode(contracts.graphql_fields(F.col("t"))).alias("field"))


def openapi_ops(spark, sf):
    text = '{"openapi": "3.0.0", "paths": {"/orders#9": {"get": {}, "post": {}, "parameters": []}, "/orders/#n/{id}": {"delete": {"x": 1}}}}'
    return _texts(spark, sf, text).select("n", F.explode(contracts.openapi_operations(F.col("t"))).alias("operation"))


def npm_deps(spark, sf):
    text = '{"name": "shop", "dependencies": {"kafkajs": "^2.2.#9", "@scope/ui#n": "~1.0.0"}, "devDependencies": {"jest": ">=29.#c.0"}}'
    return _texts(spark, sf, text).select("n", F.inline(manifests.npm_dependencies(F.col("t"))))


def pom_deps(spark, sf):
    text = "<project><groupId>own</groupId>\n<artifactId>shop#n</artifactId><dependencies><dependency><groupId>org.springframework.kafka</groupId> <artifactId>spring-#9</artifactId></dependency></dependencies></project>"
    return _texts(spark, sf, text).select("n", F.inline(manifests.maven_dependencies(F.col("t"))))


def properties_map(spark, sf):
    text = "# names\nkafka.topic = orders#9\nempty=\nurl#9=http://x/#n?a=b\nkafka.topic=late#c\nnot a line"
    return _texts(spark, sf, text).select("n", F.explode(properties(F.col("t"))).alias("key", "value"))


def python_requirements(spark, sf):
    text = "# pins\nRequests#9>=2.0\nkafka-python#n==2.0.2 ; x\n\n-e .\nhttpx\nrequests#9"
    return _texts(spark, sf, text).select("n", F.explode(manifests.requirement_names(F.col("t"))).alias("name"))


def json_answers(spark, sf):
    texts = ('{"a": #n}', 'Sure.\n```json\n{"a": #c}\n```', 'I say {"a": #9} so', "no #n", "[#n]", "")
    return _texts(spark, sf, *texts).select("n", F.try_variant_get(json_object(F.col("t")), "$.a", "int").alias("a"))


def sql_heads(spark, sf):
    return _texts(spark, sf, " select #n", "WITH x#9 AS (SELECT #n)", "without #n", "update t#n", "hello #c").select("n", looks_like_sql(F.col("t")).alias("is_sql"))


QUERIES = {f.__name__: f for f in (sql_lineage, sql_columns, fk_edges, orphan_tables, proto_rpc, graphql_fields, openapi_ops, npm_deps, pom_deps, properties_map, python_requirements, json_answers, sql_heads)}

_O = "o AS (SELECT o_orderkey AS n, o_custkey AS c, o_custkey % 9 AS k FROM orders)"


def _each(columns: str, *rows: tuple[str, ...]) -> str:
    """A select over o for each row of expressions; the last one of a row may say for which orders."""
    names = columns.split(", ")
    return f"WITH {_O} " + " UNION ALL ".join("SELECT n, " + ", ".join(f'{v} AS "{x}"' for v, x in zip(row, names, strict=False)) + f" FROM o{f' WHERE {row[-1]}' if len(row) > len(names) else ''}" for row in rows)


ORACLES = {
    "sql_lineage": _each(
        "direction, table", ("'WRITES'", "'day' || k", "n % 5 = 0"), ("'READS'", "'orders' || c", "n % 5 = 0"), ("'READS'", "'items'", "n % 5 = 0"), ("'WRITES'", "'t' || n", "n % 5 = 1"), ("'WRITES'", "'z' || n", "n % 5 = 1"),
        ("'WRITES'", "'c' || c", "n % 5 = 2"), ("'WRITES'", "'gone' || k", "n % 5 = 2"), ("'WRITES'", "'best' || n", "n % 5 = 3"), ("'READS'", "'day' || k", "n % 5 = 3"),
    ),
    "sql_columns": _each(
        "column", ("'day' || k || '.day'", "n % 5 = 0"), ("'day' || k || '.total' || k", "n % 5 = 0"), ("'t' || n || '.id'", "n % 5 = 1"), ("'t' || n || '.price'", "n % 5 = 1"), ("'t' || n || '.f' || k", "n % 5 = 1"), ("'z' || n || '.id'", "n % 5 = 1"),
    ),
    "fk_edges": f"WITH {_O} SELECT 't' || n AS child, 'o' || k AS parent FROM o WHERE n % 5 = 1",
    "orphan_tables": f"WITH {_O} SELECT 'z' || n AS \"table\" FROM o WHERE n % 5 = 1",
    "proto_rpc": _each("method", ("'S' || n || '/Place' || k",), ("'S' || n || '/Cancel'",), ("'Stock/Count'",)),
    "graphql_fields": _each("field", ("'Query.order' || n",), ("'Query.orders'",), ("'Mutation.place' || k",)),
    "openapi_ops": _each("operation", ("'GET /orders' || k",), ("'POST /orders' || k",), ("'DELETE /orders/' || n || '/{id}'",)),
    "npm_deps": _each("purl, scope", ("'pkg:npm/kafkajs@2.2.' || k", "'runtime'"), ("'pkg:npm/@scope/ui' || n || '@1.0.0'", "'runtime'"), ("'pkg:npm/jest@29.' || c || '.0'", "'test'")),
    "pom_deps": _each("purl, scope", ("'pkg:maven/own/shop' || n", "'runtime'"), ("'pkg:maven/org.springframework.kafka/spring-' || k", "'runtime'")),
    "properties_map": _each("key, value", ("'kafka.topic'", "'late' || c"), ("'empty'", "''"), ("'url' || k", "'http://x/' || n || '?a=b'")),
    "python_requirements": _each("name", ("'_e'",), ("'httpx'",), ("'kafka_python' || n",), ("'requests' || k",)),
    "json_answers": f"WITH {_O} SELECT n, (CASE n % 6 WHEN 0 THEN n WHEN 1 THEN c WHEN 2 THEN k END)::INT AS a FROM o",
    "sql_heads": f"WITH {_O} SELECT n, n % 5 IN (0, 1, 3) AS is_sql FROM o",
}
