"""What services offer: OpenAPI, gRPC and GraphQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("get", "post", "put", "delete", "patch")


def openapi_operations(spec: Column) -> Column:
    """Sorted "GET /path" strings of an OpenAPI document in JSON; none for anything else."""
    paths = F.map_entries(F.from_json(F.get_json_object(spec, "$.paths"), "map<string, map<string, string>>"))
    each = F.flatten(F.transform(paths, lambda p: F.transform(F.filter(F.map_keys(p["value"]), lambda m: F.lower(m).isin(*METHODS)), lambda m: F.concat_ws(" ", F.upper(m), p["key"]))))
    return F.array_sort(F.coalesce(each, F.array().cast("array<string>")))


def yaml_as_json(text: Column) -> Column:
    """A YAML document as JSON text, null if it cannot be read or PyYAML is not there."""

    @F.arrow_udf("string")
    def of(values):
        import json

        import pyarrow as pa

        try:
            import yaml
        except ImportError:
            return pa.nulls(len(values), pa.string())
        out = []
        for v in values:
            try:
                out.append(json.dumps(yaml.safe_load(v.as_py() or ""), default=str))
            except Exception:  # noqa: BLE001  a document that is not YAML has no operations
                out.append(None)
        return pa.array(out, pa.string())

    return of(text)


def _blocks(text: Column, block: str, item: str) -> Column:
    """Name and item of every item in every block: two patterns, of two groups and of one."""
    names, bodies = (F.regexp_extract_all(text, F.lit(block), F.lit(g)) for g in (1, 2))
    return F.flatten(F.transform(names, lambda n, i: F.transform(F.regexp_extract_all(F.get(bodies, i), F.lit(item), F.lit(1)), lambda x: F.struct(n.alias("of"), x.alias("name")))))


def grpc_methods(proto: Column) -> Column:
    """Service/Method of a proto file."""
    return F.transform(_blocks(proto, r"service\s+([A-Za-z0-9_]+)\s*\{([^}]*)\}", r"\brpc\s+([A-Za-z0-9_]+)\s*\("), lambda x: F.concat_ws("/", x["of"], x["name"]))


def graphql_fields(schema: Column) -> Column:
    """Query.field and Mutation.field of a GraphQL schema."""
    return F.transform(_blocks(schema, r"type\s+(Query|Mutation)\s*\{([^}]*)\}", r"(?m)^\s*([A-Za-z0-9_]+)\s*[(:]"), lambda x: F.concat_ws(".", x["of"], x["name"]))


def is_openapi(rel_path: Column) -> Column:
    return F.lower(F.regexp_extract(rel_path, "([^/]*)$", 1)).rlike(r"^(?:openapi|swagger).*\.(?:ya?ml|json)$")


def surfaces_of(rel_path: Column, content: Column) -> Column:
    """What a file serves, an array of (kind, signature, endpoint); empty for files that are no contract."""
    path = F.lower(rel_path)
    spec = F.when(path.endswith(".json"), F.when(is_openapi(rel_path), content)).otherwise(yaml_as_json(F.when(is_openapi(rel_path), content)))
    said = lambda found, kind, prefix: F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("signature"), F.concat(F.lit(prefix), s).alias("endpoint")))
    none = F.array().cast("array<struct<kind: string, signature: string, endpoint: string>>")
    return (
        F.when(is_openapi(rel_path), F.coalesce(said(openapi_operations(spec), "REST", ""), none))
        .when(path.endswith(".proto"), said(grpc_methods(content), "GRPC", "grpc:"))
        .when(path.rlike(r"\.(?:graphqls?|gql)$"), said(graphql_fields(content), "GRAPHQL", "graphql:"))
        .otherwise(none)
    )


def surfaces(files: DataFrame) -> DataFrame:
    """(module_id, kind, signature, endpoint, rel_path) of files (module_id, rel_path, content), all served."""
    return files.select("module_id", "rel_path", F.inline(surfaces_of(F.col("rel_path"), F.col("content"))))
