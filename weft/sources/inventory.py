"""Project inventories of a code host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PROJECT = "struct<id: bigint, path_with_namespace: string, http_url_to_repo: string, name: string>"


def _schema(depth: int) -> str:
    inner = f", subgroups: array<{_schema(depth - 1)}>" if depth else ""
    return f"struct<id: bigint, full_path: string, projects: array<{_PROJECT}>{inner}>"


def nesting(text: Column) -> Column:
    """How deep the groups of a JSON text nest; 0 where it is no JSON."""

    @F.arrow_udf("int")
    def of(values):
        import json

        import pyarrow as pa

        def deep(text):
            try:
                todo = [(json.loads(text), 0)]
            except (TypeError, ValueError):
                return 0
            most = 0
            while todo:
                node, level = todo.pop()
                most = max(most, level)
                if isinstance(node, dict):
                    todo += [(x, level + (k == "subgroups")) for k, x in node.items()]
                elif isinstance(node, list):
                    todo += [(x, level) for x in node]
            return most

        return pa.array([deep(v.as_py()) for v in values], pa.int32())

    return of(text)


def parse(spark: SparkSession, text: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, path, url, name) from JSON text (column value): nested groups, or a flat list of projects.

    An id that occurs again adds only what is missing. Groups may nest as deep as they do: without a depth it is read
    from the text."""
    if depth is None:
        depth = text.agg(F.max(nesting(F.col("value")))).first()[0] or 0
    none = F.array().cast(f"array<{_PROJECT}>")
    grouped = F.from_json("value", f"struct<groups: array<{_schema(depth)}>, projects: array<{_PROJECT}>>")

    def below(groups: Column, left: int) -> Column:
        own = F.flatten(F.transform(groups, lambda g: F.coalesce(g["projects"], none)))
        if not left:
            return own
        return F.concat(own, F.flatten(F.transform(groups, lambda g: F.coalesce(below(g["subgroups"], left - 1), none))))

    flat = F.from_json("value", f"array<{_PROJECT}>")
    found = F.when(F.col("value").rlike(r"^\s*\["), flat).otherwise(F.concat(F.coalesce(grouped["projects"], none), F.coalesce(below(grouped["groups"], depth), none)))
    rows = text.select(F.posexplode(found).alias("seq", "p")).select("seq", "p.*").filter("id is not null")
    first = lambda c: F.min_by(c, F.when(F.length(F.coalesce(c, F.lit(""))) > 0, F.col("seq")))
    path, url = first("path_with_namespace"), first("http_url_to_repo")
    return rows.groupBy("id").agg(path.alias("path"), url.alias("url"), first("name").alias("name")).select("id", "path", "url", F.coalesce("name", F.regexp_extract("path", "([^/]*)$", 1)).alias("name"))


def request(base: str, project: str, token: str | None) -> tuple[str, dict[str, str]]:
    """The address and the headers that ask a host for one project."""
    from urllib.parse import quote

    return f"{base.rstrip('/')}/api/v4/projects/{quote(project, safe='')}", ({"PRIVATE-TOKEN": token} if token else {})


def clone_command(url: str, target: str, exists: bool) -> list[str]:
    """The command that brings a working copy up to date; running it is the caller's affair."""
    return ["git", "-C", target, "pull", "--ff-only"] if exists else ["git", "clone", "--depth", "1", url, target]
