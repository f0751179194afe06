"""Remediation as text that is made, never as files that are changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTED_ON = ("RETIRE", "STANDARDIZE")


def _slug(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9]+", "_")


def ratchets(clusters: DataFrame) -> DataFrame:
    """(id, kind, file, content): three one-way rules for each cluster (id, label, play) that is acted on.

    Files are named by the cluster, so that clusters with one first member do not overwrite each other."""
    acted = clusters.filter(F.col("play").isin(*ACTED_ON))
    name, label = _slug(F.col("id")), F.regexp_replace("label", r"[\r\n\"]", " ")
    first = F.split_part("id", F.lit(":"), F.lit(-1))
    kinds = {
        "archunit": (F.concat(F.lit("Ratchet_"), name, F.lit(".java")), F.format_string('// %s\n@ArchTest static final ArchRule only_canonical = noClasses().that().resideOutsideOfPackage("..%s..").should().dependOnClassesThat().resideInAPackage("..%s..");\n', label, first, first)),
        "import-linter": (F.concat(F.lit("ratchet_"), name, F.lit(".ini")), F.format_string("# %s\n[importlinter:contract:%s]\nname = only the canonical module\ntype = forbidden\nforbidden_modules = %s\n", label, name, first)),
        "dependency-cruiser": (F.concat(F.lit("ratchet_"), name, F.lit(".json")), F.format_string('{"comment": "%s", "forbidden": [{"name": "%s", "severity": "error", "from": {}, "to": {"path": "%s"}}]}\n', label, name, first)),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), f.alias("file"), c.alias("content")) for k, (f, c) in kinds.items()])
    return acted.select("id", F.inline(rows))


def canonical(kind: Column, resource: Column) -> Column:
    """The name that a shared resource should have; null for kinds that are not renamed."""
    return F.when(kind == "KAFKA_TOPIC", F.concat(F.lit("canonical."), resource)).when(kind == "SQL_TABLE", F.concat(F.lit("canonical_"), resource)).when(kind == "HTTP_ENDPOINT", F.concat(F.lit("/canonical"), F.regexp_replace(resource, "^[A-Z]+ ", "")))


def recipes(shared: DataFrame) -> DataFrame:
    """(id, resource_type, resource_id, file, content): a rewrite recipe for each shared topic, table or endpoint."""
    rows = shared.withColumn("_to", canonical(F.col("resource_type"), F.col("resource_id"))).filter("_to is not null")
    what = F.format_string("type: specs.openrewrite.org/v1beta/recipe\nname: converge.%s.%s\nrecipeList:\n  - org.openrewrite.text.FindAndReplace:\n      find: \"%s\"\n      replace: \"%s\"\n", F.lower("resource_type"), _slug(F.col("resource_id")), F.col("resource_id"), F.col("_to"))
    return rows.select("id", "resource_type", "resource_id", F.concat(F.lit("rewrite_"), F.lower("resource_type"), F.lit("_"), _slug(F.col("resource_id")), F.lit(".yml")).alias("file"), what.alias("content"))


def class_recipe(old: str, new: str) -> str:
    return f"type: specs.openrewrite.org/v1beta/recipe\nname: converge.class\nrecipeList:\n  - org.openrewrite.java.ChangeType:\n      oldFullyQualifiedTypeName: {old}\n      newFullyQualifiedTypeName: {new}\n"


def run_line(file: str) -> str:
    return f"mvn -q org.openrewrite.maven:rewrite-maven-plugin:run -Drewrite.configLocation={file}\n"


#: What stands in front of a name that has been dealt with.
CANONICAL, GONE = "canonical.", "decommissioned."


def _named(name: Column) -> Column:
    """A pattern for a resource's name as a whole: not a part of a longer name, nor one that was dealt with."""
    return F.concat(F.lit(r"(?<![\w./])\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![./]?\w)"))


def _step(text: Column, action: Column, comment: Column) -> Column:
    """A file's text after one action (resource_id, role)."""
    name = action["resource_id"]
    literal = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    done = F.concat(comment, F.lit("decommissioned: "))
    marked = lambda x: F.regexp_replace(x, _named(name), F.concat(F.lit(GONE), literal))
    sends = lambda x: F.regexp_like(x, _named(name)) & x.rlike(r"\.(?:send|produce)\s*\(")
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.when(x.startswith(done), x).when(sends(x), F.concat(done, x)).otherwise(marked(x)))
    return F.when(~F.contains(text, name), text).when(action["role"] == "primary", F.regexp_replace(text, _named(name), F.concat(F.lit(CANONICAL), literal))).otherwise(F.array_join(lines, "\n"))


def healed(files: DataFrame, actions: DataFrame) -> DataFrame:
    """files (project, rel_path, content, ...) of projects that have actions, with all of them done in a new column `healed`.

    actions (project, resource_id, role): in the primary's files the name becomes canonical; in a secondary's,
    lines that send to it are commented out and other mentions are marked as decommissioned. A file is gone through once,
    longer names first; a name that is part of a longer one stays, and what was done once is not done again. A project
    with two roles for a name is its primary. Only the actions of one project are gathered, not its files."""
    one = actions.filter("length(resource_id) > 0").groupBy("project", "resource_id").agg(F.min("role").alias("role"))
    acts = one.groupBy("project").agg(F.array_sort(F.collect_list(F.struct((-F.length("resource_id")).alias("order"), "resource_id", "role"))).alias("_acts"))
    comment = F.when(F.col("rel_path").endswith(".py"), "# ").when(F.col("rel_path").endswith(".sql"), "-- ").otherwise("// ")
    rows = files.join(acts, "project").withColumn("_mark", comment)
    return rows.withColumn("healed", F.aggregate("_acts", F.col("content"), lambda text, a: _step(text, a, F.col("_mark")))).drop("_acts", "_mark")


def class_migration(files: DataFrame, moves: DataFrame) -> DataFrame:
    """(file, content): for each old class of moves (old, new) that some Java file imports, the recipe that changes it, and
    a script that runs all of them, in the order of their names."""
    used = files.filter("rel_path like '%.java'").select(F.explode(F.regexp_extract_all("content", F.lit(r"import\s+(?:static\s+)?([\w.]+)"), F.lit(1))).alias("old")).distinct()
    named = moves.join(used, "old", "left_semi").select(F.concat(F.lit("class_"), _slug(F.col("old")), F.lit(".yml")).alias("file"), F.format_string(class_recipe("%s", "%s"), "old", "new").alias("content"))
    script = named.agg(F.array_join(F.transform(F.array_sort(F.collect_list("file")), lambda f: F.format_string(run_line("%s"), f)), "").alias("lines")).filter("lines <> ''")
    return named.unionByName(script.select(F.lit("run.sh").alias("file"), F.concat(F.lit("#!/bin/sh\nset -eu\n"), "lines").alias("content")))
