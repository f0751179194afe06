"""Views of the results: matrices, graphs, diagrams, bills of material, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import html_escaped, safe_id, safe_label
from weft.operators.capability import library_of


def matrix_cells(members: DataFrame, caps: DataFrame, max_columns: int = 40) -> DataFrame:
    """(dimension, capability, position, module_id, direction) for the best capabilities of each dimension.

    Long form: a row for each filled cell, so that it works for any number of modules; pivoted() makes the
    table."""
    best = Window.partitionBy("dimension").orderBy(F.desc("opportunity"), "id")
    columns = caps.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= max_columns).select(F.col("id").alias("capability"), "dimension", "position")
    return members.withColumnRenamed("id", "capability").join(F.broadcast(columns), "capability").select("dimension", "capability", "position", "module_id", "direction")


def pivoted(cells: DataFrame, dimension: str, columns: list[str]) -> DataFrame:
    """A row for each module, a column for each capability."""
    return cells.filter(F.col("dimension") == dimension).groupBy("module_id").pivot("capability", columns).agg(F.min("direction"))


def bipartite_edges(members: DataFrame) -> DataFrame:
    return members.select(F.col("module_id").alias("source"), F.col("id").alias("target"), F.col("direction").alias("label"))


def bipartite_nodes(members: DataFrame, caps: DataFrame) -> DataFrame:
    """Modules and capabilities as nodes (node, kind, size): size is the number of edges."""
    modules = members.groupBy(F.col("module_id").alias("node")).agg(F.count(F.lit(1)).alias("size")).withColumn("kind", F.lit("module"))
    resources = members.join(caps.select("id"), "id", "left_semi").groupBy(F.col("id").alias("node")).agg(F.count(F.lit(1)).alias("size")).withColumn("kind", F.lit("capability"))
    return modules.unionByName(resources)


def resource_edges(facts: DataFrame) -> DataFrame:
    """(source, target, direction): what is produced or written flows out of a module, all else into it."""
    out = F.col("direction").isin("PRODUCES", "WRITES")
    resource = F.concat_ws(":", "resource_type", "resource_id")
    return facts.select(F.when(out, F.col("module_id")).otherwise(resource).alias("source"), F.when(out, resource).otherwise(F.col("module_id")).alias("target"), "direction").distinct()


def diagram_edges(facts: DataFrame, clustered: DataFrame, max_edges: int = 1000) -> DataFrame:
    """The edges (module_id, resource_type, resource_id, direction, tier, points) worth drawing.

    An edge of a resource with n > 1 users has 100 * n points, a clustered module 50, a HIGH fact 20 and
    any other 10. Of repeated edges the first counts."""
    key = ["module_id", "resource_type", "resource_id", "direction"]
    edges = facts.groupBy(*key).agg(F.min_by("tier", "fact_seq").alias("tier"), F.min("fact_seq").alias("seq"))
    users = facts.groupBy("resource_type", "resource_id").agg(F.countDistinct("module_id").alias("users"))
    found = edges.join(users, ["resource_type", "resource_id"]).join(clustered.select("module_id").distinct().withColumn("_in", F.lit(50)), "module_id", "left")
    points = F.when(F.col("users") >= 2, F.col("users") * 100).otherwise(0) + F.coalesce("_in", F.lit(0)) + F.when(F.col("tier") == "HIGH", 20).otherwise(10)
    return found.withColumn("points", points).orderBy(F.desc("points"), "seq", *key).limit(max_edges).select(*key, "tier", "points")


def diagram_lines(edges: DataFrame) -> DataFrame:
    """A line of diagram text for each edge."""
    module, resource = safe_id(F.concat(F.lit("m_"), "module_id")), safe_id(F.concat(F.lit("r_"), "resource_type", F.lit("_"), "resource_id"))
    shown = lambda node, label: F.concat(node, F.lit('["'), safe_label(label), F.lit('"]'))
    m, r = shown(module, F.col("module_id")), shown(resource, F.col("resource_id"))
    arrow = F.concat(F.lit(" -->|"), F.lower("direction"), F.lit("| "))
    out = F.col("direction").isin("PRODUCES", "WRITES")
    return edges.select(F.when(out, F.concat(m, arrow, r)).otherwise(F.concat(r, arrow, m)).alias("line"))


def bills_of_material(dependencies: DataFrame, modules: DataFrame) -> DataFrame:
    """(project_id, document): a CycloneDX 1.5 document for each project."""
    at = dependencies.join(modules.select(F.col("id").alias("module_id"), "project_id"), "module_id", "left")
    part = F.struct(F.lit("library").alias("type"), library_of(F.col("purl")).alias("name"), "purl", F.when(F.col("scope") == "runtime", "required").otherwise("optional").alias("scope"))
    docs = at.groupBy(F.coalesce("project_id", "module_id").alias("project_id")).agg(F.array_sort(F.collect_list(part)).alias("components"))
    name = F.struct(F.struct(F.lit("application").alias("type"), F.col("project_id").alias("name")).alias("component")).alias("metadata")
    return docs.select("project_id", F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"), name, "components")).alias("document"))


#: Tiers that each audience sees.
AUDIENCES = {"executive": ("HIGH",), "prioritization": ("HIGH", "MED"), "exploratory": ("HIGH", "MED", "LOW")}


def for_audience(rows: DataFrame, audience: str, search: str = "", text: Column | None = None) -> DataFrame:
    """Rows of the audience's tiers whose text holds the search term, in any case."""
    shown = F.col("tier").isin(*AUDIENCES[audience])
    return rows.filter(shown & F.contains(F.lower(text if text is not None else F.to_json(F.struct("*"))), F.lit(search.lower())))


#: What each play asks for.
NEXT_STEPS = {
    "RETIRE": "Pick the module that stays, move its callers over, and remove the other.",
    "STANDARDIZE": "Agree on one owner and one interface; the others become its clients.",
    "EXTRACT": "Move what is shared into a library or service of its own.",
    "LEAVE": "Nothing to do now; look again when the evidence changes.",
}


def next_steps(play: Column) -> Column:
    out = F.when(F.lit(False), "")
    for p, text in NEXT_STEPS.items():
        out = out.when(play == p, text)
    return out.otherwise(NEXT_STEPS["LEAVE"])


def table_rows(rows: DataFrame) -> DataFrame:
    """An HTML row for each row, cells escaped."""
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")  # noqa: E731  a capability's name may have dots
    cells = [F.concat(F.lit("<td>"), html_escaped(F.coalesce(named(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in rows.columns]
    return rows.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))


def page(title: str, headings: list[str], lines: list[str]) -> str:
    """A page from rows that are few enough to show."""
    head = "".join(f"<th>{h}</th>" for h in headings)
    return f"<!doctype html><meta charset='utf-8'><title>{title}</title><h1>{title}</h1><table><tr>{head}</tr>{''.join(lines)}</table>"


def unconfirmed(candidates: DataFrame, project_of: DataFrame) -> DataFrame:
    """Candidates left to look at: not confirmed, not within one project, each pair once."""
    side = lambda c: project_of.select(F.col("module_id").alias(c), F.col("project_id").alias(f"p_{c}"))
    rows = candidates.filter("not coalesce(confirmed, false)").join(side("a"), "a", "left").join(side("b"), "b", "left")
    other = rows.filter("not (p_a <=> p_b) or p_a is null").drop("p_a", "p_b")
    return other.withColumns({"_x": F.least("a", "b"), "_y": F.greatest("a", "b")}).dropDuplicates(["_x", "_y"]).drop("_x", "_y")
