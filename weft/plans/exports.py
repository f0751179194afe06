"""What a run leaves for people and other tools: pages, JSON and logs under one folder, in any store that Spark writes.

Tables are sorted by range and written by the tasks that sorted them, each a numbered part that is whole by itself: JSON
lines, or a page. What carries a table's name is a manifest of its parts. A page shows a table's first rows and names the
parts, which have all. The driver writes manifests and pages, whose size is bounded, and gives parts their numbers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from html import escape
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import graph
from weft.operators.capability import ranked
from weft.plans import views

#: Rows of a table that a page shows.
SHOWN = 500


class Site:
    """A folder that files are written to; `names` are those written, relative to it."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root, self.names = spark, str(root).rstrip("/"), []
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def put(self, name: str, pieces: Iterable[str]) -> None:
        """A file of bounded size."""
        out = self._fs.create(self._path(f"{self.root}/{name}"), True)
        try:
            out.write(bytearray("".join(pieces).encode()))
        finally:
            out.close()
        self.names.append(name)

    def parts(self, name: str, lines: DataFrame, extension: str) -> list[str]:
        """Writes the one column of lines, a part for each partition that has rows, in their order; the names of the parts."""
        home, fresh = f"{self.root}/parts/{name}", f"{self.root}/parts/_{uuid.uuid4().hex}"
        lines.write.text(fresh)
        made = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(fresh)) if s.getPath().getName().startswith("part-") and s.getLen())
        self._fs.delete(self._path(home), True)  # of an earlier run
        self._fs.mkdirs(self._path(home))
        done = [f"parts/{name}/{i:05d}.{extension}" for i in range(len(made))]
        for old, new in zip(made, done, strict=True):
            self._fs.rename(self._path(f"{fresh}/{old}"), self._path(f"{self.root}/{new}"))
        self._fs.delete(self._path(fresh), True)
        self.names += done
        return done

    def records(self, name: str, rows: DataFrame) -> list[str]:
        """Sorted rows as JSON lines."""
        return self.parts(name, rows.select(F.to_json(F.struct("*")).alias("line")), "jsonl")

    def manifest(self, name: str, **tables: list[str]) -> None:
        """Which parts, in order, make up each table."""
        self.put(name, [json.dumps(tables, indent=1), "\n"])

    def section(self, name: str, title: str, rows: DataFrame) -> Iterator[str]:
        """A table of sorted rows for a page: its first ones, and links to pages with all of them."""
        head = f"<table><tr>{''.join(f'<th>{escape(h)}</th>' for h in rows.columns)}</tr>"
        done = self.parts(name, views.table_rows(rows).mapInArrow(_framed(f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title>{head}", "</table>"), "line string"), "html")
        yield f"<h2>{escape(title)}</h2>\n{head}\n"
        for r in views.table_rows(rows.limit(SHOWN)).collect():
            yield f"{r[0]}\n"
        yield "</table>\n<p>All rows: " + " ".join(f'<a href="{x}">{i}</a>' for i, x in enumerate(done, 1)) + "</p>\n"


def _framed(head: str, foot: str):
    """The lines of each partition that has some between a first and a last line."""

    def of(batches):
        import pyarrow as pa

        line = lambda text: pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["line"])
        begun = False
        for batch in batches:
            if batch.num_rows and not begun:
                begun = True
                yield line(head)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["line"])
        if begun:
            yield line(foot)

    return of


def _page(title: str, sections: Iterable[str]) -> Iterator[str]:
    yield f"<!doctype html><meta charset='utf-8'><title>{title}</title><h1>{title}</h1>\n"
    yield from sections


def matched_by(members: DataFrame) -> DataFrame:
    """(id, why): what links a capability's members: how many touch it in which direction, and whose names come first."""
    each = members.select("id", "direction", "module_id").distinct().groupBy("id", "direction").agg(F.count(F.lit(1)).alias("n"), F.min("module_id").alias("first"))
    more = F.when(F.col("n") > 1, F.concat(F.lit(" +"), (F.col("n") - 1).cast("string"), F.lit(" more"))).otherwise("")
    said = F.concat(F.lower("direction"), F.lit(": "), "first", more)
    return each.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(said)), "; ").alias("why"))  # one entry for each direction


def badge(tier: Column) -> Column:
    """How sure the evidence is, in words."""
    return F.when(tier == "HIGH", "certain").when(tier == "MED", "likely").otherwise("possible")


def matrix_tables(cells: DataFrame) -> Iterator[tuple[str, DataFrame]]:
    """For each dimension a row for each of its modules and a column for each capability (a bounded number)."""
    heads = cells.select("dimension", "position", "capability").distinct().orderBy("dimension", "position").collect()
    for dimension in dict.fromkeys(r["dimension"] for r in heads):
        yield dimension, views.pivoted(cells, dimension, [r["capability"] for r in heads if r["dimension"] == dimension]).orderBy("module_id")


def write_site(tables: dict[str, DataFrame], out: str | Path) -> list[str]:
    """Writes index.html, matrix.html and .json, graph.json (modules and capabilities), resources.json (modules and
    resources), diagram.mmd, tech.json, capabilities.json, bills_of_material.json (a CycloneDX document a line) and
    errors.json (lines of the log); the names of all files, parts too."""
    site = Site(tables["totals"].sparkSession, out)
    caps, every = tables["capabilities"], lambda t: t.orderBy(*t.columns)
    now = (badge(F.col("tier")).alias("evidence"), views.next_steps(F.col("play")).alias("next"))
    named = ("id", "label", "play", "opportunity", "n_members", "n_owners")
    told = ranked(caps.join(matched_by(tables["members"]), "id", "left")).select(*named, now[0], "why", now[1])
    clusters = graph.ranked(tables["clusters"]).withColumn("next", now[1])
    sections = [*site.section("totals", "Totals", tables["totals"]), *site.section("shared", "Shared capabilities", told), *site.section("clusters", "Clusters", clusters)]
    if "candidates" in tables:
        left = tables["candidates"].select("a", "b", F.round("similarity", 2).alias("similarity"), "tier", "reason", F.array_join("shared_resources", ", ").alias("shared"))
        sections += site.section("candidates", "Pairs to look at", left.orderBy(F.desc("similarity"), "a", "b"))
    site.put("index.html", _page("Shared capabilities", sections))
    site.put("matrix.html", _page("Who touches what", (x for i, (d, t) in enumerate(matrix_tables(tables["matrix"])) for x in site.section(f"matrix-{i}", d, t))))
    site.manifest("matrix.json", cells=site.records("cells", tables["matrix"].orderBy("dimension", "position", "module_id")))
    site.manifest("graph.json", nodes=site.records("nodes", every(views.bipartite_nodes(tables["members"], caps))), edges=site.records("edges", every(views.bipartite_edges(tables["members"]))))
    edges = views.resource_edges(tables["facts"])
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    site.manifest("resources.json", nodes=site.records("resource_nodes", every(nodes)), edges=site.records("resource_edges", every(edges)))
    site.put("diagram.mmd", ["graph LR\n", *(f"  {r[0]}\n" for r in tables["diagram"].collect())])  # at most the diagram's edges
    site.manifest("tech.json", standards=site.records("standards", tables["standards"]))
    site.manifest("capabilities.json", capabilities=site.records("capabilities", ranked(caps).select(*named, *now)))
    log = tables["error_log"].orderBy("day", "seq").select(F.concat_ws(" ", F.col("day").cast("string"), F.col("seq").cast("string"), F.replace(F.col("line"), F.lit("\n"), F.lit(" "))).alias("line"))
    site.manifest("errors.json", lines=site.parts("errors", log, "log"))
    bills = tables["bills_of_material"].orderBy("project_id").select(F.col("document").alias("line"))
    site.manifest("bills_of_material.json", documents=site.parts("bills_of_material", bills, "jsonl"))
    return site.names
