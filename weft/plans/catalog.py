"""Stored tables: appends, upserts, cascading deletes, and which projects a new scan has to read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.schema import KEYS, TABLES


#: Buckets of projects; a changed project rewrites those of its own.
BUCKETS = 64
#: Tables whose rows a project's id (files: their folder) names; all others but clone_pairs name a module.
BY_PROJECT = {"projects": "id", "modules": "project_id", "scan_cache": "project_id", "files": "folder"}


class Catalog:
    """Parquet tables under one folder, each dealt into buckets by a hash of the project that a row belongs to.

    A bucket is a folder of numbered parts: p (rows added) and w (the bucket written anew, which hides all parts before it).
    A part is written elsewhere and then renamed into its place, so a reader never sees half of one, and a job that fails
    leaves the old ones. Buckets that a change does not name keep their files."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _parts(self, table: str, bucket: int) -> list[str]:
        """A bucket's parts that count, in order: from the last that wrote it anew."""
        names = sorted((n for n in self._names(f"{self.root}/{table}/b{bucket}") if n[:1] in "pw"), key=lambda n: int(n[1:]))
        last = max((i for i, n in enumerate(names) if n[0] == "w"), default=0)
        return names[last:]

    def bucket(self, project: Column) -> Column:
        return F.pmod(F.xxhash64(project), F.lit(self.buckets)).cast("int")

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets."""
        every = [int(n[1:]) for n in self._names(f"{self.root}/{table}") if n[:1] == "b"] if buckets is None else buckets
        paths = [f"{self.root}/{table}/b{k}/{part}" for k in every for part in self._parts(table, k)]
        schema = TABLES[table]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _placed(self, table: str, rows: DataFrame) -> DataFrame:
        """rows as the table has them, with their bucket. A row of a module goes by the module's project; one whose module
        the store does not have, by its module's id."""
        shaped = self.spark.createDataFrame([], TABLES[table]).unionByName(rows, allowMissingColumns=True)
        if table in BY_PROJECT:
            return shaped.withColumn("_bucket", self.bucket(F.col(BY_PROJECT[table])))
        module = {"clone_pairs": "module_a", "errors": "source"}.get(table, "module_id")
        projects = self.read("modules").select(F.col("id").alias(module), F.col("project_id").alias("_project"))
        return shaped.join(projects, module, "left").withColumn("_bucket", self.bucket(F.coalesce("_project", module))).drop("_project")

    def _write(self, table: str, rows: DataFrame, kind: str, buckets: list[int]) -> None:
        """One job writes the rows of all buckets; then the parts of `buckets`, or of all that have rows, get their names."""
        fresh = f"{self.root}/{table}/_{uuid.uuid4().hex}"
        rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(fresh)
        made = {int(n.split("=")[1]): n for n in self._names(fresh) if n.startswith("_bucket=")}
        for k in sorted({*made, *buckets}):
            home = f"{self.root}/{table}/b{k}"
            number = max((int(n[1:]) for n in self._names(home)), default=-1) + 1
            fs, to = self._fs(f"{home}/{kind}{number}")
            fs.mkdirs(self._fs(home)[1])
            if k in made:
                fs.rename(self._fs(f"{fresh}/{made[k]}")[1], to)
            else:
                fs.mkdirs(to)  # nothing is left of the bucket
            if kind == "w":  # what the part before this one hid is read by nobody any more
                hidden = [n for n in self._names(home) if int(n[1:]) < number]
                newest = max((int(n[1:]) for n in hidden if n[0] == "w"), default=-1)
                for n in hidden:
                    if int(n[1:]) < newest:
                        fs.delete(self._fs(f"{home}/{n}")[1], True)
        fs, p = self._fs(fresh)
        fs.delete(p, True)

    def overwrite(self, table: str, rows: DataFrame, buckets: list[int] | None = None) -> None:
        """Puts rows in place of the table's, or of what these buckets hold; rows must be of them then."""
        held = [int(n[1:]) for n in self._names(f"{self.root}/{table}") if n[:1] == "b"] if buckets is None else buckets
        self._write(table, self._placed(table, rows), "w", held)

    def append(self, table: str, rows: DataFrame) -> None:
        self._write(table, self._placed(table, rows), "p", [])

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Rows with a key that is there replace it. A key that is a module's may have moved to another project, so modules
        are looked through in all buckets; else only the rows' own buckets are read and written."""
        if table == "modules":
            return self.overwrite(table, upserted(self.read(table), rows, KEYS[table]))
        named = [r[0] for r in rows.select(self.bucket(F.col(BY_PROJECT[table]))).distinct().collect()]
        return self.overwrite(table, upserted(self.read(table, named), rows, KEYS[table]), named)

    def exchange(self, table: str, rows: DataFrame, gone: DataFrame) -> None:
        """Puts rows in the place of those with their keys, and takes out those with the keys of gone. Only the buckets of both are
        read and written; gone has the key and the column that names the bucket."""
        by, key = BY_PROJECT[table], KEYS[table]
        named = [r[0] for r in rows.select(by).unionByName(gone.select(by)).select(self.bucket(F.col(by))).distinct().collect()]
        if named:
            self.overwrite(table, upserted(self.read(table, named).join(gone.select(key), key, "left_anti"), rows, key), named)

    def clear_projects(self, ids: DataFrame) -> None:
        """Takes the projects in ids (project_id) and all that belongs to their modules out of the store. Only their buckets are
        read and written, a bounded number; clone_pairs, whose rows belong to two projects each, in all of its buckets."""
        named = [r[0] for r in ids.select(self.bucket(F.col("project_id"))).distinct().collect()]
        held = {t: self.read(t, None if t == "clone_pairs" else named) for t in TABLES if t != "files"}
        for name, rows in cleared(held, ids).items():
            if name != "modules" and self._holds(name, named):  # the others look their buckets up there
                self.overwrite(name, rows, None if name == "clone_pairs" else named)
        if self._holds("modules", named):
            self.overwrite("modules", cleared({"modules": held["modules"]}, ids)["modules"], named)

    def _holds(self, table: str, buckets: list[int]) -> bool:
        """Whether a table has anything in these buckets, clone_pairs in any: where nothing is, nothing is written."""
        if table == "clone_pairs":
            return any(n[:1] == "b" for n in self._names(f"{self.root}/{table}"))
        return any(self._parts(table, k) for k in buckets)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's rows added, or in place of those that have their key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def cleared(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the projects in ids (project_id) and all that belongs to their modules."""
    gone = tables["modules"].join(ids, "project_id", "left_semi").select(F.col("id").alias("module_id"))
    out = {}
    for name in ("integration_facts", "dependencies", "api_surfaces", "gaps", "capability_summaries", "module_metrics"):
        if name in tables:
            out[name] = tables[name].join(gone, "module_id", "left_anti")
    if "errors" in tables:
        out["errors"] = tables["errors"].join(gone.withColumnRenamed("module_id", "source"), "source", "left_anti")
    if "clone_pairs" in tables:
        pairs = tables["clone_pairs"]
        for side in ("module_a", "module_b"):
            pairs = pairs.join(gone.withColumnRenamed("module_id", side), side, "left_anti")
        out["clone_pairs"] = pairs
    out["modules"] = tables["modules"].join(ids, "project_id", "left_anti")
    if "projects" in tables:
        out["projects"] = tables["projects"].join(ids.withColumnRenamed("project_id", "id"), "id", "left_anti")
    if "scan_cache" in tables:
        out["scan_cache"] = tables["scan_cache"].join(ids, "project_id", "left_anti")
    return out


def changed(hashes: DataFrame, cache: DataFrame) -> DataFrame:
    """(project_id, content_hash, state): what to do with each project: new, changed, same or deleted."""
    old = cache.select("project_id", F.col("content_hash").alias("was"))
    rows = hashes.select("project_id", "content_hash").join(old, "project_id", "full")
    state = F.when(F.col("was").isNull(), "new").when(F.col("content_hash").isNull(), "deleted").when(F.col("was") == F.col("content_hash"), "same").otherwise("changed")
    return rows.select("project_id", "content_hash", state.alias("state"))
