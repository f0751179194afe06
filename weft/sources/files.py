"""Repositories as tables of files, and the census of the projects in them."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names and suffixes that decide what is scanned.
IGNORED = (
    ".git", ".svn", ".hg", ".DS_Store",
    "node_modules", ".next", ".nuxt", ".output", ".turbo", ".yarn", ".npm", "coverage", ".nyc_output", "storybook-static", "bower_components", "jspm_packages",
    ".venv", "venv", "env", ".env", "__pycache__", ".pytest_cache", ".tox", ".nox", ".mypy_cache", ".ruff_cache", ".coverage", "htmlcov", ".hypothesis", ".eggs",
    "target", "build", ".gradle", ".m2", "out", "bin", ".settings", ".metadata",
    ".idea", ".vscode", "vendor", "dist", "tmp", "temp", ".terraform",
)
MANIFESTS = (
    "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "package.json", "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "Pipfile", "go.mod", "Cargo.toml", "Gemfile",
    "OWNER", "catalog-info.yaml",
)
#: Folders inside a project that are never projects themselves.
INTERNAL = (
    "src", "main", "test", "tests", "resources", "lib", "app", "controllers", "services", "models", "routes", "views", "components", "config", "utils", "internal", "pkg", "cmd",
)
CODE = (".py", ".java", ".sql", ".ts", ".js", ".go", ".rb", ".jsp", ".jspf", ".tag", ".tld", ".jsx", ".tsx")
CLONE_SUFFIXES = (".py", ".java", ".sql", ".js", ".ts", ".jsx", ".tsx")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def is_ignored(path: Column) -> Column:
    """Whether a folder on the path is one to pass over."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.exists(folders, lambda d: d.isin(*IGNORED) | d.startswith(".") | d.endswith(".egg-info") | d.endswith(".dist-info"))


def _passed_over(folder: str) -> bool:
    return folder in IGNORED or folder.startswith(".") or folder.endswith((".egg-info", ".dist-info"))


def _system(root: str):
    """The file system of a root and the root's path there: a local folder, or an address (s3://, gs://, hdfs://)."""
    from pyarrow import fs

    if "://" in root and not root.startswith("file:"):
        system, path = fs.FileSystem.from_uri(root)
        return system, path.rstrip("/")
    return fs.LocalFileSystem(), os.path.abspath(re.sub("^file:/+", "/", root))


def _entries(system, path: str):
    """(name, whether it is a folder, modified, size) of what lies in a folder. Linked folders are not entered."""
    from pyarrow import fs

    for i in system.get_file_info(fs.FileSelector(path)):
        if i.type == fs.FileType.File:
            yield i.base_name, False, i.mtime_ns or 0, i.size
        elif i.type == fs.FileType.Directory and not _passed_over(i.base_name) and not (system.type_name == "local" and os.path.islink(i.path)):
            yield i.base_name, True, 0, 0


LISTED = "rel_path string, modified bigint, size bigint"
#: Most files and bytes of one Arrow batch; a longer file is a batch of its own.
BATCH_FILES, BATCH_BYTES = 256, 16 << 20


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, suffix, modified, size) of the files under root. Folders to pass over are not entered, and no file is opened.

    Spark's own reader leaves out files whose names begin with _ or a dot, which are code as others are (__init__.py);
    so tasks list folders themselves. The driver lists two levels, tasks walk what lies below, a folder each."""
    system, base = _system(root)
    top, below = [], []
    todo = [("", 0)]
    while todo:
        folder, level = todo.pop()
        for name, is_folder, modified, size in _entries(system, f"{base}/{folder}" if folder else base):
            rel = f"{folder}/{name}" if folder else name
            if not is_folder:
                top.append((rel, modified, size))
            elif level:
                below.append((rel,))
            else:
                todo.append((rel, 1))

    def walked(batches):
        import pyarrow as pa

        system, base = _system(root)
        names = [c.strip().split(" ")[0] for c in LISTED.split(",")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names)
        rows = []
        for batch in batches:
            todo = batch.column(0).to_pylist()
            while todo:
                folder = todo.pop()
                for name, is_folder, modified, size in _entries(system, f"{base}/{folder}"):
                    if is_folder:
                        todo.append(f"{folder}/{name}")
                    else:
                        rows.append((f"{folder}/{name}", modified, size))
                if len(rows) >= 10_000:
                    yield made(rows)
                    rows = []
        if rows:
            yield made(rows)

    found = spark.createDataFrame(top, LISTED)
    if below:
        dealt = spark.createDataFrame(below, "folder string").repartition(min(len(below), 4 * spark.sparkContext.defaultParallelism), "folder")
        found = found.unionByName(dealt.mapInArrow(walked, LISTED))
    return found.select("rel_path", suffix(F.col("rel_path")).alias("suffix"), "modified", "size")


def opened(listed: DataFrame, root: str) -> DataFrame:
    """(rel_path, suffix, modified, size, content): the files of a listing, read by tasks, a few megabytes a batch. Bytes that are
    not UTF-8 are left out and line ends are \\n; a file that may not be read is empty, one that has gone since it was listed is
    no row."""

    def read(batches):
        import pyarrow as pa

        system, base = _system(root)
        for batch in batches:
            at, texts, size = [], [], 0
            for i, rel in enumerate(batch.column(0).to_pylist()):
                try:
                    with system.open_input_stream(f"{base}/{rel}") as f:
                        texts.append(f.read().decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n"))
                except FileNotFoundError:
                    continue
                except OSError:
                    texts.append("")
                at.append(i)
                size += len(texts[-1])
                if len(at) >= BATCH_FILES or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(texts, pa.large_string()).cast(pa.string())], [*batch.schema.names, "content"])
                    at, texts, size = [], [], 0
            if at:
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(texts, pa.large_string()).cast(pa.string())], [*batch.schema.names, "content"])

    rows = listed.select("rel_path", "suffix", "modified", "size")
    return rows.mapInArrow(read, "rel_path string, suffix string, modified bigint, size bigint, content string")


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """(rel_path, suffix, content) of the files under root, ignored folders left out."""
    rows = walk(spark, root)
    if suffixes:
        rows = rows.filter(F.col("suffix").isin(*suffixes))
    return opened(rows, root).select("rel_path", "suffix", "content")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """The folders above a path, nearest first; the root is the empty string."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, F.lit(1), n - k), "/"))


def projects(files: DataFrame, max_depth: int = 5, keep_parent: bool = False) -> DataFrame:
    """(dir): folders that are projects.

    A folder with a manifest or code is one, unless a folder below it (no internal one) is: then only the
    ones below are, even if it holds a manifest itself. keep_parent keeps it."""
    name = F.regexp_extract("rel_path", "([^/]*)$", 1)
    marked = files.filter(name.isin(*MANIFESTS) | suffix(F.col("rel_path")).isin(*CODE)).select(parent(F.col("rel_path")).alias("dir")).distinct()
    # code in an internal folder marks the nearest folder above that is not one
    outer = F.filter(F.concat(F.array("dir"), ancestors(F.col("dir"))), lambda d: ~F.exists(F.split(d, "/"), lambda p: p.isin(*INTERNAL)))
    dirs = marked.select(F.get(outer, F.lit(0)).alias("dir")).filter("dir is not null").distinct().filter((F.size(F.split("dir", "/")) <= max_depth))
    if keep_parent:
        return dirs
    above = dirs.filter("dir <> ''").select(F.explode(ancestors(F.col("dir"))).alias("dir")).distinct()
    return dirs.join(above, "dir", "left_anti")


def named(dirs: DataFrame) -> DataFrame:
    """(dir, project_id): the folder's name, or its whole path where names collide."""
    base = F.when(F.col("dir") == "", "root").otherwise(F.regexp_extract("dir", "([^/]*)$", 1))
    rows = dirs.withColumn("_base", base).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_base")))
    return rows.select("dir", F.when(F.col("_n") > 1, F.replace("dir", F.lit("/"), F.lit("-"))).otherwise(F.col("_base")).alias("project_id"))


def in_projects(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """files with project_id and the path within the project; each file is in the nearest project above it."""
    held = files.withColumn("_dir", F.explode(ancestors(F.col("rel_path")))).join(dirs.withColumnRenamed("dir", "_dir"), "_dir")
    best = Window.partitionBy("rel_path").orderBy(F.desc(F.length("_dir")))
    near = held.withColumn("_r", F.row_number().over(best)).filter("_r = 1")
    return near.withColumn("in_path", F.when(F.col("_dir") == "", F.col("rel_path")).otherwise(F.expr("substring(rel_path, length(_dir) + 2)"))).drop("_r", "_dir")


def owners(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """(project_id, owner): the first line of the nearest OWNER file, from the project upward, else 'unknown'."""
    marks = files.filter(F.regexp_extract("rel_path", "([^/]*)$", 1) == "OWNER").select(parent(F.col("rel_path")).alias("at"), F.trim(F.get(F.split("content", "\n"), F.lit(0))).alias("owner"))
    up = dirs.select("project_id", F.explode(F.concat(F.array("dir"), F.when(F.col("dir") != "", ancestors(F.col("dir"))).otherwise(F.array().cast("array<string>")))).alias("at"))
    near = up.join(marks, "at", "left").groupBy("project_id").agg(F.max_by("owner", F.when(F.col("owner").isNotNull(), F.length("at"))).alias("owner"))
    return near.select("project_id", F.coalesce("owner", F.lit("unknown")).alias("owner"))


def lines_of_code(files: DataFrame, key: str = "project_id") -> DataFrame:
    return files.filter(F.col("suffix").isin(*CODE)).groupBy(key).agg(F.sum(F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1).alias("loc"))


#: A language's plugin: its suffixes, the languages it claims, and the manifests that tell the build.
LANGUAGES = {
    "python": ((".py",), (("pyproject.toml", "pyproject"), ("requirements.txt", "pip")), "unknown"),
    "java": ((".java", ".jsp", ".jspf", ".tag", ".tld"), (("pom.xml", "maven"),), "gradle"),
    "javascript": ((".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"), (("package.json", "npm"),), ""),
    "sql": ((".sql",), (), "sql"),
}


def detected(files: DataFrame) -> DataFrame:
    """(project_id, lang, build, score) for files (project_id, in_path, suffix): a row for each language found."""
    lang, name = F.when(F.lit(False), ""), F.regexp_extract("in_path", "([^/]*)$", 1)
    for k, (suffixes, _, _) in LANGUAGES.items():
        lang = lang.when(F.col("suffix").isin(*suffixes), k)
    at_root = ~F.contains(F.col("in_path"), F.lit("/"))
    held = files.groupBy("project_id").agg(F.collect_set(F.when(at_root & name.isin(*MANIFESTS), name)).alias("manifests"))
    found = files.withColumn("lang", lang).filter("lang is not null").groupBy("project_id", "lang").agg(F.count(F.lit(1)).alias("n")).join(held, "project_id")
    build, bonus = F.lit(""), F.when((F.col("lang") == "javascript") & F.array_contains("manifests", "package.json"), 20).otherwise(0)
    for k, (_, marks, default) in LANGUAGES.items():
        said = F.lit(default)
        for mark, tool in reversed(marks):
            said = F.when(F.array_contains("manifests", mark), tool).otherwise(said)
        build = F.when(F.col("lang") == k, said).otherwise(build)
    return found.select("project_id", "lang", build.alias("build"), (F.col("n") + bonus).alias("score"))


def primary(found: DataFrame) -> DataFrame:
    """(project_id, primary, langs): the language of the highest score, by name among equals."""
    return found.groupBy("project_id").agg(F.min_by("lang", F.struct(-F.col("score"), "lang")).alias("primary"), F.array_sort(F.collect_set("lang")).alias("langs"))


def from_inventory(items: DataFrame, dirs: DataFrame) -> DataFrame:
    """(dir, project_id, and the items' columns): inventory items (name, ...) that have a folder of their name."""
    return items.join(dirs.withColumn("name", F.col("project_id")), "name")


def listed_hashes(files: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, content_hash): the sha256 of a project's lines "rel_path:sha256 of the content", in order, a line break between them.

    All of each digest counts, and its place. Spark sorts the lines, spilling what memory does not hold, and a task hashes them as
    they come, some 80 bytes a file: nothing is gathered. A file without content has no line, a project without a line a null hash."""
    line = F.concat("rel_path", F.lit(":"), F.sha2(F.col("content").cast("binary"), 256))

    def hashed(batches):
        import hashlib

        import pyarrow as pa

        kind, now, sha = None, None, None

        def row(k, s):
            return pa.record_batch([pa.array([k], kind), pa.array([s and s.hexdigest()], pa.string())], [key, "content_hash"])

        begun = False
        for batch in batches:
            kind = batch.schema.field(0).type
            for k, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if begun and k != now:
                    yield row(now, sha)
                    sha = None
                begun, now = True, k
                if one is not None:
                    if sha is None:
                        sha = hashlib.sha256(one.encode())
                    else:
                        sha.update(b"\n" + one.encode())
        if begun:
            yield row(now, sha)

    rows = files.select(key, line.alias("line")).repartition(key).sortWithinPartitions(key, "line")
    return rows.mapInArrow(hashed, f"{key} {files.schema[key].dataType.simpleString()}, content_hash string")


def content_hashes(files: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, content_hash) of a project's files, in any order: the sha256 of their number and of two sums.

    A file counts with two independent 60-bit numbers, cut from the sha256 of its path and of its content's sha256. Sums are
    aggregated where files lie, so a project of any size is one row of a shuffle. With a column digest (that sha256 of the
    content) no content is read."""
    digest = F.col("digest") if "digest" in files.columns else F.sha2(F.col("content").cast("binary"), 256)
    one = files.select(key, F.sha2(F.concat_ws(":", "rel_path", digest).cast("binary"), 256).alias("h"))
    number = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(20,0)"))
    sums = one.groupBy(key).agg(F.count(F.lit(1)).alias("n"), number(1).alias("s1"), number(16).alias("s2"))
    return sums.select(key, F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in ("n", "s1", "s2"))).cast("binary"), 256).alias("content_hash"))
