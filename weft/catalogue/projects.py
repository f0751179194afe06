"""Runs over a portfolio that the tables spell out: each supplier is a project of files, its nation the folder above.

A nation's suppliers share a topic and a table; every seventh supplier has its own. A nation whose key 5 divides names no
owner. The key tells the language."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalogue.standins import CTES, read
from weft.plans import catalog, pipeline
from weft.plans.durable import durable_folder
from weft.sources import files, inventory, sourcecode, synthetic

#: Files that no run may read: one for each supplier, in a folder to pass over.
_IGNORED = "node_modules/x"


def supplier_files(spark: SparkSession, sf: str) -> DataFrame:
    """(rel_path, suffix, content)."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    own, text = key % 7 == 0, lambda *p: F.concat(*(x.cast("string") for x in p))
    rows = read(spark, sf, "supplier").select(
        text(F.lit("nation-"), nation, F.lit("/supplier-"), key).alias("dir"), F.lit(None).cast("string").alias("owner"), key.alias("id"), (key % 4).alias("language"),
        F.when(own, text(F.lit("supply.only."), key)).otherwise(text(F.lit("supply.of."), nation)).alias("topic"), F.when(own, text(F.lit("stock_only_"), key)).otherwise(text(F.lit("stock_"), nation)).alias("table"), text(F.lit("staging_"), nation).alias("staging"),
    )
    made = synthetic.of_projects(rows)
    settled = read(spark, sf, "nation").join(read(spark, sf, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi")  # a folder with an owner alone would be a project
    owners = settled.filter("n_nationkey % 5 <> 0").select(text(F.lit("nation-"), F.col("n_nationkey"), F.lit("/OWNER")).alias("rel_path"), F.lit("").alias("suffix"), text(F.lit("team-"), F.col("n_name"), F.lit("\n")).alias("content"))
    passed = rows.select(F.concat("dir", F.lit(f"/{_IGNORED}/index.js")).alias("rel_path"), F.lit(".js").alias("suffix"), F.lit("fetch('http://no');\n").alias("content"))
    return made.unionByName(owners).unionByName(passed).filter(~files.is_ignored(F.col("rel_path")))


def census_projects(spark, sf):
    all_files = supplier_files(spark, sf)
    dirs = files.named(files.projects(all_files))
    placed = files.in_projects(all_files, dirs)
    return dirs.join(files.owners(all_files, dirs), "project_id").join(files.primary(files.detected(placed)), "project_id", "left").join(files.lines_of_code(placed), "project_id", "left").select("project_id", "dir", "owner", "primary", F.array_join("langs", ",").alias("langs"), "loc")


def extracted_facts(spark, sf):
    lang = F.when(F.col("suffix") == ".py", "python").when(F.col("suffix") == ".java", "java").when(F.col("suffix") == ".js", "javascript")
    found = supplier_files(spark, sf).select("rel_path", sourcecode.extracted(lang, F.col("content")).alias("x"))
    return found.select("rel_path", F.inline("x.facts")).select("rel_path", "direction", "resource_type", "resource_id", "tier", "line")


def portfolio_run(spark, sf):
    """A whole run; of its capabilities those of resources."""
    caps = pipeline.run(spark, supplier_files(spark, sf))["capabilities"]
    return caps.filter(F.col("dimension").isin("messaging", "data", "column")).select("id", "dimension", "label", "n_members", "n_owners", "tier", "coupling", "play", "opportunity")


def portfolio_rejections(spark, sf):
    """Errors of a run with an extractor that names no resource, by module."""
    careless = lambda rows: pipeline.shaped(rows.filter("suffix = '.sql'").select("module_id", "rel_path", F.lit("WRITES").alias("direction"), F.lit("SQL_TABLE").alias("resource_type"), F.lit("").alias("resource_id"), F.lit("HIGH").alias("tier")))
    got = pipeline.ingested(spark, supplier_files(spark, sf))
    errors = pipeline.extract(got["placed"], got["owned"], pipeline.EXTRACTORS | {"careless": careless})["errors"]
    return errors.groupBy("phase", "source", "error_type", "message", "severity").agg(F.count(F.lit(1)).alias("n"))


def portfolio_incremental(spark, sf):
    """Two runs over one store: all; then with every tenth supplier changed and every eleventh gone. What each run did with each
    project, and the facts that the store has of it at the end."""
    store = catalog.Catalog(spark, f"{durable_folder(spark)}/store-{uuid.uuid4().hex}", buckets=8)  # a small store has few buckets
    first, key = supplier_files(spark, sf), F.regexp_extract("rel_path", "supplier-([0-9]+)/", 1).try_cast("long")
    later = first.filter(F.coalesce(key % 11 != 0, F.lit(True))).withColumn("content", F.when((key % 10 == 0) & (F.col("suffix") != ""), F.concat("content", F.lit("\n"))).otherwise(F.col("content")))
    out = None
    for k, source in enumerate((first, later)):
        states, _ = pipeline.incremental(spark, source, store, pipeline.Config(semantic=False))
        one = states.select(F.lit(k).alias("run"), F.col("project_id").alias("id"), "state")
        out = one if out is None else out.unionByName(one)
    held = store.read("integration_facts").groupBy(F.split_part("module_id", F.lit(":"), F.lit(1)).alias("id")).agg(F.count(F.lit(1)).cast("string").alias("state"))
    return out.unionByName(held.select(F.lit(2).alias("run"), "id", "state"))


def inventory_projects(spark, sf):
    """An inventory for each supplier: its nation is a group with a subgroup; the project is told twice, once without its path."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    path = F.concat(F.lit("n"), nation, F.lit("/s/"), key.cast("string"))
    project = lambda **more: F.array(F.struct(key.alias("id"), *(v.alias(k) for k, v in more.items())))
    inner = F.array(F.struct(F.concat(F.lit("n"), nation, F.lit("/s")).alias("full_path"), project(path_with_namespace=path, http_url_to_repo=F.when(key % 3 > 0, F.concat(F.lit("https://host/"), path)).otherwise("")).alias("projects")))
    groups = F.array(F.struct(F.concat(F.lit("n"), nation).alias("full_path"), inner.alias("subgroups")))
    texts = read(spark, sf, "supplier").select(F.to_json(F.struct(groups.alias("groups"), project(name=F.when(key % 2 == 0, F.col("s_name"))).alias("projects"))).alias("value"))
    return inventory.parse(spark, texts)


QUERIES = {f.__name__: f for f in (census_projects, extracted_facts, portfolio_run, portfolio_rejections, portfolio_incremental, inventory_projects)}

_S = """s AS (SELECT s_suppkey AS k, s_suppkey % 4 AS l, 'supplier-' || s_suppkey AS p, 'nation-' || s_nationkey || '/supplier-' || s_suppkey AS dir, s_nationkey AS n, n_name,
  CASE WHEN s_suppkey % 7 = 0 THEN 'supply.only.' || s_suppkey ELSE 'supply.of.' || s_nationkey END AS topic, CASE WHEN s_suppkey % 7 = 0 THEN 'stock_only_' || s_suppkey ELSE 'stock_' || s_nationkey END AS tab
  FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey)"""
_M = "s.p || ':' || ['py', 'java', 'node', 'sql'][l + 1]"
#: What a supplier's files say: language, file, direction, resource, line.
_SAID = """said(l, file, direction, resource_type, resource, line) AS (VALUES (0, 'app.py', 'PRODUCES', 'KAFKA_TOPIC', 'topic', 6), (0, 'app.py', 'WRITES', 'SQL_TABLE', 'tab', 7), (0, 'app.py', 'WRITES', 'SQL_COLUMN', 'id', 7), (0, 'app.py', 'WRITES', 'SQL_COLUMN', 'total', 7),
  (0, 'store.py', 'READS', 'SQL_TABLE', 'tab', 2), (1, 'Main.java', 'PRODUCES', 'KAFKA_TOPIC', 'topic', 4), (1, 'Main.java', 'READS', 'SQL_TABLE', 'tab', 5), (2, 'index.js', 'PRODUCES', 'KAFKA_TOPIC', 'topic', 2),
  (3, 'schema.sql', 'WRITES', 'SQL_TABLE', 'tab', NULL), (3, 'schema.sql', 'WRITES', 'SQL_COLUMN', 'id', NULL), (3, 'schema.sql', 'WRITES', 'SQL_COLUMN', 'total', NULL), (3, 'load.sql', 'WRITES', 'SQL_TABLE', 'tab', NULL), (3, 'load.sql', 'READS', 'SQL_TABLE', 'staging', NULL), (3, 'load.sql', 'WRITES', 'SQL_COLUMN', 'id', NULL), (3, 'load.sql', 'WRITES', 'SQL_COLUMN', 'total', NULL))"""
_FACTS = f"""facts AS (SELECT {_M} AS module_id, s.dir || '/' || file AS rel_path, direction, resource_type, CASE resource WHEN 'topic' THEN topic WHEN 'tab' THEN tab WHEN 'staging' THEN 'staging_' || n ELSE tab || '.' || resource END AS resource_id,
  'HIGH' AS tier, line, CASE file WHEN 'store.py' THEN 1 ELSE 0 END AS fact_seq, k FROM s JOIN said USING (l))"""
_OWNERS = f"owners AS (SELECT {_M} AS module_id, 'team-' || n_name AS owner FROM s WHERE n % 5 <> 0 AND n_name IS NOT NULL)"
_COUPLINGS = f"couplings AS (SELECT {_M} AS module_id, CASE l WHEN 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS coupling FROM s WHERE l < 3)"

ORACLES = {
    "census_projects": f"""WITH {_S} SELECT p AS project_id, dir, CASE WHEN n % 5 <> 0 AND n_name IS NOT NULL THEN 'team-' || n_name ELSE 'unknown' END AS owner, ['python', 'java', 'javascript', 'sql'][l + 1] AS "primary",
        ['python', 'java', 'javascript', 'sql'][l + 1] AS langs, [13, 7, 3, 4][l + 1]::BIGINT AS loc FROM s""",
    "extracted_facts": f"WITH {_S}, {_SAID}, {_FACTS} SELECT rel_path, direction, resource_type, resource_id, tier, line::INT AS line FROM facts WHERE line IS NOT NULL",
    "portfolio_run": f"WITH {', '.join((_S, _SAID, _FACTS, _OWNERS, _COUPLINGS, *(CTES[c] for c in ('touch', 'members', 'sums', 'caps'))))} SELECT id, dimension, label, n_members, n_owners, tier, coupling, play, opportunity FROM caps",
    "portfolio_rejections": f"WITH {_S} SELECT 'extract' AS phase, p || ':sql' AS source, 'InvalidRow' AS error_type, 'row of integration_facts is not valid' AS message, 'WARNING' AS severity, 2::BIGINT AS n FROM s WHERE l = 3",
    "portfolio_incremental": f"""WITH {_S}, {_SAID}, {_FACTS} SELECT 0 AS run, p AS id, 'new' AS state FROM s UNION ALL SELECT 1, p, CASE WHEN k % 11 = 0 THEN 'deleted' WHEN k % 10 = 0 THEN 'changed' ELSE 'same' END FROM s
        UNION ALL SELECT 2, split_part(module_id, ':', 1), count(*)::VARCHAR FROM facts WHERE k % 11 <> 0 GROUP BY module_id""",
    "inventory_projects": """SELECT s_suppkey::BIGINT AS id, 'n' || s_nationkey || '/s/' || s_suppkey AS path, CASE WHEN s_suppkey % 3 > 0 THEN 'https://host/n' || s_nationkey || '/s/' || s_suppkey END AS url,
        CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE s_suppkey::VARCHAR END AS name FROM supplier""",
}
