"""What is kept up instead of made anew: stores, counts, components; healed texts; recall by hyperplanes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weft.catalogue.standins import CTES, facts, modules, read, sql
from weft.operators import deltas, similarity
from weft.operators.components import connected_components, updated_components
from weft.plans import catalog, remediate
from weft.plans.durable import durable, durable_folder
from weft.sources import files

#: Tables and bits of the registered recall: 0.95 of the pairs at a cosine of 0.4 for some 2,000 vectors.
SHAPE = (80, 6)


def recall_lsh(spark, sf):
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return similarity.cosine_pairs_by_planes(vectors, 0.40, shape=SHAPE).withColumn("similarity", F.round("similarity", 6))


def repo_hash(spark, sf):
    docs = read(spark, sf, "documents").select("source", F.col("doc_id").cast("string").alias("rel_path"), F.col("text").alias("content"))
    return files.listed_hashes(docs, "source")


def _store(spark):
    return catalog.Catalog(spark, f"{durable_folder(spark)}/store-{uuid.uuid4().hex}")


def store_cleared(spark, sf):
    """Facts by module and tier in a store after two appends and after three projects left it."""
    store, rows = _store(spark), facts(spark, sf)
    store.append("modules", modules(spark, sf).select(F.col("module_id").alias("id"), "project_id"))
    for odd in (0, 1):
        store.append("integration_facts", rows.filter(F.col("fact_seq") % 2 == odd))
    store.clear_projects(spark.range(1, 4).select(F.concat(F.lit("p"), "id").alias("project_id")))
    return store.read("integration_facts").groupBy("module_id", "tier").agg(F.count(F.lit(1)).alias("n"))


def store_upserted(spark, sf):
    """Projects of a store after new rows took the place of every third."""
    store = _store(spark)
    rows = read(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").cast("long").alias("loc"))
    store.append("projects", rows)
    store.upsert("projects", rows.filter("loc % 3 = 0").withColumns({"name": F.lit("renamed"), "loc": F.col("loc") * 2}))
    return store.read("projects").select("id", "name", "loc")


def _moved(spark, sf):
    """A tenth of the facts, as they are and as they become: at another resource, of another tier."""
    rows = facts(spark, sf).withColumn("part", F.floor(F.col("fact_seq") / 8) % 10)
    old = rows.filter("part = 0").drop("part")
    return old, old.withColumns({"resource_id": F.concat(F.lit("r"), F.substring("resource_id", 2, 20).cast("long") + 7), "tier": F.when(F.col("tier") == "HIGH", "LOW").otherwise("HIGH")})


def shared_kept_up(spark, sf):
    """Shared resources after a tenth of the facts has moved, from the counts before and the facts that moved."""
    held = durable(deltas.touches(facts(spark, sf)))
    removed, added = _moved(spark, sf)
    _, totals = deltas.applied(held, durable(deltas.shared(held)), added, removed)
    return deltas.best_tier(totals).select("resource_type", "resource_id", "n_modules", "n_facts", "n_high", "n_produces", "n_writes", "n_serves", "tier")


def touches_kept_up(spark, sf):
    """Which modules touch a resource, and how often, after the same move."""
    held = durable(deltas.touches(facts(spark, sf)))
    removed, added = _moved(spark, sf)
    return deltas.applied(held, durable(deltas.shared(held)), added, removed)[0].select("resource_type", "resource_id", "module_id", "n_facts", "n_high")


def _ring(spark, sf):
    """Customers that follow each other within groups of twelve."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("a"))
    return c.select("a", (F.col("a") + 1).alias("b")).filter("a % 12 <> 11")


def components_kept_up(spark, sf):
    """Components after some edges went and others came, from those before."""
    edges = _ring(spark, sf)
    gone = edges.filter("a % 36 = 5")
    came = read(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("a")).filter("a % 60 = 7").select("a", (F.col("a") + 24).alias("b"))
    now = edges.join(gone, ["a", "b"], "left_anti").unionByName(came)
    return updated_components(durable(connected_components(edges, small=0)), durable(now), durable(came), durable(gone), small=0)


def healed_texts(spark, sf):
    """A text for each order that sends to one topic and names two, healed by what its project is to do with each."""
    o = read(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("p"), (F.col("o_orderkey") % 7).alias("t"), (F.col("o_orderkey") % 5).alias("u"))
    text = F.format_string("bus.send('t%d', 1)\nx = 't%d' + 'u%d'\ny = 'u%d.more' + 'au%d'", "t", "t", "u", "u", "u")
    sources = o.select("o_orderkey", F.concat(F.lit("p"), "p").alias("project"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".py")).alias("rel_path"), text.alias("content"))
    role = lambda odd: F.when(F.col("p") % 2 == odd, "primary").otherwise("secondary").alias("role")
    acts = o.select("p").distinct().select(F.concat(F.lit("p"), "p").alias("project"), F.inline(F.array(F.struct(F.concat(F.lit("t"), F.col("p") % 7).alias("resource_id"), role(0)), F.struct(F.concat(F.lit("u"), F.col("p") % 5).alias("resource_id"), role(1)))))
    return remediate.healed(sources, acts).select("o_orderkey", "healed")


QUERIES = {f.__name__: f for f in (recall_lsh, repo_hash, store_cleared, store_upserted, shared_kept_up, touches_kept_up, components_kept_up, healed_texts)}

_TABLES, _BITS = SHAPE
_COS = "list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[])"
_MOVED = f"""{CTES['facts']}, after AS (SELECT resource_type, resource_id, module_id, direction, tier FROM facts WHERE fact_seq // 8 % 10 <> 0
  UNION ALL SELECT resource_type, 'r' || (substr(resource_id, 2)::BIGINT + 7), module_id, direction, CASE tier WHEN 'HIGH' THEN 'LOW' ELSE 'HIGH' END FROM facts WHERE fact_seq // 8 % 10 = 0)"""
ORACLES = {
    "recall_lsh": f"""WITH planes AS (SELECT t, b, list(CASE WHEN substr(md5(t || ':' || b || ':' || d), 1, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY d) AS plane
        FROM range({_TABLES}) AS x(t), range({_BITS}) AS y(b), (SELECT unnest(range(max(len(embedding)))) AS d FROM embeddings) GROUP BY t, b),
      codes AS (SELECT vec_id, t, sum(CASE WHEN list_dot_product(embedding::DOUBLE[], plane) >= 0 THEN 1 << b ELSE 0 END) AS code FROM embeddings, planes GROUP BY vec_id, t),
      met AS (SELECT DISTINCT p.vec_id AS a, q.vec_id AS b FROM codes p JOIN codes q ON p.t = q.t AND p.code = q.code AND p.vec_id < q.vec_id)
      SELECT a, b, round({_COS}, 6) AS similarity FROM met JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b WHERE {_COS} >= 0.4""",
    "repo_hash": "SELECT source, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id || ':' || sha256(text))) AS content_hash FROM documents GROUP BY source",
    "store_cleared": sql("facts modules", "SELECT module_id, tier, count(*) AS n FROM facts WHERE module_id NOT IN (SELECT module_id FROM modules WHERE project_id IN ('p1', 'p2', 'p3')) GROUP BY module_id, tier"),
    "store_upserted": "SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'renamed' ELSE c_name END AS name, (c_custkey * CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END)::BIGINT AS loc FROM customer",
    "shared_kept_up": f"""WITH {_MOVED} SELECT resource_type, resource_id, count(DISTINCT module_id) AS n_modules, count(*) AS n_facts, count(*) FILTER (tier = 'HIGH') AS n_high, count(*) FILTER (direction = 'PRODUCES') AS n_produces,
        count(*) FILTER (direction = 'WRITES') AS n_writes, count(*) FILTER (direction = 'SERVES') AS n_serves, CASE WHEN count(*) FILTER (tier = 'HIGH') > 0 THEN 'HIGH' WHEN count(*) FILTER (tier = 'MED') > 0 THEN 'MED' ELSE 'LOW' END AS tier
        FROM after GROUP BY resource_type, resource_id HAVING n_modules > 1""",
    "touches_kept_up": f"WITH {_MOVED} SELECT resource_type, resource_id, module_id, count(*) AS n_facts, count(*) FILTER (tier = 'HIGH') AS n_high FROM after GROUP BY ALL",
    "components_kept_up": """WITH RECURSIVE one AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey % 12 <> 11 AND c_custkey % 36 <> 5 UNION ALL SELECT c_custkey, c_custkey + 24 FROM customer WHERE c_custkey % 60 = 7),
      e AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one), r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node AND r.root < e.b)
      SELECT node, min(root) AS root FROM r GROUP BY node""",
    "healed_texts": r"""WITH o AS (SELECT o_orderkey, o_custkey % 20 AS p, 't' || (o_orderkey % 7) AS t, 'u' || (o_orderkey % 5) AS u FROM orders),
      x AS (SELECT *, CASE WHEN t = 't' || (p % 7) THEN CASE WHEN p % 2 = 0 THEN 'canonical.' ELSE 'gone' END ELSE '' END AS ct, CASE WHEN u = 'u' || (p % 5) THEN CASE WHEN p % 2 = 1 THEN 'canonical.' ELSE 'decommissioned.' END ELSE '' END AS cu FROM o)
      SELECT o_orderkey, CASE WHEN ct = 'gone' THEN '# decommissioned: ' ELSE '' END || 'bus.send(''' || CASE WHEN ct = 'gone' THEN '' ELSE ct END || t || ''', 1)' || chr(10)
        || 'x = ''' || CASE WHEN ct = 'gone' THEN 'decommissioned.' ELSE ct END || t || ''' + ''' || cu || u || '''' || chr(10) || 'y = ''' || u || '.more'' + ''a' || u || '''' AS healed FROM x""",
}
