"""Capabilities, edges, clusters and their orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalogue.standins import CAPS, CTES, couplings, dependencies, facts, modules, owners, read, sql
from weft.operators import capability, graph
from weft.schema import split_valid, tier_name

COLUMNS = "id, dimension, label, n_members, n_owners, tier, coupling, play, opportunity"


def _caps(spark: SparkSession, sf: str) -> DataFrame:
    return capability.resource_capabilities(facts(spark, sf), owners(spark, sf), couplings(spark, sf))


def _raw_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts some of which break a rule."""
    bad = F.col("fact_seq") % 11
    return facts(spark, sf).withColumns({
        "tier": F.when(bad == 0, "SURE").otherwise(F.col("tier")), "resource_id": F.when(bad == 1, "").otherwise(F.col("resource_id")), "direction": F.when(bad == 2, F.lit(None)).otherwise(F.col("direction")),
    })


def fact_validation_split(spark, sf):
    good, bad = split_valid("integration_facts", _raw_facts(spark, sf))
    said = lambda df, name: df.groupBy("resource_type").agg(F.count(F.lit(1)).alias("n")).withColumn("verdict", F.lit(name))
    return said(good, "valid").unionByName(said(bad, "rejected"))


def strongest_touch(spark, sf):
    return capability.strongest_touch(facts(spark, sf)).select("resource_type", "resource_id", "module_id", "direction", tier_name(F.col("rank")).alias("tier"))


def owner_join(spark, sf):
    return read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("module"), F.col("n_name").alias("owner"))


def owner_left_default(spark, sf):
    return capability.with_owner(modules(spark, sf), owners(spark, sf), couplings(spark, sf)).select("module_id", "owner", "coupling")


def edges_shared_resource(spark, sf):
    return graph.shared_edges(facts(spark, sf))


def edge_type_counts(spark, sf):
    return graph.edge_counts(facts(spark, sf))


def cap_resource_ranked(spark, sf):
    return capability.ranked(_caps(spark, sf))


def cap_top10(spark, sf):
    return capability.ranked(_caps(spark, sf)).limit(10)


def cap_by_dimension(spark, sf):
    return _caps(spark, sf).groupBy("dimension").agg(F.count(F.lit(1)).alias("n"))


def cap_by_play(spark, sf):
    return _caps(spark, sf).groupBy("play").agg(F.count(F.lit(1)).alias("n"), F.max("opportunity").alias("best"))


def cap_topn_per_dimension(spark, sf):
    return capability.top_per_dimension(_caps(spark, sf), 5).select("dimension", "position", "id", "opportunity")


def cap_dim_play_cube(spark, sf):
    cube = _caps(spark, sf).cube("dimension", "play").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    return cube.select("dimension", "play", "n", F.col("level").cast("long").alias("level"))


def cap_dim_play_rollup(spark, sf):
    return _caps(spark, sf).rollup("dimension", "play").agg(F.count(F.lit(1)).alias("n"))


def dependency_capability(spark, sf):
    return capability.ranked(capability.dependency_capabilities(dependencies(spark, sf), owners(spark, sf), couplings(spark, sf)))


def fact_modules_of_resource(spark, sf):
    """Facts of one resource, as a point lookup."""
    return facts(spark, sf).filter("resource_id = 'r7'").groupBy("resource_type", "module_id").agg(F.count(F.lit(1)).alias("n"))


def _pairs(spark, sf):
    """Supplier pairs of one nation next to each other: chains."""
    s = read(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    t = s.select(F.col("s_suppkey").alias("k2"), F.col("s_nationkey").alias("n2"))
    near = s.join(t, F.col("s_nationkey") == F.col("n2")).filter("k2 > s_suppkey and k2 - s_suppkey <= 12")
    return near.select(F.concat(F.lit("m"), "s_suppkey").alias("a"), F.concat(F.lit("m"), "k2").alias("b"), F.when((F.col("s_suppkey") + F.col("k2")) % 3 == 0, "LOW").otherwise("MED").alias("tier"))


def _nation_facts(spark, sf):
    """A fact for each supplier, on a resource of its nation: a graph of as many components as nations."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return read(spark, sf, "supplier").select(
        F.concat(F.lit("m"), key).alias("module_id"), F.when(key % 3 == 0, "READS").when(nation % 2 == 0, "WRITES").otherwise("PRODUCES").alias("direction"), F.when(nation % 2 == 0, "SQL_TABLE").otherwise("KAFKA_TOPIC").alias("resource_type"),
        F.concat(F.lit("n"), nation).alias("resource_id"), F.when(F.col("s_acctbal") >= 0, "HIGH").otherwise("MED").alias("tier"), key.cast("long").alias("fact_seq"),
    )


def _neighbours(spark, sf):
    """Each supplier with the next one by key."""
    s = read(spark, sf, "supplier").select("s_suppkey")
    return s.join(s.select((F.col("s_suppkey") - 1).alias("s_suppkey")), "s_suppkey").select(F.concat(F.lit("m"), "s_suppkey").alias("a"), F.concat(F.lit("m"), F.col("s_suppkey") + 1).alias("b"), F.when(F.col("s_suppkey") % 3 == 0, "LOW").otherwise("MED").alias("tier"))


def graph_clusters(spark, sf):
    clones = _pairs(spark, sf).filter("false").select(F.col("a").alias("module_a"), F.col("b").alias("module_b"), F.lit(1).alias("clone_type"), "tier")
    return graph.clusters(facts(spark, sf), clones, owners(spark, sf), couplings(spark, sf))


def graph_clusters_by_nation(spark, sf):
    clones = _pairs(spark, sf).filter("false").select(F.col("a").alias("module_a"), F.col("b").alias("module_b"), F.lit(1).alias("clone_type"), "tier")
    return graph.clusters(_nation_facts(spark, sf), clones, owners(spark, sf), couplings(spark, sf))


def functional_capabilities(spark, sf):
    return capability.pair_capabilities(_pairs(spark, sf), "functional", "Semantic duplicate", owners(spark, sf), couplings(spark, sf), max_size=6)


def code_capabilities(spark, sf):
    return capability.pair_capabilities(_pairs(spark, sf), "code", "Code clone", owners(spark, sf), couplings(spark, sf))


def judge_promote_anti(spark, sf):
    held = graph.connected_components(graph.stars(_nation_facts(spark, sf))).withColumnsRenamed({"node": "module_id", "root": "id"})
    return graph.promoted(_neighbours(spark, sf).withColumn("play", F.lit("STANDARDIZE")), held, couplings(spark, sf))


def component_members(spark, sf):
    """By rounds whatever the size, as a large graph is done."""
    return graph.connected_components(_pairs(spark, sf), small=0).select(F.col("node").alias("module_id"), F.col("root").alias("component"))


QUERIES = {f.__name__: f for f in (
    fact_validation_split, strongest_touch, owner_join, owner_left_default, edges_shared_resource, edge_type_counts, cap_resource_ranked, cap_top10, cap_by_dimension, cap_by_play,
    cap_topn_per_dimension, cap_dim_play_cube, cap_dim_play_rollup, dependency_capability, fact_modules_of_resource, graph_clusters, graph_clusters_by_nation, functional_capabilities, code_capabilities,
    judge_promote_anti, component_members,
)}

_EDGES = """edges AS (SELECT x.module_id AS a, y.module_id AS b, CASE WHEN x.resource_type = 'KAFKA_TOPIC' AND x.direction = 'PRODUCES' AND y.direction = 'PRODUCES' THEN 'DUP_PRODUCER'
  WHEN x.resource_type = 'SQL_TABLE' AND x.direction = 'WRITES' AND y.direction = 'WRITES' THEN 'DUP_WRITER' WHEN x.resource_type = 'HTTP_ENDPOINT' AND x.direction = 'SERVES' AND y.direction = 'SERVES' THEN 'DUP_ENDPOINT'
  ELSE 'SHARES_RESOURCE' END AS type, x.resource_type, x.resource_id, CASE least(x.rank, y.rank) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MED' ELSE 'LOW' END AS tier
  FROM touch x JOIN touch y ON x.resource_type = y.resource_type AND x.resource_id = y.resource_id AND x.module_id < y.module_id)"""
_RANKED = "ORDER BY opportunity DESC, CASE tier WHEN 'HIGH' THEN 3 WHEN 'MED' THEN 2 ELSE 1 END DESC, id"
_PAIRS = "pairs AS (SELECT 'm' || x.s_suppkey AS a, 'm' || y.s_suppkey AS b, CASE WHEN (x.s_suppkey + y.s_suppkey) % 3 = 0 THEN 'LOW' ELSE 'MED' END AS tier FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND y.s_suppkey > x.s_suppkey AND y.s_suppkey - x.s_suppkey <= 12)"


def _reach(edges: str, name: str = "comp") -> str:
    """Components by a recursive union; needs WITH RECURSIVE."""
    return f"{name}_reach(node, other) AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges} UNION SELECT r.node, CASE WHEN e.a = r.other THEN e.b ELSE e.a END FROM {name}_reach r JOIN {edges} e ON e.a = r.other OR e.b = r.other), {name} AS (SELECT node AS module_id, least(node, min(other)) AS component FROM {name}_reach GROUP BY node)"


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


_PAIR_CAPS = """rows AS (SELECT component, module_id, coalesce(owner, 'unknown') AS owner, coupling FROM comp LEFT JOIN owners USING (module_id) LEFT JOIN couplings USING (module_id)),
  sums AS (SELECT component, count(*) AS n_members, count(DISTINCT owner) AS n_owners, round_even(avg(coupling), 3) AS coupling, array_to_string(list_sort(list(module_id))[1:3], ', ') AS names FROM rows GROUP BY component),
  weak AS (SELECT component, min(CASE tier WHEN 'MED' THEN 2 ELSE 1 END) AS rank FROM pairs JOIN comp ON a = module_id GROUP BY component)
  SELECT '{kind}:' || component AS id, '{kind}' AS dimension, '{prefix} · ' || names AS label, n_members, n_owners, CASE rank WHEN 2 THEN 'MED' ELSE 'LOW' END AS tier, coupling,
  CASE WHEN n_owners = 1 THEN 'RETIRE' ELSE 'STANDARDIZE' END AS play, round_even((n_members + 2) * (1 - coalesce(coupling, 0)) * CASE WHEN n_owners > 1 THEN 1.5::DOUBLE ELSE 1::DOUBLE END * (rank / 3), 2) AS opportunity
  FROM sums JOIN weak USING (component) {where}"""
_NATION_FACTS = """facts AS (SELECT 'm' || s_suppkey AS module_id, CASE WHEN s_suppkey % 3 = 0 THEN 'READS' WHEN s_nationkey % 2 = 0 THEN 'WRITES' ELSE 'PRODUCES' END AS direction, CASE WHEN s_nationkey % 2 = 0 THEN 'SQL_TABLE' ELSE 'KAFKA_TOPIC' END AS resource_type,
  'n' || s_nationkey AS resource_id, CASE WHEN s_acctbal >= 0 THEN 'HIGH' ELSE 'MED' END AS tier, s_suppkey AS fact_seq FROM supplier)"""
_NEIGHBOURS = "pairs AS (SELECT 'm' || x.s_suppkey AS a, 'm' || y.s_suppkey AS b, CASE WHEN x.s_suppkey % 3 = 0 THEN 'LOW' ELSE 'MED' END AS tier FROM supplier x JOIN supplier y ON y.s_suppkey = x.s_suppkey + 1)"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


ORACLES = {
    "fact_validation_split": sql("facts", """, raw AS (SELECT resource_type, CASE WHEN fact_seq % 11 IN (0, 1, 2) THEN 'rejected' ELSE 'valid' END AS verdict FROM facts)
        SELECT resource_type, count(*) AS n, verdict FROM raw GROUP BY ALL"""),
    "strongest_touch": sql("facts touch", "SELECT resource_type, resource_id, module_id, direction, tier FROM touch"),
    "owner_join": "SELECT s_suppkey AS module, n_name AS owner FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "owner_left_default": sql("owners couplings modules", "SELECT module_id, coalesce(owner, 'unknown') AS owner, coupling FROM modules LEFT JOIN owners USING (module_id) LEFT JOIN couplings USING (module_id)"),
    "edges_shared_resource": _with(CTES["facts"], CTES["touch"], _EDGES) + " SELECT * FROM edges",
    "edge_type_counts": _with(CTES["facts"], CTES["touch"], _EDGES) + " SELECT type, tier, count(*) AS n FROM edges GROUP BY ALL",
    "cap_resource_ranked": sql(CAPS, f"SELECT {COLUMNS} FROM caps {_RANKED}"),
    "cap_top10": sql(CAPS, f"SELECT {COLUMNS} FROM caps {_RANKED} LIMIT 10"),
    "cap_by_dimension": sql(CAPS, "SELECT dimension, count(*) AS n FROM caps GROUP BY ALL"),
    "cap_by_play": sql(CAPS, "SELECT play, count(*) AS n, max(opportunity) AS best FROM caps GROUP BY ALL"),
    "cap_topn_per_dimension": sql(CAPS, "SELECT * FROM (SELECT dimension, (row_number() OVER (PARTITION BY dimension ORDER BY opportunity DESC, CASE tier WHEN 'HIGH' THEN 3 WHEN 'MED' THEN 2 ELSE 1 END DESC, id))::INT AS position, id, opportunity FROM caps) WHERE position <= 5"),
    "cap_dim_play_cube": sql(CAPS, "SELECT dimension, play, count(*) AS n, grouping(dimension, play)::BIGINT AS level FROM caps GROUP BY CUBE (dimension, play)"),
    "cap_dim_play_rollup": sql(CAPS, "SELECT dimension, play, count(*) AS n FROM caps GROUP BY ROLLUP (dimension, play)"),
    "dependency_capability": sql("owners couplings dependencies", """, used AS (SELECT DISTINCT module_id, split_part(split_part(purl, '/', -1), '@', 1) AS name FROM dependencies),
        sums AS (SELECT name, count(*) AS n_members, count(DISTINCT coalesce(owner, 'unknown')) AS n_owners, round_even(avg(coupling), 3) AS coupling FROM used LEFT JOIN owners USING (module_id) LEFT JOIN couplings USING (module_id) GROUP BY name HAVING n_members >= 2 AND n_owners >= 2)
        SELECT 'dependency:' || name AS id, 'dependency' AS dimension, 'Shared library ' || name AS label, n_members, n_owners, 'HIGH' AS tier, coupling, 'STANDARDIZE' AS play,
        round_even(n_members * (1 - coalesce(coupling, 0)) * CASE WHEN n_owners > 1 THEN 1.5::DOUBLE ELSE 1::DOUBLE END, 2) AS opportunity FROM sums"""),
    "fact_modules_of_resource": sql("facts", "SELECT resource_type, module_id, count(*) AS n FROM facts WHERE resource_id = 'r7' GROUP BY ALL"),
    "functional_capabilities": _recursive(_with(_PAIRS, CTES["owners"], CTES["couplings"], _reach("pairs"), _PAIR_CAPS.format(kind="functional", prefix="Semantic duplicate", where="WHERE n_members <= 6"))),
    "code_capabilities": _recursive(_with(_PAIRS, CTES["owners"], CTES["couplings"], _reach("pairs"), _PAIR_CAPS.format(kind="code", prefix="Code clone", where=""))),
    "component_members": _recursive(_with(_PAIRS, _reach("pairs"))) + " SELECT * FROM comp",
    "judge_promote_anti": _recursive(_with(_NATION_FACTS, CTES["touch"], _EDGES, CTES["couplings"], _NEIGHBOURS, "pr AS (SELECT DISTINCT a, b FROM edges)", _reach("pr")))
        + """, best AS (SELECT least(a, b) AS a, greatest(a, b) AS b, tier FROM pairs), free AS (SELECT best.* FROM best LEFT JOIN comp x ON x.module_id = a LEFT JOIN comp y ON y.module_id = b WHERE x.component IS NULL OR y.component IS NULL OR x.component <> y.component)
        SELECT a, b, tier, 4 AS score, round_even(c, 3) AS coupling, round_even(4 * (1 - coalesce(round_even(c, 3), 0)), 2) AS opportunity, 'STANDARDIZE' AS play, 'Semantic duplicate · ' || a || ' & ' || b AS label
        FROM (SELECT free.*, CASE WHEN p.coupling IS NULL THEN q.coupling WHEN q.coupling IS NULL THEN p.coupling ELSE (p.coupling + q.coupling) / 2 END AS c FROM free LEFT JOIN couplings p ON p.module_id = a LEFT JOIN couplings q ON q.module_id = b)""",
}
ORACLES |= {
    name: _recursive(_with(_facts, CTES["touch"], _EDGES, CTES["owners"], CTES["couplings"], "pr AS (SELECT DISTINCT a, b FROM edges)", _reach("pr"),
        "evid AS (SELECT component, e.* FROM edges e JOIN comp ON e.a = module_id)",
        """ev AS (SELECT component AS id, count(DISTINCT (resource_type, resource_id)) AS n_shared, max(CASE tier WHEN 'HIGH' THEN 3 WHEN 'MED' THEN 2 ELSE 1 END) AS rank, bool_or(type <> 'SHARES_RESOURCE') AS dup,
          min(CASE WHEN type = 'DUP_PRODUCER' THEN resource_id END) AS producer, min(CASE WHEN type = 'DUP_WRITER' THEN resource_id END) AS writer, min(CASE WHEN type = 'DUP_ENDPOINT' THEN resource_id END) AS endpoint,
          min({'t': resource_type, 'r': resource_id}) AS eg FROM evid GROUP BY component)""",
        "ms AS (SELECT component AS id, count(*) AS n_members, count(DISTINCT coalesce(owner, 'unknown')) AS n_owners, round_even(avg(coupling), 3) AS coupling FROM comp LEFT JOIN owners USING (module_id) LEFT JOIN couplings USING (module_id) GROUP BY component)"))
        + """ SELECT id, n_members, n_owners, n_shared, CASE rank WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MED' ELSE 'LOW' END AS tier, n_shared * n_members + CASE WHEN dup THEN 2 ELSE 0 END AS score, coupling,
          round_even((n_shared * n_members + CASE WHEN dup THEN 2 ELSE 0 END) * (1 - coalesce(coupling, 0)), 2) AS opportunity, CASE WHEN dup AND n_owners = 1 THEN 'RETIRE' WHEN dup THEN 'STANDARDIZE' ELSE 'EXTRACT' END AS play,
          coalesce('Publishes event · ' || producer, 'Writes table · ' || writer, 'Duplicate API · ' || endpoint, 'Shares ' || CASE eg.t WHEN 'KAFKA_TOPIC' THEN 'topic' WHEN 'SQL_TABLE' THEN 'table' WHEN 'SQL_COLUMN' THEN 'column' ELSE 'endpoint' END || ' · ' || eg.r) AS label FROM ms JOIN ev USING (id)"""
    for name, _facts in (("graph_clusters", CTES["facts"]), ("graph_clusters_by_nation", _NATION_FACTS))
}
