"""Reports, views, stored tables and streams over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalogue.capabilities import _caps
from weft.catalogue.standins import CAPS, CTES, dependencies, facts, modules, owners, read, sql
from weft.functions.text import resolve, safe_label
from weft.operators import capability, reports
from weft.plans import catalog, remediate, views
from weft.streaming import events as streams


def shared_dependency(spark, sf):
    return reports.shared_dependencies(dependencies(spark, sf), owners(spark, sf))


def _categories(spark: SparkSession) -> DataFrame:
    return spark.range(40).select(F.concat(F.lit("c"), F.col("id") % 7).alias("category"), F.concat(F.lit("lib"), "id").alias("library"))


def tech_standard(spark, sf):
    return reports.tech_standards(dependencies(spark, sf), _categories(spark))


def tech_fragmented(spark, sf):
    return reports.tech_standards(dependencies(spark, sf), _categories(spark)).filter("fragmentation > 5").select("category", "fragmentation")


def lang_histogram(spark, sf):
    return reports.histogram(read(spark, sf, "documents"), "lang")


def shared_tables(spark, sf):
    return reports.shared_tables(facts(spark, sf))


def orphan_orders(spark, sf):
    return read(spark, sf, "orders").join(read(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_orderstatus")


def orphan_documents(spark, sf):
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def _expected_got(spark, sf):
    docs = read(spark, sf, "documents")
    expected = docs.join(read(spark, sf, "labels").filter("quality = 0"), "doc_id").select("source", "doc_id")
    got = docs.join(read(spark, sf, "labels"), "doc_id").filter(F.length(F.regexp_replace("text", "[^#$%&*|!]", "")) * 20 > F.length("text")).select("source", "doc_id")
    gaps = docs.filter("n_chars < 200").select("source")
    return expected, got, gaps


def eval_precision_recall(spark, sf):
    expected, got, gaps = _expected_got(spark, sf)
    return reports.evaluation(expected, got, gaps, "source", "doc_id")


def eval_missed_extra(spark, sf):
    expected, got, _ = _expected_got(spark, sf)
    return reports.missed_and_extra(expected, got, "source", "doc_id")


def counts_all(spark, sf):
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
    return reports.counts({n: read(spark, sf, n) for n in names})


def error_severity_counts(spark, sf):
    severity = F.when(F.col("event_type") == F.lit("error"), "ERROR").when(F.col("value") > 50, "WARNING").otherwise("INFO")
    return reports.error_counts(read(spark, sf, "events").select(severity.alias("severity")))


def run_totals(spark, sf):
    rows = facts(spark, sf)
    sums = rows.agg(F.countDistinct("module_id").alias("n_modules"), F.count(F.lit(1)).alias("n_facts"), F.count_if(F.col("tier") == "MED").alias("n_med"))
    return sums.withColumn("resolution", reports.resolution_rate(F.col("n_facts") - F.col("n_med"), F.col("n_med")))


def resolver_precedence(spark, sf):
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_id") % 6
    expression = F.when(kind == 0, F.concat(F.lit('"t'), k, F.lit('"'))).when(kind == 1, F.lit("settings.TOPIC")).when(kind == 2, F.lit("${a.b:fall}")).when(kind == 3, F.concat(F.lit("${x."), k, F.lit("}"))).when(kind == 4, F.lit("HOME")).otherwise(k)
    text = lambda **x: F.create_map(*[F.lit(y) for p in x.items() for y in p])
    got = resolve(expression, text(TOPIC="orders"), F.create_map(F.lit("x.1"), F.lit("one"), F.lit("a.c"), F.lit("no")), text(HOME="house"))
    return read(spark, sf, "events").select("event_id", got.alias("r")).select("event_id", "r.value", "r.tier", "r.notes")


def json_props(spark, sf):
    return read(spark, sf, "events").select(F.from_json("props", "k int").getField("k").alias("k"), "event_type").groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


def incremental_changed(spark, sf):
    docs = read(spark, sf, "documents")
    now = docs.filter("doc_id % 7 <> 0").select(F.col("doc_id").cast("string").alias("project_id"), F.md5(F.col("text").cast("binary")).alias("content_hash"))
    was = docs.filter("doc_id % 5 <> 0").select(F.col("doc_id").cast("string").alias("project_id"), F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.md5(F.col("text").cast("binary"))).alias("content_hash"))
    return catalog.changed(now, was)


def clear_project(spark, sf):
    mods = modules(spark, sf).select(F.col("module_id").alias("id"), "project_id")
    gone = spark.range(1, 4).select(F.concat(F.lit("p"), "id").alias("project_id"))
    left = catalog.cleared({"modules": mods, "integration_facts": facts(spark, sf)}, gone)
    return reports.counts({"modules": left["modules"], "integration_facts": left["integration_facts"]})


def upsert_by_key(spark, sf):
    s = read(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = s.filter("s_suppkey % 4 = 0").select((F.col("s_suppkey") * 2).alias("s_suppkey"), F.lit("new").alias("s_name"), F.lit(0.0).alias("s_acctbal"))
    return catalog.upserted(s, new, "s_suppkey")


def bill_of_material(spark, sf):
    mods = modules(spark, sf).select(F.col("module_id").alias("id"), "project_id")
    docs = views.bills_of_material(dependencies(spark, sf).distinct(), mods)
    parts = F.from_json("document", "bomFormat string, specVersion string, components array<struct<name: string, purl: string, scope: string>>")
    return docs.select("project_id", parts.alias("d")).select("project_id", "d.bomFormat", "d.specVersion", F.size("d.components").cast("long").alias("n"), F.size(F.filter("d.components", lambda c: c["scope"] == "required")).cast("long").alias("n_required"))


def _members(spark, sf):
    from weft.schema import dimension

    touch = capability.strongest_touch(facts(spark, sf)).withColumn("id", F.concat_ws(":", dimension(F.col("resource_type")), "resource_id"))
    return touch.join(_caps(spark, sf).select("id"), "id", "left_semi")


def matrix_cells(spark, sf):
    return views.matrix_cells(_members(spark, sf).select("id", "module_id", "direction"), _caps(spark, sf), 3)


def matrix_pivot(spark, sf):
    """How many modules touch each of four topics, by direction: one column each."""
    rows = facts(spark, sf).filter("resource_type = 'KAFKA_TOPIC'")
    return rows.groupBy("direction").pivot("resource_id", ["r1", "r2", "r3", "r4"]).agg(F.countDistinct("module_id")).fillna(0)


def bipartite_edges(spark, sf):
    return views.bipartite_edges(_members(spark, sf))


def bipartite_nodes(spark, sf):
    return views.bipartite_nodes(_members(spark, sf), _caps(spark, sf))


def resource_edges(spark, sf):
    return views.resource_edges(facts(spark, sf)).groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"), F.countDistinct("target").alias("n_targets"))


def mermaid_topk(spark, sf):
    clustered = modules(spark, sf).filter("project_id = 'p1'")
    return views.diagram_edges(facts(spark, sf), clustered, 100)


def mermaid_lines(spark, sf):
    clustered = modules(spark, sf).filter("project_id = 'p1'")
    return views.diagram_lines(views.diagram_edges(facts(spark, sf), clustered, 100))


def safe_labels(spark, sf):
    return read(spark, sf, "pages").select("page_id", safe_label(F.col("url"), 30).alias("label"))


def audience_filter(spark, sf):
    rows = _caps(spark, sf)
    out = None
    for name in views.AUDIENCES:
        one = views.for_audience(rows, name, "topic r1", F.col("label")).groupBy("play").agg(F.count(F.lit(1)).alias("n")).withColumn("audience", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def next_steps(spark, sf):
    return _caps(spark, sf).groupBy("play").agg(F.count(F.lit(1)).alias("n")).withColumn("step", views.next_steps(F.col("play")))


def ratchet_text(spark, sf):
    rows = remediate.ratchets(_caps(spark, sf))
    return rows.select("id", "kind", "file", F.md5(F.col("content").cast("binary")).alias("digest"))


def rewrite_recipes(spark, sf):
    shared = facts(spark, sf).select(F.col("module_id").alias("id"), "resource_type", "resource_id").distinct()
    return remediate.recipes(shared).groupBy("resource_type").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("first_file"))


def _events(spark, sf):
    return read(spark, sf, "events")


def ev_tumbling(spark, sf):
    return streams.tumbling(_events(spark, sf)).select("start", "event_type", "n", F.round("total", 4).alias("total"))


def ev_sliding(spark, sf):
    return streams.sliding(_events(spark, sf)).select("start", "event_type", "n")


def ev_session(spark, sf):
    return streams.sessions(_events(spark, sf)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))


def ev_dedup(spark, sf):
    again = _events(spark, sf).unionByName(_events(spark, sf).filter("event_id % 3 = 0"))
    return streams.first_of_each(again, ["event_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    shared_dependency, tech_standard, tech_fragmented, lang_histogram, shared_tables, orphan_orders, orphan_documents, eval_precision_recall, eval_missed_extra, counts_all, error_severity_counts, run_totals,
    resolver_precedence, json_props, incremental_changed, clear_project, upsert_by_key, bill_of_material, matrix_cells, matrix_pivot, bipartite_edges, bipartite_nodes, resource_edges, mermaid_topk,
    mermaid_lines, safe_labels, audience_filter, next_steps, ratchet_text, rewrite_recipes, ev_tumbling, ev_sliding, ev_session, ev_dedup,
)}

_USED = "used AS (SELECT DISTINCT module_id, split_part(split_part(purl, '/', -1), '@', 1) AS library FROM dependencies)"
_TECH = f"""WITH {CTES['dependencies']}, {_USED}, held AS (SELECT 'c' || (substr(library, 4)::INT % 7) AS category, library, module_id FROM used),
  counts AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, library) AS nth FROM (SELECT category, library, count(*) AS n FROM held GROUP BY ALL)),
  std AS (SELECT category, max(library) FILTER (nth = 1) AS standard, max(n) AS n_standard, count(*) AS fragmentation, coalesce(string_agg(library, ',' ORDER BY library) FILTER (nth > 1), '') AS outliers FROM counts GROUP BY category),
  oth AS (SELECT h.category, count(DISTINCT module_id) AS n_outlier_modules FROM held h JOIN counts c ON c.category = h.category AND c.library = h.library AND c.nth > 1 GROUP BY 1)"""
_MEMBERS = "mem AS (SELECT t.module_id, t.direction, t.resource_type, t.resource_id, c.id, c.dimension, c.opportunity FROM touch t JOIN caps c ON c.id = (CASE t.resource_type WHEN 'KAFKA_TOPIC' THEN 'messaging' WHEN 'SQL_TABLE' THEN 'data' WHEN 'SQL_COLUMN' THEN 'column' ELSE 'api' END) || ':' || t.resource_id)"
_EVAL = """WITH e AS (SELECT DISTINCT source, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 0),
  g AS (SELECT DISTINCT source, doc_id FROM documents JOIN labels USING (doc_id) WHERE length(regexp_replace(text, '[^#$%&*|!]', '', 'g')) * 20 > length(text))"""
_EDGES = """base AS (SELECT module_id, resource_type, resource_id, direction, arg_min(tier, fact_seq) AS tier, min(fact_seq) AS seq FROM facts GROUP BY ALL),
  users AS (SELECT resource_type, resource_id, count(DISTINCT module_id) AS users FROM facts GROUP BY ALL),
  top AS (SELECT b.module_id, resource_type, resource_id, direction, tier, CASE WHEN users >= 2 THEN users * 100 ELSE 0 END + CASE WHEN project_id = 'p1' THEN 50 ELSE 0 END + CASE WHEN tier = 'HIGH' THEN 20 ELSE 10 END AS points, seq
    FROM base b JOIN users USING (resource_type, resource_id) JOIN modules m ON m.module_id = b.module_id ORDER BY points DESC, seq, b.module_id, resource_type, resource_id, direction LIMIT 100)"""
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_STEPS = " ".join(f"WHEN '{p}' THEN '{t}'" for p, t in views.NEXT_STEPS.items())
_SLUG = "regexp_replace({}, '[^A-Za-z0-9]+', '_', 'g')"

ORACLES = {
    "shared_dependency": f"WITH {CTES['dependencies']}, {CTES['owners']}, {_USED} SELECT library AS dependency, count(*) AS n_modules, count(DISTINCT coalesce(owner, 'unknown')) AS n_owners FROM used LEFT JOIN owners USING (module_id) GROUP BY library HAVING n_modules >= 2 AND n_owners >= 2",
    "tech_standard": f"{_TECH} SELECT category, standard, n_standard, fragmentation, outliers, coalesce(n_outlier_modules, 0) AS n_outlier_modules FROM std LEFT JOIN oth USING (category)",
    "tech_fragmented": f"{_TECH} SELECT category, fragmentation FROM std WHERE fragmentation > 5",
    "lang_histogram": "SELECT lang, count(*) AS n FROM documents WHERE lang <> '' GROUP BY lang",
    "shared_tables": sql("facts", "SELECT resource_id, count(DISTINCT module_id) AS n_modules FROM facts WHERE resource_type = 'SQL_TABLE' GROUP BY 1 HAVING n_modules > 1"),
    "orphan_orders": "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey)",
    "orphan_documents": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "eval_precision_recall": f"""{_EVAL}, j AS (SELECT coalesce(e.source, g.source) AS source, count(e.doc_id) AS n_expected, count(g.doc_id) AS n_got, count(*) FILTER (e.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS hits FROM e FULL JOIN g ON e.source = g.source AND e.doc_id = g.doc_id GROUP BY 1),
        m AS (SELECT source, count(*) AS n_gaps FROM documents WHERE n_chars < 200 GROUP BY 1)
        SELECT source, n_expected, n_got, hits, CASE WHEN n_got = 0 THEN 0.0 ELSE round_even(hits / n_got, 2) END AS precision, CASE WHEN n_expected = 0 THEN 1.0 ELSE round_even(hits / n_expected, 2) END AS recall,
        CASE WHEN n_got + coalesce(n_gaps, 0) = 0 THEN 1.0 ELSE round_even(n_got / (n_got + coalesce(n_gaps, 0)), 2) END AS resolution FROM j LEFT JOIN m USING (source)""",
    "eval_missed_extra": f"{_EVAL} SELECT source, doc_id, 'missed' AS side FROM e WHERE doc_id NOT IN (SELECT doc_id FROM g) UNION ALL SELECT source, doc_id, 'extra' FROM g WHERE doc_id NOT IN (SELECT doc_id FROM e)",
    "counts_all": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in _TABLES),
    "error_severity_counts": "SELECT CASE WHEN event_type = 'error' THEN 'ERROR' WHEN value > 50 THEN 'WARNING' ELSE 'INFO' END AS severity, count(*) AS n FROM events GROUP BY 1",
    "run_totals": sql("facts", "SELECT count(DISTINCT module_id) AS n_modules, count(*) AS n_facts, count(*) FILTER (tier = 'MED') AS n_med, (count(*) - count(*) FILTER (tier = 'MED')) / count(*) * 100 AS resolution FROM facts"),
    "resolver_precedence": """WITH x AS (SELECT event_id, event_id % 6 AS kind, json_extract_string(props, '$.k') AS k FROM events)
        SELECT event_id, CASE kind WHEN 0 THEN 't' || k WHEN 1 THEN 'orders' WHEN 2 THEN 'fall' WHEN 3 THEN CASE WHEN k = '1' THEN 'one' END WHEN 4 THEN 'house' END AS value,
        CASE kind WHEN 0 THEN 'HIGH' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MED' WHEN 3 THEN CASE WHEN k = '1' THEN 'MED' ELSE 'LOW' END WHEN 4 THEN 'MED' ELSE 'LOW' END AS tier,
        CASE kind WHEN 0 THEN 'literal at call site' WHEN 1 THEN 'local constant' WHEN 2 THEN 'config default for a.b' WHEN 3 THEN CASE WHEN k = '1' THEN 'config key x.1' ELSE 'dynamic / unresolved' END WHEN 4 THEN 'env default HOME' ELSE 'dynamic / unresolved' END AS notes FROM x""",
    "json_props": "SELECT json_extract_string(props, '$.k')::INT AS k, event_type, count(*) AS n FROM events GROUP BY ALL",
    "incremental_changed": """WITH now AS (SELECT doc_id::VARCHAR AS project_id, md5(text) AS content_hash FROM documents WHERE doc_id % 7 <> 0), was AS (SELECT doc_id::VARCHAR AS project_id, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE md5(text) END AS h FROM documents WHERE doc_id % 5 <> 0)
        SELECT project_id, content_hash, CASE WHEN h IS NULL THEN 'new' WHEN content_hash IS NULL THEN 'deleted' WHEN h = content_hash THEN 'same' ELSE 'changed' END AS state FROM now FULL JOIN was USING (project_id)""",
    "clear_project": sql("facts modules", "SELECT 'modules' AS \"table\", count(*) AS n FROM modules WHERE project_id NOT IN ('p1', 'p2', 'p3') UNION ALL SELECT 'integration_facts', count(*) FROM facts WHERE module_id NOT IN (SELECT module_id FROM modules WHERE project_id IN ('p1', 'p2', 'p3'))"),
    "upsert_by_key": "WITH new AS (SELECT s_suppkey * 2 AS s_suppkey, 'new' AS s_name, 0.0::DOUBLE AS s_acctbal FROM supplier WHERE s_suppkey % 4 = 0) SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM new) UNION ALL FROM new",
    "bill_of_material": sql("dependencies modules", "SELECT project_id, 'CycloneDX' AS \"bomFormat\", '1.5' AS \"specVersion\", count(*) AS n, count(*) FILTER (scope = 'runtime') AS n_required FROM (SELECT DISTINCT * FROM dependencies) JOIN modules USING (module_id) GROUP BY project_id"),
    "matrix_cells": sql(CAPS, f", {_MEMBERS}, best AS (SELECT id, dimension, (row_number() OVER (PARTITION BY dimension ORDER BY opportunity DESC, id))::INT AS position FROM caps) SELECT best.dimension, best.id AS capability, position, module_id, direction FROM mem JOIN best USING (id) WHERE position <= 3"),
    "matrix_pivot": sql("facts", "SELECT direction, " + ", ".join(f"count(DISTINCT CASE WHEN resource_id = 'r{i}' THEN module_id END) AS r{i}" for i in range(1, 5)) + " FROM facts WHERE resource_type = 'KAFKA_TOPIC' GROUP BY direction"),
    "bipartite_edges": sql(CAPS, f", {_MEMBERS} SELECT module_id AS source, id AS target, direction AS label FROM mem"),
    "bipartite_nodes": sql(CAPS, f", {_MEMBERS} SELECT module_id AS node, count(*) AS size, 'module' AS kind FROM mem GROUP BY 1 UNION ALL SELECT id, count(*), 'capability' FROM mem GROUP BY 1"),
    "resource_edges": sql("facts", ", e AS (SELECT DISTINCT module_id, resource_type || ':' || resource_id AS r, direction FROM facts) SELECT direction, count(*) AS n, CASE WHEN direction IN ('PRODUCES', 'WRITES') THEN count(DISTINCT module_id) ELSE count(DISTINCT r) END AS n_sources, CASE WHEN direction IN ('PRODUCES', 'WRITES') THEN count(DISTINCT r) ELSE count(DISTINCT module_id) END AS n_targets FROM e GROUP BY direction"),
    "mermaid_topk": sql("facts modules", f", {_EDGES} SELECT module_id, resource_type, resource_id, direction, tier, points FROM top"),
    "mermaid_lines": sql("facts modules", f", {_EDGES} SELECT CASE WHEN direction IN ('PRODUCES', 'WRITES') THEN m || ' -->|' || lower(direction) || '| ' || r ELSE r || ' -->|' || lower(direction) || '| ' || m END AS line FROM (SELECT direction, 'm_' || module_id || '[\"' || module_id || '\"]' AS m, 'r_' || resource_type || '_' || resource_id || '[\"' || resource_id || '\"]' AS r FROM top)"),
    "safe_labels": "SELECT page_id, CASE WHEN length(u) > 30 THEN substring(u, 1, 27) || '...' ELSE u END AS label FROM (SELECT page_id, trim(replace(url, '\"', '''')) AS u FROM pages)",
    "audience_filter": sql(CAPS, " UNION ALL ".join(f"SELECT play, count(*) AS n, '{a}' AS audience FROM caps WHERE tier IN ({', '.join(repr(t) for t in ts)}) AND contains(lower(label), 'topic r1') GROUP BY play" for a, ts in views.AUDIENCES.items())),
    "next_steps": sql(CAPS, f"SELECT play, count(*) AS n, CASE play {_STEPS} END AS step FROM caps GROUP BY play"),
    "ratchet_text": sql(CAPS, f""", t AS (SELECT id, label, play FROM caps),
        x AS (SELECT id, label, {_SLUG.format('id')} AS s, split_part(id, ':', -1) AS f FROM t WHERE play IN ('RETIRE', 'STANDARDIZE'))
        SELECT id, 'archunit' AS kind, 'Ratchet_' || s || '.java' AS file, md5(printf('// %s\n@ArchTest static final ArchRule only_canonical = noClasses().that().resideOutsideOfPackage("..%s..").should().dependOnClassesThat().resideInAPackage("..%s..");\n', label, f, f)) AS digest FROM x
        UNION ALL SELECT id, 'import-linter', 'ratchet_' || s || '.ini', md5(printf('# %s\n[importlinter:contract:%s]\nname = only the canonical module\ntype = forbidden\nforbidden_modules = %s\n', label, s, f)) FROM x
        UNION ALL SELECT id, 'dependency-cruiser', 'ratchet_' || s || '.json', md5(printf('{{"comment": "%s", "forbidden": [{{"name": "%s", "severity": "error", "from": {{}}, "to": {{"path": "%s"}}}}]}}\n', label, s, f)) FROM x"""),
    "rewrite_recipes": sql("facts", ", d AS (SELECT DISTINCT module_id, resource_type, resource_id FROM facts WHERE resource_type IN ('KAFKA_TOPIC', 'SQL_TABLE', 'HTTP_ENDPOINT')) SELECT resource_type, count(*) AS n, min('rewrite_' || lower(resource_type) || '_' || resource_id || '.yml') AS first_file FROM d GROUP BY 1"),
    "ev_tumbling": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "ev_sliding": "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS start FROM events) GROUP BY ALL",
    "ev_session": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s FROM events),
        k AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g), c AS (SELECT user_id, session, count(*) AS n FROM k GROUP BY ALL) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY user_id""",
    "ev_dedup": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
}
