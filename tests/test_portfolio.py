"""A whole run over a small portfolio, and the stored tables."""

import json
import re

import pytest
from pyspark.sql import functions as F

from weft.catalogue.extraction import PORTFOLIO, portfolio_files
from weft.plans import catalog, pipeline, remediate, views
from weft.sources import files, sourcecode
from weft.streaming import events as streams


@pytest.fixture(scope="module")
def run(spark):
    return pipeline.run(spark, portfolio_files(spark), pipeline.Config(remediate=True))


def test_projects_and_owners(spark, run):
    got = {(r["id"], r["owner"]) for r in run["modules"].collect()}
    assert {("orders-py:py", "team-shop"), ("billing:java", "team-bill"), ("web:node", "unknown"), ("warehouse:sql", "unknown")} <= got


def test_the_topic_is_shared_by_three_languages(run):
    r = run["capabilities"].filter("id = 'messaging:order.created'").first()
    assert (r["n_members"], r["n_owners"]) == (4, 3)


def test_copies_are_code_clones(run):
    r = run["capabilities"].filter("dimension = 'code'").first()
    assert r["id"] == "code:orders-copy:py" and r["play"] == "RETIRE"


def test_unresolved_topics_are_gaps(run):
    assert {r["expression"] for r in run["gaps"].collect()} == {"pick(o)"}


def test_config_values_are_medium(run):
    got = {(r["resource_id"], r["tier"]) for r in run["facts"].filter("module_id = 'billing:java' and direction = 'PRODUCES'").collect()}
    assert got == {("order.created", "MED"), ("bill.late", "HIGH")}


def test_couplings(run):
    got = {r["module_id"]: r["coupling"] for r in run["couplings"].collect()}
    assert got["orders-py:py"] == 0.5 and got["billing:java"] == 0.5 and got["web:node"] == 0.5


def test_orphans_and_reports(run):
    assert {r["table"] for r in run["orphans"].collect()} == {"audit"}
    assert run["bills_of_material"].count() >= 3 and run["ratchets"].count() > 0 and run["recipes"].count() > 0


def test_what_each_language_says(spark):
    lang = F.when(F.col("suffix") == ".py", "python").when(F.col("suffix") == ".java", "java").when(F.col("suffix") == ".js", "javascript")
    found = portfolio_files(spark).select("rel_path", sourcecode.extracted(lang, F.col("content")).alias("x")).select("rel_path", F.inline("x.facts"))
    app = (("CALLS", "HTTP_ENDPOINT", "http://stock/count", "HIGH", 11), ("PRODUCES", "KAFKA_TOPIC", "order.created", "HIGH", 9), ("WRITES", "SQL_COLUMN", "orders.id", "HIGH", 8), ("WRITES", "SQL_COLUMN", "orders.total", "HIGH", 8), ("WRITES", "SQL_TABLE", "orders", "HIGH", 8))
    want = [
        ("bill/billing/src/Billing.java", "CONSUMES", "KAFKA_TOPIC", "order.created", "HIGH", 8), ("bill/billing/src/Billing.java", "PRODUCES", "KAFKA_TOPIC", "bill.late", "HIGH", 6), ("bill/billing/src/Billing.java", "PRODUCES", "KAFKA_TOPIC", "none", "MED", 6),
        ("bill/billing/src/Billing.java", "READS", "SQL_TABLE", "customers", "HIGH", 7), *((f"shop/{p}/app.py", *f) for p in ("orders-py", "orders-copy") for f in app),
        ("shop/orders-py/store.py", "READS", "SQL_TABLE", "customers", "HIGH", 2), ("shop/orders-py/store.py", "READS", "SQL_TABLE", "orders", "HIGH", 2), ("web/api.js", "CALLS", "HTTP_ENDPOINT", "http://shop/place", "HIGH", 1),
        ("web/index.js", "CALLS", "HTTP_ENDPOINT", "http://shop/orders", "HIGH", 6), ("web/index.js", "CONSUMES", "KAFKA_TOPIC", "bill.late", "HIGH", 5), ("web/index.js", "PRODUCES", "KAFKA_TOPIC", "order.created", "HIGH", 4),
    ]
    assert sorted(tuple(r) for r in found.select("rel_path", "direction", "resource_type", "resource_id", "tier", "line").collect()) == sorted(want)


def test_capabilities_of_the_small_portfolio(run):
    want = {
        ("api:http://stock/count", 2, 1, "EXTRACT", 1.5), ("code:orders-copy:py", 2, 1, "RETIRE", 3.0), ("column:orders.id", 3, 2, "STANDARDIZE", 5.62), ("column:orders.total", 2, 1, "RETIRE", 3.0), ("data:customers", 3, 3, "EXTRACT", 2.25),
        ("data:orders", 3, 2, "STANDARDIZE", 5.62), ("functional:billing:java", 5, 3, "STANDARDIZE", 2.19), ("messaging:bill.late", 2, 2, "EXTRACT", 1.5), ("messaging:order.created", 4, 3, "EXTRACT", 3.75),
    }
    assert {(r["id"], r["n_members"], r["n_owners"], r["play"], r["opportunity"]) for r in run["capabilities"].collect()} == want


def test_scan_from_a_folder_gives_the_same_rows(spark, tmp_path):
    for path, text in PORTFOLIO.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = {(r["rel_path"], r["content"]) for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {(r["rel_path"], r["content"]) for r in portfolio_files(spark).collect()}


def test_colliding_names_become_paths(spark):
    rows = spark.createDataFrame([(f"{a}/{b}/svc/app.py", ".py", "x = 1") for a in "ab" for b in "cd"], "rel_path string, suffix string, content string")
    assert {r["project_id"] for r in files.named(files.projects(rows)).collect()} == {"a-c-svc", "a-d-svc", "b-c-svc", "b-d-svc"}


def test_q26_a_folder_above_a_project_is_none(spark):
    rows = spark.createDataFrame([("repo/pom.xml", ".xml", ""), ("repo/frontend/package.json", ".json", "{}")], "rel_path string, suffix string, content string")
    assert [r["dir"] for r in files.projects(rows).collect()] == ["repo/frontend"]
    assert {r["dir"] for r in files.projects(rows, keep_parent=True).collect()} == {"repo", "repo/frontend"}


def test_q17_a_constant_topic_is_found():
    assert [f["resource_id"] for f in sourcecode.node_facts("const T = 'a.b';\np.send({ topic: T })").facts] == ["a.b"]


def test_python_that_does_not_parse_gives_nothing():
    assert sourcecode.python_facts("def (").facts == []


def test_catalog_appends_upserts_and_clears(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "store"))
    c.upsert("modules", spark.createDataFrame([("a:py", "a", "old"), ("b:py", "b", "b")], "id string, project_id string, name string"))
    c.upsert("modules", spark.createDataFrame([("a:py", "a", "new")], "id string, project_id string, name string"))
    c.append("dependencies", spark.createDataFrame([("a:py", "x"), ("b:py", "y")], "module_id string, purl string"))
    c.append("dependencies", spark.createDataFrame([("b:py", "z")], "module_id string, purl string"))
    assert {r["id"]: r["name"] for r in c.read("modules").collect()} == {"a:py": "new", "b:py": "b"}
    c.clear_projects(spark.createDataFrame([("b",)], "project_id string"))
    assert [r["purl"] for r in c.read("dependencies").collect()] == ["x"] and [r["id"] for r in c.read("modules").collect()] == ["a:py"]


def test_only_changed_projects_are_read_again(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "project_id string, content_hash string")
    was = spark.createDataFrame([("a", "1"), ("b", "0"), ("d", "4")], "project_id string, content_hash string")
    assert {r["project_id"]: r["state"] for r in catalog.changed(now, was).collect()} == {"a": "same", "b": "changed", "c": "new", "d": "deleted"}


def test_healing_changes_text_and_not_files(spark):
    rows = spark.createDataFrame([("p", "a.py", "producer.send('t', 1)"), ("q", "b.py", "producer.send('t', 1)\nx = 't'")], "project string, rel_path string, content string")
    acts = spark.createDataFrame([("p", "t", "primary"), ("q", "t", "secondary")], "project string, resource_id string, role string")
    got = {r["project"]: r["healed"] for r in remediate.healed(rows, acts).collect()}
    assert "canonical.t" in got["p"] and got["q"].startswith("# decommissioned: ") and got["q"].endswith("'decommissioned.t'")


def test_pages_are_escaped(spark):
    row = views.table_rows(spark.createDataFrame([("<b>", 1)], "a string, n int")).first()[0]
    assert row == "<tr><td>&lt;b&gt;</td><td>1</td></tr>" and row in views.page("T", ["a", "n"], [row])


def test_a_stream_gives_the_batch_counts(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source)
    spark.read.parquet(source).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.first_of_each(streams.source(spark, str(tmp_path / "in"), batch.schema), ["event_id"])
    seen = []
    streams.upserts(stream, str(tmp_path / "ck"), lambda df, n: seen.extend(df.groupBy("event_type").count().collect())).awaitTermination()
    total: dict = {}
    for r in seen:
        total[r["event_type"]] = total.get(r["event_type"], 0) + r["count"]
    assert total == {r["event_type"]: r["count"] for r in batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("count")).collect()}


def test_claims_of_a_package(spark):
    from weft.sources.manifests import node_claims

    text = '{"dependencies": {"@angular/core": "1"}, "devDependencies": {"typescript": "5"}}'
    assert spark.range(1).select(node_claims(F.lit(text))).first()[0] == ["javascript", "typescript", "angular"]
    assert spark.range(1).select(node_claims(F.lit("{}"))).first()[0] == ["javascript"]


def test_a_made_up_portfolio_shares_its_topics(spark):
    from weft.sources.synthetic import portfolio

    caps = pipeline.run(spark, portfolio(spark, 30), pipeline.Config(semantic=False))["capabilities"]
    assert caps.filter("dimension = 'messaging' and n_members > 1").count() > 3


def test_preflight_and_waiting():
    from weft.operators import judge

    assert judge.preflight(lambda p: (200, {}, '{"confirmed": true}'))[0] and not judge.preflight(lambda p: (401, {}, ""))[0]
    assert judge.retry_after({"Retry-After": "7"}, 0) == 7 and judge.retry_after({}, 3) == 8 and judge.retry_after({"retry-after": "900"}, 0) == 60


def test_errors_are_logged_in_order(spark):
    from weft.operators import reports
    from weft.schema import rejections

    bad = spark.createDataFrame([("m", "x", None, "t", "HIGH", 1)], "module_id string, direction string, resource_type string, resource_id string, tier string, fact_seq long")
    lines = reports.error_log(rejections("integration_facts", bad)).collect()
    assert len(lines) == 1 and lines[0]["line"].startswith("[WARNING] extract · m: ")


def test_groups_of_an_inventory_may_nest_deep(spark):
    import json

    from weft.sources import inventory

    group = {"full_path": "g", "projects": [{"id": 0, "path_with_namespace": "g/p0", "name": "p0"}], "subgroups": []}
    for i in range(1, 12):
        group = {"full_path": "g", "projects": [{"id": i, "path_with_namespace": f"g/p{i}", "name": f"p{i}"}], "subgroups": [group]}
    got = inventory.parse(spark, spark.createDataFrame([(json.dumps({"groups": [group]}),)], "value string")).collect()
    assert sorted(r["id"] for r in got) == [*range(12)]


def test_a_run_of_an_inventory_has_its_projects_only(spark):
    items = spark.createDataFrame([("web",), ("billing",), ("nowhere",), ("web",)], "name string")
    got = pipeline.ingested(spark, portfolio_files(spark), items)
    assert sorted(r["project_id"] for r in got["dirs"].collect()) == ["billing", "web"]
    assert {r["project_id"] for r in got["placed"].collect()} == {"billing", "web"}


def test_a_site_has_every_row(run, tmp_path):
    from weft.plans import exports

    names = exports.write_site(run.tables, tmp_path)
    assert all((tmp_path / n).is_file() for n in names) and len(names) == len(set(names))
    text = lambda name: (tmp_path / name).read_text()
    rows = lambda name, table: [json.loads(x) for part in json.loads(text(name))[table] for x in text(part).splitlines()]
    caps = rows("capabilities.json", "capabilities")
    assert len(caps) == run["capabilities"].count() and caps[0]["opportunity"] == max(c["opportunity"] for c in caps)
    edges = rows("graph.json", "edges")
    assert len(edges) == run["members"].count() and {e["source"] for e in edges} <= {n["node"] for n in rows("graph.json", "nodes")}
    page = text("index.html")
    assert all(c["id"] in page for c in caps) and "produces: " in page and "Pairs to look at" in page and "resolution" in page
    bills = rows("bills_of_material.json", "documents")
    assert {b["metadata"]["component"]["name"] for b in bills} >= {"orders-py"} and {b["bomFormat"] for b in bills} == {"CycloneDX"}
    assert "order.created" in text("matrix.html") and rows("matrix.json", "cells")
    assert text("diagram.mmd").startswith("graph LR\n") and rows("resources.json", "edges")
    assert json.loads(text("errors.json")) == {"lines": []}
    again = exports.write_site(run.tables, tmp_path)
    assert again == names and sorted(p.name for p in (tmp_path / "parts").iterdir() if p.name.startswith("_")) == []


def test_parts_are_whole_pages_in_order(spark, tmp_path, monkeypatch):
    from weft.plans import exports

    monkeypatch.setattr(exports, "SHOWN", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        site = exports.Site(spark, tmp_path)
        rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("n"), F.lit("<b>").alias("of")).orderBy("n")
        page = "".join(site.section("many", "Many & more", rows))
        few = site.records("few", rows)
        none = site.records("none", rows.limit(0))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [n for n in site.names if n.startswith("parts/many/")]
    texts = [(tmp_path / n).read_text() for n in parts]
    assert len(parts) > 1 and all(t.startswith("<!doctype html>") and t.endswith("</table>\n") and t.count("<table>") == 1 for t in texts)
    assert [int(x) for t in texts for x in re.findall("<tr><td>([0-9]+)</td><td>&lt;b&gt;</td></tr>", t)] == list(range(1000))
    assert page.count("<tr><td>") == 7 and "Many &amp; more" in page and all(f'href="{n}"' in page for n in parts)
    assert [json.loads(x)["n"] for n in few for x in (tmp_path / n).read_text().splitlines()] == list(range(1000)) and none == []


def test_a_project_has_its_frameworks(run):
    assert {r["id"]: r["langs"] for r in run["projects"].collect()}["web"][0] == "javascript"
    assert run["totals"].first()["n_projects"] == 5 and run["errors"].count() == 0


def test_published_opportunities(spark):
    """Six members with a duplicate, three with one, a pair and a group of summaries: 7.88, 5.62, 2.67 and 3.06."""
    from weft.operators import capability

    owner = lambda *ms: spark.createDataFrame([(m, o) for m, o in ms], "module_id string, owner string")
    facts = [(f"m{i}", "PRODUCES", "KAFKA_TOPIC", "order.created", "MED" if i == 0 else "HIGH", i) for i in range(4)]
    facts += [(f"m{i}", "WRITES", "SQL_COLUMN", "customers.id", "HIGH", 10 + i) for i in (1, 2, 3)]
    shape = "module_id string, direction string, resource_type string, resource_id string, tier string, fact_seq long"
    couplings = spark.createDataFrame([("m0", 0.0), ("m1", 0.25), ("m2", 0.25), ("m3", 0.0)], "module_id string, coupling double")
    owners = owner(("m0", "a"), ("m1", "b"), ("m2", "b"), ("m3", "c"))
    got = {r["id"]: (r["opportunity"], r["play"]) for r in capability.resource_capabilities(spark.createDataFrame(facts[:4], shape), owners, couplings).collect()}
    assert got == {"messaging:order.created": (7.88, "STANDARDIZE")}
    three = spark.createDataFrame([("m1", 0.25), ("m2", 0.25)], "module_id string, coupling double")
    got = {r["id"]: (r["opportunity"], r["play"]) for r in capability.resource_capabilities(spark.createDataFrame(facts[4:], shape), owners, three).collect()}
    assert got == {"column:customers.id": (5.62, "STANDARDIZE")}
    pairs = spark.createDataFrame([("p0", "p1", "MED"), ("q0", "q1", "LOW"), ("q1", "q2", "MED"), ("q2", "q3", "MED"), ("q3", "q4", "MED")], "a string, b string, tier string")
    owners = owner(("p0", "x"), ("p1", "x"), *((f"q{i}", f"t{i}") for i in range(5)))
    couplings = spark.createDataFrame([("p0", 0.0), ("p1", 0.0), ("q0", 0.0), ("q1", 0.25)], "module_id string, coupling double")
    got = {r["n_members"]: (r["opportunity"], r["play"]) for r in capability.pair_capabilities(pairs, "functional", "x", owners, couplings, max_size=6).collect()}
    assert got == {2: (2.67, "RETIRE"), 5: (3.06, "STANDARDIZE")}


def test_a_model_judges_and_is_preflighted(spark, tmp_path, capsys):
    """Against a server of our own: busy once, then a verdict; and one that is not there."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from weft.__main__ import main
    from weft.operators import judge

    seen = []

    class Model(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.headers["Authorization"], body["messages"][0]["content"]))
            busy = len(seen) == 2
            self.send_response(429 if busy else 200)
            self.send_header("Retry-After", "0")
            self.end_headers()
            if not busy:
                self.wfile.write(json.dumps({"choices": [{"message": {"content": 'So: {"confirmed": true, "confidence": 0.9, "play": "RETIRE", "reason": "same"}'}}]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    address, key = f"http://127.0.0.1:{server.server_port}/v1", tmp_path / "key"
    key.write_text("k1\n")
    assert main(["test-llm", ".", "--model", address, "--key-file", str(key)]) == 0 and capsys.readouterr().out == "ready\n"
    assert seen[0][0] == "Bearer k1"
    candidates = spark.createDataFrame([("a", "b", 0.5, ["KAFKA_TOPIC:t"])], "a string, b string, similarity double, shared_resources array<string>")
    summaries = spark.createDataFrame([("a", "orders of shops"), ("b", "bills of shops")], "module_id string, summary string")
    owners = spark.createDataFrame([("a", "x"), ("b", "x")], "module_id string, owner string")
    got = judge.by_model(judge.Client(address, "m"))(candidates, summaries, owners).first()
    assert (got["confirmed"], got["confidence"], got["play"], got["reason"]) == (True, 0.9, "RETIRE", "same") and "KAFKA_TOPIC:t" in seen[-1][1] and len(seen) == 3
    server.shutdown()
    server.server_close()
    got = judge.by_model(judge.Client(address, "m", timeout=1))(candidates, summaries, owners).first()
    assert got["reason"].startswith("[Fallback: no answer] ") and main(["test-llm", ".", "--model", address]) == 1
