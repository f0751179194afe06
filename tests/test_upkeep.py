"""What is kept up instead of made anew, against making it anew."""

import os
import random

import pytest
from pyspark.sql import functions as F

from weft.catalogue.standins import facts
from weft.operators import deltas, judge, similarity
from weft.operators.components import connected_components, updated_components
from weft.plans import catalog, pipeline, remediate, tracking
from weft.plans.durable import durable
from weft.sources import files
from weft.streaming import ingest


def pairs(df):
    return {(r["a"], r["b"]) for r in df.collect()}


def test_hyperplanes_find_nine_pairs_of_ten(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    exact = pairs(similarity.cosine_pairs(vectors, 0.40))
    found = similarity.cosine_pairs_by_planes(vectors, 0.40)
    got = pairs(found)
    assert got <= exact and len(got) >= 0.9 * len(exact) > 800
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_the_shape_follows_threshold_and_size():
    few, many, close = similarity.plane_shape(2000, 0.4, 0.95), similarity.plane_shape(2_000_000, 0.4, 0.95), similarity.plane_shape(2_000_000, 0.8, 0.95)
    assert many[1] > few[1] and many[0] > few[0] and close[0] < many[0] / 5
    assert 1 - (1 - (1 - 1.1592794807274085 / 3.141592653589793) ** few[1]) ** few[0] >= 0.95


def test_copies_of_a_vector_make_no_pairs(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(900, [1.0, 2.0, 3.1]), (901, [0.0, 0.0, 0.0]), (902, [0.0, 0.0, 0.0]), (903, []), (None, [1.0, 2.0, 3.0]), (904, [-3.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    assert pairs(similarity.cosine_pairs_by_planes(df, 0.9)) == {(0, 0), (0, 900)}
    assert similarity.vector_classes(df).filter("class = 0").count() == 400


# --- the store ----------------------------------------------------------------------------------------------


def listed(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.startswith("part-")}


def test_clearing_a_project_touches_its_buckets_only(spark, tmp_path):
    store = catalog.Catalog(spark, str(tmp_path / "store"))
    modules = spark.range(140).select(F.concat(F.lit("m"), "id").alias("id"), F.concat(F.lit("p"), "id").alias("project_id"))
    store.append("projects", modules.select(F.col("project_id").alias("id")))
    store.append("modules", modules)
    store.append("dependencies", modules.select(F.col("id").alias("module_id"), F.lit("x").alias("purl")))
    before = listed(tmp_path)
    gone = spark.createDataFrame([("p7",)], "project_id string")
    bucket = gone.select(store.bucket(F.col("project_id"))).first()[0]
    store.clear_projects(gone)
    after = listed(tmp_path)
    others = {p for p in before if f"/b{bucket}/" not in p}
    assert len(others) > 100 and all(after.get(p) == before[p] for p in others)
    assert all(f"/b{bucket}/" in p for p in after.keys() - before.keys())
    assert {t: store.read(t).count() for t in ("projects", "modules", "dependencies")} == {"projects": 139, "modules": 139, "dependencies": 139}
    assert store.read("modules").filter("project_id = 'p7'").isEmpty()


def test_a_failed_write_leaves_the_rows_before(spark, tmp_path):
    store = catalog.Catalog(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", "a"), ("b", "b")], "id string, name string")
    store.append("projects", rows)
    fails = rows.withColumn("name", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        store.overwrite("projects", fails)
    assert sorted(r["name"] for r in store.read("projects").collect()) == ["a", "b"]


def test_parts_add_up_until_a_bucket_is_written_anew(spark, tmp_path):
    store = catalog.Catalog(spark, str(tmp_path / "store"), buckets=2)
    one = lambda *names: spark.createDataFrame([(n, n) for n in names], "id string, name string")
    for names in (("a", "b", "c"), ("d",), ("e", "f")):
        store.append("projects", one(*names))
    assert store.read("projects").count() == 6
    store.upsert("projects", spark.createDataFrame([("a", "A"), ("g", "G")], "id string, name string"))
    assert {r["id"]: r["name"] for r in store.read("projects").collect()} == {"a": "A", "g": "G", **{x: x for x in "bcdef"}}
    for _ in range(4):  # parts that nobody reads go
        store.overwrite("projects", store.read("projects"))
    assert store.read("projects").count() == 7 and max(len(os.listdir(tmp_path / "store/projects" / b)) for b in ("b0", "b1")) <= 4


# --- deltas -------------------------------------------------------------------------------------------------


def test_random_changes_give_the_counts_of_a_fresh_start(spark):
    rng = random.Random(2)
    every = facts(spark, "/root/testdata/sf0.001").limit(600).collect()
    schema = facts(spark, "/root/testdata/sf0.001").schema
    now = every[:300]
    held = durable(deltas.touches(spark.createDataFrame(now, schema)))
    totals = durable(deltas.shared(held))
    for _ in range(3):
        gone = rng.sample(now, 60)
        came = rng.sample(every, 50) + gone[:5]
        for x in gone:
            now.remove(x)
        now = now + came
        a, b = deltas.applied(held, totals, spark.createDataFrame(came, schema), spark.createDataFrame(gone, schema))
        held, totals = durable(a), durable(b)
        fresh = deltas.touches(spark.createDataFrame(now, schema))
        assert sorted(map(repr, held.select(*fresh.columns).collect())) == sorted(map(repr, fresh.collect()))
        again = deltas.shared(fresh)
        assert sorted(map(repr, totals.select(*again.columns).collect())) == sorted(map(repr, again.collect()))


def test_all_facts_may_go(spark):
    rows = facts(spark, "/root/testdata/sf0.001").limit(20)
    held = deltas.touches(rows)
    a, b = deltas.applied(held, deltas.shared(held), rows.limit(0), rows)
    assert a.isEmpty() and b.isEmpty()


# --- components ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("small", [0, 10_000])
def test_components_after_random_changes(spark, small):
    rng = random.Random(small)
    kind = "a long, b long"
    edges = {tuple(sorted(rng.sample(range(80), 2))) for _ in range(60)}
    held = durable(connected_components(spark.createDataFrame(sorted(edges), kind), small))
    for k in range(4):
        gone = set(rng.sample(sorted(edges), 8 if k % 2 else 0))
        came = {tuple(sorted(rng.sample(range(90), 2))) for _ in range(7)} - edges
        edges = (edges - gone) | came
        df = lambda rows: spark.createDataFrame(sorted(rows), kind)
        held = durable(updated_components(held, df(edges), df(came), df(gone), small))
        fresh = connected_components(df(edges), small)
        assert sorted(map(tuple, held.select("node", "root").collect())) == sorted(map(tuple, fresh.select("node", "root").collect()))


# --- hashes -------------------------------------------------------------------------------------------------


def test_a_projects_hash_does_not_gather_its_files(spark):
    rows = spark.createDataFrame([("p", f"f{i}", f"text {i}") for i in range(50)] + [("q", "f1", "text 1"), ("r", "f1", None)], "project_id string, rel_path string, content string")
    df = files.content_hashes(rows)
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert "partial_sum" in plan and "collect" not in plan
    of = lambda d: {r["project_id"]: r["content_hash"] for r in files.content_hashes(d).collect()}
    first = of(rows)
    assert first == of(rows.orderBy(F.rand(3)).repartition(7)) and len(set(first.values())) == 3
    other = rows.withColumn("content", F.when(F.col("rel_path") == "f7", "text 8").otherwise(F.col("content")))
    assert of(other)["p"] != first["p"] and of(other)["q"] == first["q"]
    swapped = rows.withColumn("rel_path", F.when(F.col("rel_path") == "f7", "f8").when(F.col("rel_path") == "f8", "f7").otherwise(F.col("rel_path")))
    assert of(swapped)["p"] != first["p"]


# --- healing ------------------------------------------------------------------------------------------------


def texts(spark, *rows):
    return spark.createDataFrame(rows, "project string, rel_path string, content string")


def test_a_file_with_two_resources_is_healed_of_both(spark):
    rows = texts(spark, ("p", "in/a.py", "bus.send('t1', 1)\nbus.send('t2', t1)\nx = 't10.t1' + 't1.more'"), ("q", "b.java", "k.produce(\"t1\");\nf(\"t2\");"), ("r", "c.py", "bus.send('t1')"))
    acts = spark.createDataFrame([("p", "t1", "primary"), ("p", "t2", "secondary"), ("q", "t1", "secondary"), ("q", "t2", "secondary"), ("q", "t2", "secondary")], "project string, resource_id string, role string")
    once = remediate.healed(rows, acts)
    got = {r["project"]: r["healed"] for r in once.collect()}
    assert got == {
        "p": "bus.send('canonical.t1', 1)\n# decommissioned: bus.send('t2', canonical.t1)\nx = 't10.t1' + 't1.more'",
        "q": '// decommissioned: k.produce("t1");\nf("decommissioned.t2");',
    }
    again = remediate.healed(once.withColumn("content", F.col("healed")).drop("healed"), acts)
    assert {r["project"]: r["healed"] for r in again.collect()} == got


def test_names_are_taken_as_they_are(spark):
    rows = texts(spark, ("p", "a.py", r"s('GET /a.b$1\x')" + "\ns('axb')"))
    acts = spark.createDataFrame([("p", r"GET /a.b$1\x", "primary"), ("p", "a.b", "primary")], "project string, resource_id string, role string")
    assert remediate.healed(rows, acts).first()["healed"] == r"s('canonical.GET /a.b$1\x')" + "\ns('axb')"


def test_an_estate_is_healed_and_scanned_again(spark):
    """Projects in nested folders that write one table and send to two topics; afterwards none of them is shared by its old name."""
    py = "import kafka\np.send('order.made', 1)\np.send('order.late', 2)\ncur.execute('INSERT INTO stock (a) VALUES (1)')\n"
    rows = [(f"deep/er/{name}/app.py", py) for name in ("one", "two")] + [("deep/er/one/requirements.txt", "kafka-python\n"), ("deep/er/two/requirements.txt", "kafka-python\n"), ("deep/OWNER", "team\n"), ("other/x/app.py", "print('order.made')\n"), ("other/x/requirements.txt", "")]
    source = spark.createDataFrame(rows, "rel_path string, content string").select("rel_path", files.suffix(F.col("rel_path")).alias("suffix"), "content")
    changed, report = pipeline.heal(spark, source, pipeline.Config(semantic=False))
    got = {r["rel_path"]: r["healed"] for r in changed.collect()}
    assert set(got) == {"deep/er/one/app.py", "deep/er/two/app.py"}
    assert "canonical.order.made" in got["deep/er/one/app.py"] and "canonical.order.late" in got["deep/er/one/app.py"]
    assert got["deep/er/two/app.py"].count("# decommissioned: p.send") == 2
    told = {r["resource_id"]: (r["n_modules"], r["n_files"], r["n_left"]) for r in report.collect()}
    assert told["order.made"] == (2, 2, 0) and told["order.late"] == (2, 2, 0) and told["stock"][2] == 0


def test_recipes_for_classes_that_are_imported(spark):
    rows = spark.createDataFrame([("a/A.java", "import old.Thing;\nimport static old.Other.f;\n"), ("a/b.py", "import old.Gone")], "rel_path string, content string")
    moves = spark.createDataFrame([("old.Thing", "fresh.Thing"), ("old.Gone", "fresh.Gone")], "old string, new string")
    got = {r["file"]: r["content"] for r in remediate.class_migration(rows, moves).collect()}
    assert set(got) == {"class_old_Thing.yml", "run.sh"} and "newFullyQualifiedTypeName: fresh.Thing\n" in got["class_old_Thing.yml"]
    assert got["run.sh"].splitlines()[0] == "#!/bin/sh" and got["run.sh"].endswith("-Drewrite.configLocation=class_old_Thing.yml\n")


def test_errors_outlast_a_run_that_reads_nothing_new(spark, tmp_path, monkeypatch):
    careless = lambda rows: pipeline.shaped(rows.filter("suffix = '.py'").select("module_id", "rel_path", F.lit("WRITES").alias("direction"), F.lit("SQL_TABLE").alias("resource_type"), F.lit("").alias("resource_id"), F.lit("HIGH").alias("tier")))
    monkeypatch.setitem(pipeline.EXTRACTORS, "careless", careless)
    source = lambda text: spark.createDataFrame([("a/app.py", ".py", text), ("b/app.py", ".py", "y = 2\n")], "rel_path string, suffix string, content string")
    store = catalog.Catalog(spark, str(tmp_path / "store"))
    counts = []
    for text in ("x = 1\n", "x = 1\n", "x = 3\n"):
        _, r = pipeline.incremental(spark, source(text), store, pipeline.Config(semantic=False))
        counts.append(sorted(x["source"] for x in r["errors"].collect()))
    assert counts == [["a:py", "b:py"]] * 3


# --- a model's verdicts -------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("body", "good"),
    [
        ('{"confirmed": true}', True), ('so: {"confirmed": false, "confidence": 1, "play": "LEAVE", "reason": "r"}', True), ('{"confirmed": true, "confidence": "high"}', False), ('{"confirmed": true, "confidence": true}', False),
        ('{"confirmed": true, "confidence": 1.5}', False), ('{"confirmed": true, "confidence": NaN}', False), ('{"confirmed": true, "play": "MERGE"}', False), ('{"confirmed": true, "play": ["LEAVE"]}', False), ('{"confirmed": true, "reason": 3}', False),
        ('{"confirmed": "yes"}', False), ("[true]", False), ("no", False),
    ],
)
def test_what_is_no_verdict_is_no_answer(body, good):
    assert (judge.answered("p", lambda prompt: (200, {}, body), 1) is not None) == good


def test_a_bad_verdict_leaves_the_heuristic_one(spark):
    rows = spark.createDataFrame([("a", "b", 0.9, True, 0.8, "RETIRE", "why", "x", "y")], "a string, b string, similarity double, confirmed boolean, confidence double, play string, reason string, summary_a string, summary_b string")
    of = lambda body: judge.asked(rows, lambda prompt: (200, {}, body)).first()
    got = of('{"confirmed": false, "confidence": "high"}')
    assert (got["confirmed"], got["confidence"], got["play"], got["reason"]) == (True, 0.8, "RETIRE", "[Fallback: no answer] why")
    got = of('{"confirmed": false, "confidence": 1, "play": "LEAVE", "reason": "no"}')
    assert (got["confirmed"], got["confidence"], got["play"], got["reason"]) == (False, 1.0, "LEAVE", "no")


def test_the_shell_leaves_all_rows_in_files(spark, tmp_path):
    from weft.__main__ import main

    for name in ("one", "two"):
        (tmp_path / "in/deep" / name).mkdir(parents=True)
        (tmp_path / "in/deep" / name / "requirements.txt").write_text("kafka-python\n")
        (tmp_path / "in/deep" / name / "app.py").write_text("import kafka\np.send('order.made', 1)\n")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert main(["census", source, "--out", out]) == 0 and main(["heal", source, "--out", out]) == 0
    assert {r["project_id"] for r in spark.read.json(f"{out}/census").collect()} == {"one", "two"}
    assert spark.read.json(f"{out}/healed").count() == 2 and [r["n_left"] for r in spark.read.json(f"{out}/healing").collect()] == [0]


# --- files kept up ------------------------------------------------------------------------------------------


def app(topic, table="orders"):
    return f"import kafka\n\ndef run(p, cur):\n    p.send('{topic}', 1)\n    cur.execute('INSERT INTO {table} (id, total) VALUES (1, 2)')\n"


def put(root, texts):
    for rel, text in texts.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text(text)


def test_names_that_begin_with_an_underscore_are_files(spark, tmp_path):
    put(tmp_path, {"OWNER": "t\n", "a/pkg/__init__.py": "x = 1\r\ny = 2\r", "a/pkg/[id].js": "z", "a/deep/down/_m.py": "m", "node_modules/x/i.js": "no", "a/b/node_modules/x/i.js": "no", "a/b/c/.venv/i.py": "no", "a/b/c/.hidden.py": "h", "a/é.py": "e"})
    (tmp_path / "a/b/bad.py").write_bytes(b"a\xffb\n")
    (tmp_path / "a/b/loop").symlink_to(tmp_path / "a")
    got = {r["rel_path"]: r["content"] for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"OWNER": "t\n", "a/pkg/__init__.py": "x = 1\ny = 2\n", "a/pkg/[id].js": "z", "a/deep/down/_m.py": "m", "a/b/c/.hidden.py": "h", "a/é.py": "e", "a/b/bad.py": "ab\n"}
    assert {r["suffix"] for r in files.walk(spark, f"file://{tmp_path}").filter("rel_path like '%js'").collect()} == {".js"}
    (tmp_path / "empty").mkdir()
    assert files.scan(spark, str(tmp_path / "empty")).count() == 0


def test_only_changed_files_are_opened(spark, tmp_path):
    root, store = tmp_path / "in", catalog.Catalog(spark, str(tmp_path / "store"))
    put(root, {f"p{i}/app.py": app("order.made") for i in range(6)} | {"p0/__init__.py": "a = 1\n"})
    assert tracking.refreshed(spark, str(root), store) == (7, 0)
    was = os.stat(root / "p1/app.py")
    (root / "p1/app.py").write_text("#" * was.st_size)  # not to be seen: as large, and as old
    os.utime(root / "p1/app.py", ns=(was.st_atime_ns, was.st_mtime_ns))
    put(root, {"p2/app.py": "x = 2\n", "p9/app.py": "x = 9\n"})
    (root / "p3/app.py").unlink()
    assert tracking.refreshed(spark, str(root), store) == (2, 1)
    got = {r["rel_path"]: r["content"] for r in store.read("files").collect()}
    assert got["p1/app.py"] == app("order.made") and got["p2/app.py"] == "x = 2\n" and got["p9/app.py"] == "x = 9\n" and "p3/app.py" not in got and len(got) == 7
    before = listed(tmp_path / "store")
    assert tracking.refreshed(spark, str(root), store) == (0, 0) and listed(tmp_path / "store") == before


def test_a_feed_of_three_batches_equals_three_full_runs(spark, tmp_path):
    now, steps = {}, [
        {"a/OWNER": "team-a\n", "a/one/app.py": app("order.made"), "a/two/app.py": app("order.made", "stock"), "b/app.py": app("order.late"), "node_modules/x.py": "no"},
        {"a/two/app.py": app("order.late", "stock"), "c/app.py": app("order.made")},
        {"b/app.py": None, "a/OWNER": "team-z\n"},
    ]
    feed, store, seen = tmp_path / "feed", catalog.Catalog(spark, str(tmp_path / "store"), buckets=4), []
    config = pipeline.Config(semantic=False)
    facts_of = lambda r: sorted(map(str, r["facts"].select("module_id", "direction", "resource_type", "resource_id", "tier", "line").collect()))
    found_of = lambda r: (facts_of(r), sorted(map(str, r["capabilities"].collect())), sorted(map(str, r["modules"].select("id", "owner").collect())), sorted(map(str, r["projects"].select("id", "owner_team", "loc").collect())))
    then = lambda number, states, r: seen.append(({x["project_id"]: x["state"] for x in states.collect()}, found_of(r)))
    for k, step in enumerate(steps):
        rows = [(p, "old\n", 10 * k) for p, t in step.items() if t] + [(p, t, 10 * k + 1) for p, t in step.items()]
        spark.createDataFrame(rows, ingest.CHANGE).coalesce(1).write.mode("append").parquet(str(feed))
        ingest.followed(spark, str(feed), store, str(tmp_path / "checkpoint"), then, config).awaitTermination()
        now = {p: t for p, t in (now | step).items() if t is not None}
        full = pipeline.run(spark, spark.createDataFrame([(p, "." + p.rsplit(".", 1)[1] if "." in p else "", t) for p, t in now.items() if "node_modules" not in p], "rel_path string, suffix string, content string"), config)
        assert len(seen) == k + 1 and seen[k][1] == found_of(full)
    assert [s for s, _ in seen] == [{"one": "new", "two": "new", "b": "new"}, {"one": "same", "two": "changed", "b": "same", "c": "new"}, {"one": "same", "two": "same", "b": "deleted", "c": "same"}]
