"""The scoring rules on rows written by hand."""

import pytest
from pyspark.sql import functions as F

from weft.operators import capability, graph, judge, reports, similarity
from weft.schema import split_valid

FACT = "module_id string, direction string, resource_type string, resource_id string, tier string, fact_seq long"


def facts_of(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], FACT)


def owned(spark, **names):
    return spark.createDataFrame([*names.items()], "module_id string, owner string")


def coupled(spark, **values):
    return spark.createDataFrame([*values.items()], "module_id string, coupling double")


def caps(spark, facts, owners, couplings):
    return {r["id"]: r for r in capability.resource_capabilities(facts, owners, couplings).collect()}


def test_producers_of_two_teams_standardize(spark):
    f = facts_of(spark, ("a", "PRODUCES", "KAFKA_TOPIC", "t", "HIGH"), ("b", "PRODUCES", "KAFKA_TOPIC", "t", "HIGH"))
    r = caps(spark, f, owned(spark, a="x", b="y"), coupled(spark))["messaging:t"]
    assert (r["play"], r["opportunity"], r["label"]) == ("STANDARDIZE", 6.0, "Publishes t")


def test_producers_of_one_team_retire(spark):
    f = facts_of(spark, ("a", "PRODUCES", "KAFKA_TOPIC", "t", "HIGH"), ("b", "PRODUCES", "KAFKA_TOPIC", "t", "HIGH"))
    r = caps(spark, f, owned(spark, a="x", b="x"), coupled(spark))["messaging:t"]
    assert (r["play"], r["opportunity"]) == ("RETIRE", 4.0)


def test_a_resource_of_one_module_is_none(spark):
    f = facts_of(spark, ("a", "PRODUCES", "KAFKA_TOPIC", "t", "HIGH"), ("a", "CONSUMES", "KAFKA_TOPIC", "t", "LOW"))
    assert caps(spark, f, owned(spark, a="x"), coupled(spark)) == {}


def test_q1_first_of_the_strongest_tier_counts(spark):
    f = facts_of(spark, ("a", "READS", "SQL_TABLE", "t", "MED"), ("a", "WRITES", "SQL_TABLE", "t", "HIGH"), ("a", "READS", "SQL_TABLE", "t", "HIGH"))
    assert [(r["direction"], r["rank"]) for r in capability.strongest_touch(f).collect()] == [("WRITES", 3)]


def test_q2_rounding_is_half_even(spark):
    from weft.functions.numbers import half_even

    row = spark.range(1).select(half_even(F.lit(5.625), 2).alias("a"), half_even(F.lit(2.675), 2).alias("b"), half_even(F.lit(7.875), 2).alias("c")).first()
    assert tuple(row) == (5.62, 2.68, 7.88)


def test_q4_a_consumer_makes_no_duplicate(spark):
    f = facts_of(spark, ("a", "PRODUCES", "KAFKA_TOPIC", "t", "HIGH"), ("b", "PRODUCES", "KAFKA_TOPIC", "t", "HIGH"), ("c", "CONSUMES", "KAFKA_TOPIC", "t", "HIGH"))
    owners = owned(spark, a="x", b="x", c="x")
    assert caps(spark, f, owners, coupled(spark))["messaging:t"]["play"] == "EXTRACT"
    none = spark.createDataFrame([], "module_a string, module_b string, clone_type int, tier string")
    assert graph.clusters(f, none, owners, coupled(spark)).first()["play"] == "RETIRE"


def test_q5_coupling_is_the_mean_of_those_that_have_it(spark):
    f = facts_of(spark, *((m, "WRITES", "SQL_TABLE", "t", "HIGH") for m in "abc"))
    r = caps(spark, f, owned(spark, a="x", b="y", c="z"), coupled(spark, a=0.5, b=0.0))["data:t"]
    assert (r["coupling"], r["opportunity"]) == (0.25, 5.62)


def test_q6_no_owner_is_an_owner(spark):
    f = facts_of(spark, ("a", "WRITES", "SQL_TABLE", "t", "HIGH"), ("b", "WRITES", "SQL_TABLE", "t", "HIGH"))
    assert caps(spark, f, owned(spark, a="x"), coupled(spark))["data:t"]["n_owners"] == 2


def test_blobs_are_dropped_and_q25_the_weakest_pair_tells(spark):
    big = [(f"m{i}", f"m{j}", "HIGH") for i in range(10) for j in range(i)]
    pairs = spark.createDataFrame([*big, ("p:py", "q:py", "HIGH"), ("q:py", "r:py", "LOW")], "a string, b string, tier string")
    got = capability.pair_capabilities(pairs, "functional", "Semantic duplicate", owned(spark, x="y"), coupled(spark), 6).collect()
    assert [(r["id"], r["n_members"], r["tier"], r["label"]) for r in got] == [("functional:p:py", 3, "LOW", "Semantic duplicate · p, q, r")]


def test_clusters_cross_dimensions(spark):
    f = facts_of(
        spark, ("a", "PRODUCES", "KAFKA_TOPIC", "t", "HIGH"), ("b", "CONSUMES", "KAFKA_TOPIC", "t", "MED"), ("b", "WRITES", "SQL_TABLE", "s", "HIGH"), ("c", "WRITES", "SQL_TABLE", "s", "HIGH")
    )
    none = spark.createDataFrame([], "module_a string, module_b string, clone_type int, tier string")
    r = graph.clusters(f, none, owned(spark, a="x", b="x", c="y"), coupled(spark, a=0.8)).first()
    assert (r["id"], r["n_members"], r["n_shared"], r["score"], r["opportunity"], r["play"], r["tier"]) == ("a", 3, 2, 8, 1.6, "STANDARDIZE", "HIGH")


def test_promotion_leaves_out_what_a_cluster_holds(spark):
    confirmed = spark.createDataFrame([("a:py", "b:py", "MED", "RETIRE"), ("c:py", "a:py", "LOW", "RETIRE")], "a string, b string, tier string, play string")
    held = spark.createDataFrame([("a:py", "k"), ("b:py", "k")], "module_id string, id string")
    got = graph.promoted(confirmed, held, coupled(spark)).collect()
    assert [(r["a"], r["b"], r["opportunity"], r["label"]) for r in got] == [("a:py", "c:py", 4.0, "Semantic duplicate · a & c")]


def test_libraries_and_standards(spark):
    deps = spark.createDataFrame([("a", "pkg:maven/o/spring-kafka@1"), ("b", "pkg:maven/o/spring-kafka@2"), ("a", "pkg:maven/o/commons-io"), ("c", "pkg:pypi/kafka-python"), ("d", "pkg:pypi/kafka-python"), ("e", "pkg:npm/kafkajs@2")], "module_id string, purl string")
    shared = reports.shared_dependencies(deps, owned(spark, a="x", b="y", c="z", d="z", e="z")).collect()
    assert [(r["dependency"], r["n_modules"]) for r in shared] == [("spring-kafka", 2)]
    tech = reports.tech_standards(deps, reports.category_table(spark)).first()
    assert (tech["category"], tech["standard"], tech["fragmentation"], tech["outliers"]) == ("messaging client", "kafka-python", 3, "kafkajs,spring-kafka")


def test_q8_names_with_underscores_match_only_when_asked(spark):
    deps = spark.createDataFrame([("a", "pkg:pypi/kafka_python")], "module_id string, purl string")
    cats = reports.category_table(spark)
    assert reports.tech_standards(deps, cats).count() == 0 and reports.tech_standards(deps, cats, normalise=True).count() == 1


@pytest.mark.parametrize(("a", "b", "sim", "owners", "want"), [
    ("billing invoice ledger", "invoice ledger run", 0.9, ("x", "x"), (True, "RETIRE", 0.9)), ("invoice ledger", "invoice ledger", 0.9, ("x", "y"), (True, "STANDARDIZE", 0.9)),
    ("kafka topic", "kafka topic", 0.99, ("x", "x"), (False, "LEAVE", 0.4)), ("invoice", "invoice words", 0.5, ("x", "x"), (False, "LEAVE", 0.4)),
])
def test_judge_confirms_on_domain_terms(spark, a, b, sim, owners, want):
    cands = spark.createDataFrame([("m", "n", sim)], "a string, b string, similarity double")
    summaries = spark.createDataFrame([("m", a), ("n", b)], "module_id string, summary string")
    r = judge.judged(cands, summaries, owned(spark, m=owners[0], n=owners[1])).first()
    assert (r["confirmed"], r["play"], r["confidence"]) == want


def test_q24_the_stemmer_lets_publishes_through(spark):
    from weft.functions.text import domain_tokens

    assert spark.range(1).select(domain_tokens(F.lit("publishes events with orders"))).first()[0] == ["ord", "publishe"]


def test_a_model_that_does_not_answer_leaves_the_heuristic(spark):
    cands = spark.createDataFrame([("m", "n", 0.9)], "a string, b string, similarity double")
    rows = judge.judged(cands, spark.createDataFrame([("m", "invoice ledger"), ("n", "invoice ledger")], "module_id string, summary string"), owned(spark, m="x", n="x"))
    r = judge.asked(rows, lambda prompt: (500, {}, "no")).first()
    assert r["confirmed"] and r["reason"].startswith("[Fallback")
    r = judge.asked(rows, lambda prompt: (200, {}, 'so: {"confirmed": false, "play": "LEAVE", "confidence": 0.1, "reason": "no"}')).first()
    assert (r["confirmed"], r["play"]) == (False, "LEAVE")


def test_clone_pairs_and_classes(spark):
    from weft.functions.text import code_lines

    text = "a = 1\nb = 2\nc = 3\n"
    rows = spark.createDataFrame([(1, text), (2, text + "# note\n"), (3, "x = 1\ny = 2\nz = 3"), (4, "other"), (5, "")], "id long, text string")
    got = similarity.clone_pairs(rows, code_lines(F.col("text")), code_lines(F.col("text"), normalise=True), 0.7).collect()
    assert sorted((r["module_a"], r["module_b"], r["clone_type"], r["similarity"]) for r in got) == [(1, 1, 1, 1.0), (1, 1, 2, 1.0)]
    classes = similarity.set_classes(rows.select("id", code_lines(F.col("text"), normalise=True).alias("tokens"))).collect()
    assert sorted(map(tuple, classes)) == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_jaccard_pairs_match_all_pairs(spark):
    import random

    rng = random.Random(1)
    sets = {i: {rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 8))} for i in range(60)}
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, tokens array<string>")
    want = sorted((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-12)
    assert sorted((r["a"], r["b"]) for r in similarity.jaccard_pairs(rows, 0.6).collect()) == want


def test_cosine_pairs_in_blocks_match_all_pairs(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(50, 8))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = sorted((i, j) for i in range(50) for j in range(i + 1, 50) if u[i] @ u[j] >= 0.4)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    assert sorted((r["a"], r["b"]) for r in similarity.cosine_pairs(rows, 0.4, block=7).collect()) == want


def test_rows_that_break_a_rule_are_split_off(spark):
    f = facts_of(spark, ("a", "READS", "SQL_TABLE", "t", "HIGH"), ("a", "READS", "SQL_TABLE", "", "HIGH"), ("a", None, "SQL_TABLE", "t", "HIGH"), ("a", "READS", "FILE", "t", "HIGH"))
    good, bad = split_valid("integration_facts", f)
    assert (good.count(), bad.count()) == (1, 3)


@pytest.mark.parametrize("small", [0, 10**6])
def test_components_of_chains_stars_and_cycles(spark, monkeypatch, small):
    from weft.operators import components

    monkeypatch.setattr(components, "SMALL", small)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(20)] + [(203, 201), (201, 202), (202, 203), (203, 203)] + [(399 - i, 398 - i) for i in range(30)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(20)} | {i: 201 for i in (201, 202, 203)} | {i: 369 for i in range(369, 400)}
