"""What reviews of the whole found."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from weft.catalogue import evidence, standins
from weft.functions import vectors
from weft.functions.text import COMMENT, code_lines
from weft.operators import capability, graph, judge, similarity
from weft.sources import files


def test_a_reason_says_the_cosine_as_c_does(spark):
    # the first four doubles lie below their digits or at a half; Java's format rounds the digits up
    rows = spark.createDataFrame([(0.435,), (0.985,), (0.125,), (0.415,), (0.445,), (1.0,)], "s double")
    none = F.array().cast("array<string>")
    said = rows.select("s", judge.evaluated(F.col("s"), none, none, F.lit("x"), F.lit("y"))["reason"].alias("r")).collect()
    assert {r["s"]: r["r"].rsplit(" ", 1)[1] for r in said} == {s: f"{s:.2f}" for (s,) in ((0.435,), (0.985,), (0.125,), (0.415,), (0.445,), (1.0,))}


def test_a_listed_hash_is_of_every_digest_in_order(spark):
    rows = [("p", str(i), f"text {i % 90}") for i in range(300)] + [("q", "1", ""), ("q", "2", None), (None, "1", "x"), ("r", "1", None)]
    df = spark.createDataFrame(rows, "project_id string, rel_path string, content string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for key, path, text in rows:
        want.setdefault(key, []).extend([] if text is None else [f"{path}:{sha(text)}"])
    got = {r["project_id"]: r["content_hash"] for r in files.listed_hashes(df.repartition(7)).collect()}
    assert got == {k: sha("\n".join(sorted(v))) if v else None for k, v in want.items()}


def test_a_star_joins_what_the_pairs_of_a_resource_join(spark):
    facts = spark.createDataFrame([(f"m{i:02}", "READS", "SQL_TABLE", f"t{i % 7 if i < 30 else i}", "HIGH", i) for i in range(40)] + [("m05", "READS", "SQL_TABLE", "t6", "MED", 50)], "module_id string, direction string, resource_type string, resource_id string, tier string, fact_seq long")
    star = graph.stars(facts)
    parts = lambda edges: sorted(map(tuple, graph.connected_components(edges).select("node", "root").collect()))
    assert parts(star) == parts(graph.shared_edges(facts).select("a", "b"))
    assert star.count() == 31 - 7 < graph.shared_edges(facts).count()


TEXTS = ["", "a", "  ab ", "a\tb  c", "abcabcab", "\U0001f600é xyz Σς", "x" * 40, None]


def _hashed(text, digest):
    s = " ".join(text.lower().split())
    v = [0] * vectors.DIMENSIONS
    for g in [s] if len(s) < 3 else [s[i : i + 3] for i in range(len(s) - 2)]:
        v[int.from_bytes(digest(g.encode())[:4], "big") % vectors.DIMENSIONS] += 1
    return v


def test_a_gram_is_hashed_once_for_a_tasks_texts(spark):
    asked = []

    def digest(b):
        asked.append(b)
        return hashlib.blake2b(b, digest_size=4).digest()

    texts, known = ["abcabc" * 50, "abcabd", "ab"], {}
    got = [*vectors._counts(texts, digest, known, vectors.DIMENSIONS).tolist(), *vectors._counts(texts, digest, known, vectors.DIMENSIONS).tolist()]
    assert got == [_hashed(t, lambda b: hashlib.blake2b(b, digest_size=4).digest()) for t in texts] * 2
    assert sorted(asked) == sorted([b"abc", b"bca", b"cab", b"abd", b"ab", b"ab"])  # before, some 300 for the first text alone


def test_embeddings_are_the_counts_over_their_length(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").coalesce(1)
    for i, v in df.select("i", vectors.trigram_embedding(F.col("t"))).collect():
        n = _hashed(TEXTS[i] or "", lambda b: hashlib.blake2b(b, digest_size=4).digest())
        assert v == pytest.approx([x / math.sqrt(sum(y * y for y in n)) for x in n], abs=1e-15)


def test_gram_counts_are_those_of_md5(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").repartition(2)
    got = dict(map(tuple, df.select("i", vectors.gram_counts(F.col("t"))).collect()))
    assert got == {i: None if t is None else _hashed(t, lambda b: hashlib.md5(b).digest()) for i, t in enumerate(TEXTS)}


def test_sums_of_gram_counts_leave_a_task_as_three_numbers(spark):
    texts = [*TEXTS, "\u2028 a \r\n b\f", " \t", "a  b\n\nc " * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    counts = dict(map(tuple, df.select("i", vectors.gram_counts(F.col("t"))).collect()))
    got = {r["i"]: r["g"] and tuple(r["g"]) for r in df.select("i", vectors.gram_sums(F.col("t")).alias("g")).collect()}
    assert got == {i: g and (sum(g), sum(n > 0 for n in g), sum(n * k for k, n in enumerate(g))) for i, g in counts.items()}
    assert got[len(texts) - 2] == tuple(counts[0] and (1, 1, counts[0].index(1)))  # blanks only are as an empty text
    plan = evidence.hash_embed_md5(spark, "/root/testdata/sf0.001")
    assert "lambda" not in plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple")


def test_clone_components_make_the_lines_of_a_text_once(spark):
    reads = []
    durable = similarity.durable

    def written(df, *more):
        reads.append("regexp_replace" in df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple"))
        return durable(df, *more)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(similarity, "durable", written)
        evidence.clone_components(spark, "/root/testdata/sf0.001")
    assert sum(reads) == 1  # before, the classes' and the sets' plans each had the texts


def test_code_lines_of_odd_texts(spark):
    texts = ["", " \t\n", None, "a\r\nb\rc\n\x0b d \f", "x // y\nx\n/* z\n */w # v", "é  e\n#\n/", "a\u2028 \n\u00a0b", "/* open\nb", "http:/x\ny"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(map(tuple, df.select("i", code_lines(F.col("t"))).collect()))
    for i, t in enumerate(texts):
        lines = None if t is None else [x.strip(" \t\n\x0b\f\r") for x in re.split("\r\n|\r|\n", re.sub(COMMENT, "", t))]
        assert got[i] == (None if t is None else list(dict.fromkeys(x for x in lines if x)))


def test_touches_are_dealt_out_before_they_are_aggregated(spark):
    df = capability.strongest_touch(standins.facts(spark, "/root/testdata/sf0.001"))
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert plan.count("Exchange") == 1 and plan.index("partial_min") < plan.index("Exchange")  # the plan is printed from the top: below the exchange nothing is aggregated


def test_recall_in_few_buckets_makes_no_rows_of_pairs(spark, monkeypatch):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(120)], "id long, vector array<double>")
    tables, bits = 3, 4
    codes = {}
    for i, b in similarity.plane_buckets(df, tables, bits, 5).collect():
        codes.setdefault(i, set()).add(b)
    v = dict(map(tuple, df.collect()))
    cos = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y) or 1)
    want = {(a, b) for a in v for b in v if a < b and cos(v[a], v[b]) >= 0.4 and codes[a] & codes[b]}
    everything = {(a, b) for a in v for b in v if a < b and cos(v[a], v[b]) >= 0.4}
    monkeypatch.delattr(similarity, "plane_buckets")  # that way is for many buckets
    got = {(r["a"], r["b"]) for r in similarity.cosine_pairs_by_planes(df, 0.4, shape=(tables, bits)).collect()}
    assert got == want and want < everything


def test_clusters_do_not_read_the_facts_again(spark):
    sf = "/root/testdata/sf0.001"
    none = spark.createDataFrame([], "module_a string, module_b string, clone_type int, tier string")
    df = graph.clusters(standins.facts(spark, sf), none, standins.owners(spark, sf), standins.couplings(spark, sf))
    assert "lineitem" not in df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_clone_classes_say_what_the_pairs_say(spark):
    rng = random.Random(5)
    rows = []
    for i in range(150):  # families of few lines, of which some members have lines of their own, copies, and what is alike loosely only
        family = rng.randrange(6)
        t1 = {f"f{family}.{rng.randrange(2)}" for _ in range(3)} | {f"c{rng.randrange(3)}" for _ in range(rng.randrange(2))} | ({f"own{i}"} if rng.random() < 0.95 else set())
        t2 = {f"L{family // 2}.{rng.randrange(2)}" for _ in range(3)} | ({f"own{i}"} if rng.random() < 0.9 else set())
        rows.append((f"m{i:03}", sorted(t1), sorted(t2)))
    rows += [("x1", [], []), ("x2", ["alone", "too"], ["alone", "too"]), ("x3", ["three", "lines", "alone"], []), ("m9", rows[7][1], rows[8][2])]
    df = spark.createDataFrame(rows, "id string, t1 array<string>, t2 array<string>")
    want = sorted(map(tuple, similarity.clone_pairs(df, F.col("t1"), F.col("t2"), 0.6).collect()))
    members, links = similarity.clone_classes(df, F.col("t1"), F.col("t2"), 0.6)
    assert sorted(map(tuple, similarity.linked_pairs(members, links).select("module_a", "module_b", "clone_type", "similarity", "tier").collect())) == want
    two = [(a, b, k) for a, b, k, _, _ in want if a != b]
    assert {k for _, _, k in two} == {1, 2} and len(two) > 150 and links.count() < len(two) / 2
    assert {r["id"]: r["n_links"] for r in similarity.link_counts(members, links).collect() if r["n_links"]} == {m: sum(m in p[:2] for p in two) for m in {x for p in two for x in p[:2]}}
    # each module is in its class by a head whose lines are its own
    lines = {i: t for i, t, _ in rows}
    held = members.collect()
    assert {r["id"] for r in held} == {i for i, t, _ in rows if t} and all(lines[r["id"]] == lines[r["head"]] for r in held)
    # spans have the components of the pairs, and their types
    spans = similarity.linked_spans(members, links).select(F.col("module_a").alias("a"), F.col("module_b").alias("b"), "clone_type")
    pairs = spark.createDataFrame(two, "a string, b string, clone_type int")

    def parts(edges):
        roots = dict(map(tuple, graph.connected_components(edges.select("a", "b")).select("node", "root").collect()))
        return roots, {(roots[r["a"]], r["clone_type"]) for r in edges.collect() if r["a"] in roots}

    assert parts(spans) == parts(pairs)


def test_near_copies_make_no_rows_of_pairs(spark):
    rows = spark.range(3000).select(F.concat(F.lit("m"), "id").alias("id"), F.array(*(F.lit(x) for x in "abcdefg"), F.concat(F.lit("own "), F.col("id").cast("string"))).alias("t"))
    members, links = similarity.clone_classes(rows, F.col("t"), F.col("t"), 0.6)
    assert [tuple(r) for r in links.collect()] == [("m0", "m0", 1, 0.778)] and similarity.linked_spans(members, links).count() == 2999
    assert {r[0] for r in similarity.link_counts(members, links).select("n_links").distinct().collect()} == {2999}


def test_spans_of_judged_pairs_hold_what_the_pairs_hold(spark):
    rng = random.Random(8)
    words = ["order", "invoice", "parcel", "refund", "ticket", "coupon"]
    rows = [(f"m{i:03}", [1.0, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)], " ".join(rng.sample(words, 2 if i % 3 else 1)) if i % 7 else "of 12", f"p{i // 2}") for i in range(90)]
    df = spark.createDataFrame(rows, "id string, vector array<double>, summary string, project_id string")
    near = similarity.cosine_pairs(df, 0.4, group="project_id").withColumn("tier", similarity.recall_tier(F.col("similarity"), 0.75))
    summaries = df.select(F.col("id").alias("module_id"), "summary")
    every = judge.judged(near, summaries, summaries.select("module_id", F.lit("x").alias("owner"))).select("a", "b", "tier", "confirmed").collect()
    for block in (7, 90):
        got = judge.judged_spans(df, 0.4, 0.75, block=block).collect()
        spans = [(r["a"], r["b"], r["tier"]) for r in got if r["b"]]
        want = {(r["a"], r["b"], r["tier"]) for r in every if r["confirmed"]}
        assert set(spans) <= want and len(want) > 150 and len(every) > len(want)
        if block == 90:
            assert len(spans) < 2 * len(rows)

        def parts(pairs):
            edges = spark.createDataFrame([*pairs], "a string, b string, tier string")
            roots = dict(map(tuple, graph.connected_components(edges.select("a", "b")).select("node", "root").collect()))
            return roots, {roots[a] for a, _, t in pairs if t == "LOW"}

        assert parts(spans) == parts(want)
        n = {}
        for r in got:
            if r["b"] is None:
                n[r["a"]] = tuple(x + y for x, y in zip(n.get(r["a"], (0, 0)), (r["n_candidates"], r["n_confirmed"]), strict=True))
        assert n == {m: (sum(m in (r["a"], r["b"]) for r in every), sum(m in (r["a"], r["b"]) for r in every if r["confirmed"])) for m in {x for r in every for x in (r["a"], r["b"])}}


def test_pairs_judged_where_blocks_meet_are_judged_alike(spark):
    rng = random.Random(4)
    words = ["order", "invoice", "parcel", "refund", "ticket", "coupon", "ing", "ers", "events", "naïve"]
    rows = [(f"m{i:03}", [1.0, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(150)]
    texts = [(m, None if i % 11 == 0 else "" if i % 13 == 0 else " ".join([*rng.sample(words, rng.randrange(5)), *[f"own{m}"] * (i % 2), *["alone"] * (i == 5)]), rng.choice(["x", "y", None])) for i, (m, _) in enumerate(rows) if i % 17]
    df = spark.createDataFrame([*rows, ("m900", None), (None, rows[0][1])], "id string, vector array<double>")
    modules = spark.createDataFrame([*texts, ("zz", "order invoice", "x")], "module_id string, summary string, owner string")
    near = similarity.cosine_pairs(spark.createDataFrame(rows, df.schema), 0.4).withColumn("similarity", F.round("similarity", 6))
    columns = ["a", "b", "similarity", "confirmed", "confidence", "play", "reason"]
    want = sorted(map(tuple, judge.judged(near, modules.select("module_id", "summary"), modules.select("module_id", "owner")).select(*columns).collect()))
    assert {r[5] for r in want} == {"RETIRE", "STANDARDIZE", "LEAVE"} and any("of , " in r[6] for r in want)  # "ing" has no letter left
    for block in (7, 40, None):
        assert sorted(map(tuple, judge.judged_cosine(df, modules, 0.4, block=block).select(*columns).collect())) == want


def test_a_pair_carries_no_text_through_a_join(spark):
    plan = lambda df: df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    above = plan(evidence.judge_heuristic(spark, "/root/testdata/sf0.001")).split("FlatMapGroups")[0]
    assert "Join" not in above and "Exchange" not in above
    # a vector goes to at most eight tasks while a block has under 32,768 rows
    many = spark.range(20001).select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    assert re.search(r"xxhash64\(id#\d+L, 42\), 8\)", plan(similarity.cosine_pairs(many)))
