"""Clones, recall and judgement, over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalogue.standins import read
from weft.functions import vectors
from weft.functions.numbers import half_even
from weft.functions.text import GENERIC, STOP_WORDS, code_lines, domain_tokens
from weft.operators import judge, similarity
from weft.operators.components import connected_components


def _modules(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def _clones(spark: SparkSession, sf: str, kinds: tuple[int, ...] = (1, 2)) -> DataFrame:
    return similarity.clone_pairs(_modules(spark, sf), code_lines(F.col("text")), code_lines(F.col("text"), normalise=True), kinds=kinds)


def clones_type1(spark, sf):
    return _clones(spark, sf, kinds=(1,))


def clones_type2(spark, sf):
    return _clones(spark, sf).filter("clone_type = 2")


def clone_classes(spark, sf):
    return similarity.set_classes(_modules(spark, sf).select("id", code_lines(F.col("text")).alias("tokens")))


def clone_components(spark, sf):
    """(id, component, n_links): every document that has a clone of type 1, its group, and how many others link."""
    lines = _modules(spark, sf).select("id", code_lines(F.col("text")).alias("tokens"))
    classes, sets = similarity.hashed_sets(lines)
    heads = classes.groupBy("class").agg(F.count(F.lit(1)).alias("held"))
    found = similarity.durable(similarity.jaccard_pairs(sets, 0.60))
    both = found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(heads.select(F.col("class").alias("b"), "held"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("held").alias("near"))
    groups = connected_components(found.select("a", "b")).select(F.col("node").alias("class"), "root")
    rows = classes.join(heads, "class").join(near, "class", "left").join(groups, "class", "left")
    links = F.col("held") - 1 + F.coalesce("near", F.lit(0))
    return rows.select("id", F.coalesce("root", "class").alias("component"), links.alias("n_links")).filter("n_links > 0")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _recalled(spark: SparkSession, sf: str, low: float = 0.40) -> DataFrame:
    return similarity.cosine_pairs(_vectors(spark, sf), low)


def recall_cosine(spark, sf):
    return _recalled(spark, sf).withColumn("similarity", F.round("similarity", 6))


def recall_tiered(spark, sf):
    rows = _recalled(spark, sf, 0.30)
    return rows.groupBy(similarity.recall_tier(F.col("similarity"), 0.45).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def recall_topk(spark, sf):
    return _recalled(spark, sf).withColumn("similarity", F.round("similarity", 6)).orderBy(F.desc("similarity"), "a", "b").limit(20)


def hash_embed_md5(spark, sf):
    return read(spark, sf, "documents").select("doc_id", vectors.gram_sums(F.col("text")).alias("g")).select("doc_id", "g.n_grams", "g.n_buckets", "g.total")


def hash_embed_blake2b(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", vectors.trigram_embedding(F.col("text")).alias("v"))
    return rows.select("doc_id", F.size("v").alias("n"), half_even(vectors.dot(F.col("v"), F.col("v")), 6).alias("norm"))


def domain_terms(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", domain_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", ",").cast("binary")).alias("digest"))


def judge_heuristic(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("module_id"), F.col("text").alias("summary"), F.col("source").alias("owner"))
    return judge.judged_cosine(_vectors(spark, sf), docs)


QUERIES = {f.__name__: f for f in (clones_type1, clones_type2, clone_classes, clone_components, recall_cosine, recall_tiered, recall_topk, hash_embed_md5, hash_embed_blake2b, domain_terms, judge_heuristic)}

_LINES = r"""l1 AS (SELECT DISTINCT doc_id AS id, line FROM (SELECT doc_id, regexp_replace(unnest(string_split(regexp_replace(text, '#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/', '', 'g'), chr(10))), '^\s+|\s+$', '', 'g') AS line FROM documents) WHERE line <> '')"""
_CLASS = "c{k} AS (SELECT id, min(id) OVER (PARTITION BY key) AS class FROM (SELECT id, string_agg(line, chr(10) ORDER BY line) AS key FROM l{k} GROUP BY id))"
_CLASS1, _CLASS2 = _CLASS.format(k=1), _CLASS.format(k=2)
_LOOSE = "l2 AS (SELECT DISTINCT id, regexp_replace(line, '[A-Za-z_][A-Za-z0-9_]*', 'ID', 'g') AS line FROM l1 WHERE id IN (SELECT class FROM c1))"
_JACCARD = """n{k} AS (SELECT id, count(*) AS n FROM l{k} WHERE id IN (SELECT class FROM c{k}) GROUP BY id),
  i{k} AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM l{k} a JOIN l{k} b ON a.line = b.line AND a.id < b.id WHERE a.id IN (SELECT class FROM c{k}) AND b.id IN (SELECT class FROM c{k}) GROUP BY 1, 2),
  j{k} AS (SELECT a, b, common / (x.n + y.n - common) AS sim FROM i{k} JOIN n{k} x ON x.id = a JOIN n{k} y ON y.id = b WHERE common / (x.n + y.n - common) >= 0.6),
  p{k} AS (SELECT a AS module_a, b AS module_b, {k} AS clone_type, round_even(sim, 3) AS similarity FROM j{k} UNION ALL SELECT class, class, {k}, 1.0 FROM c{k} GROUP BY class HAVING count(*) > 1)"""
_COS = "list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[])"
_PAIRS = f"SELECT x.vec_id AS a, y.vec_id AS b, {_COS} AS s FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id"
_TERMS = (
    r"terms AS (SELECT doc_id, source, coalesce(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: regexp_matches(w, '^[a-z]{3,}$') AND NOT list_contains([STOP], w) AND NOT list_contains([GEN], w) AND NOT list_contains([GEN], regexp_replace(w, '(?:ing|ers|er|ed|s)$', ''))), lambda w: regexp_replace(w, '(?:ing|ers|er|ed|s)$', '')))), []) AS t FROM documents)"
    .replace("STOP", ", ".join(f"'{w}'" for w in STOP_WORDS)).replace("GEN", ", ".join(f"'{w}'" for w in GENERIC))
)

ORACLES = {
    "clones_type1": f"WITH {_LINES}, {_CLASS1}, {_JACCARD.format(k=1)} SELECT *, 'HIGH' AS tier FROM p1",
    "clones_type2": f"WITH {_LINES}, {_CLASS1}, {_JACCARD.format(k=1)}, {_LOOSE}, {_CLASS2}, {_JACCARD.format(k=2)} SELECT *, 'HIGH' AS tier FROM p2 WHERE module_a = module_b OR NOT EXISTS (FROM p1 WHERE p1.module_a = p2.module_a AND p1.module_b = p2.module_b)",
    "clone_classes": f"WITH {_LINES}, {_CLASS1} SELECT id, class FROM c1",
    "clone_components": f"""WITH RECURSIVE {_LINES}, {_CLASS1}, {_JACCARD.format(k=1)}, e AS (SELECT a, b FROM j1 UNION SELECT b, a FROM j1),
        r(node, other) AS (SELECT a, b FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other), g AS (SELECT node, least(node, min(other)) AS root FROM r GROUP BY node),
        h AS (SELECT class, count(*) AS held FROM c1 GROUP BY class), near AS (SELECT e.a AS class, sum(held)::BIGINT AS near FROM e JOIN h ON h.class = e.b GROUP BY e.a)
        SELECT id, coalesce(root, class) AS component, held - 1 + coalesce(near, 0) AS n_links FROM c1 JOIN h USING (class) LEFT JOIN near USING (class) LEFT JOIN g ON g.node = class WHERE held - 1 + coalesce(near, 0) > 0""",
    "recall_cosine": f"SELECT a, b, round(s, 6) AS similarity FROM ({_PAIRS}) WHERE s >= 0.4",
    "recall_tiered": f"SELECT CASE WHEN s >= 0.45 THEN 'MED' ELSE 'LOW' END AS tier, count(*) AS n FROM ({_PAIRS}) WHERE s >= 0.3 GROUP BY 1",
    "recall_topk": f"SELECT a, b, round(s, 6) AS similarity FROM ({_PAIRS}) WHERE s >= 0.4 ORDER BY 3 DESC, 1, 2 LIMIT 20",
    "hash_embed_md5": r"""WITH t AS (SELECT doc_id, regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') AS s FROM documents),
        c AS (SELECT doc_id, s, string_split(s, '') AS c FROM t),
        g AS (SELECT doc_id, z[1] || z[2] || z[3] AS gram FROM (SELECT doc_id, unnest(list_zip(c[:-3], c[2:-2], c[3:])) AS z FROM c WHERE length(s) >= 3) UNION ALL SELECT doc_id, s FROM c WHERE length(s) < 3),
        b AS (SELECT doc_id, ('0x' || substr(md5(gram), 1, 8))::BIGINT % 256 AS k FROM g)
        SELECT doc_id, count(*) AS n_grams, count(DISTINCT k) AS n_buckets, sum(k)::BIGINT AS total FROM b GROUP BY doc_id""",
    "domain_terms": f"WITH {_TERMS} SELECT doc_id, len(t) AS n, md5(array_to_string(t, ',')) AS digest FROM terms",
    "judge_heuristic": f"""WITH {_TERMS}, p AS (SELECT a, b, round(s, 6) AS similarity FROM ({_PAIRS}) WHERE s >= 0.4),
        q AS (SELECT p.*, coalesce(x.source, 'unknown') AS oa, coalesce(y.source, 'unknown') AS ob, coalesce(list_sort(list_intersect(x.t, y.t)), []) AS common, len(list_distinct(list_concat(coalesce(x.t, []), coalesce(y.t, [])))) AS total FROM p LEFT JOIN terms x ON x.doc_id = a LEFT JOIN terms y ON y.doc_id = b),
        v AS (SELECT *, len(common) >= 2 OR (len(common) >= 1 AND similarity >= 0.82) AS confirmed FROM q)
        SELECT a, b, similarity, confirmed, round_even(CASE WHEN confirmed THEN least(similarity, 0.5 + len(common) / greatest(total, 1)) ELSE least(similarity, 0.4) END, 2) AS confidence,
        CASE WHEN confirmed AND oa = ob THEN 'RETIRE' WHEN confirmed THEN 'STANDARDIZE' ELSE 'LEAVE' END AS play,
        CASE WHEN confirmed THEN 'Both speak of ' || array_to_string(common[1:3], ', ') || '; their summaries have cosine ' || printf('%.2f', similarity) ELSE 'Too little in common: ' || len(common) || ' terms, cosine ' || printf('%.2f', similarity) END AS reason FROM v""",
}
