"""The queries of this package, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, cotraining, licenses, media, merkle, minhash, mining, quality_rules, quotes, raking, secrets, sharding, simhash
from weft.llm.base import sha256, table


def op1_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return secrets.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), sha256(secrets.joined(F.col("base"))).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(quality_rules.BASE)) != 0).alias("base_failed"), "kept", "failed", "policy",
    )


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    said = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["matched"].cast("string"), m["size"].cast("string"), m["first"].cast("string"), m["last"].cast("string")))
    best = F.array_max(F.transform("matches", lambda m: m["coverage"]))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"), best.alias("coverage"), F.array_join(said, ",").alias("matches"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload, shown = F.col("payload"), F.col("media")
    tail = F.crc32(F.substring(payload, -32, 32))
    return media.media_columns(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), tail.alias("tail_crc32"),
        F.octet_length(shown).cast("long").alias("media_bytes"), F.sha2(shown, 256).alias("media_sha256"), F.lower(F.hex("hash")).alias("feature"),
    )


def op7_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op8_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.drawn(table(spark, sf_dir, "documents"))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op12_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return mining.hard_negatives(rows, F.col("id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quote_links, op2_secret_scans, op3_byte_bpe, op4_quality_rules, op5_license_scans, op6_media_columns, op7_hypergeometric_shards, op8_cotrained_quality, op9_raked_mixture, op10_simhash_groups, op11_merkle_manifest, op12_minhash_groups, op13_hard_negatives)
}
_FAILED = " + ".join(f"CASE WHEN {rule} THEN {quality_rules.BIT[name]} ELSE 0 END" for name, rule in quality_rules.RULES)
#: The CRC of a decimal doc_id, and the leaf of a row with that text, in SQL.
_CRC = "list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, _: xor(x >> 1, 3988292384 * (x & 1))))"
_LEAF = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
#: Trained, drawn, iterated and format-bound operators are held against brute force in tests/llm instead.
ORACLES: dict[str, str] = {
    "op4_quality_rules": rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
      lines AS (SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
      wins AS (SELECT row, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] AS win FROM d, unnest(range(1, greatest(len(ws) - 3, 1))) AS u(i)),
      often AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, win) AS n FROM wins) WHERE n > 1),
      covered AS (SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM often, unnest(range(0, 5)) AS u(k) GROUP BY row),
      m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
        len(list_filter(ws, lambda w: length(w) > 1 AND ascii(right(w, 1)) < 128 AND NOT regexp_matches(right(w, 1), '[A-Za-z0-9]') AND right(w, 1) = left(right(w, 2), 1))) AS n_marked_words
        FROM d LEFT JOIN lines USING (row) LEFT JOIN covered USING (row)),
      f AS (SELECT *, ({_FAILED})::INT AS failed FROM m)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {quality_rules.BASE} <> 0 AS base_failed, failed & {quality_rules.POLICIES[quality_rules.CURRENT].mask} = 0 AS kept, failed, {quality_rules.CURRENT} AS policy FROM f""",
    "op11_merkle_manifest": f"""WITH RECURSIVE
      d AS (SELECT *, {_LEAF("text")} AS leaf, CASE WHEN {_CRC} & 1 = 1 THEN {_LEAF("replace(text, chr(10), '')")} END AS odd FROM documents),
      p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
      up AS (SELECT source, 0 AS level, list(leaf ORDER BY place) AS nodes FROM p GROUP BY source
        UNION ALL SELECT source, level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1 : i + 3], ''))) FROM up WHERE len(nodes) > 1),
      sub AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM up WHERE len(nodes) = 1),
      top AS (SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM sub
        UNION ALL SELECT level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1 : i + 3], ''))) FROM top WHERE len(nodes) > 1),
      l AS (SELECT source, level, nodes, 0 AS tree FROM up WHERE len(nodes) > 1 UNION ALL SELECT source, level, nodes, 1 FROM (SELECT DISTINCT source FROM up), top WHERE len(nodes) > 1),
      s AS (SELECT p.place AS row, p.source, l.tree, l.level, CASE l.tree WHEN 0 THEN p.place ELSE sub.place END // (3 ** l.level)::BIGINT AS pos, l.nodes
        FROM p JOIN sub ON p.source IS NOT DISTINCT FROM sub.source JOIN l ON l.source IS NOT DISTINCT FROM p.source),
      proof AS (SELECT row, source, list({{'left': array_to_string(l.nodes[pos // 3 * 3 + 1 : pos], ''), 'right': array_to_string(l.nodes[pos + 2 : pos // 3 * 3 + 3], '')}} ORDER BY tree, level) AS path FROM s AS l GROUP BY row, source),
      f AS (SELECT p.*, coalesce(path, []) AS path, coalesce(odd, leaf) AS node, 1 AS i FROM p LEFT JOIN proof ON row = place AND p.source IS NOT DISTINCT FROM proof.source
        UNION ALL SELECT * REPLACE (sha256(path[i].left || node || path[i].right) AS node, i + 1 AS i) FROM f WHERE i <= len(path))
      SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.left || x.right), '')) AS proof_sha256, node AS folded_root, node = root AS verified
      FROM f JOIN sub ON f.source IS NOT DISTINCT FROM sub.source, (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1) WHERE i > len(path)""",
    "op13_hard_negatives": """WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT a.id AS anchor_id, b.id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 50 = 0),
      p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
      SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
      QUALIFY rank <= 3""",
    "op12_minhash_groups": r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
      s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM d),
      x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS one FROM s),
      links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.one = b.one AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
      reach AS (SELECT a AS node, a AS root FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node AND r.root < l.b),
      least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
      SELECT doc_id, len(sh)::BIGINT AS n_shingles, coalesce(least(root, doc_id), doc_id) AS component_id, coalesce(least(root, doc_id), doc_id) = doc_id AS kept FROM s LEFT JOIN least ON node = doc_id""",
}
