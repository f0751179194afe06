"""The Merkle manifest, MinHash groups and hard negatives against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import base, entry, merkle, minhash, mining

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [
    (1, "", "en", "s", 0), (2, None, None, None, None), (None, "words without an id", "en", "s", 19), (3, "same row", "en", "s", 8), (3, "same row", "en", "s", 8), (4, " \t\n ", "de", "t", 4),
    (5, "x" * 20000, "en", "s", 20000), (6, "é ü 漢字 😀   " * 500, "fr", "u", 5000), (8, "line\nline\nline\n" * 300, "en", "s", 4500), (12, "a b\nc", "en", "", 5), (None, None, None, None, None), (9, "A B\nc", "en", None, 5),
]


@pytest.fixture(scope="module")
def edges(spark):
    df = spark.createDataFrame(EDGES, DOCS)
    for name in ("tree", "id", "place", "n", "digest", "c0", "same", "key", "signature", "head", "level", "children", "_tie", "found", "Leaf"):
        df = df.withColumn(name, F.lit("mine"))
    return df


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_minhash_groups", "op13_hard_negatives"])
def test_query_gives_the_rows_of_its_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.QUERIES[name](spark, SF)
    want = duck.sql(entry.ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


# --- 11 -----------------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_by_hand(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree_by_hand(leaves):
    """The root and each leaf's proof as (left, right) pairs."""
    proofs, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for i, p in enumerate(at):
            run = leaves[p // 3 * 3 : p // 3 * 3 + 3]
            proofs[i].append(("".join(run[: p % 3]), "".join(run[p % 3 + 1 :])))
        leaves = [sha("".join(leaves[i : i + 3])) for i in range(0, len(leaves), 3)]
        at = [p // 3 for p in at]
    return leaves[0], proofs


def manifest_by_hand(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees, placed = {}, {}
    for s in names:
        placed[s] = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_by_hand(*r)))
        trees[s] = tree_by_hand([leaf_by_hand(*r) for r in placed[s]])
    root, over = tree_by_hand([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, over, strict=True):
        for r, own in zip(placed[s], trees[s][1], strict=True):
            proof = own + above
            text = r[1].replace("\n", "") if r[1] and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            node = leaf_by_hand(r[0], text, *r[2:])
            for left, right in proof:
                node = sha(left + node + right)
            out.append((r[0], leaf_by_hand(*r), trees[s][0], root, sha("".join(x + y for x, y in proof)), node, node == root))
    return out


def shown(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), "folded_root", "verified").collect())


def test_manifest_of_the_edge_cases(spark, edges):
    assert shown(merkle.verified(edges)) == sorted(map(repr, manifest_by_hand(EDGES)))


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (3, 4, 10), (27, 28, 1, 81), (9,) * 10])
def test_trees_of_many_shapes(spark, sizes):
    rng = random.Random(sum(sizes))
    ids = rng.sample(range(10_000), sum(sizes))
    rows = [(ids.pop(), "a\nb" * rng.randint(0, 2), "en", f"s{k}" if k else None, k) for k, n in enumerate(sizes) for _ in range(n)]
    assert shown(merkle.verified(spark.createDataFrame(rows, DOCS))) == sorted(map(repr, manifest_by_hand(rows)))


def test_a_proof_holds_for_its_leaf_only(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 3}", i) for i in range(40)]
    held = merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()
    of = spark.createDataFrame([(x["leaf"], y["proof"], x["doc_id"] == y["doc_id"], x["root"]) for x in held for y in held], "leaf string, proof array<struct<left:string,right:string>>, own boolean, root string")
    assert of.filter((merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")) != F.col("own")).count() == 0
    assert sorted((r["source"], r["place"]) for r in held) == [(f"s{s}", p) for s in range(3) for p in range(14 if s == 0 else 13)]


def test_many_rows_of_one_source_and_id(spark):
    """A place for each of equal rows, and ranges that one id fills."""
    df = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    held = merkle.manifest(df)
    assert held.select("place").distinct().count() == 5000 and held.agg(F.max("place")).first()[0] == 4999
    assert held.filter(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


@pytest.mark.parametrize("f", [merkle.verified, minhash.near_groups])
def test_empty_table_of_documents(spark, f):
    assert f(spark.createDataFrame([], DOCS)).count() == 0


# --- 12 -----------------------------------------------------------------------------------------------------


def set_by_hand(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(base.WORD, lowered)
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} or ({tuple(words)} if words else set())


def components_by_hand(rows, percent=85):
    """For (doc_id, text) the smallest doc_id that links reach."""
    sets, root = [set_by_hand(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(repr((d, len(sets[i]), (c := least.get(find(i))) if sets[i] else d, d == (c if sets[i] else d))) for i, (d, _) in enumerate(rows))


def grouped(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in minhash.near_groups(df, **more).collect())


def test_groups_of_the_edge_cases(spark, edges):
    got = sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in minhash.near_groups(edges).collect())
    assert got == components_by_hand([(d[0], d[1]) for d in EDGES])


def near_copies(rng, groups, each, words, edits):
    """Texts in groups of copies of a base text, with up to so many words changed, and texts that share passages only."""
    rows, vocabulary = [], [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=40)
    for _ in range(groups):
        first = rng.choices(vocabulary, k=rng.randint(*words))
        for _ in range(rng.randint(*each)):
            own = list(first)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append(" ".join(own if rng.random() < 0.7 else [x.upper() for x in own]))
        rows.append(" ".join(passage + rng.choices(vocabulary, k=rng.randint(5, 60))))
    ids = rng.sample(range(100_000), len(rows))
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize(("seed", "groups", "each", "words", "edits"), [(1, 40, (1, 6), (1, 60), 3), (2, 3, (60, 80), (100, 160), 9), (3, 60, (2, 4), (3, 12), 1)])
def test_groups_match_brute_force(spark, seed, groups, each, words, edits):
    rows = near_copies(random.Random(seed), groups, each, words, edits)
    assert grouped(spark, rows) == components_by_hand(rows)


def test_links_at_the_threshold(spark):
    """Pairs of 85 per cent and just under it: 17 of 20 and 84 of 99 shingles in common."""
    w = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    at = [(1, w("a", 19) + " x"), (2, w("a", 19)), (3, w("b", 102)), (4, w("b", 86) + " " + w("c", 13))]
    assert len(set_by_hand(at[1][1])) == 17
    assert grouped(spark, at) == components_by_hand(at)
    exact = [(5, w("d", 22)), (6, w("d", 19))]  # 17 of 20
    assert 100 * len(set_by_hand(exact[0][1]) & set_by_hand(exact[1][1])) == 85 * len(set_by_hand(exact[0][1]) | set_by_hand(exact[1][1]))
    assert grouped(spark, exact) == components_by_hand(exact)
    assert len({r.split(", ")[2] for r in grouped(spark, exact)}) == 1


def test_ids_may_be_null_or_repeated(spark):
    some, other = "one text of six words here", "another text that stands by itself alone"
    rows = [(None, some), (4, some), (4, other), (None, other + " x y z a b c"), (2, some), (None, "")]
    assert grouped(spark, rows) == components_by_hand(rows)


def test_copies_that_are_not_alike_enough_are_not_compared_in_pairs(spark, monkeypatch):
    """Copies of one text by five changes each that six others have as well, four of their own, and some that link."""
    rng, first, rows = random.Random(5), [f"w{i}" for i in range(260)], []
    for x, y in itertools.product(range(7), repeat=2):
        own = list(first)
        for k, line in enumerate((x, y, (x + y) % 7, (x + 2 * y) % 7, (x + 3 * y) % 7)):
            own[4 + 7 * (7 * k + line)] = f"line{k}.{line}"
        for at in rng.sample(range(35), 4):
            own[7 + 7 * at] = f"own{len(rows)}.{at}"
        rows.append((len(rows), " ".join(own)))
    rows += [(100 + i, rows[i][1] + " and more") for i in range(0, 49, 6)]
    compared, confirmed = [], minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, *more: compared.append(pairs.count()) or confirmed(pairs, *more))
    assert grouped(spark, rows) == components_by_hand(rows)
    assert compared[-1] < 50


def test_thresholds_that_signatures_do_not_serve_are_errors(spark):
    with pytest.raises(ValueError, match="thresholds"):
        minhash.near_groups(spark.createDataFrame([], DOCS), threshold=60)


def test_a_signature_agrees_as_often_as_sets_are_similar():
    """Coordinates agree with the similarity's frequency, and 85 per cent hardly ever fall under the number wanted."""
    rng, by = np.random.default_rng(7), minhash.multipliers()
    agree = []
    for _ in range(3000):
        common, own = rng.integers(0, 2**63, 170, np.uint64), rng.integers(0, 2**63, (2, 15), np.uint64)
        a, b = (minhash.signature(np.concatenate([common, x]), by) for x in own)
        agree.append(int((a == b).sum()))
    assert abs(np.mean(agree) / minhash.COORDINATES - 0.85) < 0.005
    assert min(agree) >= minhash.AGREE
    tail, n = 0.0, minhash.COORDINATES
    for k in range(minhash.AGREE):
        c = 1
        for i in range(k):
            c = c * (n - i) // (i + 1)
        tail += c * 0.85**k * 0.15 ** (n - k)
    assert tail < 2e-6


# --- 13 -----------------------------------------------------------------------------------------------------


def negatives_by_hand(rows, positives=5, negatives=3):
    """For (id, label, vector) with ids divisible by 10 as anchors."""
    held = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        held[(i, label, tuple(int(np.floor(256 * float(x))) for x in v))] = None
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in (k for k in held if k[0] % 10 == 0):
        every = sorted((-score(a[2], b[2]), b[0], b[1]) for b in held if b is not a)
        for p, pid, _ in [x for x in every if x[2] == a[1] and x[1] != a[0]][:positives]:
            fits = [x for x in every if x[2] != a[1] and 50 * -p <= 100 * -x[0] <= 95 * -p][:negatives]
            out += [(a[0], pid, k + 1, nid, -p, -n) for k, (n, nid, _) in enumerate(fits)]
    return sorted(map(repr, out))


def mined(spark, rows):
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>").withColumns({c: F.lit("mine") for c in ("v", "key", "low", "rows", "anchor_id")})
    return sorted(repr(tuple(r)) for r in mining.hard_negatives(df, F.col("id") % 10 == 0).collect())


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 1, [0.9, 0.5]), (3, 2, [0.8, 0.4]), (4, 2, [0.8, 0.4]), (5, 3, [0.8]), (6, 3, []), (7, 2, None), (8, None, [1.0, 1.0]), (None, 2, [0.9, 0.4]),
        (9, 2, [nan, 1.0]), (10, 2, [0.5, -0.5]), (11, 2, [inf, 1.0]), (12, 2, [None, 1.0]), (13, 1, [0.0, 0.0]), (20, 9, [1.0, 1.0]), (30, 2, [-1.0, -1.0]), (3, 2, [0.8, 0.4]), (40, 5, [0.0, 0.0]), (41, 5, [0.1, 0.0]), (14, 1, [3.0, 4.0, 5.0]),
    ]
    assert mined(spark, rows) == negatives_by_hand(rows)


@pytest.mark.parametrize("tile", [(256, 4096), (3, 7)])
def test_negatives_match_brute_force(spark, monkeypatch, tile):
    """Clusters, ties and vectors of one value, in tiles and blocks of many sizes."""
    monkeypatch.setattr(mining, "TILE", tile)
    monkeypatch.setattr(mining, "LEAST_ROWS", 50)
    monkeypatch.setattr(mining, "ANCHORS", 9)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (6, 16))
    rows = [(int(i), int(rng.integers(4)), [float(x) for x in centres[rng.integers(6)] * 2 + rng.normal(0, 0.3, 16)]) for i in range(300)]
    rows += [(1000 + i, i % 3, rows[7][2]) for i in range(60)]
    assert mined(spark, rows) == negatives_by_hand(rows)


def test_bounds_hold_for_large_and_small_components(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(i % 3), [float(x) for x in rng.normal(0, 10.0 ** rng.integers(-3, 6), 8)]) for i in range(200)]
    rows += [(500, 1, [1e30] * 8), (501, 1, [-2e6] * 8)]
    assert mined(spark, rows) == negatives_by_hand([r for r in rows if r[0] != 500])


def test_an_empty_table_has_no_negatives(spark):
    assert mining.hard_negatives(spark.createDataFrame([], "id long, label int, vector array<float>"), F.col("id") % 10 == 0).count() == 0


def test_most_pairs_are_discarded_before_their_product(spark, monkeypatch):
    """With a spectrum that falls, few rows of a block reach the integer products."""
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (4000, 32)) * 300 * 0.7 ** np.arange(32)
    ints = np.floor(x).astype(np.int64)
    axes = np.linalg.eigh(ints.T.astype(float) @ ints)[1][:, ::-1]
    seen = []
    real = mining.products
    monkeypatch.setattr(mining, "products", lambda a, b, i, j: seen.append(len(i)) or real(a, b, i, j))
    ends = [8, 16, 32]
    rows, anchors = mining.Side(ints, axes, ends), mining.Side(ints[:100], axes, ends)
    ids, labels = np.arange(4000), np.zeros(4000, np.int64)
    low, high = np.full((100, 1), mining.NONE + 1), np.full((100, 1), 2**63 - 1)
    best, found = mining.best_of_block(anchors, ids[:100], labels[:100], low, high, rows, ids, labels, ends, 1e-12, True, 5)
    scores = ints[:100] @ ints.T
    scores[np.arange(100), np.arange(100)] = mining.NONE
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores.astype(float)))[:, :5]
    assert (found[:, 0] == order).all() and (best[:, 0] == np.take_along_axis(scores, order, 1)).all()
    assert sum(seen) < 0.05 * 100 * 4000
