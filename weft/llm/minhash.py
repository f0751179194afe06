"""Near-duplicates by Jaccard similarity of word shingles: MinHash signatures, joined by their coordinates.

Each distinct set of shingles has a signature of 64 minima; each coordinate with its value is a token, and sets are posted
under their tokens. Two sets of a similarity of 0.85 agree in 54 coordinates on average, and in fewer than 39 once in a
million; so pairs that agree in 39 are wanted.

Prefixes: with tokens ordered by how few sets have them, sets that agree in 39 of 64 tokens share at least 4 of
the first 64 - 39 + 4 of each. Tokens of one set alone come first and meet nobody: a set of which more than 25 tokens are its
own is done. Only prefixes are posted.

Of the sets that are left the shingles are counted, too: those that no other set has are in no common part.

Collisions: first each set meets one set of its lists, the most central of them, which already joins large groups of
near copies, without their pairs. Then in each list that still holds several groups, what is not of the largest group meets
the others. Lists are merged as they are joined: a pair's collisions are counted in the first list that both are in, and
the pair is skipped in all others; 4 keep it. A common part has at most what either set has besides its rare shingles and the rare
ones that both have; so the similarity of most pairs is bounded by numbers alone, and those that share rare shingles are listed
by them. In a large group of near copies that are linked with nothing this spares nearly all of the pairs. What agrees in 39 coordinates is then compared by its whole sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.base import durable, forget
from weft.operators.components import connected_components

#: Coordinates of a signature, how many must agree, and how many of those must be met in the prefixes.
COORDINATES, AGREE, MET = 64, 39, 4
#: Most sets of mixed lists that have a rare shingle.
RARE = 128
#: Words in a shingle.
SHINGLE = 3


def shingles(text: str | None):
    """The distinct shingles of a text as sorted 64-bit hashes; with fewer words the whole sequence is one."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= SHINGLE:
        return np.array([xxh64_intdigest(b" ".join(words), SHINGLE)], np.uint64)
    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = len(w) - SHINGLE + 1
    h = w[:n].copy()
    for i in range(1, SHINGLE):  # order counts: the words before are mixed anew at each step
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += w[i : n + i]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def multipliers(coordinates: int = COORDINATES):
    """Odd numbers, one for each coordinate."""
    import numpy as np

    return np.random.default_rng(12).integers(0, 2**63, coordinates, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes, by):
    """For each multiplier the least of the upper halves of the products."""
    import numpy as np

    least = np.full(len(by), 2**64 - 1, np.uint64)
    for s in range(0, len(hashes), 512):
        np.minimum(least, (hashes[s : s + 512, None] * by).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, same, n, key, signature) for each row of docs (doc_id, same, text); rows of equal sets have one key."""

    def of(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        by = multipliers()
        for b in batches:
            n, keys, marks = [], [], []
            for text in b.column(2):
                found = shingles(text.as_py())
                n.append(len(found))
                keys.append(xxh3_128_digest(found.tobytes()) if len(found) else None)
                marks.append(signature(found, by) if len(found) else None)
            values = pa.array(np.concatenate([m for m in marks if m is not None] or [np.empty(0, np.int32)]))
            ends = pa.array(np.cumsum([0, *(0 if m is None else len(m) for m in marks)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(ends, values)], ["doc_id", "same", "n", "key", "signature"])

    return docs.mapInArrow(of, "doc_id long, same long, n long, key binary, signature array<int>")


def _prefixes(sets: DataFrame) -> DataFrame:
    """(id, tokens, weight): the tokens of each set's prefix that other sets have as well, and how many sets have its tokens
    in all. A set without a partner has no row."""
    token = F.transform("signature", lambda v, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(v.cast("long").bitwiseAND(F.lit(2**32 - 1))))
    posted = sets.select("id", F.explode(token).alias("token"))
    several = posted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = posted.join(several, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"), F.sum("df").alias("weight"))  # 64 at most
    own = own.filter(F.size("tokens") >= AGREE)
    return own.select("id", F.transform(F.slice("tokens", F.lit(1), F.size("tokens") - AGREE + MET), lambda t: t["token"]).alias("tokens"), "weight")


def _alone(whole: DataFrame) -> DataFrame:
    """(id, alone): how many shingles no other of the sets (id, hashes) has. Sets without one have no row."""
    counted = whole.select("id", F.explode("hashes").alias("h")).groupBy("h").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("c"))
    return counted.filter("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))


def _rare(placed: DataFrame, whole: DataFrame, numbers: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(id, few) and (a, b, common) of the sets of mixed lists (id, group, other): how many of a set's shingles are rare, at most
    RARE of these sets having them, and how many rare ones two sets share that may link: of different groups, one other in some list."""
    left = placed.groupBy("id").agg(F.min("group").alias("group"), F.bool_or("other").alias("other")).join(numbers.select("id", "n"), "id")
    posted = durable(whole.join(left, "id").select("id", "group", "other", "n", F.explode("hashes").alias("h")))
    counts = posted.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.bool_or("other").alias("wanted")).filter(F.col("c") <= RARE)
    rare = durable(posted.join(counts, "h").select("id", "group", "other", "n", "h", (F.col("wanted") & (F.col("c") > 1)).alias("shared")), spent=(posted,))
    few = rare.groupBy("id").agg(F.count(F.lit(1)).alias("few"))
    shared = rare.filter("shared").drop("shared")
    met = shared.filter("other").join(shared.select("h", F.col("id").alias("id2"), F.col("group").alias("group2"), F.col("other").alias("other2"), F.col("n").alias("n2")), "h")
    met = met.filter(F.expr("group <> group2 and (not other2 or id < id2)") & _possible(F.least("n", "n2"), threshold))
    return durable(few), durable(met.groupBy(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).agg(F.count(F.lit(1)).alias("common")), spent=(rare,))


def _possible(most: Column, threshold: int) -> Column:
    """Whether sets of n and n2 shingles, of which at most so many are common, can be that similar."""
    return 100 * most >= threshold * (F.col("n") + F.col("n2") - most)


def _agree(one: str, other: str) -> Column:
    """Whether two signatures agree in enough coordinates."""
    return F.aggregate(F.zip_with(one, other, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) >= AGREE


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree in enough coordinates."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("signature").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_agree("sa", "sb")).select("a", "b")


def _mixed(known: DataFrame, groups: DataFrame) -> DataFrame:
    """(token, id, group, other): the lists that hold several groups (id, group; without a row a set is its own); other tells
    that the set is not of its list's largest group."""
    lists = known.join(groups, "id", "left").select(F.explode("tokens").alias("token"), "id", F.coalesce("group", "id").alias("group"))
    several = lists.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high").select("token")
    mixed = durable(lists.join(several, "token"))
    largest = mixed.groupBy("token", "group").agg(F.count(F.lit(1)).alias("size")).groupBy("token").agg(F.max(F.struct("size", "group")).alias("most"))
    return durable(mixed.join(largest, "token").select("token", "id", "group", (F.col("group") != F.col("most.group")).alias("other")), spent=(mixed,))


def _confirmed(pairs: DataFrame, whole: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of which the common part is at least `threshold` per cent of both together, by whole sets (id, hashes)."""

    @F.arrow_udf("long")
    def common(x, y):
        import numpy as np
        import pyarrow as pa

        read = lambda v: v.values.to_numpy()
        return pa.array([len(np.intersect1d(read(p), read(q), assume_unique=True)) for p, q in zip(x, y, strict=True)], pa.int64())

    side = lambda x: whole.select(F.col("id").alias(x), F.col("hashes").alias(f"h{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    sizes = (F.size("ha") + F.size("hb")).cast("long")
    met = both.select("a", "b", sizes.alias("sizes"), common(F.col("ha"), F.col("hb")).alias("common"))
    return met.filter(100 * F.col("common") >= threshold * (F.col("sizes") - F.col("common"))).select("a", "b")


def _whole(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, hashes): the sets of wanted (id, doc, same), made again from their texts."""

    def of(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            found = [shingles(t.as_py()).view(np.int64) for t in b.column(1)]
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found or [np.empty(0, np.int64)])))], ["id", "hashes"])

    texts = docs.join(wanted.select("id", F.col("doc").alias("doc2"), F.col("same").alias("same2")), F.col("doc_id").eqNullSafe(F.col("doc2")) & (F.col("same") == F.col("same2")))
    return texts.dropDuplicates(["id"]).select("id", "text").mapInArrow(of, "id long, hashes array<long>")


def linked(docs: DataFrame, sets: DataFrame, threshold: int = 85) -> DataFrame:
    """(id, root) for the sets (id, n, doc, same, signature) that links join to others: the smallest id that they reach.
    doc and same name a row of docs (doc_id, same, text) that has the set."""
    able = durable(_prefixes(sets))
    whole = durable(_whole(docs, sets.join(able.select("id"), "id", "left_semi")))
    left = lambda name: F.col("n") - F.coalesce(name, F.lit(0))
    known = able.join(sets.select("id", "n", "signature"), "id").join(_alone(whole), "id", "left").select("id", F.array_sort("tokens").alias("tokens"), "signature", "weight", "n", left("alone").alias("rest"))
    known = durable(known.filter(100 * F.col("rest") >= threshold * F.col("n")), spent=(able,))
    other = lambda *names: [F.col(c).alias(f"{c}2") for c in names]
    of = lambda df: connected_components(df, small=0).withColumnsRenamed({"node": "id", "root": "group"})
    numbers = known.select("id", "weight", "n", "rest")
    # a list's most central set, for each set that with which it has the most lists in common
    posted = known.select(F.explode("tokens").alias("token"), "weight", "id", "n", "rest")
    central = F.max(F.struct("weight", *other("id", "n", "rest"))).alias("f")
    first = posted.groupBy("token").agg(central).select("token", "f.*")
    met = posted.drop("weight").join(first, "token").filter((F.col("id") != F.col("id2")) & _possible(F.least("rest", "rest2"), threshold)).groupBy("id", "id2").agg(F.count(F.lit(1)).alias("met"), F.max("weight").alias("weight"))
    best = met.groupBy("id").agg(F.max(F.struct("met", "weight", "id2")).alias("best")).select(F.col("id").alias("a"), F.col("best.id2").alias("b"))
    some = durable(_alike(best, sets))
    groups = of(_confirmed(some, whole, threshold))
    # what is left over tries the most central sets of its lists' largest groups
    placed = _mixed(known, groups)
    heads = placed.filter("not other").join(numbers, "id").groupBy("token").agg(central).select("token", "f.*")
    tried = placed.filter("other").join(numbers.drop("weight"), "id").join(heads, "token").filter(_possible(F.least("rest", "rest2"), threshold)).select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()
    again = durable(_alike(tried, sets))
    groups = of(durable(groups.select(F.col("id").alias("a"), F.col("group").alias("b")).unionByName(_confirmed(again, whole, threshold))))
    forget(some, again, placed)
    placed = _mixed(known, groups)
    few, shared = _rare(placed, whole, numbers, threshold)
    side = durable(known.join(placed.select("id").distinct(), "id").join(few, "id", "left").select("id", "n", left("few").alias("often")), spent=(few,))
    full = durable(placed.join(side, "id").join(known.select("id", "tokens", "signature"), "id"), spent=(placed,))
    met = full.join(full.filter("other").select("token", *other("id", "group", "n", "often", "tokens", "signature")), "token")
    # a pair is met in every list that both are in, once each, and is kept in the first
    first = F.exists(F.array(F.array_intersect("tokens", "tokens2")), lambda shared: (F.size(shared) >= MET) & (F.get(shared, F.lit(0)) == F.col("token")))
    kept = F.when(F.expr("group = group2 or (other and id >= id2)") | ~_possible(F.least("often", "often2"), threshold), False).when(~first, False).otherwise(_agree("signature", "signature2"))
    by_lists = met.filter(kept).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))
    rare = shared.join(side.withColumnRenamed("id", "a"), "a").join(side.select(F.col("id").alias("b"), *other("n", "often")), "b")
    by_rare = rare.filter(_possible(F.least("often", "often2") + F.col("common"), threshold)).select("a", "b")
    close = durable(by_lists.unionByName(_alike(by_rare, sets)).distinct())
    merged = of(durable(groups.select(F.col("id").alias("a"), F.col("group").alias("b")).unionByName(_confirmed(close, whole, threshold))))
    forget(known, full, whole, shared, side, close)
    return merged.withColumnRenamed("group", "root")


def near_groups(docs: DataFrame, threshold: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Texts are linked if the common part of their sets of distinct three-word shingles is at least `threshold` per cent of
    both together, confirmed by the whole sets; A to Z count as a to z. component_id is the smallest doc_id that links
    reach, the row's own included; kept tells whether it is the row's. A null, empty or wordless text has no shingles and
    is linked with nothing. Texts of equal sets fold into one first. A row with a null doc_id takes part in links, but its
    id is a component's only if all are null. Repeated rows stay. Long texts are read whole. An empty table gives no
    rows; other columns are not read.

    A link is missed only where fewer than 39 of 64 coordinates agree: at 85 per cent once in a million, above
    more seldom. Thresholds under 85 would be missed more often and are an error."""
    if not 85 <= threshold <= 100:
        raise ValueError("signatures serve for thresholds from 85 to 100")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("same"), "text")
    rows = durable(_signed(held))
    sets = rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("head"), F.min(F.struct("doc_id", "same")).alias("of"), F.min("n").alias("n"), F.first("signature").alias("signature"))
    sets = durable(sets.select(F.monotonically_increasing_id().alias("id"), "key", "head", "n", F.col("of.doc_id").alias("doc"), F.col("of.same").alias("same"), "signature"))
    roots = linked(held, sets, threshold)
    own = sets.select("id", "key", "head").join(roots, "id", "left").select("key", "head", F.coalesce("root", "id").alias("root"))
    least = own.groupBy("root").agg(F.min("head").alias("component"))
    known = durable(own.join(least, "root").select("key", "component"), spent=(sets,))
    out = rows.join(known, "key", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
