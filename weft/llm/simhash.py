"""SimHash fingerprints and the near-duplicate groups that they link, by pigeonhole blocks.

The 64 bits are split into 6 blocks. Two fingerprints that differ in at most 4 bits differ in at most 4
blocks, so they agree in 2 blocks at least: each fingerprint is filed under each of the 15 pairs of
blocks (20 to 22 bits), and whatever is close shares a file. Five single blocks would do as well, but a
file of 13 bits holds a 8,192nd of the corpus, and comparing within files then grows with its square.

Copies fold into one fingerprint first. Within a file, each fingerprint is compared with the smallest and
with its neighbours in order; that already joins the large groups of near copies, without their pairs.
Then each file that holds several groups is gone through for pairs between them: no link is lost."""

from __future__ import annotations

from itertools import accumulate, combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.base import durable, forget, fresh
from weft.operators.components import connected_components

#: The lowest bit and the width of each block.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]


def fingerprint_of(text: str | None) -> int:
    """The unsigned fingerprint of a text; null and wordless texts give 0."""
    import numpy as np
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= 4:
        parts, n = [joined], 1
    else:
        ends = [*accumulate(len(w) + 1 for w in words)]
        starts = [0, *ends]
        n = len(words) - 3
        parts = (joined[starts[i] : ends[i + 3] - 1] for i in range(n))
    hashes = np.frombuffer(b"".join([xxh64_digest(p, 42) for p in parts]), np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        ones += np.unpackbits(hashes[i : i + 8192], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: Column) -> Column:
    """fingerprint_of as a column of signed longs."""

    @F.arrow_udf("long")
    def of(texts):
        import pyarrow as pa

        return pa.array([(x + 2**63) % 2**64 - 2**63 for x in (fingerprint_of(t.as_py()) for t in texts)], pa.int64())

    return of(text)


def _files(prints: DataFrame, *more: str) -> DataFrame:
    """A row for each fingerprint and pair of blocks."""
    signed = lambda m: m - 2**64 if m >= 2**63 else m
    masks = [sum(((1 << w) - 1) << low for low, w in two) for two in combinations(BLOCKS, 2)]
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("pair"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(masks)])
    return prints.select("fp", *more, F.inline(keys))


def linked(prints: DataFrame, distance: int = 4) -> DataFrame:
    """(fp, root) for the distinct fingerprints in prints, a table of durable; root: the smallest that links reach.

    A file whose fingerprints are all of one group by then has nothing to add and goes, however large it is. In the
    others, what is not of the file's largest group meets the whole file, so the pairs within that group are not made."""
    if not 0 <= distance <= 4:
        raise ValueError("six blocks, filed by twos, serve for distances up to 4")
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= distance
    file = ["pair", "bits"]
    filed = Window.partitionBy(*file).orderBy("fp")
    first, last = F.first("fp").over(filed), F.lag("fp").over(filed)
    some = (
        _files(prints).select("fp", F.array(first, last).alias("others"))
        .select("fp", F.explode("others").alias("other"))
        .filter(near(F.col("fp"), F.col("other")) & (F.col("fp") != F.col("other")))
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
    )
    groups = connected_components(some, small=0).withColumnsRenamed({"node": "fp", "root": "group"})
    grouped = durable(prints.join(groups, "fp", "left").select("fp", F.coalesce("group", "fp").alias("group")))
    one = _files(grouped, "group")
    several = one.groupBy(*file).agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high").select(*file)
    mixed = durable(one.join(several, file, "left_semi"))
    largest = mixed.groupBy(*file, "group").agg(F.count(F.lit(1)).alias("n")).groupBy(*file).agg(F.max(F.struct("n", "group")).alias("most"))
    others = durable(mixed.join(largest, file).filter(F.col("group") != F.col("most.group")).select(*file, F.col("fp").alias("fp2"), F.col("group").alias("group2")))
    between = mixed.join(others, file).filter((F.col("group") != F.col("group2")) & near(F.col("fp"), F.col("fp2")))
    merged = connected_components(between.select(F.col("group").alias("a"), F.col("group2").alias("b")), small=0)
    forget(mixed, others)
    merged = merged.withColumnsRenamed({"node": "group"})
    return grouped.join(merged, "group", "left").select("fp", F.coalesce("root", "group").alias("root"))


def _heads(prints: DataFrame, head: Column, distance: int) -> tuple[DataFrame, DataFrame]:
    """Of prints (fp, and what head aggregates): (fp, root) for each fingerprint, and (root, head), each group's head.

    Fingerprints fold first, so a group of copies is one row; heads are aggregated map-side and written, so that a
    join by root is between plain exchanges, which Spark can deal out anew where a group is large."""
    distinct = durable(prints.groupBy("fp").agg(head.alias("head")))
    roots = durable(linked(distinct.select("fp"), distance))
    return roots, durable(roots.join(distinct, "fp").groupBy("root").agg(F.min("head").alias("head")), spent=(distinct,))


def near_groups(docs: DataFrame, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    component_id is the smallest doc_id of the rows that links of at most `distance` bits reach, its own
    included. A null text is an empty one: fingerprint zero, linked like any other. A row with a null
    doc_id takes part in links, but its id is a component's only if all are null. Repeated rows stay. An
    empty table gives no rows; other columns are not read. A long text is read whole, a shingle at a time; its
    fingerprint is as any other's."""
    prints = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text")).alias("fp")))
    roots, heads = _heads(prints, F.min("doc_id"), distance)
    groups = durable(roots.join(heads, "root").select("fp", F.col("head").alias("component_id")), spent=(roots, heads))
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = 4) -> DataFrame:
    """The rows of docs without near-duplicates, columns as they are.

    Of each group of near_groups the row with the smallest doc_id stays (null ids count as largest); of
    rows that share that id the one with the smallest hash of its text, and of copies of that row one. Groups are told
    apart by their fingerprints, as ids may be null or repeated. A null text is an empty one; an empty table gives no rows.

    Ids and hashes say which rows stay; the texts move once, after copies have folded where they lie."""
    key = {"none": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "same": F.xxhash64("text")}
    prints = durable(docs.select(*(c.alias(n) for n, c in key.items()), fingerprint(F.col("text")).alias("fp")))
    roots, heads = _heads(prints, F.min(F.struct(*key)), distance)
    own = {n: fresh(docs, f"_{n}") for n in key}
    kept = heads.select(*(F.col(f"head.{n}").alias(c) for n, c in own.items()))
    forget(prints, roots)
    marked = docs.withColumns({own[n]: c for n, c in key.items()}).dropDuplicates([*own.values()])
    return marked.join(kept, [*own.values()], "left_semi").select(*docs.columns)
