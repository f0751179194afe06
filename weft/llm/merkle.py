"""A Merkle manifest of a dataset: a leaf for each row, a tree for each source, a tree over the sources' roots.

Three neighbours make a parent, the last run of a level fewer, a run of one too. Bottom up, each level is written:
a node with its children's digests. Top down, proofs are pushed: each level joins the proofs of its nodes, and
each child puts its siblings in front of what its parent inherits. A level has a third of the rows of the one
below, so all of them together cost half as much again as the first, and no task sees a source whole: leaves get
their places from rows dealt out by range, runs from places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.base import durable

#: Children of a node.
ARITY = 3
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(*values: Column) -> Column:
    """The digest of a row's values: each as its number of UTF-8 bytes, a colon and itself, a null as a dash."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (x.cast("string") for x in values)]
    return F.sha2(F.concat(*parts), 256)


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with their place (from 0) in their tree, in the order of the columns, and the tree's number of rows n.

    Rows are dealt out by range, equal ones too, and written with numbers that rise in this order; a tree has a run of
    numbers in each part that it has rows in, and what its earlier parts hold is added. The largest window has a row for
    each of a tree's parts."""
    sort = ["tree", *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort)
    written = durable(dealt.drop("_tie").withColumn("_number", F.monotonically_increasing_id()))
    rows = written.withColumn("_part", F.shiftright("_number", 33))
    runs = rows.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_number").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("tree", "_part", (F.col("first") - F.coalesce(before, F.lit(0))).alias("_from"), F.sum("n").over(tree).alias("n"))
    held = rows.join(runs, ["tree", "_part"]).withColumn("place", F.col("_number") - F.col("_from")).drop("_part", "_number", "_from")
    return durable(held, spent=(written,))


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """Level 0 is leaves (tree, place, n, digest); each one after it has (tree, place, n, children, digest), n the nodes
    of the tree at that level. A tree of one node has no level above."""
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        up = F.floor(F.col("place") / ARITY).cast("long").alias("place")
        runs = levels[-1].filter("n > 1").groupBy("tree", up).agg(F.array_sort(F.collect_list(F.struct(F.col("place").alias("at"), "digest"))).alias("run"), F.max("n").alias("n"))
        children = F.transform("run", lambda c: c["digest"])
        levels.append(durable(runs.select("tree", "place", F.ceil(F.col("n") / ARITY).cast("long").alias("n"), children.alias("children")).withColumn("digest", F.sha2(F.array_join("children", ""), 256))))
        most = -(-most // ARITY)
    return levels


def _siblings(children: Column, at: Column) -> Column:
    """What stands left and right of child number `at`."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), at), "").alias("left"), F.array_join(F.slice(children, at + 2, F.lit(ARITY)), "").alias("right"))


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, level, digest) of each tree's last node."""
    out = None
    for k, level in enumerate(levels):
        one = level.filter("n = 1").select("tree", F.lit(k).alias("level"), "digest")
        out = one if out is None else out.unionByName(one)
    return out


def _pushed(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, place, children, suffix and what else tops has) for the parents of leaves; a lone leaf has a row without
    children. tops: (tree, level, suffix, ...)."""
    held = [c for c in tops.columns if c not in ("tree", "level")]
    at = lambda k: tops.filter(F.col("level") == k).select("tree", F.lit(0).cast("long").alias("place"), *held)
    proofs = None
    for k in range(len(levels) - 1, 0, -1):
        proofs = at(k) if proofs is None else proofs.unionByName(at(k))
        proofs = levels[k].select("tree", "place", "children").join(proofs, ["tree", "place"])
        if k > 1:
            below = proofs.select("*", F.posexplode("children").alias("i", "_child"))
            suffix = F.concat(F.array(_siblings(F.col("children"), F.col("i"))), F.col("suffix"))
            proofs = below.select("tree", (F.col("place") * ARITY + F.col("i")).alias("place"), *(suffix.alias(c) if c == "suffix" else c for c in held))
    alone = at(0).withColumn("children", F.lit(None).cast("array<string>"))
    return alone if proofs is None else proofs.unionByName(alone)


def _proved(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The rows of level 0 with their proof and what else tops has: (tree, level, suffix, ...)."""
    parents = _pushed(levels, tops).withColumnRenamed("place", "_up")
    up = F.floor(F.col("place") / ARITY).cast("long")
    rows = levels[0].withColumn("_up", up).join(parents, ["tree", "_up"])
    own = F.array(_siblings(F.col("children"), (F.col("place") % ARITY).cast("int")))
    return rows.withColumn("proof", F.when(F.col("children").isNull(), F.col("suffix")).otherwise(F.concat(own, F.col("suffix")))).drop("_up", "children", "suffix")


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof give."""
    return F.aggregate(proof, digest, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of a proof's siblings, from the leaf's to the root's children, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda level: F.concat(level["left"], level["right"])), ""), 256)


def manifest(docs: DataFrame, carried: dict[str, Column] | None = None) -> DataFrame:
    """For each row of docs: doc_id, source, place (from 0 in its source), leaf, subroot (of its source), root, proof
    (from the leaf upward a struct of what stands left and right of the node, as hex text), and the columns `carried`, computed
    from docs.

    Leaves of a source stand in the order of doc_id (null first), those of one id in that of their digests; equal rows are
    equal leaves, each with a place of its own. A null source is one of its own, before all others. Nulls in any column have
    their digest, an empty text is none; a long text is read whole, once. An empty table gives no rows, a single row is
    its own root, with an empty proof. Columns but FIELDS and the carried ones are not read, whatever their names."""
    carried = carried or {}
    # no null, and in order: null first, then by the bytes of the name
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col("doc_id").alias("id"), leaf(*(F.col(f) for f in FIELDS)).alias("digest"), *(c.alias(f"c{i}") for i, c in enumerate(carried.values())))
    levels = _levels(_placed(rows, "id", "digest"))
    tops = durable(_tops(levels))
    # the same once more: the sources' roots are the leaves of one tree
    over = _levels(_placed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "level", "digest"), "source"))
    last = _tops(over).first()
    root = last["digest"] if last else None
    start = F.array().cast("array<struct<left:string,right:string>>")
    above = _proved(over, _tops(over).select("tree", "level", start.alias("suffix")))
    tops2 = durable(above.select(F.col("source").alias("tree"), "level", F.col("digest").alias("subroot"), F.col("proof").alias("suffix")), spent=(tops, *over))
    out = _proved(levels, tops2)
    source = F.when(F.col("tree") != "", F.expr("substring(tree, 2)"))
    return out.select(F.col("id").alias("doc_id"), source.alias("source"), "place", F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), "proof", *(F.col(f"c{i}").alias(n) for i, n in enumerate(carried)))


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row whose text has lost its line breaks; null where it has none, or where it is left alone: that is
    where the CRC of the decimal doc_id is odd, or there is no id."""
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    return F.when(hit, leaf(*(F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in FIELDS)))


def verified(docs: DataFrame) -> DataFrame:
    """manifest, with folded_root (what the leaf found now and the proof give) and verified (whether it is the root), after
    every second document has lost its line breaks. Rows and edge cases as in manifest."""
    held = manifest(docs, {"found": tampered(docs)})
    again = folded(F.coalesce("found", "leaf"), F.col("proof"))
    return held.withColumn("folded_root", again).withColumn("verified", F.col("folded_root") == F.col("root")).drop("found")
