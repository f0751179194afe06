"""Connected components of an edge table by contraction, without gathering anything on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.plans.durable import counted, durable, forget

#: Most distinct edges that one task may take, some 20 MB.
SMALL = 100_000


def _at_once(edges: DataFrame) -> DataFrame:
    """Components of a small table of edges, by one task."""

    def solve(frames):
        import pandas as pd

        up: dict = {}

        def top(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for frame in frames:
            for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
                a, b = sorted((top(a), top(b)))
                up[b] = a  # the smaller stays on top
        if up:  # a frame without rows has no string columns
            yield pd.DataFrame({"node": [*up], "root": [top(x) for x in up]})

    kind = edges.schema["a"].dataType.simpleString()
    return durable(edges.coalesce(1).mapInPandas(solve, f"node {kind}, root {kind}"), spent=(edges,))


def _flattened(parents: DataFrame) -> DataFrame:
    """parents (node, root), each root smaller than its node or equal: follows the pointers to their ends.

    A round squares the pointers twice, so a chain of length n takes about log4(n) rounds; where the second squaring
    moves none, the first has come to all ends. Both sides of a join are plain exchanges, so that Spark can deal out
    anew what a hub gathers."""
    while True:
        at = parents
        for _ in range(2):
            ahead = at.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            at = at.join(ahead, F.col("root") == F.col("_n"), "left").select("node", F.col("root").alias("_was"), F.coalesce("_r", "root").alias("root"))
        jumped, moved = counted(at, F.count_if(F.col("root") != F.col("_was")), spent=(parents,))
        if not moved:
            out = jumped.select("node", "root")
            out.durable_path = jumped.durable_path
            return out
        path = jumped.durable_path
        parents = jumped.select("node", "root")
        parents.durable_path = path


def connected_components(edges: DataFrame, small: int | None = None) -> DataFrame:
    """(node, root) for every node of edges (a, b), root the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour (a map-side minimum, so a hub costs no more
    than another node), flattens the trees and keeps only the edges between different trees. At least
    every node but the local minima goes, so rounds are few. Loops and repeated edges are allowed.

    A graph of at most `small` edges (None: SMALL) is done in one task: there the rounds' jobs would cost more than the work.
    The rows are the same either way; 0 takes the rounds for every graph."""
    pair, rows = F.array_sort(F.array("a", "b")), F.count(F.lit(1))
    left, n = counted(edges.filter("a <> b").select(pair[0].alias("a"), pair[1].alias("b")).distinct(), rows)
    if n <= (SMALL if small is None else small):
        return _at_once(left)
    whole: DataFrame | None = None
    while n:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        trees = _flattened(durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root"))))
        of_a = trees.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = trees.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        joined = left.join(of_a, "a").join(of_b, "b").filter("ra <> rb")
        left, n = counted(joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), rows, spent=(left,))
        if whole is None:
            whole = trees
        else:
            higher = trees.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            whole = durable(whole.join(higher, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), spent=(whole, trees))
    if whole is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    forget(left)
    return whole


def updated_components(held: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame, small: int | None = None) -> DataFrame:
    """held (node, root), the components of a graph before a change, brought up to its edges (a, b) after it.

    added and removed (a, b) are what has changed; edges are all that are there now. Where edges only came, the
    roots that they join are contracted, and no other edge is read. Components that lose an edge may fall apart: their own
    edges are gone through again, those of no others. The rows are those of connected_components(edges); a node
    without an edge has no row."""
    of = lambda node, root: held.select(F.col("node").alias(node), F.col("root").alias(root))
    torn = durable(removed.select(F.explode(F.array("a", "b")).alias("node")).join(held, "node").select("root").distinct())
    if torn.isEmpty():
        whole, loose = held, edges.limit(0)
    else:
        inside = durable(held.join(torn, "root", "left_semi").select("node"))
        # an edge that is there now has both ends in one old component, unless it is new
        loose = edges.join(inside.withColumnRenamed("node", "a"), "a", "left_semi").join(inside.withColumnRenamed("node", "b"), "b", "left_semi")
        whole = held.join(torn, "root", "left_anti").select("node", "root").unionByName(connected_components(loose, small).select("node", "root"))
    whole = durable(whole)
    # new edges between components, or to nodes that had none
    own = whole.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    ends = lambda df, x: df.join(own, F.col(x) == F.col("_n"), "left").withColumn(x, F.coalesce("_r", x)).drop("_n", "_r")
    joined = connected_components(ends(ends(added.select("a", "b"), "a"), "b").filter("a <> b"), small)
    ahead = joined.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    first = whole.join(ahead, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    fresh = added.filter("a <> b").select(F.explode(F.array("a", "b")).alias("node")).distinct().join(whole, "node", "left_anti").join(joined, "node")
    return first.unionByName(fresh.select("node", "root"))
