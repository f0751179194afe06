"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

1. Rows lie in `cells` source cells (a hash of their content, so a recomputed task finds the same ones). Equal rows
   fold into one with a count first, in pieces of at most COPIES, which lie in different cells.
2. From the cells' row counts alone the driver draws how many rows of each cell go to each shard: every
   row of the matrix is a multivariate hypergeometric draw from what the shards still have room for, so
   the column sums are the shards' sizes exactly and the matrix has the law that a uniform shuffle gives.
3. Each cell is permuted on its own; its first rows go to shard 0, the next to shard 1, and so on.
4. Each shard is permuted again. Cells and shards are split into buckets by another hash, as many as the number of
   rows asks for; a bucket's rows are ranked in one task and the sizes of the buckets before it are added, so no
   task ever holds a whole cell or shard.

Nothing but `cells` counts is ever gathered, whatever the number of rows.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.base import durable

#: Most copies of a row that lie together, and the rows that a bucket is to have.
COPIES, MOST = 4096, 65_536


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` balls out of good + bad are good.

    Inverts the distribution function outward from the mode, in steps of the order of the standard
    deviation, so that it serves for any population size."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    lg = math.lgamma
    choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    top = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    left = rng.random() - top
    up, down, at_up, at_down = mode, mode, top, top
    while left > 0 and (up < high or down > low):
        if up < high:
            at_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= at_up
            if left <= 0:
                return up
        if down > low:
            at_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= at_down
            if left <= 0:
                return down
    return mode  # what rounding of the sum has left over


def communication_matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """rows[i]: rows in cell i. Row i of the result: how many of them each shard takes."""
    total, rng = sum(rows), random.Random(seed)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in rows:
        line, open_, todo = [], sum(room), n
        for s in range(shards):
            open_ -= room[s]
            x = hypergeometric(rng, room[s], open_, todo)
            line.append(x)
            todo -= x
        room = [r - x for r, x in zip(room, line, strict=True)]
        matrix.append(line)
    return matrix


def _starts(rows: DataFrame, group: str, bucket: str, order: list[str]) -> DataFrame:
    """rows with `start`: the copies (n) before them in the order of a group's buckets, then `order`."""
    within = F.sum("n").over(Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    before = F.sum("held").over(Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    sums = rows.groupBy(group, bucket).agg(F.sum("n").alias("held")).select(group, bucket, F.coalesce(before, F.lit(0)).alias("offset"))
    return rows.withColumn("within", F.coalesce(within, F.lit(0))).join(sums, [group, bucket]).withColumn("start", F.col("offset") + F.col("within"))


def shard_rows(docs: DataFrame, shards: int = 24, cells: int = 1024, buckets: int | None = None, seed: int = 7) -> DataFrame:
    """A row (doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs, law `rows`.

    size is the text's UTF-8 bytes plus 8. A null text counts as an empty one; null and repeated doc_ids
    are rows like others; copies of a row that agree in everything are interchangeable, and any number of them may
    be. An empty table gives no rows. Other columns are not read; of a long text nothing but size and checksum moves.
    With fewer rows than shards some shards stay empty. buckets: of each cell and shard; None for MOST rows each."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = ["doc_id", "size", "text_crc32"]
    folded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")).groupBy(*own).agg(F.count(F.lit(1)).alias("all"))
    pieces = folded.select(*own, "all", F.explode(F.sequence(F.lit(0), F.floor((F.col("all") - 1) / COPIES).cast("long"))).alias("piece"))
    hashed = pieces.select(*own, F.least(F.lit(COPIES).cast("long"), F.col("all") - F.col("piece") * COPIES).alias("n"), F.xxhash64(F.lit(seed), *own, "piece").alias("order"))
    rows = durable(hashed.select(*own, "n", F.pmod(F.col("order"), F.lit(cells)).cast("int").alias("cell"), F.xxhash64(F.lit(seed + 1), "order").alias("order")))
    held = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # at most `cells` rows
    total = sum(held.values())
    split = lambda groups: buckets or max(1, math.ceil(total / groups / MOST))
    ends = []
    for line in communication_matrix([held.get(c, 0) for c in range(cells)], shards, seed):
        ends.append([sum(line[: s + 1]) for s in range(shards)])
    ends_of = F.get(F.from_json(F.lit(json.dumps(ends)), "array<array<bigint>>"), F.col("cell"))
    bucket = lambda column, salt, n: F.pmod(F.xxhash64(F.lit(seed + salt), column), F.lit(n)).cast("int").alias("bucket")
    ranked = _starts(rows.select("*", bucket("order", 4, split(cells))), "cell", "bucket", ["order", *own])
    copies = ranked.select(*own, "order", ends_of.alias("ends"), "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    sent = copies.select(*own, F.size(F.filter("ends", lambda e: e <= F.col("start") + F.col("copy"))).alias("shard"), F.xxhash64(F.lit(seed + 2), "order", "copy").alias("again"))
    sent = sent.select("*", F.lit(1).alias("n"), bucket("again", 3, split(shards)))
    placed = _starts(sent, "shard", "bucket", ["again", *own])
    return placed.select(*own, F.lit("rows").alias("law"), "shard", F.col("start").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
