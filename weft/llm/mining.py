"""Hard negatives: for an anchor and each of its positives, the best rows of other labels within a band of scores.

Scores are integer inner products of quantised vectors. All rows are searched, block by block; what spares the
work within a pair of blocks is a rotation to the principal axes of all rows. Products are added up over the
leading components; what the others can add is at most the product of the two residual norms, by Cauchy and
Schwarz, and rounding is covered by a slack. A pair whose bound can't come into the result goes early; the
integer product of the quantised vectors decides on the others. So the rotation and the order of sums decide how
much is spared, never what is found."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.base import durable

#: Rows and anchors in a block: what one task holds. Each row is sent once to every block of anchors, and each anchor once
#: to every block of rows, so larger blocks send less.
ROWS, ANCHORS = 65_536, 65_536
#: Small tables are dealt into as many blocks of rows, if each gets so many.
LEAST_BLOCKS, LEAST_ROWS = 64, 2_048
#: Anchors and rows whose products a task has in memory at once.
TILE = (256, 4_096)
#: Shares of the components after which bounds are looked at.
STEPS = (0.25, 0.5, 1.0)
NONE = -(2**63)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) for each component; null where the vector or a component is null or not finite, or where the
    squared norm is 2^62 or more, so that products might not fit in a long."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    norm = F.aggregate(ints, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(whole & (norm < float(2**62)), ints.cast("array<int>"))


def matrix(column, width: int):
    """A column of lists of integers as a matrix; short ones end in zeros."""
    import numpy as np

    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def rotation(rows: DataFrame, width: int):
    """The principal axes of rows (v) as columns, those of the most energy first, and how far they are from orthogonal.

    Tasks sum products of components; width^2 / 2 sums reach the driver, however many rows there are."""
    import numpy as np

    def moments(batches):
        import numpy as np
        import pyarrow as pa

        sums = np.zeros((width, width))
        for b in batches:
            x = matrix(pa.chunked_array([b.column(0)]), width).astype(np.float64)
            sums += x.T @ x
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[i, j])], ["i", "j", "s"])

    sums = rows.select("v").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    full = np.zeros((width, width))
    full[sums["i"], sums["j"]] = full[sums["j"], sums["i"]] = sums["s"]
    axes = np.linalg.eigh(full)[1][:, ::-1]
    return axes, float(np.linalg.norm(axes.T @ axes - np.eye(width)))


class Side:
    """Vectors of a block: integers, rotated ones, and for each step the norm of what is left."""

    def __init__(self, ints, axes, ends):
        import numpy as np

        self.ints, self.y = ints, ints.astype(np.float64) @ axes
        energy = np.cumsum((self.y * self.y)[:, ::-1], axis=1)[:, ::-1]
        self.norm = np.sqrt((ints.astype(np.float64) ** 2).sum(1))
        self.left = [np.sqrt(energy[:, e]) if e < ints.shape[1] else np.zeros(len(ints)) for e in ends]


def products(a: Side, b: Side, i, j):
    """Integer products of rows i of a and rows j of b."""
    import numpy as np

    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), 65_536):
        out[s : s + 65_536] = np.einsum("pd,pd->p", a.ints[i[s : s + 65_536]], b.ints[j[s : s + 65_536]])
    return out


def merged(best, ids, group, score, of, k: int) -> None:
    """Brings rows (group, score, of) into the k best scores and ids of each group, smaller ids first among equals."""
    import numpy as np

    touched, at = np.unique(group, return_inverse=True)
    old = np.repeat(np.arange(len(touched)), k)
    g, s, n = np.concatenate([old, at]), np.concatenate([best[touched].ravel(), score]), np.concatenate([ids[touched].ravel(), of])
    order = np.lexsort((n, -s.astype(np.float64), g)) if (np.abs(s[s != NONE]) < 2**53).all() else np.lexsort((n, np.where(s == NONE, 2**63 - 1, -s), g))
    g, s, n = g[order], s[order], n[order]
    rank = np.arange(len(g)) - np.searchsorted(g, g)
    keep = rank < k
    best[touched], ids[touched] = s[keep].reshape(-1, k), n[keep].reshape(-1, k)


def best_of_block(anchors: Side, a_ids, a_labels, low, high, rows: Side, r_ids, r_labels, ends, slack: float, same: bool, k: int):
    """(scores, ids), each of len(anchors) x wishes x k: for each wish of an anchor the k best rows of the block with a
    score from low to high (both of len(anchors) x wishes), of the anchor's label and another id, or of another label.

    What is empty has the score NONE."""
    import numpy as np

    n, wishes = low.shape
    best, ids = np.full((n * wishes, k), NONE), np.full((n * wishes, k), 2**63 - 1)
    for a0 in range(0, n, TILE[0]):
        a = slice(a0, min(a0 + TILE[0], n))
        top = high[a].max(1).astype(np.float64)
        for r0 in range(0, len(r_ids), TILE[1]):
            r = slice(r0, r0 + TILE[1])
            fits = (a_labels[a, None] == r_labels[None, r]) == same
            if same:
                fits &= a_ids[a, None] != r_ids[None, r]
            # a row matters to a wish from its low on, and from the last of its best on
            need = np.maximum(low[a], best.reshape(n, wishes, k)[a, :, -1]).min(1).astype(np.float64)
            part = anchors.y[a, : ends[0]] @ rows.y[r, : ends[0]].T
            more = np.outer(anchors.left[0][a], rows.left[0][r]) + slack * np.outer(anchors.norm[a], rows.norm[r])
            if wishes == 1 and part.shape[1] > k:  # k rows are sure to have that much, if they are not too high
                sure = np.where(fits & (part + more <= high[a, :1]), part - more, -np.inf)
                need = np.maximum(need, np.partition(sure, -k, axis=1)[:, -k])
            i, j = np.nonzero(fits & (part + more >= need[:, None]) & (part - more <= top[:, None]))
            part, i0, j0 = part[i, j], i + a0, j + r0
            for step in range(1, len(ends)):
                cut = slice(ends[step - 1], ends[step])
                live = np.empty(len(part), bool)
                for s in range(0, len(part), 65_536):
                    p = slice(s, s + 65_536)
                    part[p] += np.einsum("pd,pd->p", anchors.y[i0[p], cut], rows.y[j0[p], cut])
                    more = anchors.left[step][i0[p]] * rows.left[step][j0[p]] + slack * anchors.norm[i0[p]] * rows.norm[j0[p]]
                    live[p] = (part[p] + more >= need[i0[p] - a0]) & (part[p] - more <= top[i0[p] - a0])
                part, i0, j0 = part[live], i0[live], j0[live]
            score = products(anchors, rows, i0, j0)
            for w in range(wishes):
                ok = (score >= low[i0, w]) & (score <= high[i0, w])
                if ok.any():
                    merged(best, ids, i0[ok] * wishes + w, score[ok], r_ids[j0[ok]], k)
    return best.reshape(n, wishes, k), ids.reshape(n, wishes, k)


def _searched(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, axes, off: float, same: bool, k: int) -> DataFrame:
    """(anchor_id, anchor_key, wish, score, id): the k best of all rows for each wish of anchors (anchor_id, anchor_key, label,
    v, low, high), low and high arrays of bounds."""
    width = len(axes)
    ends = sorted({max(1, math.ceil(width * s)) for s in STEPS})
    slack = off + 4 * width**1.5 * 2.0**-52
    r_blocks, a_blocks = max(math.ceil(n_rows / ROWS), min(LEAST_BLOCKS, math.ceil(n_rows / LEAST_ROWS)), 1), max(math.ceil(n_anchors / ANCHORS), 1)

    def search(left, right):
        import numpy as np
        import pyarrow as pa

        names = ["anchor_id", "anchor_key", "wish", "score", "id"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        held = lambda t, name: t.column(name).to_numpy()
        wishes = max(1, int(np.max(np.diff(right.column("low").combine_chunks().offsets.to_numpy()))))
        count = np.diff(right.column("low").combine_chunks().offsets.to_numpy())
        low, high = matrix(right.column("low"), wishes), matrix(right.column("high"), wishes)
        none = np.arange(wishes) >= count[:, None]
        low[none], high[none] = 2**62, NONE  # no score is there
        a, b = Side(matrix(right.column("v"), width), axes, ends), Side(matrix(left.column("v"), width), axes, ends)
        best, ids = best_of_block(a, held(right, "anchor_id"), held(right, "label"), low, high, b, held(left, "id"), held(left, "label"), ends, slack, same, k)
        i, w, p = np.nonzero(best != NONE)
        return pa.table([pa.array(x, t) for x, t in zip((held(right, "anchor_id")[i], held(right, "anchor_key")[i], w, best[i, w, p], ids[i, w, p]), kinds, strict=True)], names)

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("id", "label", "v", F.pmod("key", F.lit(r_blocks)).cast("int").alias("rows"), every(a_blocks).alias("anchors"))
    right = anchors.select("anchor_id", "anchor_key", "label", "v", "low", "high", F.pmod("anchor_key", F.lit(a_blocks)).cast("int").alias("anchors"), every(r_blocks).alias("rows"))
    found = left.groupBy("rows", "anchors").cogroup(right.groupBy("rows", "anchors")).applyInArrow(search, "anchor_id long, anchor_key long, wish int, score long, id long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "anchor_key", "wish").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """For rows (id long, label long, vector) and the anchors among them: (anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score).

    Components become floor(scale * x); a score is the integer product with the anchor, higher ones first, smaller ids
    first among equals. An anchor's positives are its first `positives` rows of the same label and another id; for each,
    the first `negatives` rows of another label whose score is `low` to `high` per cent of the positive's are returned.
    is_anchor is a condition over id.

    Rows with a null id, label, vector or component, with a component that is not finite, or a squared norm of 2^62 or more
    take no part. Rows equal in id, label and quantised vector are one row; rows that share an id only are never each other's
    positives. A shorter vector ends in zeros, an empty one scores 0. An empty table gives no rows. Other columns are not read."""
    held = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), quantised(F.col("vector"), scale).alias("v")).filter("id is not null and label is not null and v is not null")
    held = durable(held.dropDuplicates().withColumn("key", F.xxhash64("id", "label", "v")).withColumn("is_anchor", is_anchor))
    n, n_anchors, width = held.agg(F.count(F.lit(1)), F.count_if("is_anchor"), F.max(F.size("v"))).first()
    width = max(width or 0, 1)
    axes, off = rotation(held, width)
    anchors = held.filter("is_anchor").select(F.col("id").alias("anchor_id"), F.col("key").alias("anchor_key"), "label", "v")
    whole = F.array(F.lit(NONE + 1).cast("long"))
    near = _searched(held, anchors.withColumns({"low": whole, "high": F.array(F.lit(2**63 - 1).cast("long"))}), n, n_anchors, axes, off, True, positives)
    taken = durable(near.groupBy("anchor_id", "anchor_key").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("taken")))
    # the whole numbers from low to high per cent of a score, by its hundreds and the rest, so that no product is too large
    rest = F.pmod("score", F.lit(100))
    hundreds = F.expr("(score - pmod(score, 100)) div 100")
    bound = {"low": hundreds * low + F.ceil(rest * low / 100), "high": hundreds * high + F.floor(rest * high / 100)}
    per = taken.select("anchor_id", "anchor_key", "taken", F.posexplode("taken").alias("wish", "p")).select("anchor_id", "anchor_key", "taken", "wish", F.col("p.score").alias("score"))
    bounds = per.groupBy("anchor_id", "anchor_key").agg(*(F.transform(F.array_sort(F.collect_list(F.struct("wish", b.cast("long").alias("b")))), lambda x: x["b"]).alias(name) for name, b in bound.items()))
    wishing = durable(anchors.join(bounds, ["anchor_id", "anchor_key"]))
    hard = _searched(held, wishing, n, n_anchors, axes, off, False, negatives)
    positive = taken.select("anchor_id", "anchor_key", F.posexplode("taken").alias("wish", "p"))
    return hard.join(positive, ["anchor_id", "anchor_key", "wish"]).select(
        "anchor_id", F.col("p.id").alias("positive_id"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score")
    )
