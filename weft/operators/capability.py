"""Capabilities: resources, clones, functions and libraries that several modules share, scored and ranked.

Members stay rows. Everything that a score needs is an aggregate (counts, minima, sums), which Spark
pre-aggregates before it shuffles, so a topic that a third of all modules touch costs no task more than
others; arrays of members are made only for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.numbers import half_even
from weft.operators.components import connected_components
from weft.schema import DIRECTIONS, dimension, tier_name, tier_rank


#: Parts that touches are dealt into, for each part of the facts and at most: with 200 million facts a million in each.
PARTS_EACH, PARTS = 8, 200


def strongest_touch(facts: DataFrame) -> DataFrame:
    """One row for each module and resource: its strongest tier, and the direction of the first fact of that tier.

    Rank, sequence number and direction are packed in one long, whose minimum is a fixed-size aggregate. Most keys come once or
    twice, so facts are dealt out before they are aggregated: a map of a whole split's keys would save little and hold most of it."""
    code = F.lit(0)
    for i, d in enumerate(DIRECTIONS):
        code = F.when(F.col("direction") == d, i).otherwise(code)
    packed = F.shiftleft((3 - tier_rank(F.col("tier"))).cast("long"), 60) + F.shiftleft(F.col("fact_seq").cast("long"), 3) + code
    key = ("resource_type", "resource_id", "module_id")
    best = facts.select(*key, packed.alias("best")).repartition(min(PARTS, PARTS_EACH * max(1, facts.rdd.getNumPartitions())), *key).groupBy(*key).agg(F.min("best").alias("best"))
    names = F.array(*[F.lit(d) for d in DIRECTIONS])
    return best.select(
        "resource_type", "resource_id", "module_id", F.get(names, F.col("best").bitwiseAND(F.lit(7)).cast("int")).alias("direction"),
        (3 - F.shiftright("best", 60)).cast("int").alias("rank"),
    )


def coupling_of(metrics: DataFrame) -> DataFrame:
    """(module_id, coupling): the last value of the metric by seq, if metrics have one."""
    rows = metrics.filter("name = 'coupling'")
    last = F.max_by("value", "seq") if "seq" in metrics.columns else F.last("value")
    return rows.groupBy("module_id").agg(last.alias("coupling"))


def with_owner(members: DataFrame, owners: DataFrame, couplings: DataFrame) -> DataFrame:
    """Adds owner ('unknown' where there is none) and coupling (null where the module has no metric)."""
    return members.join(owners.select("module_id", "owner"), "module_id", "left").join(couplings, "module_id", "left").withColumn("owner", F.coalesce("owner", F.lit("unknown")))


# Fixed values in the two functions that make labels (here and in graph): the wording by which reports name a capability.
def label_of(dim: Column, rid: Column, n: Column, produces: Column, writes: Column, serves: Column) -> Column:
    return (
        F.when(dim == "messaging", F.concat(F.when(produces == n, "Publishes ").otherwise("Topic "), rid))
        .when(dim == "data", F.concat(F.when(writes == n, "Writes ").otherwise("Table "), rid))
        .when(dim == "column", F.concat(F.lit("Column "), rid))
        .when(dim == "api", F.concat(F.when(serves == n, "Serves ").otherwise("Endpoint "), rid))
        .otherwise(F.concat(dim, F.lit(":"), rid))
    )


def score(caps: DataFrame) -> DataFrame:
    """Adds coupling, play and opportunity to (dimension, n_members, n_owners, rank, mean_coupling, produces,
    writes, serves)."""
    dim = F.col("dimension")
    dup = (
        dim.isin("code", "functional") | ((dim == "messaging") & (F.col("produces") == F.col("n_members")))
        | (dim.isin("data", "column") & (F.col("writes") >= 2)) | ((dim == "api") & (F.col("serves") >= 2))
    )
    play = F.when(dup & (F.col("n_owners") == 1), "RETIRE").when(dup | (dim == "dependency"), "STANDARDIZE").otherwise("EXTRACT")
    coupling = half_even(F.col("mean_coupling"), 3)
    base = F.col("n_members") + F.when(dup, 2).otherwise(0)
    worth = base * (1 - F.coalesce(F.col("coupling"), F.lit(0.0))) * F.when(F.col("n_owners") > 1, 1.5).otherwise(1.0) * (F.col("rank") / 3)
    return caps.withColumn("coupling", coupling).withColumn("play", play).withColumn("opportunity", half_even(worth, 2))


_OUT = ("id", "dimension", "label", "n_members", "n_owners", "tier", "coupling", "play", "opportunity")


def _summed(members: DataFrame, *keys: str) -> DataFrame:
    """Aggregates over members (module_id, direction, rank, owner, coupling), one row for each key."""
    said = lambda d: F.count_if(F.col("direction") == d)
    return members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_members"), F.countDistinct("owner").alias("n_owners"), F.max("rank").alias("rank"), F.avg("coupling").alias("mean_coupling"),
        said("PRODUCES").alias("produces"), said("WRITES").alias("writes"), said("SERVES").alias("serves"),
    )


def resource_capabilities(facts: DataFrame, owners: DataFrame, couplings: DataFrame) -> DataFrame:
    """Resources that two or more modules touch."""
    sums = _summed(with_owner(strongest_touch(facts), owners, couplings), "resource_type", "resource_id").filter("n_members >= 2")
    caps = sums.withColumn("dimension", dimension(F.col("resource_type")))
    label = label_of(F.col("dimension"), F.col("resource_id"), F.col("n_members"), F.col("produces"), F.col("writes"), F.col("serves"))
    caps = caps.withColumns({"id": F.concat_ws(":", "dimension", "resource_id"), "label": label, "tier": tier_name(F.col("rank"))})
    return score(caps).select(*_OUT)


def pair_capabilities(pairs: DataFrame, kind: str, prefix: str, owners: DataFrame, couplings: DataFrame, max_size: int | None = None) -> DataFrame:
    """Components of pairs (a, b, tier), in one dimension; larger ones than max_size are taken for blobs.

    The component's smallest member stands for it in the id; its tier is its weakest pair's."""
    members = connected_components(pairs.select("a", "b")).withColumnsRenamed({"node": "module_id"})
    weakest = pairs.join(members, pairs.a == members.module_id).groupBy("root").agg(F.min(tier_rank(F.col("tier"))).alias("rank"))
    rows = with_owner(members.withColumn("direction", F.lit("SHARES")), owners, couplings).withColumn("rank", F.lit(0))
    sums = _summed(rows, "root").drop("rank").join(weakest, "root")
    if max_size is not None:
        sums = sums.filter(F.col("n_members") <= max_size)
    first = members.withColumn("nth", F.row_number().over(Window.partitionBy("root").orderBy("module_id"))).filter("nth <= 3")
    named = first.groupBy("root").agg(F.array_join(F.array_sort(F.collect_list(F.struct("nth", F.split_part("module_id", F.lit(":"), F.lit(1)).alias("n"))))["n"], ", ").alias("names"))
    caps = sums.join(named, "root").withColumns({"dimension": F.lit(kind), "id": F.concat(F.lit(f"{kind}:"), "root"), "label": F.concat(F.lit(f"{prefix} · "), "names"), "tier": tier_name(F.col("rank"))})
    return score(caps).select(*_OUT)


def library_of(purl: Column) -> Column:
    """The last segment of a package url, without its version."""
    return F.split_part(F.element_at(F.split(purl, "/"), -1), F.lit("@"), F.lit(1))


def dependency_capabilities(dependencies: DataFrame, owners: DataFrame, couplings: DataFrame) -> DataFrame:
    """Libraries of two or more modules of two or more owners."""
    used = dependencies.select("module_id", library_of(F.col("purl")).alias("name")).distinct()
    rows = with_owner(used.withColumns({"direction": F.lit("USES"), "rank": F.lit(3)}), owners, couplings)
    caps = _summed(rows, "name").filter("n_members >= 2 and n_owners >= 2")
    caps = caps.withColumns({"dimension": F.lit("dependency"), "id": F.concat(F.lit("dependency:"), "name"), "label": F.concat(F.lit("Shared library "), "name"), "tier": F.lit("HIGH")})
    return score(caps).select(*_OUT)


def ranked(caps: DataFrame) -> DataFrame:
    """By opportunity, then tier, then id."""
    return caps.orderBy(F.desc("opportunity"), F.desc(tier_rank(F.col("tier"))), "id")


def top_per_dimension(caps: DataFrame, k: int = 40) -> DataFrame:
    best = Window.partitionBy("dimension").orderBy(F.desc("opportunity"), F.desc(tier_rank(F.col("tier"))), "id")
    return caps.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= k)


def build_capabilities(facts: DataFrame, clone_pairs: DataFrame, semantic_pairs: DataFrame, dependencies: DataFrame, owners: DataFrame, couplings: DataFrame, functional_max_size: int = 6) -> DataFrame:
    """All four families."""
    clones = clone_pairs.select(F.col("module_a").alias("a"), F.col("module_b").alias("b"), "tier")
    return (
        resource_capabilities(facts, owners, couplings)
        .unionByName(pair_capabilities(clones, "code", "Code clone", owners, couplings))
        .unionByName(pair_capabilities(semantic_pairs, "functional", "Semantic duplicate", owners, couplings, functional_max_size))
        .unionByName(dependency_capabilities(dependencies, owners, couplings))
    )
