"""The evidence graph: edges between modules that share a resource or code, and its clusters across dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.numbers import half_even
from weft.operators.capability import strongest_touch
from weft.operators.components import connected_components
from weft.plans.durable import durable
from weft.schema import tier_name, tier_rank

DUPLICATES = ("DUP_PRODUCER", "DUP_WRITER", "DUP_ENDPOINT")


def edge_type(kind: Column, one: Column, two: Column) -> Column:
    both = lambda d: (one == d) & (two == d)
    return (
        F.when((kind == "KAFKA_TOPIC") & both("PRODUCES"), "DUP_PRODUCER").when((kind == "SQL_TABLE") & both("WRITES"), "DUP_WRITER")
        .when((kind == "HTTP_ENDPOINT") & both("SERVES"), "DUP_ENDPOINT").otherwise("SHARES_RESOURCE")
    )


def shared_edges(facts: DataFrame) -> DataFrame:
    """(a, b, type, resource_type, resource_id, tier) for each pair a < b of modules on a resource.

    All pairs of a resource's modules are the result here; clusters() does not need them."""
    one = strongest_touch(facts)
    two = one.select("resource_type", "resource_id", F.col("module_id").alias("b"), F.col("direction").alias("d2"), F.col("rank").alias("r2"))
    joined = one.withColumnRenamed("module_id", "a").join(two, ["resource_type", "resource_id"]).filter("a < b")
    return joined.select("a", "b", edge_type(F.col("resource_type"), F.col("direction"), F.col("d2")).alias("type"), "resource_type", "resource_id", tier_name(F.least("rank", "r2")).alias("tier"))


def edge_counts(facts: DataFrame) -> DataFrame:
    """(type, tier, n): how many edges shared_edges has of each, counted without making one.

    Of a resource's n modules at or above a rank n * (n - 1) / 2 pairs have that rank at least; so too among those of
    the direction in which two modules duplicate each other."""
    touch = strongest_touch(facts)
    kinds = {"KAFKA_TOPIC": ("PRODUCES", "DUP_PRODUCER"), "SQL_TABLE": ("WRITES", "DUP_WRITER"), "HTTP_ENDPOINT": ("SERVES", "DUP_ENDPOINT")}
    name, same = F.lit(None).cast("string"), F.lit(False)
    for kind, (direction, found) in kinds.items():
        name = F.when(F.col("resource_type") == kind, found).otherwise(name)
        same = same | ((F.col("resource_type") == kind) & (F.col("direction") == direction))
    per = touch.groupBy("resource_type", "resource_id").agg(*(F.count_if(F.col("rank") >= r).alias(f"all_{r}") for r in (1, 2, 3)), *(F.count_if(same & (F.col("rank") >= r)).alias(f"dup_{r}") for r in (1, 2, 3)))
    pairs = lambda c: (F.col(c) * (F.col(c) - 1) / 2).cast("long")
    of = lambda what, r: pairs(f"{what}_{r}") - (pairs(f"{what}_{r + 1}") if r < 3 else F.lit(0))
    rows = [F.struct(t.alias("type"), tier_name(F.lit(r)).alias("tier"), n.alias("n")) for r in (1, 2, 3) for t, n in ((name, of("dup", r)), (F.lit("SHARES_RESOURCE"), of("all", r) - of("dup", r)))]
    return per.select(F.inline(F.array(*rows))).filter("n > 0").groupBy("type", "tier").agg(F.sum("n").alias("n"))


def stars(facts: DataFrame) -> DataFrame:
    """(a, b): each module of a resource with the resource's smallest. The components are those of shared_edges, without its pairs."""
    touch = facts.select("resource_type", "resource_id", "module_id").distinct()
    hub = touch.groupBy("resource_type", "resource_id").agg(F.min("module_id").alias("a"))
    return touch.join(hub, ["resource_type", "resource_id"]).filter("a <> module_id").select("a", F.col("module_id").alias("b"))


def clone_edges(pairs: DataFrame) -> DataFrame:
    kind = F.col("clone_type").cast("string")
    return pairs.select(
        F.col("module_a").alias("a"), F.col("module_b").alias("b"), F.concat(F.lit("CLONE_TYPE_"), kind).alias("type"), F.lit("CODE_CLONE").alias("resource_type"),
        F.concat(F.lit("clone(T"), kind, F.lit(")")).alias("resource_id"), "tier",
    )


def ranked(clusters: DataFrame) -> DataFrame:
    """Clusters by opportunity, then tier, then id."""
    return clusters.orderBy(F.desc("opportunity"), F.desc(tier_rank(F.col("tier"))), "id")


def clusters(facts: DataFrame, clone_pairs: DataFrame, owners: DataFrame, couplings: DataFrame) -> DataFrame:
    return clusters_and_members(facts, clone_pairs, owners, couplings)[0]


def clusters_and_members(facts: DataFrame, clone_pairs: DataFrame, owners: DataFrame, couplings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of the whole graph, scored: (id, n_members, n_owners, n_shared, tier, score, coupling,
    opportunity, play, label), id being the smallest member.

    A resource joins its modules as a star around the smallest, so no pairs are made. What the pairs would
    say is counted instead: a duplicate is two modules in the duplicating direction, and a pair's tier is
    its weaker end's, so a resource's best pair has the tier of its second strongest module. Also (module_id, id)."""
    touch = durable(strongest_touch(facts))  # read for resources and for stars
    first = durable(touch.groupBy("resource_type", "resource_id").agg(
        F.min("module_id").alias("hub"), F.count(F.lit(1)).alias("n"),
        *(F.count_if((F.col("direction") == d) & (F.col("resource_type") == k)).alias(f"n_{d}") for d, k in (("PRODUCES", "KAFKA_TOPIC"), ("WRITES", "SQL_TABLE"), ("SERVES", "HTTP_ENDPOINT"))),
        *(F.count_if(F.col("rank") >= r).alias(f"at_{r}") for r in (3, 2)),
    ).filter("n >= 2"))
    star = touch.join(first.select("resource_type", "resource_id", "hub"), ["resource_type", "resource_id"]).select(F.col("hub").alias("a"), F.col("module_id").alias("b"))
    copies = clone_edges(clone_pairs)
    members = connected_components(star.unionByName(copies.select("a", "b"))).withColumnsRenamed({"node": "module_id", "root": "id"})
    of = members.withColumnsRenamed({"module_id": "hub"})
    pair_rank = F.when(F.col("at_3") >= 2, 3).when(F.col("at_2") >= 2, 2).otherwise(1)
    kind = F.when(F.col("n_PRODUCES") >= 2, "DUP_PRODUCER").when(F.col("n_WRITES") >= 2, "DUP_WRITER").when(F.col("n_SERVES") >= 2, "DUP_ENDPOINT")
    evidence = first.join(of, "hub").select("id", "resource_type", "resource_id", pair_rank.alias("rank"), kind.alias("kind")).unionByName(
        copies.join(of, copies.a == of.hub).select("id", "resource_type", "resource_id", tier_rank(F.col("tier")).alias("rank"), F.lit("CLONE").alias("kind"))
    )
    best = lambda k: F.min(F.when(F.col("kind") == k, F.col("resource_id")))
    shared = evidence.groupBy("id").agg(
        F.countDistinct("resource_type", "resource_id").alias("n_shared"), F.max("rank").alias("rank"), F.coalesce(F.bool_or(F.col("kind") != "CLONE"), F.lit(False)).alias("dup"),
        best("CLONE").alias("clone"), best("DUP_PRODUCER").alias("producer"), best("DUP_WRITER").alias("writer"), best("DUP_ENDPOINT").alias("endpoint"), F.min(F.struct("resource_type", "resource_id")).alias("some"),
    )
    sums = members.join(owners.select("module_id", "owner"), "module_id", "left").join(couplings, "module_id", "left").groupBy("id").agg(
        F.count(F.lit(1)).alias("n_members"), F.countDistinct(F.coalesce("owner", F.lit("unknown"))).alias("n_owners"), half_even(F.avg("coupling"), 3).alias("coupling")
    )
    worth = F.col("n_shared") * F.col("n_members") + F.when(F.col("dup"), 2).otherwise(0)
    alike = F.col("dup") | F.col("clone").isNotNull()
    noun = F.create_map(*[F.lit(x) for x in ("KAFKA_TOPIC", "topic", "SQL_TABLE", "table", "SQL_COLUMN", "column", "HTTP_ENDPOINT", "endpoint")])
    label = F.coalesce(
        F.concat(F.lit("Code clone · "), "clone"), F.concat(F.lit("Publishes event · "), "producer"), F.concat(F.lit("Writes table · "), "writer"), F.concat(F.lit("Duplicate API · "), "endpoint"),
        F.concat(F.lit("Shares "), F.coalesce(F.try_element_at(noun, F.col("some.resource_type")), F.lit("resource")), F.lit(" · "), F.col("some.resource_id")),
    )
    scored = sums.join(shared, "id").withColumn("score", worth).select(
        "id", "n_members", "n_owners", "n_shared", tier_name(F.col("rank")).alias("tier"), "score", "coupling",
        half_even(F.col("score") * (1 - F.coalesce("coupling", F.lit(0.0))), 2).alias("opportunity"),
        F.when(alike & (F.col("n_owners") == 1), "RETIRE").when(alike, "STANDARDIZE").otherwise("EXTRACT").alias("play"), label.alias("label"),
    )
    return scored, members


def promoted(confirmed: DataFrame, members: DataFrame, couplings: DataFrame) -> DataFrame:
    """Confirmed pairs (a, b, tier, play) that no cluster holds already, as clusters of two.

    members (module_id, id) says which cluster a module is in: a pair is held if both are in one."""
    pairs = confirmed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "tier", "play").dropDuplicates(["a", "b"])
    at = lambda c: members.select(F.col("module_id").alias(c), F.col("id").alias(f"in_{c}"))
    free = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").filter("in_a is null or in_b is null or in_a <> in_b")
    of = lambda c: couplings.select(F.col("module_id").alias(c), F.col("coupling").alias(f"coupling_{c}"))
    mean = F.when(F.col("coupling_a").isNull(), F.col("coupling_b")).when(F.col("coupling_b").isNull(), F.col("coupling_a")).otherwise((F.col("coupling_a") + F.col("coupling_b")) / 2)
    name = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    return free.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumn("coupling", half_even(mean, 3)).select(
        "a", "b", "tier", F.lit(4).alias("score"), "coupling", half_even(4 * (1 - F.coalesce("coupling", F.lit(0.0))), 2).alias("opportunity"), "play",
        F.concat(F.lit("Semantic duplicate · "), name("a"), F.lit(" & "), name("b")).alias("label"),
    )
