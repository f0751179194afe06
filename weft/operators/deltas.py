"""Shared resources kept up by what has changed: counts that facts can be added to and taken from.

Two tables are kept. `touches` has a row for each module that touches a resource: its facts by tier. `shared` has
a row for each resource: its modules and facts. Both are sums, so removed facts count as minus one; a night's work reads
the facts that came and went, and of the tables only the rows of resources that these name are changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.plans.durable import durable
from weft.schema import DIRECTIONS, TIERS

RESOURCE = ["resource_type", "resource_id"]
#: What is counted for a module at a resource.
COUNTS = ["n_facts", *(f"n_{t.lower()}" for t in TIERS), *(f"n_{d.lower()}" for d in DIRECTIONS)]


def touches(facts: DataFrame, sign: int = 1) -> DataFrame:
    """(resource_type, resource_id, module_id, and COUNTS) of facts; with sign -1, of facts that are taken away."""
    of = lambda column, value: F.sum(F.when(F.col(column) == value, sign).otherwise(0))
    counts = [F.sum(F.lit(sign)), *(of("tier", t) for t in TIERS), *(of("direction", d) for d in DIRECTIONS)]
    return facts.groupBy(*RESOURCE, "module_id").agg(*(c.alias(n) for c, n in zip(counts, COUNTS, strict=True)))


def shared(held: DataFrame) -> DataFrame:
    """(resource_type, resource_id, n_modules, and COUNTS) from touches."""
    return held.groupBy(*RESOURCE).agg(F.count(F.lit(1)).alias("n_modules"), *(F.sum(c).alias(c) for c in COUNTS))


def changes(added: DataFrame, removed: DataFrame) -> DataFrame:
    """touches of both, removed facts counted as minus one, without the rows that come to nothing."""
    both = touches(added).unionByName(touches(removed, -1)).groupBy(*RESOURCE, "module_id").agg(*(F.sum(c).alias(c) for c in COUNTS))
    return both.filter(" or ".join(f"{c} <> 0" for c in COUNTS))


def _with(held: DataFrame, more: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """held with the sums of more added, rows of more that held lacks included."""
    own = more.select(*keys, *(F.col(c).alias(f"_{c}") for c in sums))
    both = held.join(own, keys, "full")
    return both.select(*keys, *((F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums))


def applied(held: DataFrame, totals: DataFrame, added: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(touches, shared) after facts have come and gone, from those before. Rows that come to no facts go.

    Facts that are removed must be among those counted; the same fact may come and go in one call."""
    delta = durable(changes(added, removed))
    was = held.join(delta.select(*RESOURCE, "module_id"), [*RESOURCE, "module_id"], "left_semi").select(*RESOURCE, "module_id", F.col("n_facts").alias("_was"))
    # a module joins a resource with its first fact and leaves with its last
    before = F.coalesce("_was", F.lit(0))
    step = (before + F.col("n_facts") > 0).cast("long") - (before > 0).cast("long")
    by_resource = delta.join(was, [*RESOURCE, "module_id"], "left").withColumn("n_modules", step).groupBy(*RESOURCE).agg(*(F.sum(c).alias(c) for c in ["n_modules", *COUNTS]))
    return _with(held, delta, [*RESOURCE, "module_id"], COUNTS).filter("n_facts > 0"), _with(totals, by_resource, RESOURCE, ["n_modules", *COUNTS]).filter("n_modules > 0")


def best_tier(totals: DataFrame) -> DataFrame:
    """totals with `tier`, the best of a resource's facts, and shared resources only (two modules or more)."""
    tier = F.when(F.col("n_high") > 0, "HIGH").when(F.col("n_med") > 0, "MED").otherwise("LOW")
    return totals.filter("n_modules > 1").withColumn("tier", tier)
