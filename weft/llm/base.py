"""What several operators need: input tables, names that do not clash, small expressions."""

from __future__ import annotations

import gc
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.plans.durable import durable, forget  # noqa: F401  for the operators

#: A word everywhere in this package: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (f"{name}_{i}" if i else name for i in count()) if x.lower() not in taken)


def released(spark: SparkSession) -> None:
    """Lets go of what the driver holds of finished queries. Their broadcasts and shuffles are only cleaned up once
    collections have found the plans gone, first in Python, then in the JVM; Spark itself sees to that twice an hour."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def running(lengths: Column, step: int = 64) -> Column:
    """For each number of an array the sum of those before it.

    Sums whole steps first, so that n numbers take about n * step + (n / step)^2 additions and no
    growing array is copied."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.size(lengths)

    def placed(steps):
        before = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda c: total(F.slice(steps, F.lit(1), c)))
        return let(before, lambda b: F.transform(lengths, lambda x, i: F.get(b, F.floor(i / step).cast("int")) + total(F.slice(lengths, F.floor(i / step).cast("int") * step + 1, i % step))))

    steps = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda c: total(F.slice(lengths, c * step + 1, F.lit(step))))
    return F.when(n > 0, let(steps, placed)).otherwise(F.array().cast("array<bigint>"))
