"""The store's copy of a portfolio's files, kept up by what has changed: by listing a folder, or by a feed of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.plans.catalog import Catalog
from weft.plans.durable import counted, durable, forget
from weft.sources import files


def shaped(rows: DataFrame) -> DataFrame:
    """Rows (rel_path, content, and suffix, modified and size where known) as the store has them."""
    have = set(rows.columns)
    known = lambda c: F.col(c) if c in have else F.lit(None).cast("bigint")
    return rows.select(
        "rel_path", files.parent(F.col("rel_path")).alias("folder"), files.suffix(F.col("rel_path")).alias("suffix"), known("modified").alias("modified"), known("size").alias("size"),
        F.sha2(F.col("content").cast("binary"), 256).alias("digest"), "content",
    )


def refreshed(spark: SparkSession, root: str, store: Catalog) -> tuple[int, int]:
    """Brings the store's files up to those under root; how many were opened, and how many left.

    A file is opened only if the store does not have it with its time of change and its size. Times are those of the
    listing, so a file that changes while it is read is read again by the next call; so are the files of a call that failed."""
    now = durable(files.walk(spark, root))
    had = store.read("files").select("rel_path", "folder", F.col("modified").alias("was"), F.col("size").alias("had"))
    both = now.join(had, "rel_path", "full").filter(~(F.col("modified").eqNullSafe(F.col("was")) & F.col("size").eqNullSafe(F.col("had"))))
    changes = durable(both)
    n_gone = changes.filter("modified is null").count()
    fresh, n_open = counted(shaped(files.opened(changes.filter("modified is not null"), root)), F.count(F.lit(1)))
    store.exchange("files", fresh, changes.filter("modified is null").select("rel_path", "folder"))
    forget(now, changes, fresh)
    return n_open, n_gone


def changed_by(rows: DataFrame, store: Catalog) -> None:
    """Applies changes (rel_path, content, seq) to the store's files: the one with the highest seq of a path stands, and null as
    content takes the file out. Ignored folders are passed over. The same changes once more change nothing."""
    rows = rows.filter(~files.is_ignored(F.col("rel_path")))
    last = rows.groupBy("rel_path").agg(F.max_by(F.struct("content"), F.struct("seq", "content")).alias("_last")).select("rel_path", "_last.content")
    held = durable(last)
    store.exchange("files", shaped(held.filter("content is not null")), held.filter("content is null").select("rel_path", files.parent(F.col("rel_path")).alias("folder")))
    forget(held)
