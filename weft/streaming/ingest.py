"""Runs kept up by a stream of changed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weft.plans import pipeline, tracking
from weft.plans.catalog import Catalog

#: A feed's rows: a file's new text, or null where it was deleted, numbered in the order of the changes.
CHANGE = "rel_path string, content string, seq bigint"


def followed(
    spark: SparkSession, feed: str, store: Catalog, checkpoint: str, then: Callable[[int, DataFrame, pipeline.Run], None] = lambda batch, states, run: None,
    config: pipeline.Config | None = None, files_per_batch: int = 64,
) -> StreamingQuery:
    """Applies a feed, a folder to which Parquet files of changes are added, to the store, all that is there by now.

    Each batch changes the store's files and is followed by an incremental run, so only projects that it changed are parsed;
    `then` gets the batch's number, the projects' states and the run. A batch that failed is done again from the
    same changes and leaves the same store."""
    rows = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_batch).parquet(feed)

    def apply(batch: DataFrame, number: int) -> None:
        tracking.changed_by(batch, store)
        then(number, *pipeline.incremental(spark, None, store, config))

    return rows.writeStream.foreachBatch(apply).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
