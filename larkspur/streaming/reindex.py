"""Periodic and on-demand ingestion of newly crawled items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from larkspur.operators.ingest import create_if_missing, insert_if_absent, only_stories, project_stories, with_preprocessed_text
from larkspur.sources.schemas import STORIES


def ingest(spark: SparkSession, items: DataFrame, stories_path: str, order: str = "arrival_no", flush: Callable[[], None] | None = None) -> int:
    """Store the new stories among ``items``; returns how many. Then flush the cache.

    The rows to append are cut from the stored table before it is written to.
    """
    create_if_missing(spark, stories_path, STORIES)
    stored = spark.read.schema(STORIES).parquet(stories_path)
    fresh = with_preprocessed_text(insert_if_absent(stored, project_stories(only_stories(items), order), order))
    columns = [f.name for f in STORIES.fields]
    rows = fresh.select(*columns).persist()
    try:
        n = rows.count()
        if n:
            rows.write.mode("append").parquet(stories_path)
    finally:
        rows.unpersist()
    if flush:
        flush()
    return n


def start(
    items: DataFrame,
    stories_path: str,
    checkpoint: str,
    every: str | None = "1 hour",
    order: str = "arrival_no",
    flush: Callable[[], None] | None = None,
) -> StreamingQuery:
    """Ingest a stream of crawled items every so often; with ``every=None``, once, all there is now."""

    def one(batch: DataFrame, _: int) -> None:
        ingest(batch.sparkSession, batch, stories_path, order, flush)

    writer = items.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
