"""Reports on the search log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.paging import date_label


def once(log: DataFrame) -> DataFrame:
    """The log without rows delivered twice (all columns equal)."""
    return log.select("id", "query", "results_count", "timestamp").distinct()


def top_searches(log: DataFrame, limit: int = 10) -> DataFrame:
    """``label, query, count``: the most frequent queries, as spelled; a null query counts 0; ties by query."""
    counted = log.groupBy("query").agg(F.count("query").alias("count"))
    best = counted.orderBy(F.desc("count"), F.asc_nulls_last("query")).limit(limit)
    # The window is over the ``limit`` rows of the report.
    place = F.row_number().over(Window.orderBy(F.desc("count"), F.asc_nulls_last("query")))
    return best.select(F.concat(F.lit("#"), place.cast("string")).alias("label"), "query", "count")


def zero_searches(log: DataFrame, limit: int = 20) -> DataFrame:
    """``query, timestamp, date``: the latest searches without a result, repeats kept; null times first, ties by id."""
    empty = log.filter(F.col("results_count") == 0)
    latest = empty.orderBy(F.desc_nulls_first("timestamp"), F.desc("id")).limit(limit)
    return latest.select("query", "timestamp", date_label(F.col("timestamp")).alias("date"))
