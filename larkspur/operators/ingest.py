"""From crawled items to stored stories and the search log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspur.functions.text import preprocess


def only_stories(items: DataFrame) -> DataFrame:
    """Items that are whole stories: of type ``story``, with id, title and score; the rest is dropped."""
    return items.filter((F.col("type") == "story") & F.col("id").isNotNull() & F.col("title").isNotNull() & F.col("score").isNotNull())


def story_text(title: str = "title", body: str = "text") -> Column:
    """Title, a space and the body, HTML kept; a missing body is empty, so the space always follows the title."""
    return F.concat(F.col(title), F.lit(" "), F.coalesce(F.col(body), F.lit("")))


def project_stories(items: DataFrame, *keep: str) -> DataFrame:
    """``id, title, text, url, score`` (and the columns ``keep``) of items; a missing url becomes empty."""
    url = F.coalesce(F.col("url"), F.lit("")).alias("url")
    return items.select("id", "title", story_text().alias("text"), url, "score", *keep)


def keyword_filter(stories: DataFrame, keyword: str | None) -> DataFrame:
    """Stories whose title holds the keyword, letter case ignored; ``%`` and ``_`` are literal. No keyword keeps all."""
    if not keyword:
        return stories
    return stories.filter(F.contains(F.lower("title"), F.lit(keyword.lower())))


def with_preprocessed_text(stories: DataFrame) -> DataFrame:
    """Stories with ``preprocessed_text`` added."""
    return stories.withColumn("preprocessed_text", preprocess(F.col("text")))


def insert_if_absent(stored: DataFrame, crawled: DataFrame, order: str) -> DataFrame:
    """The crawled rows to append: of each id not stored, the first by ``order``. Stored rows are never updated.

    Null ids are never stored; rows without an order come last. Ids and orders alone tell which rows are new: repeated ids
    are combined before they are shuffled, and whole rows are fetched only for those, by id and order. Of several rows
    with one id and order the smallest is taken.
    """
    columns = [c for c in crawled.columns if c not in ("id", order)]
    firsts = crawled.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(order).alias("first"))
    fresh = firsts.join(stored.select("id").distinct(), "id", "left_anti").withColumnRenamed("id", "new")
    whole = crawled.join(fresh, (F.col("id") == F.col("new")) & F.col(order).eqNullSafe(F.col("first")))
    return whole.groupBy("id").agg(F.min(F.struct(*columns)).alias("row")).select("id", "row.*")


def log_rows(searches: DataFrame) -> DataFrame:
    """Search-log rows of executed searches (``q, total``): ``query, results_count, timestamp`` (now)."""
    return searches.select(F.col("q").alias("query"), F.col("total").cast("int").alias("results_count"), F.current_timestamp().alias("timestamp"))


def create_if_missing(spark: SparkSession, path: str, schema: StructType) -> None:
    """An empty table of the given schema at ``path``, unless something is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        spark.createDataFrame([], schema).write.parquet(path)
