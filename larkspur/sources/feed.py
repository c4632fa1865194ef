"""The story feed as a Spark data source: ranked ids, and the items fetched by id in parallel partitions.

The feed is any base URL (``http://…/`` or ``file:/…/``) with ``topstories.json``, an array of ids in rank order,
and ``item/<id>.json``. Register with ``spark.dataSource.register(StoryFeed)``, then
``spark.read.format("story_feed").option("base_url", …).option("limit", 200).load()``. Read as a stream, every trigger
crawls the feed anew.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.parse import urljoin
from urllib.request import urlopen

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from larkspur.sources.schemas import FEED_ITEM


def _fetch(url: str, timeout: float) -> str:
    with urlopen(url, timeout=timeout) as answer:  # noqa: S310 - the caller names the feed
        return answer.read().decode("utf-8")


class _Ids(InputPartition):
    def __init__(self, ranked: list[tuple[int, int]]) -> None:
        self.ranked = ranked


class _Crawl:
    """How a crawl is split into partitions and read."""

    def __init__(self, options: dict[str, str]) -> None:
        self.base = options["base_url"].rstrip("/") + "/"
        self.limit = int(options.get("limit", 200))
        self.timeout = float(options.get("timeout", 10))
        self.parts = int(options.get("partitions", 8))

    def parts_of(self) -> list[InputPartition]:
        # A failure to read the list of ids fails the query; one item that cannot be read does not.
        ids = json.loads(_fetch(urljoin(self.base, "topstories.json"), self.timeout))[: self.limit]
        ranked = list(enumerate(ids))
        return [_Ids(ranked[k :: self.parts]) for k in range(self.parts) if ranked[k :: self.parts]]

    def read(self, partition: _Ids) -> Iterator[tuple]:
        for rank, item_id in partition.ranked:
            try:
                yield rank, item_id, _fetch(urljoin(self.base, f"item/{item_id}.json"), self.timeout)
            except Exception:  # noqa: BLE001 - whatever is wrong with one item, the others go on
                yield rank, item_id, None


class _Reader(_Crawl, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.parts_of()


class _StreamReader(_Crawl, DataSourceStreamReader):
    """Offsets are times, so there is always something new; a batch that is repeated after a failure crawls again."""

    def initialOffset(self) -> dict:
        return {"time": 0}

    def latestOffset(self) -> dict:
        return {"time": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.parts_of()

    def commit(self, end: dict) -> None:
        pass


class StoryFeed(DataSource):
    """Rows ``rank, item_id, body``: the raw JSON of each item, null where it could not be fetched."""

    @classmethod
    def name(cls) -> str:
        return "story_feed"

    def schema(self) -> str:
        return "rank int, item_id long, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def decode_items(bodies: DataFrame) -> DataFrame:
    """The items of raw JSON bodies: ``rank`` and the item's fields. Bodies that are null, malformed or without id are dropped."""
    decoded = bodies.withColumn("item", F.from_json("body", FEED_ITEM)).filter(F.col("item.id").isNotNull())
    return decoded.select("rank", "item.*")


def top_ids(items: DataFrame, limit: int = 200, rank: str = "score", id_col: str = "id") -> DataFrame:
    """``id, rank`` of the first ``limit`` items, ranked by descending ``rank`` column (nulls last), then id; an id counts once."""
    best = items.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(rank).alias("rank"))
    return best.orderBy(F.desc_nulls_last("rank"), "id").limit(limit)
