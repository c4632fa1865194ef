"""The search service: index, search, suggestions and reports over stored tables in one folder."""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.functions.lineage import cut
from larkspur.functions.text import preprocess_query
from larkspur.operators import hybrid, limits, paging, reports, result_cache, suggest, tfidf, vectors
from larkspur.operators.ingest import create_if_missing, keyword_filter, only_stories
from larkspur.sources.feed import StoryFeed, decode_items
from larkspur.sources.schemas import CACHED_PAGE, SEARCH_LOG, STORIES
from larkspur.streaming.reindex import ingest, start


@dataclass
class Page:
    """One page of a result; the same for hits and misses of the cache."""

    results: list[dict]
    page: int
    page_size: int
    total: int
    total_pages: int
    cache: str


class Engine:
    """Everything is kept under ``root``: stories, search log, cached pages and the index tables derived from the stories.

    An index is written as a new version beside the last one and takes its place when it is whole, so searches never see
    half of one. Stories that are stored already are indexed at the start.
    """

    def __init__(
        self, spark: SparkSession, root: str, embedder: vectors.Embedder | None = None, limiter: limits.Limiter | None = None
    ) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.embedder = embedder or vectors.HashingEmbedder()
        self.limiter = limiter or limits.Limiter()
        for name, schema in (("stories", STORIES), ("log", SEARCH_LOG), ("cache", CACHED_PAGE)):
            create_if_missing(spark, f"{self.root}/{name}", schema)
        if self._version() is None and self._read("stories", STORIES).limit(1).count():
            self.build()

    def _folder(self, name: str):
        """A folder under the root, and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        """The whole versions of the index, the latest last: a version is whole once its mark is there."""
        path, files = self._folder("index")
        names = sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []
        return [n.removesuffix(".whole") for n in names if n.endswith(".whole")]

    def _version(self) -> str | None:
        return (self._versions() or [None])[-1]

    def _index(self, name: str) -> DataFrame:
        version = self._version()
        if version is None:
            raise LookupError("nothing is indexed yet")
        return self._read(f"index/{version}/{name}")

    def _read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.root}/{name}")

    def stories(self) -> DataFrame:
        """The stored stories."""
        return tfidf.corpus(self._read("stories", STORIES))

    def crawl(self, base_url: str, limit: int = 200, keyword: str | None = None) -> DataFrame:
        """The feed's top items, with ``rank`` as their order; fetched once."""
        self.spark.dataSource.register(StoryFeed)
        bodies = self.spark.read.format("story_feed").options(base_url=base_url, limit=str(limit)).load()
        return cut(keyword_filter(decode_items(bodies), keyword))

    def reindex(self, base_url: str, limit: int = 200, rebuild: bool = False) -> str:
        """Crawl the feed, store what is new and flush the cache; the index follows at the next start, or now if asked for."""
        items = self.crawl(base_url, limit)
        ingest(self.spark, items, f"{self.root}/stories", "rank", self.flush)
        if rebuild:
            self.build()
        return f"Reindexed {only_stories(items).count()} stories"

    def start_reindexing(self, base_url: str, checkpoint: str, every: str | None = "1 hour", limit: int = 200) -> StreamingQuery:
        """Crawl the feed every so often (``None``: once) and store what is new, in the background."""
        self.spark.dataSource.register(StoryFeed)
        bodies = self.spark.readStream.format("story_feed").options(base_url=base_url, limit=str(limit)).load()
        return start(decode_items(bodies), f"{self.root}/stories", checkpoint, every, "rank", self.flush)

    def index(self, items: DataFrame, order: str = "rank", corpus: str = "stored") -> str:
        """Store the new stories among crawled items, flush the cache and rebuild the index.

        The index is of all stored stories, or with ``corpus="latest"`` of those of this crawl only.
        """
        if corpus not in ("stored", "latest"):
            raise ValueError(f"corpus must be stored or latest, not {corpus}")
        n = ingest(self.spark, items, f"{self.root}/stories", order, self.flush)
        stored = self.stories()
        self.build(stored if corpus == "stored" else stored.join(items.select("id").distinct(), "id", "left_semi"))
        return f"Indexed {n} new stories"

    def build(self, stories: DataFrame | None = None) -> None:
        """Write a version of the index tables: the ids searched, unit weights clustered by term, terms, vectors and the words of
        titles. The version before stays for searches that have begun; older ones are removed."""
        stories = self.stories() if stories is None else stories
        version = f"{time.time_ns():020d}"
        folder = f"{self.root}/index/{version}"
        stories.select("id").write.parquet(f"{folder}/indexed")
        built = tfidf.TfIdfIndex(stories)
        built.weights().repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/weights")
        built.terms.write.parquet(f"{folder}/terms")
        vectors.embed(stories, self.embedder).write.parquet(f"{folder}/vectors")
        words = suggest.vocabulary(stories)
        words.repartitionByRange("word").sortWithinPartitions("word").write.parquet(f"{folder}/words")
        mark, files = self._folder(f"index/{version}.whole")
        files.create(mark).close()
        for old in self._versions()[:-2]:
            for name in (f"index/{old}.whole", f"index/{old}"):
                files.delete(self._folder(name)[0], True)

    def ranked(self, q: str) -> DataFrame:
        """The fused candidates of a query, in order: ``id, final_score, place``."""
        index = tfidf.TfIdfIndex(self._index("indexed"), n_documents=0)
        index.terms = self._index("terms")
        sparse = index.top(preprocess_query(q), hybrid.CANDIDATES, self._index("weights"))
        dense = vectors.top(self._index("vectors"), self.embedder.encode([q])[0], hybrid.CANDIDATES)
        return hybrid.ordered(hybrid.fuse(hybrid.candidates(sparse, dense)))

    def search(self, q: str, page: int = 1, page_size: int = 5, client: str | None = None) -> Page:
        """One page; a cached page is returned as it was stored and not logged. Raises ``limits.TooManyRequests`` for a ``client``
        that asks too often; without a client, no limit holds."""
        if client is not None:
            self.limiter.check(client, time.time())
        last = paging.depth(page, page_size)
        cached = result_cache.lookup(self._read("cache", CACHED_PAGE), q, page, page_size, F.current_timestamp()).first()
        if cached is not None:
            return Page(**json.loads(cached["value"]), cache="hit")
        best = self.ranked(q).filter(F.col("place") <= last)
        rows = best.join(self.stories(), "id").select("place", "id", "title", "text", "url", F.col("final_score").alias("score"))
        # At most twice as many rows as a ranker gives candidates.
        found = [r.asDict() for r in rows.orderBy("place").collect()]
        total = len(found)
        results = [{k: v for k, v in r.items() if k != "place"} for r in found[last - page_size : last]]
        answer = Page(results, page, page_size, total, math.ceil(total / page_size), "miss")
        self._log(q, total)
        self._put(q, page, page_size, answer)
        return answer

    def _log(self, q: str, total: int) -> None:
        row = self.spark.createDataFrame([(uuid.uuid4().int >> 65, q, total)], "id long, query string, results_count int")
        row.withColumn("timestamp", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def _put(self, q: str, page: int, page_size: int, answer: Page) -> None:
        value = json.dumps({k: v for k, v in answer.__dict__.items() if k != "cache"})
        row = self.spark.createDataFrame([(q, page, page_size, value)], "q string, page int, page_size int, value string")
        result_cache.put(row, F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/cache")

    def flush(self) -> None:
        """Drop all cached pages; nothing else."""
        self.spark.createDataFrame([], CACHED_PAGE).write.mode("overwrite").parquet(f"{self.root}/cache")

    def autocomplete(self, q: str, limit: int = 10) -> list[str]:
        """The first words that start with ``q``."""
        return [r.word for r in suggest.suggest(self._index("words"), q, limit).orderBy("key").collect()]

    def top_searches(self) -> DataFrame:
        return reports.top_searches(self._read("log", SEARCH_LOG))

    def zero_searches(self) -> DataFrame:
        return reports.zero_searches(self._read("log", SEARCH_LOG))
