"""The named queries of the core, over whole tables, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.functions.stem import stem
from larkspur.operators import hybrid, ingest, limits, paging, reports, result_cache, suggest, tfidf, vectors
from larkspur.plans.oracle import QUERY, oracle_sql
from larkspur.sources.feed import top_ids
from larkspur.sources.tables import table

__all__ = ["oracle_sql", "queries"]

_Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, _Query] = {}


def _query(f: _Query) -> _Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, _Query]:
    return dict(_QUERIES)


def _stories(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.corpus(table(spark, d, "stories"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return reports.once(table(spark, d, "search_analytics"))


def _query_vector(usable: DataFrame) -> list[float]:
    """The query of the dense ranker here: the first stored vector that is not zero."""
    nonzero = F.exists("embedding", lambda x: x != 0)
    first = usable.filter(nonzero).agg(F.min_by("embedding", "id").alias("v")).first()
    return list(first["v"] or [])


# --- sources and mutations


@_query
def source_top_ids(spark: SparkSession, d: str) -> DataFrame:
    return top_ids(table(spark, d, "crawl_items"))


@_query
def source_story_filter(spark: SparkSession, d: str) -> DataFrame:
    return ingest.only_stories(table(spark, d, "crawl_items")).select("arrival_no", "id", "title", "score")


@_query
def story_projection(spark: SparkSession, d: str) -> DataFrame:
    return ingest.project_stories(ingest.only_stories(table(spark, d, "crawl_items")), "arrival_no")


@_query
def keyword_filter(spark: SparkSession, d: str) -> DataFrame:
    return ingest.keyword_filter(_stories(spark, d), "Database").select("id", "title")


@_query
def scan_stories(spark: SparkSession, d: str) -> DataFrame:
    return _stories(spark, d)


@_query
def json_decode(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@_query
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    crawled = ingest.project_stories(ingest.only_stories(table(spark, d, "crawl_items")), "arrival_no")
    return ingest.insert_if_absent(table(spark, d, "stories"), crawled, "arrival_no")


@_query
def insert_meta(spark: SparkSession, d: str) -> DataFrame:
    return insert_if_absent(spark, d).agg(F.count(F.lit(1)).alias("n_stories"))


@_query
def search_log_append(spark: SparkSession, d: str) -> DataFrame:
    misses = result_cache.outcomes(table(spark, d, "search_requests")).filter("outcome = 'miss'")
    total = F.least(F.col("page") * F.col("page_size"), F.lit(2 * hybrid.CANDIDATES))
    return ingest.log_rows(misses.withColumn("total", total)).drop("timestamp")


# --- text


@_query
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("normalized"))


@_query
def text_tokenize(spark: SparkSession, d: str) -> DataFrame:
    tokens = text.tokenize(text.normalize(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.array_join(tokens, "|").alias("tokens"), F.size(tokens).cast("long").alias("n_tokens"))


@_query
def stopword_removal(spark: SparkSession, d: str) -> DataFrame:
    kept = text.content_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.array_join(kept, " ").alias("kept"))


@_query
def stem_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(text.content_tokens(F.col("text"))).alias("word")).distinct()
    stems = F.pandas_udf(lambda column: column.map(stem), "string")
    return words.select("word", stems("word").alias("stem"))


@_query
def preprocess_text(spark: SparkSession, d: str) -> DataFrame:
    stories = table(spark, d, "stories").filter("id IS NOT NULL").select("id", "text").distinct()
    return stories.select("id", text.preprocess(F.col("text")).alias("preprocessed_text"))


@_query
def preprocess_stored(spark: SparkSession, d: str) -> DataFrame:
    """The chain recomputed for the stories that have a stored result, to compare with it."""
    stories = table(spark, d, "stories").filter("id IS NOT NULL AND preprocessed_text IS NOT NULL").select("id", "text").distinct()
    return stories.select("id", text.preprocess(F.col("text")).alias("preprocessed_text"))


# --- ranking


@_query
def tfidf_idf(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.TfIdfIndex(_stories(spark, d)).terms.select("term", "df", F.round("idf", 8).alias("idf"))


@_query
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.TfIdfIndex(_stories(spark, d)).weights().select("id", "term", F.round("weight", 8).alias("weight"))


@_query
def tfidf_scores(spark: SparkSession, d: str) -> DataFrame:
    found = tfidf.TfIdfIndex(_stories(spark, d)).scores(text.preprocess_query(QUERY))
    return found.select("id", F.round("score", 8).alias("score"))


def _tfidf_top(spark: SparkSession, d: str, k: int) -> DataFrame:
    return tfidf.TfIdfIndex(_stories(spark, d)).top(text.preprocess_query(QUERY), k)


@_query
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return _tfidf_top(spark, d, 10).select("id", F.round("score", 8).alias("score"))


@_query
def vector_scan(spark: SparkSession, d: str) -> DataFrame:
    found = vectors.usable(table(spark, d, "story_vectors"))
    return found.groupBy("id").agg(F.max(F.size("embedding")).cast("long").alias("n_values"))


@_query
def vector_scores(spark: SparkSession, d: str) -> DataFrame:
    usable = vectors.usable(table(spark, d, "story_vectors"))
    return vectors.scores(usable, _query_vector(usable)).select("id", F.round("score", 6).alias("score"))


def _vector_top(spark: SparkSession, d: str, k: int) -> DataFrame:
    usable = vectors.usable(table(spark, d, "story_vectors"))
    return vectors.top(usable, _query_vector(usable), k)


@_query
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _vector_top(spark, d, 10).select("id", F.round("score", 6).alias("score"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.candidates(_tfidf_top(spark, d, hybrid.CANDIDATES), _vector_top(spark, d, hybrid.CANDIDATES))


@_query
def hybrid_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select(
        "id", F.round("tfidf_score", 6).alias("tfidf_score"), F.round("vector_score", 6).alias("vector_score"),
        F.col("tfidf_rank").cast("long").alias("tfidf_rank"), F.col("vector_rank").cast("long").alias("vector_rank"),
    )


@_query
def hybrid_scores(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.fuse(_candidates(spark, d)).select("id", F.round("final_score", 6).alias("final_score"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.ordered(hybrid.fuse(_candidates(spark, d)))


@_query
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    best = _ranked(spark, d).filter(F.col("place") <= 10)
    return best.select(F.col("place").cast("long").alias("place"), "id", F.round("final_score", 6).alias("final_score"))


# --- pages


@_query
def search_page(spark: SparkSession, d: str) -> DataFrame:
    page = paging.page_rows(_ranked(spark, d), page=2, page_size=5)
    return page.select(F.col("place").cast("long").alias("place"), "id", F.round("final_score", 6).alias("final_score"))


@_query
def search_page_meta(spark: SparkSession, d: str) -> DataFrame:
    return paging.page_meta(_ranked(spark, d), page=4, page_size=10)


@_query
def page_buttons(spark: SparkSession, d: str) -> DataFrame:
    return paging.page_buttons(search_page_meta(spark, d))


@_query
def result_card(spark: SparkSession, d: str) -> DataFrame:
    page = paging.page_rows(_ranked(spark, d), page=1, page_size=5)
    cards = paging.result_cards(page.join(_stories(spark, d), "id"))
    return cards.withColumn("place", F.col("place").cast("long"))


@_query
def url_encoding(spark: SparkSession, d: str) -> DataFrame:
    searched = table(spark, d, "search_requests").select("q").filter("q IS NOT NULL").distinct()
    return searched.select("q", paging.url_part(F.col("q")).alias("encoded"))


# --- suggestions


@_query
def autocomplete_vocab(spark: SparkSession, d: str) -> DataFrame:
    return suggest.vocabulary(_stories(spark, d))


@_query
def autocomplete(spark: SparkSession, d: str) -> DataFrame:
    return suggest.suggest(suggest.vocabulary(_stories(spark, d)), "de").select("word")


@_query
def autocomplete_order(spark: SparkSession, d: str) -> DataFrame:
    ordered = suggest.in_order(suggest.vocabulary(_stories(spark, d)))
    return ordered.select("word", F.array_join("key", ",").alias("key"))


@_query
def debounce_effective(spark: SparkSession, d: str) -> DataFrame:
    return limits.debounce(table(spark, d, "search_requests")).select("request_id", "q")


# --- reports, limits, cache


@_query
def top_searches(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_searches(_log(spark, d))


@_query
def zero_searches(spark: SparkSession, d: str) -> DataFrame:
    return reports.zero_searches(_log(spark, d)).withColumn("timestamp", F.unix_micros("timestamp"))


@_query
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return limits.admit(table(spark, d, "search_requests")).select("request_id", "ip", "prior", "decision")


@_query
def cache_effective(spark: SparkSession, d: str) -> DataFrame:
    return result_cache.outcomes(table(spark, d, "search_requests")).select("request_id", "outcome")
