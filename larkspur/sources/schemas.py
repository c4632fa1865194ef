"""Explicit schemas of the stored relations and of the feed's documents."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_LONG, _INT, _TEXT, _TIME = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampType()

STORIES = _schema(id=_LONG, title=_TEXT, text=_TEXT, preprocessed_text=_TEXT, url=_TEXT, score=_INT)
SEARCH_LOG = _schema(id=_LONG, query=_TEXT, results_count=_INT, timestamp=_TIME)
FEED_ITEM = _schema(id=_LONG, type=_TEXT, title=_TEXT, text=_TEXT, url=_TEXT, score=_INT)
CACHED_PAGE = _schema(q=_TEXT, page=_INT, page_size=_INT, value=_TEXT, stored_at=_TIME, expires_at=_TIME)
