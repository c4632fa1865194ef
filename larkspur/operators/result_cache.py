"""The result cache: keyed pages with a time to live, and its hits and misses over a log of requests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: seconds that a stored page stays valid.
TTL_SECONDS = 3600
_KEY = ("q", "page", "page_size")


def put(pages: DataFrame, now: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """``q, page, page_size, value`` as cache rows, stored ``now``."""
    return pages.select(*_KEY, "value", now.alias("stored_at"), (now + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"))


def snapshot(stored: DataFrame) -> DataFrame:
    """The last write of each key."""
    latest = F.max_by(F.struct("value", "stored_at", "expires_at"), F.col("stored_at")).alias("row")
    return stored.groupBy(*_KEY).agg(latest).select(*_KEY, "row.*")


def get(requests: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """Requests with the cached ``value``, null on a miss; the key is compared exactly."""
    live = snapshot(stored).filter(F.col("expires_at") > now).select(*_KEY, "value")
    return requests.join(live, list(_KEY), "left")


def lookup(stored: DataFrame, q: str, page: int, page_size: int, now: Column) -> DataFrame:
    """At most one row ``value``: the live page last stored under one key. Only rows of the key leave the scan."""
    own = stored.filter((F.col("q") == q) & (F.col("page") == page) & (F.col("page_size") == page_size))
    return own.orderBy(F.desc("stored_at")).limit(1).filter(F.col("expires_at") > now).select("value")


def valid_requests(requests: DataFrame) -> DataFrame:
    """Requests with a query, a time and a page and size of 1 or more; nulls take the defaults 1 and 5."""
    filled = requests.fillna({"page": 1, "page_size": 5})
    return filled.filter("q IS NOT NULL AND epoch IS NOT NULL AND page >= 1 AND page_size >= 1")


def _scan(ttl: int):
    """Outcomes of rows sorted by key and time; only the last key and its expiry are held."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, expires = None, -1
        for batch in batches:
            micros = batch["us"].to_numpy()
            miss = np.zeros(len(batch), bool)
            columns = [batch[c].to_numpy() for c in _KEY]
            changed = np.ones(len(batch), bool)
            if len(batch) > 1:
                changed[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            starts = np.append(np.nonzero(changed)[0], len(batch))
            for begin, end in zip(starts[:-1], starts[1:]):
                own = tuple(c[begin] for c in columns)
                if own != key:
                    key, expires = own, -1
                at = begin
                while True:
                    # A hit does not extend the time to live, so the next miss is the first request past it.
                    at += int(np.searchsorted(micros[at:end], expires)) if expires >= 0 else 0
                    if at >= end:
                        break
                    miss[at], expires = True, int(micros[at]) + ttl
            yield batch[["request_id", *_KEY]].assign(outcome=np.where(miss, "miss", "hit"))

    return scan


def outcomes(requests: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """``request_id, q, page, page_size, outcome`` of valid requests: ``miss`` for the first of a key and the first after
    the page stored at the last miss expired, else ``hit``. Of requests at one time the smallest id is first.

    Rows stream through each task in order, with memory for one batch, whatever a key's share of the rows.
    """
    micros = F.round(F.col("epoch") * 1_000_000).cast("long").alias("us")
    rows = valid_requests(requests).select("request_id", *_KEY, micros)
    ordered = rows.repartition(*_KEY).sortWithinPartitions(*_KEY, "us", "request_id")
    return ordered.mapInPandas(_scan(ttl_seconds * 1_000_000), "request_id long, q string, page int, page_size int, outcome string")
