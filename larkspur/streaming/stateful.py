"""Keyed state over streams: the sliding-window limiter and the result cache, as in batch.

State expires in event time. Requests later than the watermark allows are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.operators.result_cache import TTL_SECONDS, valid_requests

_MICROS = 1_000_000


def _timed(requests: DataFrame, lateness: str, *columns: str) -> DataFrame:
    micros = F.round(F.col("epoch") * _MICROS).cast("long")
    rows = requests.filter("epoch IS NOT NULL").select(*columns, micros.alias("us"), F.timestamp_micros(micros).alias("at"))
    return rows.withWatermark("at", lateness)


def admit_stream(requests: DataFrame, limit: int = 40, window_seconds: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """``request_id, ip, prior, decision`` of a stream of ``request_id, ip, epoch``.

    Agrees with the batch operator on requests that arrive in order. The state of a client is the times of its last
    window; it is dropped when the client is quiet. A request later than a newer one of its client counts what is kept.
    """
    span = window_seconds * _MICROS

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(batches).sort_values(["us", "request_id"])
        priors = []
        for us in rows["us"].tolist():
            times = [t for t in times if t > us - span]
            priors.append(len(times))
            times.append(us)
        state.update((times,))
        state.setTimeoutTimestamp(max(times[-1] + span, 1000 * (state.getCurrentWatermarkMs() + 1000)) // 1000)
        decision = ["allow" if p < limit else "reject" for p in priors]
        yield pd.DataFrame({"request_id": rows["request_id"], "ip": rows["ip"], "prior": priors, "decision": decision})

    return _timed(requests, lateness, "request_id", "ip").groupBy("ip").applyInPandasWithState(
        admit, "request_id long, ip string, prior long, decision string", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def cache_stream(requests: DataFrame, ttl_seconds: int = TTL_SECONDS, lateness: str = "10 minutes") -> DataFrame:
    """``request_id, q, page, page_size, outcome`` of a stream of requests; a key's state is when its page expires."""
    ttl = ttl_seconds * _MICROS

    def look_up(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        expires = state.get[0] if state.exists else -1
        rows = pd.concat(batches).sort_values(["us", "request_id"])
        outcome = []
        for us in rows["us"].tolist():
            outcome.append("miss" if us >= expires else "hit")
            if us >= expires:
                expires = us + ttl
        state.update((expires,))
        state.setTimeoutTimestamp(max(expires, 1000 * (state.getCurrentWatermarkMs() + 1000)) // 1000)
        yield rows[["request_id", "q", "page", "page_size"]].assign(outcome=outcome)

    timed = _timed(valid_requests(requests), lateness, "request_id", "q", "page", "page_size")
    return timed.groupBy("q", "page", "page_size").applyInPandasWithState(
        look_up, "request_id long, q string, page int, page_size int, outcome string", "expires long", "append", GroupStateTimeout.EventTimeTimeout
    )
