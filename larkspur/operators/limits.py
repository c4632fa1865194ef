"""Sliding-window admission of requests, and debouncing of typed input.

A client with a large part of all requests must not end up in one task. So time is cut into buckets, windows are
partitioned by client and bucket, and the rows near a bucket's edge are repeated in the neighbouring bucket as
context.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_MICROS = 1_000_000


class TooManyRequests(Exception):
    """A client has asked too often."""


class Limiter:
    """Admission of live requests, one at a time, as ``admit`` decides over a log. A client's times are kept for a window."""

    def __init__(self, limit: int = 40, window_seconds: float = 60) -> None:
        self.limit, self.window, self.times = limit, window_seconds, defaultdict(deque)

    def check(self, client: str | None, now: float) -> None:
        """Count the request, whether admitted or not; raise if the window before it was full."""
        for known in list(self.times) if len(self.times) > 10_000 else [client]:
            own = self.times[known]
            while own and own[0] <= now - self.window:
                own.popleft()
            if not own and known != client:
                del self.times[known]
        prior = len(self.times[client])
        self.times[client].append(now)
        if prior >= self.limit:
            raise TooManyRequests("Too many requests. Please slow down!")


def _timed(requests: DataFrame, client: str, epoch: str) -> DataFrame:
    micros = F.round(F.col(epoch) * _MICROS).cast("long")
    return requests.filter(F.col(epoch).isNotNull()).withColumns({"_client": F.col(client), "_us": micros})


def admit(
    requests: DataFrame,
    client: str = "ip",
    epoch: str = "epoch",
    tie: str = "request_id",
    limit: int = 40,
    window_seconds: int = 60,
    bucket_seconds: int = 1800,
) -> DataFrame:
    """Requests with ``prior`` and ``decision`` (``allow`` or ``reject``).

    ``prior`` counts the client's requests in the window before, rejected ones included: later than ``window_seconds``
    ago, and of those at the same time the ones with a smaller ``tie``. Requests without a client are one
    client; requests without a time are left out.
    """
    span, width = window_seconds * _MICROS, max(bucket_seconds, window_seconds) * _MICROS
    rows = _timed(requests, client, epoch).withColumn("_bucket", F.floor(F.col("_us") / width))
    late = F.col("_us") - F.col("_bucket") * width > width - span
    spread = rows.withColumn("_in", F.explode(F.when(late, F.array("_bucket", F.col("_bucket") + 1)).otherwise(F.array("_bucket"))))
    group = Window.partitionBy("_client", "_in").orderBy("_us")
    earlier = F.count(F.lit(1)).over(group.rangeBetween(-span + 1, -1))
    same = F.row_number().over(Window.partitionBy("_client", "_in", "_us").orderBy(tie)) - 1
    counted = spread.withColumn("prior", (earlier + same).cast("long")).filter(F.col("_in") == F.col("_bucket"))
    decision = F.when(F.col("prior") < limit, "allow").otherwise("reject")
    return counted.withColumn("decision", decision).drop("_client", "_us", "_bucket", "_in")


def debounce(
    requests: DataFrame,
    client: str = "ip",
    epoch: str = "epoch",
    typed: str = "q",
    tie: str = "request_id",
    wait_ms: int = 300,
    least_length: int = 2,
    bucket_seconds: int = 1800,
) -> DataFrame:
    """The inputs that are sent: not blank, of ``least_length`` characters or more, and followed by no other input of the
    client within ``wait_ms``. Inputs without a time or a text are not sent."""
    wait, width = wait_ms * 1000, bucket_seconds * _MICROS
    rows = _timed(requests, client, epoch).withColumn("_bucket", F.floor(F.col("_us") / width))
    early = F.col("_us") - F.col("_bucket") * width < wait
    spread = rows.withColumn("_in", F.explode(F.when(early, F.array("_bucket", F.col("_bucket") - 1)).otherwise(F.array("_bucket"))))
    following = F.lead("_us").over(Window.partitionBy("_client", "_in").orderBy("_us", tie))
    sent = spread.withColumn("_next", following).filter(F.col("_in") == F.col("_bucket"))
    quiet = F.col("_next").isNull() | (F.col("_next") - F.col("_us") >= wait)
    text = F.trim(F.col(typed))
    return sent.filter(quiet & (text != "") & (F.length(typed) >= least_length)).drop("_client", "_us", "_bucket", "_in", "_next")
