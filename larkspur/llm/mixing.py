"""Mixing sources to target weights along a time-varying curriculum.

Per plan, every source has a weight schedule over the training time t from 0 to 1: given weights at some times, linear
between them, scaled so that the sources' weights add up to 1 at every t. Its integral is the source's share of the
plan's tokens. Where no schedule is given, a target weight is the share, and the schedule ``share * (1 + slope * (2 t - 1))``:
the slopes favour sources that repeat much towards the end. Integrated up to t, a schedule is the source's cumulative demand.
The documents of a source, in a fixed pseudo-random order and repeated pass by pass, lie along a line of tokens; the
demand is inverted at the middle of each copy, which gives its time, and the mixture is range-sorted by that.

The running total of tokens along a source is computed in two steps, within small buckets of the order and over
the buckets' sums, so a source that holds most documents is never in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.lineage import cut

#: Fixed value: the split pattern of the public byte-level tokenizer.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ORDER_BITS = 40
_DEMAND = (
    "plan_id long, source string, target_share double, share double, supply long, demand double, plan_tokens double, "
    "times array<double>, rates array<double>, cumulative array<double>"
)
_COLUMNS = [field.split()[0] for field in _DEMAND.split(", ")]


def default_tokenizer() -> str:
    """The path of the installed public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_counts(
    documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``doc_id, source, n_tokens``, once per document; documents without a token, id or source are left out."""
    with open(tokenizer, "rb") as lines:
        # A vocabulary has a fixed size, about one megabyte.
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    shared = documents.sparkSession.sparkContext.broadcast(ranks)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        encoding = tiktoken.Encoding("counts", pat_str=_PATTERN, mergeable_ranks=shared.value, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary(text)) for text in batch["text"]]
            yield batch[["doc_id", "source"]].assign(n_tokens=n)

    rows = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")
    ).dropna()
    counted = rows.mapInPandas(count, "doc_id long, source string, n_tokens long").filter("n_tokens > 0")
    return counted.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("d")).select("doc_id", "d.*")


def solve_plan(plan: pd.DataFrame, total: int | None, tilt: float) -> pd.DataFrame:
    """Demands of one plan's sources (columns ``source, weight, max_repeats, supply``), in tokens.

    Without ``total``, the plan is as long as the caps allow with every share exact; if no source is capped, as
    long as the supply. With ``total``, a source that reaches its cap stays there and the others share the rest.
    """
    weight = plan["weight"].to_numpy(float)
    supply = plan["supply"].to_numpy(float)
    cap = plan["max_repeats"].to_numpy(float) * supply
    cap[np.isnan(cap)] = np.inf
    usable = (supply > 0) & (cap > 0)
    share = np.where(usable, weight, 0)
    share = share / share.sum() if share.sum() else share
    if total is None:
        limits = cap[usable] / share[usable]
        finite = limits[np.isfinite(limits)]
        length = float(finite.min()) if len(finite) else float(supply[usable].sum())
        demand = length * share
    else:
        demand, free, rest = np.zeros(len(plan)), usable.copy(), float(total)
        while free.any() and rest > 0:
            wanted = rest * share / share[free].sum()
            full = free & (wanted >= cap)
            if not full.any():
                demand[free] = wanted[free]
                break
            demand[full] = cap[full]
            rest -= cap[full].sum()
            free &= ~full
        length = float(demand.sum())
    reached = demand / length if length else demand
    repeats = np.divide(demand, supply, out=np.zeros(len(plan)), where=supply > 0)
    rank = pd.Series(repeats).rank(method="average").to_numpy()
    lean = rank - (reached * rank).sum()
    slope = tilt * lean / np.abs(lean).max() if np.abs(lean).max() > 1e-12 else np.zeros(len(plan))
    return plan[["plan_id", "source"]].assign(
        target_share=weight / weight.sum(), share=reached, supply=supply.astype(np.int64), demand=demand, slope=slope, plan_tokens=length
    )


def scheduled(plan: pd.DataFrame, times: np.ndarray, rates: np.ndarray) -> pd.DataFrame:
    """The plan with each source's schedule: its rates at the times, and the part of its demand that is used by then."""
    steps = np.diff(times) * (rates[:, 1:] + rates[:, :-1]) / 2
    used = np.concatenate([np.zeros((len(plan), 1)), np.cumsum(steps, axis=1)], axis=1)
    whole = np.where(used[:, -1:] > 0, used[:, -1:], 1)
    return plan.assign(times=[times.tolist()] * len(plan), rates=(rates / whole).tolist(), cumulative=(used / whole).tolist())


def curriculum(sources: list[str], knots: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Times from 0 to 1, and the sources' rates at them (a row each): given weights (``source, time, weight``), held before the
    first and after the last time, linear between, and scaled to add up to 1. Where all are 0, no source has a rate."""
    times = np.unique(np.concatenate([[0.0, 1.0], knots["time"].to_numpy(float)]))
    rates = np.zeros((len(sources), len(times)))
    for k, source in enumerate(sources):
        own = knots[knots["source"] == source].sort_values("time")
        if len(own):
            rates[k] = np.interp(times, own["time"].to_numpy(float), own["weight"].to_numpy(float))
    total = rates.sum(axis=0)
    return times, rates / np.where(total > 0, total, 1)


class Mixture:
    """The mixtures of all plans in ``targets`` (``plan_id, source, weight, max_repeats``) from ``documents``.

    Weights are relative; rows with a null plan, source or weight or a weight of zero or less are no targets;
    repeated targets of a plan and source count once if equal, else their weights add up and the lowest cap holds.
    A null ``max_repeats`` is no cap, one below 1 excludes the source. Sources without documents get nothing, and
    the others share the plan. Empty tables give empty results. ``schedule`` (``plan_id, source, time, weight``, times from 0 to 1) is the
    curriculum of the plans that it names: their targets' weights are then the schedule's integrals, while sources and caps still come from
    ``targets``; rows with nulls, negative weights or other times are left out, the largest weight of a repeated time counts. Counts tokens and checkpoints them when made.
    """

    def __init__(
        self,
        documents: DataFrame,
        targets: DataFrame,
        tokenizer: str | None = None,
        total_tokens: int | None = None,
        tilt: float = 0.5,
        schedule: DataFrame | None = None,
    ) -> None:
        self.counts = cut(token_counts(documents, tokenizer or default_tokenizer()))
        wanted = targets.select(
            F.col("plan_id").cast("long"), "source", F.col("weight").cast("double"), F.col("max_repeats").cast("double")
        ).filter("plan_id IS NOT NULL AND source IS NOT NULL AND weight > 0")
        wanted = wanted.distinct().groupBy("plan_id", "source").agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))
        supply = self.counts.groupBy("source").agg(F.sum("n_tokens").alias("supply"))
        rows = wanted.join(supply, "source", "left").fillna(0, ["supply"])

        knots = targets.sparkSession.createDataFrame([], "plan_id long, source string, time double, weight double")
        if schedule is not None:
            knots = schedule.select(F.col("plan_id").cast("long"), "source", F.col("time").cast("double"), F.col("weight").cast("double"))
        knots = knots.dropna().filter("time BETWEEN 0 AND 1 AND weight >= 0").groupBy("plan_id", "source", "time").agg(F.max("weight").alias("weight"))

        def solve(plan: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(plan):
                return pd.DataFrame({c: pd.Series(dtype=object) for c in _COLUMNS})
            plan = plan.sort_values("source", ignore_index=True)
            names = plan["source"].tolist()
            own = own[own["source"].isin(names)]
            if not len(own):
                solved = solve_plan(plan, total_tokens, tilt)
                ends = solved["share"].to_numpy()[:, None] * (1 + solved["slope"].to_numpy()[:, None] * np.array([-1.0, 1.0]))
                return scheduled(solved, np.array([0.0, 1.0]), ends).reindex(columns=_COLUMNS)
            # Sources that give nothing leave their place to the others at every time.
            gives = plan["source"][(plan["supply"] > 0) & ~(plan["max_repeats"] < 1)]
            wanted = curriculum(names, own)
            times, rates = curriculum(names, own[own["source"].isin(gives)])
            solved = solve_plan(plan.assign(weight=np.trapezoid(rates, times, axis=1)), total_tokens, 0.0)
            solved["target_share"] = np.trapezoid(wanted[1], wanted[0], axis=1)
            return scheduled(solved, times, rates).reindex(columns=_COLUMNS)

        # A plan has a row for each source it names; documents are not in these groups.
        self.demands = cut(rows.groupBy("plan_id").cogroup(knots.groupBy("plan_id")).applyInPandas(solve, _DEMAND))

    def _placed(self, bucket_docs: int = 20_000) -> DataFrame:
        """``doc_id, source, n_tokens, offset``: the tokens before a document in its source's order."""
        buckets = max(1, -(-self.counts.count() // bucket_docs))
        place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 64 - _ORDER_BITS)
        docs = self.counts.withColumn("place", place).withColumn("bucket", F.floor(F.col("place") * F.lit(buckets) / F.lit(1 << _ORDER_BITS)))
        inside = Window.partitionBy("source", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
        starts = sums.select("source", "bucket", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("begin"))
        own = docs.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        return own.join(starts, ["source", "bucket"]).select("doc_id", "source", "n_tokens", (F.col("begin") + F.col("own")).alias("offset"))

    def documents(self) -> DataFrame:
        """``plan_id, position, doc_id, copy, source, n_tokens``, range-sorted by plan and position.

        ``position`` is the time of the copy's middle, in tokens of the plan. A copy is used if its middle lies within
        its source's demand, so a source misses its demand by half a document at most.
        """
        demands = self.demands.filter("demand > 0").select("plan_id", "source", "supply", "demand", "plan_tokens", "times", "rates", "cumulative")
        if demands.count() <= 10_000:
            demands = F.broadcast(demands)
        middle = F.col("offset") + F.col("n_tokens") / 2
        copies = F.floor((F.col("demand") - middle) / F.col("supply")).cast("int")
        used = self._placed().join(demands, "source").withColumn("last", copies).filter("last >= 0")
        each = used.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("last"))))
        # The stretch of the schedule in which the demand reaches this part of the source, and the time within it.
        each = each.withColumn("x", (F.col("copy") * F.col("supply") + middle) / F.col("demand"))
        each = each.withColumn("at", F.greatest(F.lit(1), F.size(F.filter("cumulative", lambda c: c <= F.col("x")))))
        each = each.withColumn("at", F.least("at", F.size("times") - 1))

        def low(name: str) -> Column:
            return F.element_at(name, F.col("at"))

        def high(name: str) -> Column:
            return F.element_at(name, F.col("at") + 1)

        step, left = high("times") - low("times"), F.greatest(F.lit(0.0), F.col("x") - low("cumulative"))
        bend = (high("rates") - low("rates")) / step
        root = low("rates") + F.sqrt(F.greatest(F.lit(0.0), low("rates") * low("rates") + 2 * bend * left))
        t = low("times") + F.least(step, F.when(root > 0, 2 * left / root).otherwise(F.lit(0.0)))
        placed = each.select("plan_id", (t * F.col("plan_tokens")).alias("position"), "doc_id", "copy", "source", "n_tokens")
        return placed.repartitionByRange("plan_id", "position").sortWithinPartitions("plan_id", "position", "doc_id", "copy")

    def shares(self) -> DataFrame:
        """Per plan and source: target share, the share planned under the caps, and what was reached, in tokens and documents."""
        used = self.documents().groupBy("plan_id", "source").agg(
            F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_copies"), (F.max("copy") + 1).alias("most_repeats")
        )
        rows = self.demands.join(used, ["plan_id", "source"], "left").fillna(0, ["tokens", "n_copies", "most_repeats"])
        total = F.sum("tokens").over(Window.partitionBy("plan_id"))
        return rows.select(
            "plan_id", "source", "target_share", F.col("share").alias("planned_share"),
            F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)).alias("actual_share"),
            "supply", "tokens", "n_copies", "most_repeats",
        )
