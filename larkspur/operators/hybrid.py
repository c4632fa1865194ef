"""Weighted fusion of the sparse and the dense ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.tfidf import DECIMALS

#: Fixed value: candidates that each ranker gives, whatever is asked for.
CANDIDATES = 20


def _ranked(top: DataFrame, score: str, rank: str) -> DataFrame:
    """A ranker's candidates with their places; at most ``CANDIDATES`` rows, so one window over all is small."""
    place = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("id")))
    return top.select("id", F.col("score").alias(score), place.alias(rank))


def candidates(tfidf_top: DataFrame, vector_top: DataFrame) -> DataFrame:
    """``id, tfidf_score, vector_score, tfidf_rank, vector_rank``: the union of both; a missing side scores 0."""
    both = _ranked(tfidf_top, "tfidf_score", "tfidf_rank").join(_ranked(vector_top, "vector_score", "vector_rank"), "id", "full")
    return both.fillna(0.0, ["tfidf_score", "vector_score"])


def fuse(found: DataFrame, tfidf_weight: float = 0.4, vector_weight: float = 0.6) -> DataFrame:
    """Candidates with ``final_score``; the weights are used as they are."""
    fused = tfidf_weight * F.col("tfidf_score") + vector_weight * F.col("vector_score")
    return found.withColumn("final_score", F.round(fused, DECIMALS))


def ordered(fused: DataFrame) -> DataFrame:
    """``id, final_score, place``, best first; equals stay in the sparse, then the dense ranking's order."""
    place = F.row_number().over(Window.orderBy(F.desc("final_score"), F.asc_nulls_last("tfidf_rank"), F.asc_nulls_last("vector_rank")))
    return fused.select("id", "final_score", place.alias("place"))


def top(fused: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best of ``ordered``."""
    return ordered(fused).filter(F.col("place") <= k)
