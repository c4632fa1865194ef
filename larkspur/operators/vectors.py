"""Dense vectors: building them with a pluggable embedder, and exact cosine scores against a query vector."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.tfidf import DECIMALS, top_k


class Embedder(Protocol):
    """Turns raw texts into equally long vectors."""

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class HashingEmbedder:
    """A stand-in embedder that needs no model: signed hashing of a text's words into ``size`` dimensions."""

    def __init__(self, size: int = 384) -> None:
        self.size = size

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.size), np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word)
                row[h % self.size] += 1 if h >> 63 else -1
        return out


def embed(stories: DataFrame, embedder: Embedder) -> DataFrame:
    """``id, embedding`` of the stories' raw text (null: empty), in Arrow batches, the embedder loaded once a task."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(np.asarray(embedder.encode(texts.fillna("").tolist()), np.float32)))

    return stories.select("id", encode("text").alias("embedding"))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector. Vectors are never shuffled: repeated ids are told by what is computed of them."""
    return vectors.filter(F.col("id").isNotNull() & F.col("embedding").isNotNull()).select("id", "embedding")


def scores(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """``id, score``: cosine of each vector with ``query``, 0 where either is zero or the lengths differ. An id with several
    vectors has its best score. One pass over the vectors; ids and scores alone are shuffled, to tell repeated ids."""
    wanted = np.asarray(query, np.float64)
    norm = np.sqrt(wanted @ wanted)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            fits = sizes == len(wanted)
            out = np.zeros(batch.num_rows)
            if fits.any():
                rows = lists.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(wanted)).astype(np.float64)
                length = np.sqrt((rows * rows).sum(axis=1)) * norm
                out[fits] = np.divide(rows @ wanted, length, out=np.zeros(len(rows)), where=length > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["id", "score"])

    found = vectors.select("id", "embedding").mapInArrow(score, "id long, score double")
    return found.groupBy("id").agg(F.round(F.max("score"), DECIMALS).alias("score"))


def top(vectors: DataFrame, query: Sequence[float], k: int = 10) -> DataFrame:
    """The ``k`` best ``id, score``."""
    return top_k(scores(vectors, query), k)
