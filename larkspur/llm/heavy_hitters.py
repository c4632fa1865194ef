"""The most frequent values of a column, identified through an error-correcting code in bounded memory.

Values are never kept or grouped. Each value's 40-bit digest is a message of ten 4-bit symbols; four check
symbols of a maximum-distance code over GF(16) are appended. The value is hashed to one of ``groups`` groups,
in each of ``repeats`` independent hashings, and for every position of the codeword the group counts how much
weight each of the 16 symbols carries. This sketch has ``repeats * groups * 14 * 16`` counters, whatever the
data; tasks fill it from batches of distinct digests and the partial counters are summed by Spark.

A value with weight at least T puts at least T on its own symbol at *every* position of its group, since
counters only add up. So the symbols with T or more form, per group, one short list a position, and every
frequent value is a codeword inside the product of these lists. Mixtures of symbols of different values are
rejected by the check symbols (and by the group hash). Where a product is too large to decode, another
hashing decides, and if none decodes all of its groups, the sketch is repeated with four times the groups.
The candidates found this way are then counted exactly: the records, told apart once and kept as pairs of id and
128-bit hash, give the counts, and a second pass over the column the values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.lineage import cut

_DATA, _CHECK, _SYMBOLS = 10, 4, 16
_LENGTH = _DATA + _CHECK
_DIGEST_BITS = 4 * _DATA
#: Products of symbol lists up to this size are decoded.
_DECODE_LIMIT = 1 << 21
#: Counters of a sketch with so many groups and three repeats take 350 MB.
_MOST_GROUPS = 1 << 16


def _field_tables() -> np.ndarray:
    """The multiplication table of GF(16) with x^4 + x + 1."""
    table = np.zeros((16, 16), np.uint8)
    for a in range(16):
        for b in range(16):
            product = 0
            for bit in range(4):
                if b >> bit & 1:
                    product ^= a << bit
            for bit in range(6, 3, -1):
                if product >> bit & 1:
                    product ^= 0b10011 << (bit - 4)
            table[a, b] = product
    return table


_MUL = _field_tables()
_INVERSE = np.array([0, *((_MUL[a] == 1).argmax() for a in range(1, 16))], np.uint8)
#: A Cauchy matrix, every square part of which is invertible: any four wrong or missing symbols can be told.
_CAUCHY = np.array([[_INVERSE[i ^ (_DATA + j)] for j in range(_CHECK)] for i in range(_DATA)], np.uint8)


def encode(digests: np.ndarray) -> np.ndarray:
    """Codewords (n x 14 symbols) of digests."""
    shifts = np.arange(0, _DIGEST_BITS, 4, dtype=np.uint64)
    data = ((digests.astype(np.uint64)[:, None] >> shifts) & np.uint64(15)).astype(np.uint8)
    check = np.zeros((len(data), _CHECK), np.uint8)
    for i in range(_DATA):
        check ^= _MUL[data[:, i][:, None], _CAUCHY[i][None, :]]
    return np.hstack([data, check])


def group_of(digests: np.ndarray, repeat: int, groups: int) -> np.ndarray:
    """The group (``groups`` is a power of two) of each digest in the given hashing."""
    x = digests.astype(np.uint64) + np.uint64((repeat * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64)


def add_to_sketch(counters: np.ndarray, digests: np.ndarray, weights: np.ndarray) -> None:
    """Add weighted digests to ``counters`` (repeats x groups x 14 x 16), in place."""
    repeats, groups = counters.shape[:2]
    flat, symbols = counters.reshape(-1), encode(digests).astype(np.int64)
    offsets = np.arange(_LENGTH) * _SYMBOLS
    for r in range(repeats):
        slots = ((r * groups + group_of(digests, r, groups)) * _LENGTH * _SYMBOLS)[:, None] + offsets + symbols
        np.add.at(flat, slots.ravel(), np.repeat(weights, _LENGTH))


def decode(counters: np.ndarray, threshold: int) -> tuple[dict[int, int], bool]:
    """Candidates with an upper bound of their weight, and whether they surely hold every digest of weight ``threshold``."""
    repeats, groups = counters.shape[:2]
    found: dict[int, int] = {}
    whole = False
    for r in range(repeats):
        complete = True
        for g in np.nonzero((counters[r] >= threshold).any(axis=2).all(axis=1))[0]:
            lists = [np.nonzero(counters[r, g, p] >= threshold)[0].astype(np.uint64) for p in range(_LENGTH)]
            if math.prod(len(x) for x in lists[:_DATA]) > _DECODE_LIMIT:
                complete = False
                continue
            messages = np.zeros(1, np.uint64)
            for p in range(_DATA):
                messages = (messages[:, None] | (lists[p] << np.uint64(4 * p))[None, :]).ravel()
            words = encode(messages)
            kept = group_of(messages, r, groups) == g
            for p in range(_DATA, _LENGTH):
                kept &= np.isin(words[:, p], lists[p])
            for message, word in zip(messages[kept], words[kept]):
                bound = int(counters[r, g, np.arange(_LENGTH), word].min())
                found[int(message)] = min(bound, found.get(int(message), bound))
        whole |= complete
    return found, whole


def _digest(h0: Column) -> Column:
    return h0.bitwiseAND(F.lit((1 << _DIGEST_BITS) - 1))


def _hashes(value: Column) -> list[Column]:
    return [F.xxhash64(value).alias("h0"), F.xxhash64(F.lit(1), value).alias("h1")]


def _sketch(digests: DataFrame, repeats: int, groups: int) -> np.ndarray:
    """The summed counters over a column ``digest``."""
    shape = (repeats, groups, _LENGTH, _SYMBOLS)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters = np.zeros(shape, np.int64)
        for batch in batches:
            values, weights = np.unique(batch["digest"].to_numpy(), return_counts=True)
            add_to_sketch(counters, values, weights)
        used = np.nonzero(counters.ravel())[0]
        yield pd.DataFrame({"slot": used, "weight": counters.ravel()[used]})

    parts = digests.mapInPandas(fill, "slot long, weight long")
    # As many rows at most as the sketch has counters: a constant.
    summed = parts.groupBy("slot").agg(F.sum("weight").alias("weight")).toPandas()
    counters = np.zeros(shape, np.int64)
    counters.ravel()[summed["slot"].to_numpy()] = summed["weight"].to_numpy()
    return counters


def heavy_hitters(
    log: DataFrame, id_col: str = "id", value_col: str = "query", one_in: int = 200, repeats: int = 3, groups: int = 512
) -> DataFrame:
    """Values that make up at least one in ``one_in`` of the records: ``value, approx_count, exact_count, n_records``.

    A record is a distinct non-null id; all records belong to the total, but null and blank values (without
    letter or digit) are no values. ``approx_count`` is the sketch's estimate, never below the true count. All
    values with the least count are given, ties included. An empty table gives an empty result. ``groups`` must
    be a power of two, some twice ``one_in`` or more. Fills the sketch when called; the records' ids and hashes are
    checkpointed. Calling for a sketch of more than ``_MOST_GROUPS`` groups, which only very many values near the threshold do, is an error.
    """
    rows = log.select(F.col(id_col).alias("id"), F.col(value_col).alias("value")).filter(F.col("id").isNotNull())
    usable = F.col("value").rlike(r"[\p{L}\p{N}]")
    # Null and blank values are records, too, but no values.
    pairs = cut(rows.select("id", *(F.when(usable, h).alias(n) for n, h in zip(("h0", "h1"), _hashes(F.col("value"))))).distinct())
    total = pairs.agg(F.count_distinct("id")).first()[0]
    least = max(1, -(-total // one_in))
    digests = pairs.filter(F.col("h0").isNotNull()).select(_digest(F.col("h0")).alias("digest"))
    whole, bounds = False, {}
    while not whole:
        if groups > _MOST_GROUPS:
            raise ValueError(f"values at a share of one in {one_in} cannot be told by {groups} groups")
        bounds, whole = decode(_sketch(digests, repeats, groups), least)
        groups *= 4
    # At most one_in values are that frequent; the code lets next to nothing else pass.
    keys = sorted(bounds) or [-1]
    estimate = F.create_map(*(F.lit(x) for k in keys for x in (k, bounds.get(k, 0))))
    candidate = _digest(F.xxhash64("value")).isin(keys)
    counted = pairs.filter(_digest(F.col("h0")).isin(keys)).groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("exact_count"))
    values = rows.filter(usable & candidate).select("value").distinct().select("value", *_hashes(F.col("value")))
    # At most one_in rows.
    frequent = values.join(F.broadcast(counted.filter(F.col("exact_count") >= least)), ["h0", "h1"])
    return frequent.select(
        "value", estimate[_digest(F.col("h0"))].alias("approx_count"), "exact_count", F.lit(total).cast("long").alias("n_records")
    )
