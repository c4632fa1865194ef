"""Prefix suggestions over the words of titles, in the order of a prefix tree that keeps insertion order.

Children of a node appear in the order in which their first word was inserted. For each prefix of a word take the
smallest position of any word with that prefix; the words, ordered by the array of these minima, are in the tree's
pre-order. Prefixes are told apart by a 128-bit hash and their length, so a long word does not write out all
of its prefixes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import tokenize

#: Words a title may have without positions of two titles overlapping.
_TITLE_WORDS = 1 << 20


def vocabulary(stories: DataFrame, id_col: str = "id", title_col: str = "title") -> DataFrame:
    """``word, pos``: the distinct lower-case words of titles, punctuation kept, with the first position of each.

    Positions run over the stories by id, then over the title. Null titles and ids have no words.
    """
    rows = stories.select(F.col(id_col).alias("id"), F.posexplode(tokenize(F.lower(title_col))).alias("at", "word"))
    pos = F.col("id") * _TITLE_WORDS + F.col("at")
    return rows.filter(F.col("id").isNotNull()).groupBy("word").agg(F.min(pos).alias("pos"))


def in_order(words: DataFrame) -> DataFrame:
    """``word, pos, key``: order by ``key`` for the tree's pre-order."""
    prefix = F.substr("word", F.lit(1), F.col("length"))
    prefixes = words.select("word", "pos", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("length")).select(
        "word", "pos", "length", F.xxhash64(prefix).alias("h0"), F.xxhash64(F.lit(1), prefix).alias("h1")
    )
    node = ["length", "h0", "h1"]
    minima = prefixes.groupBy(*node).agg(F.min("pos").alias("least"))
    steps = F.transform(F.sort_array(F.collect_list(F.struct("length", "least"))), lambda s: s["least"])
    return prefixes.join(minima, node).groupBy("word", "pos").agg(steps.alias("key"))


def suggest(words: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """``word, key`` of the first ``limit`` words that start with ``prefix`` (as it is, not lower-cased), in order.

    Only the words below the prefix are ranked: words outside share no longer prefix with them.
    """
    below = words.filter(F.startswith(F.col("word"), F.lit(prefix)))
    return in_order(below).orderBy("key").limit(limit).select("word", "key")
