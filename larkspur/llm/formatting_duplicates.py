"""Records that differ only in formatting, collapsed to one each with the number of copies.

A record is a line of text: either a plain phrase, or, when it holds ``=``, a list of ``name=value``
fields joined by ``&``. Every (name, value) pair is normalised and hashed; the hashes are *added* in two
prime fields, so the fingerprint of a record is a hash of the multiset of its fields that no order of the
fields changes and that no sort is needed for. Records are grouped by fingerprint. Where a group has several
spellings, each is compared field by field with the group's representative, again without sorting: two lists
are the same multiset if they have the same length and the same distinct fields, each equally often.
A record that fails the comparison (a hash collision) is regrouped on its exact fields.

The work follows the distinct spellings: copies are collapsed by partial aggregation before anything is
shuffled by spelling or fingerprint, so a spelling that holds a third of all rows is one row by then. A
fingerprint with very many spellings is compared where its spellings lie: the join brings one row, the
representative, to them, and splits them if they are many.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.lineage import cut
from larkspur.functions.unicode import WS, fold, split_words

#: Both lanes of the fingerprint are sums modulo this prime (2^61 - 1); a sum of two residues fits a long.
_PRIME = (1 << 61) - 1
_SEEDS = ("\u0002first", "\u0003second")


def _normal(text: Column) -> Column:
    return F.array_join(split_words(fold(text), WS + r"\p{P}"), " ")


def fields(line: Column) -> Column:
    """The normalised fields of a line, as strings: ``name \\u0001 value``, or for a plain phrase its words alone.

    A line's field without ``=`` has no ``\\u0001``, but starts with ``\\u0000``, so that it never equals a plain
    phrase or a field with an empty value. Fields without any word are dropped. Null for null.
    """

    def pair(part: Column) -> Column:
        at = F.instr(part, "=")
        named = F.concat(
            _normal(F.substr(part, F.lit(1), at - 1)), F.lit("\u0001"), _normal(F.substr(part, at + 1, F.length(part)))
        )
        return F.when(at > 0, named).otherwise(F.concat(F.lit("\u0000"), _normal(part)))

    parts = F.filter(F.transform(F.split(line, "&"), pair), lambda p: ~p.isin("\u0000", "\u0001"))
    return F.when(F.contains(line, F.lit("=")), parts).otherwise(F.array(_normal(line)))


def _lane(items: Column, seed: str) -> Column:
    def step(total: Column, item: Column) -> Column:
        hashed = F.pmod(F.xxhash64(item, F.lit(seed)), F.lit(_PRIME))
        return F.pmod(total + hashed, F.lit(_PRIME))

    return F.aggregate(items, F.lit(0).cast("long"), step)


def _equally_often(a: Column, b: Column) -> Column:
    """Whether two lists hold the same fields equally often, counted in a hash map; null for nulls."""

    def compare(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else Counter(x) == Counter(y) for x, y in zip(xs, ys)], dtype=object)

    return F.pandas_udf(compare, "boolean")(a, b)


def formatting_duplicates(log: DataFrame, id_col: str = "id", text_col: str = "query") -> DataFrame:
    """One row for each set of equal records: ``first_id, n_copies, n_spellings, example``.

    ``n_copies`` counts distinct ids; ``first_id`` is the smallest; ``example`` is the smallest spelling. Letter case is
    ignored letter by letter: ``ß`` is not ``SS``, ``ı`` not ``i``.
    Rows with a null id or text, and texts without letter or digit, are no records. Rows delivered more than
    once (same id, same text) count once. An empty table gives an empty result. Other columns are not read. The distinct spellings are checkpointed when called.
    """
    rows = log.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}]"))
    spellings = (
        rows.distinct()
        .groupBy("text")
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .withColumn("fields", fields(F.col("text")))
    )
    # Needed again, for the representatives and for the comparison with them, under the same numbers.
    hashed = cut(
        spellings.select(
            *(_lane(F.col("fields"), s).alias(f"lane{i}") for i, s in enumerate(_SEEDS)),
            F.when(F.contains("text", F.lit("=")), F.size("fields")).otherwise(-1).alias("width"),
            F.monotonically_increasing_id().alias("number"),
            (F.size(F.array_distinct("fields")) < F.size("fields")).alias("repeats"),
            "text",
            "fields",
            "first_id",
            "n",
        )
    )
    key = ["lane0", "lane1", "width"]
    groups = hashed.groupBy(*key).agg(F.min("number").alias("chosen"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    # One row a group of several spellings; a shuffled hash join needs no sort, and a group much larger than others is split.
    model = (
        hashed.join(groups.hint("shuffle_hash"), key)
        .filter("number = chosen")
        .select(*key, F.col("fields").alias("model"), F.col("repeats").alias("model_repeats"))
    )
    both = hashed.join(model.hint("shuffle_hash"), key, "left")
    alike = (F.size("fields") == F.size("model")) & (F.col("repeats") == F.col("model_repeats"))
    # Of two lists as long as each other and without repeats, one holds the other only if they are the same set.
    as_sets = (F.col("fields") == F.col("model")) | (F.size(F.array_except("fields", "model")) == 0)
    # Only lists with repeats go to Python, others as nulls.
    counted = _equally_often(F.when(alike & F.col("repeats"), F.col("fields")), F.when(alike & F.col("repeats"), F.col("model")))
    equal = F.col("model").isNull() | (alike & F.when(F.col("repeats"), counted).otherwise(as_sets))
    # Groups that collide on the fingerprint are told apart by their exact fields; only those are sorted.
    apart = F.when(~F.col("equal"), F.array_join(F.array_sort("fields"), "&"))
    return (
        both.withColumn("equal", equal)
        .select(*key, apart.alias("apart"), "first_id", "n", "text")
        .groupBy(*key, "apart")
        .agg(
            F.min("first_id").alias("first_id"),
            F.sum("n").alias("n_copies"),
            F.count(F.lit(1)).alias("n_spellings"),
            F.min("text").alias("example"),
        )
        .drop(*key, "apart")
    )
