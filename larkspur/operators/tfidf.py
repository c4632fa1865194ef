"""Exact TF-IDF: terms, weights, and cosine scores against a query.

Weights are ``count * (ln((1 + N) / (1 + df)) + 1)`` with rows scaled to length 1, over all ``N`` documents,
those without a term included. A term is two or more word characters. Scores are rounded to ten decimals, so that
their order does not depend on how sums were partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the token pattern of the index.
_TOKEN = r"(?U)\b\w\w+\b"
DECIMALS = 10


def corpus(stories: DataFrame) -> DataFrame:
    """``id, title, text, preprocessed_text, url, score``: each non-null id once (rows inserted twice are equal).

    Aggregated column by column, so that columns nobody asks for are never read. A story without preprocessed text
    has no terms.
    """
    columns = ["title", "text", "preprocessed_text", "url", "score"]
    return stories.filter(F.col("id").isNotNull()).groupBy("id").agg(*(F.min(c).alias(c) for c in columns))


def term_counts(stories: DataFrame) -> DataFrame:
    """``id, term, tf``."""
    terms = F.regexp_extract_all(F.coalesce("preprocessed_text", F.lit("")), F.lit(_TOKEN), F.lit(0))
    return stories.select("id", F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_table(counts: DataFrame, n_documents: int) -> DataFrame:
    """``term, df, idf``."""
    frequency = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return frequency.withColumn("idf", F.log((1 + F.lit(n_documents)) / (1 + F.col("df"))) + 1)


class TfIdfIndex:
    """Postings, terms and norms of a corpus, as lazy tables; write them to reuse them.

    For a stored index, ``stories`` holds just the ids, ``terms`` is set to the stored terms, and stored weights are passed
    to the searches.
    """

    def __init__(self, stories: DataFrame, n_documents: int | None = None) -> None:
        self.stories = stories
        self.n_documents = stories.count() if n_documents is None else n_documents
        self.counts = term_counts(stories) if "preprocessed_text" in stories.columns else None
        self.terms = None if self.counts is None else term_table(self.counts, self.n_documents)

    def _raw(self) -> DataFrame:
        return self.counts.join(self.terms, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("raw"))

    def weights(self) -> DataFrame:
        """``id, term, weight``: unit rows."""
        squares = F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id"))
        return self._raw().select("id", "term", (F.col("raw") / F.sqrt(squares)).alias("weight"))

    def matches(self, preprocessed_query: str, weights: DataFrame | None = None) -> DataFrame:
        """``id, score`` of the documents that share a term with the query.

        ``weights`` may be stored ones. The query's terms are literals, so only their postings are read.
        """
        from collections import Counter

        wanted = Counter(w for w in preprocessed_query.split() if len(w) > 1)
        postings = self.weights() if weights is None else weights
        if not wanted:
            return postings.filter(F.lit(False)).select("id", F.lit(0.0).alias("score"))
        # At most as many terms as the query has words.
        known = {r.term: r.idf for r in self.terms.filter(F.col("term").isin(list(wanted))).collect()}
        raw = {t: n * known[t] for t, n in wanted.items() if t in known}
        norm = sum(v * v for v in raw.values()) ** 0.5
        if not raw:
            return postings.filter(F.lit(False)).select("id", F.lit(0.0).alias("score"))
        weight = F.create_map(*(F.lit(x) for t, v in raw.items() for x in (t, v / norm)))
        hits = postings.filter(F.col("term").isin(list(raw)))
        return hits.groupBy("id").agg(_rounded(F.sum(F.col("weight") * weight[F.col("term")])).alias("score"))

    def scores(self, preprocessed_query: str, weights: DataFrame | None = None) -> DataFrame:
        """``id, score`` of every document; 0 without a common term."""
        found = self.matches(preprocessed_query, weights)
        return self.stories.select("id").join(found, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))

    def top(self, preprocessed_query: str, k: int = 10, weights: DataFrame | None = None) -> DataFrame:
        """The ``k`` best ``id, score``, the later id first among equals; documents that score 0 fill the quota."""
        return top_k(self.scores(preprocessed_query, weights), k)


def _rounded(value: Column) -> Column:
    return F.round(value, DECIMALS)


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of ``id, score``; of equal scores the later id first."""
    return scores.orderBy(F.desc("score"), F.desc("id")).limit(k)
