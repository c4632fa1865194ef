"""The text chain of the index: lower-case, strip to letters, tokenise, drop stop words, stem, join."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from larkspur.functions.stem import stem
from larkspur.functions.unicode import WS, split_words

#: Fixed value: the English stop words without apostrophes (the chain strips those first).
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
    her hers herself it its itself they them their theirs themselves what which who whom this that
    these those am is are was were be been being have has had having do does did doing a an the and
    but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here
    there when where why how all any both each few more most other some such no nor not only own
    same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn
    doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
    """.split()
)


def normalize(text: Column) -> Column:
    """Lower-case, with everything but ``a``-``z`` and whitespace deleted; null for null."""
    return F.regexp_replace(F.lower(text), f"[^a-z{WS}]", "")


def tokenize(text: Column) -> Column:
    """The words between Unicode whitespace, in order, repeats kept; null for null, empty for blank."""
    return split_words(text, WS)


def remove_stop_words(tokens: Column) -> Column:
    """The tokens that are no stop words, in order, repeats kept."""
    return F.filter(tokens, lambda w: ~w.isin(*STOP_WORDS))


def content_tokens(text: Column) -> Column:
    """The chain up to the stemmer."""
    return remove_stop_words(tokenize(normalize(text)))


@F.pandas_udf(StringType())
def stem_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The stems of token arrays, joined by spaces. A task stems each distinct word once, up to a bound of words kept."""
    known: dict[str, str] = {}
    for tokens in batches:
        if len(known) > 500_000:
            known.clear()
        out = []
        for words in tokens:
            if words is None:
                out.append(None)
                continue
            for word in words:
                if word not in known:
                    known[word] = stem(word)
            out.append(" ".join([known[word] for word in words]))
        yield pd.Series(out, dtype=object)


def preprocess(text: Column) -> Column:
    """The whole chain; null for null, empty where no word is left."""
    return stem_tokens(content_tokens(text))


def preprocess_query(text: str) -> str:
    """The whole chain for one query string, on the driver."""
    words = re.sub(r"[^a-z\s]", "", text.lower()).split()
    return " ".join(stem(w) for w in words if w not in STOP_WORDS)
