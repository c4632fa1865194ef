"""Pages of a ranked result, and how a result card shows a story."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def depth(page: int, page_size: int) -> int:
    """How many results a page needs. Pages and sizes below 1 are rejected."""
    if page < 1 or page_size < 1:
        raise ValueError(f"page and page_size must be at least 1, not {page} and {page_size}")
    return page * page_size


def page_rows(ranked: DataFrame, page: int = 1, page_size: int = 5) -> DataFrame:
    """The rows of one page of a result with a ``place`` from 1."""
    last = depth(page, page_size)
    return ranked.filter(F.col("place").between(last - page_size + 1, last))


def page_meta(ranked: DataFrame, page: int = 1, page_size: int = 5) -> DataFrame:
    """``page, page_size, total, total_pages``: the total is of the results up to this page, not of all matches."""
    total = F.count_if(F.col("place") <= depth(page, page_size))
    return ranked.agg(total.alias("total")).select(
        F.lit(page).alias("page"), F.lit(page_size).alias("page_size"), "total", F.ceil(F.col("total") / page_size).alias("total_pages")
    )


def page_buttons(meta: DataFrame, most: int = 5) -> DataFrame:
    """``button, is_current`` of the pager: the first pages, none when there is only one."""
    shown = F.when(F.col("total_pages") > 1, F.sequence(F.lit(1), F.least(F.col("total_pages"), F.lit(most)).cast("int")))
    return meta.select("page", F.explode(shown).alias("button")).select("button", (F.col("button") == F.col("page")).alias("is_current"))


def snippet(text: Column, length: int = 160) -> Column:
    """The first ``length`` characters, with dots if there are more."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def score_label(score: Column) -> Column:
    """The score in percent with one decimal; null for 0 or null."""
    return F.when(score != 0, F.format_string("%.1f", F.round(score * 100, 1).cast("double")))


def date_label(timestamp: Column) -> Column:
    """The date of an instant, in the session's time zone."""
    return F.date_format(timestamp, "yyyy-MM-dd")


def url_part(text: Column) -> Column:
    """A string percent-encoded for a URL, spaces as ``%20``."""
    unreserved = (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"))
    encoded = F.url_encode(text)
    for written, wanted in unreserved:
        encoded = F.replace(encoded, F.lit(written), F.lit(wanted))
    return encoded


def result_cards(results: DataFrame) -> DataFrame:
    """``place, id, title, snippet, score_label, url`` of results joined with their stories."""
    return results.select("place", "id", "title", snippet(F.col("text")).alias("snippet"), score_label(F.col("final_score")).alias("score_label"), "url")
