"""The queries of this subpackage and their SQL counterparts, for the repository's entry point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.eval_leaks import eval_leaks
from larkspur.llm.formatting_duplicates import formatting_duplicates
from larkspur.llm.garbled_text import GarbledText
from larkspur.llm.heavy_hitters import heavy_hitters
from larkspur.llm.mixing import Mixture
from larkspur.llm.nearest_vectors import nearest_vectors, recall
from larkspur.llm.seen_before import SeenBefore
from larkspur.llm.term_frequency import term_frequency
from larkspur.sources.tables import table


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    records = formatting_duplicates(table(spark, directory, "search_analytics"))
    return records.filter(F.col("n_spellings") > 1).select("first_id", "n_copies")


def p1_records(spark: SparkSession, directory: str) -> DataFrame:
    return formatting_duplicates(table(spark, directory, "search_analytics"))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return p2_terms(spark, directory).filter(F.col("mark").isNotNull()).select("term", "mark")


def p2_terms(spark: SparkSession, directory: str) -> DataFrame:
    return term_frequency(table(spark, directory, "stories"))


def _close(vectors: DataFrame) -> DataFrame:
    # Neighbours as close as this share nearly all of their lists, so fewer need be searched.
    return nearest_vectors(vectors, k=10, least_similarity=0.8, probe=1.1)


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    near = _close(table(spark, directory, "story_vectors"))
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p3_recall(spark: SparkSession, directory: str) -> DataFrame:
    """How many of the true ten most similar vectors are found, of all and of those at least 0.8 alike, by brute force for
    all queries whose id is divisible by 100."""
    vectors = table(spark, directory, "story_vectors")
    every = recall(vectors, nearest_vectors(vectors, k=10), k=10).withColumn("least_similarity", F.lit(-1.0))
    close = recall(vectors, _close(vectors), k=10, least_similarity=0.8).withColumn("least_similarity", F.lit(0.8))
    return every.unionByName(close)


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return heavy_hitters(table(spark, directory, "search_analytics")).select(F.col("value").alias("query"))


def p4_counts(spark: SparkSession, directory: str) -> DataFrame:
    return heavy_hitters(table(spark, directory, "search_analytics"))


def _seen(spark: SparkSession, directory: str) -> SeenBefore:
    return SeenBefore(table(spark, directory, "stories"), table(spark, directory, "crawl_items"))


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return _seen(spark, directory).answers().filter("seen").select(F.col("arrival").alias("arrival_no"))


def p5_rates(spark: SparkSession, directory: str) -> DataFrame:
    return _seen(spark, directory).report()


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    return p6_passages(spark, directory).select("item_id", "doc_id").distinct()


def p6_passages(spark: SparkSession, directory: str) -> DataFrame:
    return eval_leaks(table(spark, directory, "documents"), table(spark, directory, "eval_items"))


def _mixture(spark: SparkSession, directory: str) -> Mixture:
    return Mixture(table(spark, directory, "documents"), table(spark, directory, "mix_targets"))


def p7_mixture(spark: SparkSession, directory: str) -> DataFrame:
    return _mixture(spark, directory).documents()


def p7_shares(spark: SparkSession, directory: str) -> DataFrame:
    return _mixture(spark, directory).shares()


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return GarbledText(table(spark, directory, "documents")).found()


def p8_restored(spark: SparkSession, directory: str) -> DataFrame:
    return GarbledText(table(spark, directory, "documents")).restored()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = [
        p1_found, p1_records, p2_found, p2_terms, p3_found, p3_recall, p4_found, p4_counts,
        p5_found, p5_rates, p6_found, p6_passages, p7_mixture, p7_shares, p8_found, p8_restored,
    ]
    return {query.__name__: query for query in listed}


_WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _words(text: str) -> str:
    folded = f"replace(lower({text}), 'ς', 'σ')"
    return rf"trim(regexp_replace({folded}, '[{_WS}\p{{P}}]+', ' ', 'g'))"


_RECORDS = rf"""
WITH rows AS (
  SELECT DISTINCT id, query FROM search_analytics
  WHERE id IS NOT NULL AND regexp_matches(query, '[\p{{L}}\p{{N}}]')
), parts AS (
  SELECT DISTINCT query, contains(query, '=') AS is_line,
         unnest(CASE WHEN contains(query, '=') THEN string_split(query, '&') ELSE [query] END) AS part,
         generate_subscripts(CASE WHEN contains(query, '=') THEN string_split(query, '&') ELSE [query] END, 1) AS pos
  FROM rows
), named AS (
  SELECT query, is_line, pos, CASE
    WHEN NOT is_line THEN {_words('part')}
    WHEN contains(part, '=') THEN {_words("left(part, instr(part, '=') - 1)")} || chr(1) || {_words("substr(part, instr(part, '=') + 1)")}
    ELSE chr(2) || {_words('part')} END AS field
  FROM parts
), keyed AS (
  SELECT query, is_line, string_agg(field, '&' ORDER BY field) FILTER (WHERE field NOT IN (chr(1), chr(2))) AS fields
  FROM named GROUP BY query, is_line
), records AS (
  SELECT min(id) AS first_id, count(DISTINCT id) AS n_copies, count(DISTINCT query) AS n_spellings, min(query) AS example
  FROM rows JOIN keyed USING (query) GROUP BY is_line, fields
)
"""

_TERMS = rf"""
WITH texts AS (
  SELECT id, min(preprocessed_text) AS text FROM stories
  WHERE id IS NOT NULL AND preprocessed_text IS NOT NULL GROUP BY id
), tokens AS (
  SELECT id, unnest(regexp_split_to_array(text, '[{_WS}]+')) AS term FROM texts
), counts AS (
  SELECT term, count(*) AS occurrences, count(DISTINCT id) AS n_records FROM tokens WHERE term <> '' GROUP BY term
), terms AS (
  SELECT term, occurrences, n_records, CASE
    WHEN n_records <= 2 THEN 'rare'
    WHEN n_records * 6 >= (SELECT count(*) FROM texts) THEN 'common' END AS mark
  FROM counts
)
"""

_NEAR = """
WITH vectors AS (
  SELECT id, any_value(embedding)::DOUBLE[] AS v FROM story_vectors WHERE id IS NOT NULL AND embedding IS NOT NULL GROUP BY id
), usable AS (SELECT id, v FROM vectors WHERE list_max(list_transform(v, lambda x: abs(x))) > 0),
near AS (
  SELECT a.id, b.id AS other, list_cosine_similarity(a.v, b.v) AS similarity FROM usable a JOIN usable b ON a.id <> b.id
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY similarity DESC) <= 10
)
SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM near WHERE similarity >= 0.8
"""

_FREQUENT = r"""
WITH rows AS (SELECT DISTINCT id, query FROM search_analytics WHERE id IS NOT NULL)
SELECT query FROM rows WHERE regexp_matches(query, '[\p{L}\p{N}]')
GROUP BY query HAVING count(*) * 200 >= (SELECT count(DISTINCT id) FROM rows)
"""

_SEEN = """
WITH firsts AS (SELECT id, min(arrival_no) AS first FROM crawl_items WHERE id IS NOT NULL GROUP BY id)
SELECT arrival_no FROM crawl_items JOIN firsts USING (id)
WHERE arrival_no > first OR id IN (SELECT id FROM stories)
"""

_LEAKS = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(replace(lower(replace(text, 'ß', 'ss')), 'ς', 'σ'), '[\p{L}\p{N}]+') AS words FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(replace(lower(replace(text, 'ß', 'ss')), 'ς', 'σ'), '[\p{L}\p{N}]+') AS words FROM eval_items
), doc_at AS (SELECT doc_id, words, unnest(range(1, len(words) - 10)) AS pos FROM docs),
item_at AS (SELECT item_id, words, unnest(range(1, len(words) - 10)) AS pos FROM items)
SELECT DISTINCT item_id, doc_id
FROM (SELECT doc_id, array_to_string(words[pos:pos + 11], ' ') AS passage FROM doc_at)
JOIN (SELECT item_id, array_to_string(words[pos:pos + 11], ' ') AS passage FROM item_at) USING (passage)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _RECORDS + "SELECT first_id, n_copies FROM records WHERE n_spellings > 1",
        "p1_records": _RECORDS + "SELECT first_id, n_copies, n_spellings, example FROM records",
        "p2_found": _TERMS + "SELECT term, mark FROM terms WHERE mark IS NOT NULL",
        "p2_terms": _TERMS + "SELECT term, occurrences, n_records, mark FROM terms",
        "p3_found": _NEAR,
        "p4_found": _FREQUENT,
        "p5_found": _SEEN,
        "p6_found": _LEAKS,
    }
