"""op13: divergence of the sources of all documents, in the contract's columns, and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from tapeline.llm import divergence


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), kept AS (
  SELECT lang, term, count(*) OVER (PARTITION BY lang) AS terms
  FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM docs) GROUP BY lang, term HAVING count(*) >= 10
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(words) AS term FROM docs) GROUP BY lang, source, term
), dense AS (
  SELECT lang, source, term, terms, coalesce(n, 0)::HUGEINT AS n
  FROM groups JOIN kept USING (lang) LEFT JOIN counted USING (lang, source, term)
), shares AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * terms)::HUGEINT AS p FROM dense
), of_lang AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * terms)::HUGEINT AS q
  FROM (SELECT lang, term, any_value(terms) AS terms, sum(n) AS n FROM dense GROUP BY lang, term)
), pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(v.value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  ) v ON v.lang = g.lang AND v.source = g.source AND v.item = h.source
), used AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares JOIN of_lang USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value::BIGINT, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM used
) WHERE rank <= 10
"""
