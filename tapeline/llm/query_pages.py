"""op5, op6 and op7: archives, URL verdicts and main texts of all pages, in the contract's columns."""

from pyspark.sql import DataFrame, SparkSession

from tapeline.llm import common, html_text, url_filter, warc

RULES = [
    url_filter.Rule("com", "/en/", False),
    url_filter.Rule("example.com", "/en/7", True),
    url_filter.Rule("net", "/de/", True),
    url_filter.Rule("example.net", "/de/8", False),
    url_filter.Rule("org", "/es/", False),
]


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_path(spark, "warc")
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return warc.read(spark, folder)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


WARC_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
r AS (SELECT h, max(page_id) AS last FROM d WHERE n >= 1000 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM d LEFT JOIN r ON r.h = d.h
"""

URL_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rhost, rpath, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""
