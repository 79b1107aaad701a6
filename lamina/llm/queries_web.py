"""Registered query over web captures.

``pages`` holds neither fetch times nor lists, so both are derived from it: a fetch day from the page id, and
dated entries for sites (host without its first label where that is www, m or blog) and for their parents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import url_filter
from lamina.llm.common import table
from lamina.llm.registry import query

_SQL = r"""
WITH hosts AS (
  SELECT page_id, nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '.'), '') AS host,
         DATE '2024-01-01' + CAST(page_id * 7919 % 400 AS INTEGER) AS fetched
  FROM pages),
sites AS (
  SELECT regexp_replace(host, '^(www|m|blog)\.', '') AS site, min(page_id) AS m, count(*) AS n FROM hosts WHERE host IS NOT NULL GROUP BY 1),
parents AS (
  SELECT regexp_replace(site, '^[^.]+\.', '') AS parent, min(m) AS m FROM sites GROUP BY 1),
entries AS (
  SELECT site AS domain, 'add' AS action, DATE '2024-01-01' + CAST(m * 37 % 300 AS INTEGER) AS dated FROM sites WHERE m % 3 = 0
  UNION SELECT site, 'remove', DATE '2024-01-01' + CAST(m * 37 % 300 + m * 53 % 200 AS INTEGER) FROM sites WHERE m % 3 = 0 AND n % 2 = 0
  UNION SELECT site, 'add', DATE '2024-01-01' + CAST(m * 37 % 300 + m * 53 % 200 + 60 AS INTEGER) FROM sites WHERE m % 3 = 0 AND m % 5 = 0
  UNION SELECT parent, 'add', DATE '2024-01-01' + CAST(m * 11 % 300 AS INTEGER) FROM parents
  UNION SELECT parent, 'remove', DATE '2024-01-01' + CAST(m * 11 % 300 + 10 AS INTEGER) FROM parents),
states AS (SELECT domain, dated, max(action) AS action FROM entries GROUP BY 1, 2),
valid AS (
  SELECT * FROM (SELECT domain, action, dated AS valid_from, lead(dated) OVER (PARTITION BY domain ORDER BY dated) AS valid_to FROM states)
  WHERE action = 'add'),
hits AS (
  SELECT h.page_id, v.domain, v.valid_from, v.valid_to,
         row_number() OVER (PARTITION BY h.page_id ORDER BY length(v.domain) DESC) AS place
  FROM hosts h JOIN valid v
    ON (h.host = v.domain OR ends_with(h.host, '.' || v.domain))
   AND v.valid_from <= h.fetched AND (v.valid_to IS NULL OR h.fetched < v.valid_to))
SELECT h.page_id, h.fetched, x.page_id IS NOT NULL AS blocked, x.domain AS blocked_domain,
       x.valid_from AS blocked_since, x.valid_to AS blocked_until
FROM hosts h LEFT JOIN hits x ON x.page_id = h.page_id AND x.place = 1
"""


def _day(days):
    return F.date_add(F.lit("2024-01-01").cast("date"), days.cast("int"))


def captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", _day(F.col("page_id") * 7919 % 400).alias("fetched"))


def entries(pages: DataFrame) -> DataFrame:
    """Dated list entries of the sites that occur and of their parent domains."""
    site = F.regexp_replace(url_filter.host_of(F.col("url")), r"^(www|m|blog)\.", "")
    sites = (pages.select("page_id", site.alias("site")).where("site is not null")
             .groupBy("site").agg(F.min("page_id").alias("m"), F.count("*").alias("n")))
    parents = sites.groupBy(F.regexp_replace("site", r"^[^.]+\.", "").alias("site")).agg(F.min("m").alias("m"))
    m = F.col("m")
    added, gone = m * 37 % 300, m * 37 % 300 + m * 53 % 200

    def entry(source, action, days):
        return source.select(F.col("site").alias("domain"), F.lit(action).alias("action"), _day(days).alias("dated"))

    listed = sites.where(m % 3 == 0)
    return (entry(listed, "add", added).unionAll(entry(listed.where(F.col("n") % 2 == 0), "remove", gone))
            .unionAll(entry(listed.where(m % 5 == 0), "add", gone + 60))
            .unionAll(entry(parents, "add", m * 11 % 300)).unionAll(entry(parents, "remove", m * 11 % 300 + 10)))


@query("op6_url_filter", _SQL)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each capture was on the list when it was fetched, and by which entry."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(captures(pages), url_filter.intervals(entries(pages))).drop("url")
