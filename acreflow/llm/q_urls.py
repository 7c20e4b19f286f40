"""op10: every page's URL against dated lists, as of its fetch day."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreflow.llm import urls
from acreflow.llm.common import table

# Events of three lists (list, domain, prefix, action, day).
EVENTS = (
    ("adult", "adult-cams.example.com", "", "add", "2024-03-01"),
    ("gambling", "casino-win.example.com", "", "add", "2024-01-15"),
    ("gambling", "casino-win.example.com", "", "remove", "2024-04-01"),
    ("gambling", "casino-win.example.com", "", "add", "2024-06-10"),
    ("gambling", "free-bets.example.com", "", "add", "2024-02-20"),
    ("gambling", "free-bets.example.com", "/de", "add", "2024-01-01"),
    ("spam", "cheap-pills.example.com", "", "add", "2023-11-05"),
    ("spam", "cheap-pills.example.com", "", "remove", "2024-09-30"),
    ("spam", "casino-win.example.com", "/en", "add", "2024-04-15"),
    ("spam", "thther.example.org", "/en", "add", "2024-05-05"),
    ("spam", "thther.example.org", "/en", "remove", "2024-05-25"),
    ("spam", "thering.example.org", "", "add", "2024-07-01"),
    ("spam", "thering.example.org", "", "remove", "2024-07-01"),
)
#: Pages carry no fetch time: page i counts as fetched on day i mod 366 of 2024.
FIRST_DAY, DAYS = "2024-01-01", 366


def events(spark: SparkSession) -> DataFrame:
    rows = [(*e[:4], datetime.date.fromisoformat(e[4])) for e in EVENTS]
    return spark.createDataFrame(rows, "list string, domain string, prefix string, action string, day date")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.select(F.col("page_id").alias("id"), "url", F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("page_id") % DAYS).cast("int")).alias("fetched"))
    return urls.screened(captures, events(spark)).select(F.col("id").alias("page_id"), "url", F.col("fetched").cast("string").alias("fetched"), "host", "blocked", F.col("n_entries").cast("long").alias("n_entries"), "lists")


_VALUES = ", ".join(f"('{a}', '{b}', '{c}', '{d}', DATE '{e}')" for a, b, c, d, e in EVENTS)
SQL = f"""
WITH ev(list, domain, prefix, action, day) AS (VALUES {_VALUES}),
daily AS (SELECT list, domain, prefix, day, bool_or(action = 'remove') removed FROM ev GROUP BY ALL),
spans AS (SELECT *, lead(day) OVER (PARTITION BY list, domain, prefix ORDER BY day) valid_to FROM daily),
caps AS (
  SELECT DISTINCT page_id, url, DATE '{FIRST_DAY}' + CAST(page_id % {DAYS} AS INTEGER) fetched,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '[.]$', ''), '') host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) path
  FROM pages),
hits AS (
  SELECT DISTINCT c.page_id, c.url, c.fetched, s.list, s.domain || s.prefix target
  FROM caps c JOIN spans s ON (c.host = s.domain OR ends_with(c.host, '.' || s.domain))
   AND (s.prefix = '' OR c.path = s.prefix OR starts_with(c.path, s.prefix || '/'))
   AND NOT s.removed AND c.fetched >= s.day AND (s.valid_to IS NULL OR c.fetched < s.valid_to)),
n AS (SELECT page_id, url, fetched, count(*) n_entries, string_agg(DISTINCT list, ',' ORDER BY list) lists FROM hits GROUP BY ALL)
SELECT c.page_id, c.url, CAST(c.fetched AS VARCHAR) fetched, c.host, n.n_entries IS NOT NULL blocked,
  coalesce(n.n_entries, 0) n_entries, coalesce(n.lists, '') lists
FROM caps c LEFT JOIN n ON c.page_id IS NOT DISTINCT FROM n.page_id AND c.url IS NOT DISTINCT FROM n.url AND c.fetched IS NOT DISTINCT FROM n.fetched
"""

QUERIES = {"op10_url_filter": op10_url_filter}
ORACLES = {"op10_url_filter": SQL}
