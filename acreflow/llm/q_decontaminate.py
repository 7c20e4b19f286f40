"""op13: words of all documents inside ten-word windows of the benchmark's items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreflow.llm import decontaminate
from acreflow.llm.common import table


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH b AS (SELECT item_id, {_WORDS} w FROM benchmark),
bn AS (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + 10], ' ') g, least(len(w), 10) m FROM bn),
sizes AS (SELECT DISTINCT m FROM win),
d AS (SELECT doc_id, {_WORDS} w FROM documents),
dn AS (SELECT doc_id, w, m, unnest(range(len(w) - m + 1)) i FROM d, sizes WHERE len(w) >= m),
dg AS (SELECT doc_id, i, m, array_to_string(w[i + 1 : i + m], ' ') g FROM dn),
hit AS (SELECT doc_id, i, dg.m, item_id FROM dg JOIN win ON win.g = dg.g AND win.m = dg.m),
nh AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest(range(i, i + m)) p FROM hit) GROUP BY 1),
ni AS (SELECT doc_id, count(*) n, sha256(string_agg(item_id, ',' ORDER BY item_id)) s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w) n_words, coalesce(nh.n, 0) n_hit, coalesce(ni.n, 0) n_items, coalesce(s, sha256('')) items_sha256, nh.n IS NOT NULL contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""

QUERIES = {"op13_decontaminate": op13_decontaminate}
ORACLES = {"op13_decontaminate": SQL}
