"""op11: documents drawn towards the benchmark's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acreflow.llm import importance
from acreflow.llm.common import table


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The CRC of each distinct word, byte by byte, by the table of the reflected polynomial.
SQL = f"""
WITH RECURSIVE bits(b, k, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT b, c FROM bits WHERE k = 8),
dw AS (SELECT doc_id, unnest({_WORDS}) w FROM documents),
bw AS (SELECT unnest({_WORDS}) w FROM benchmark),
ws AS (SELECT w, hex(encode(w)) x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
run(w, x, p, c) AS (
  SELECT w, x, 1, 4294967295 FROM ws UNION ALL
  SELECT w, x, p + 2, xor(crc.c, run.c >> 8) FROM run JOIN crc ON crc.b = xor(run.c & 255, CAST('0x' || substr(x, p, 2) AS BIGINT)) WHERE p < length(x)),
bk AS (SELECT w, xor(c, 4294967295) % 10000 b FROM run WHERE p > length(x)),
s AS (SELECT b, count(*) n FROM dw JOIN bk USING (w) GROUP BY 1),
t AS (SELECT b, count(*) n FROM bw JOIN bk USING (w) GROUP BY 1),
g AS (SELECT s.b, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * ((SELECT sum(n) FROM s) + 10000) / (CAST(s.n + 1 AS DOUBLE) * (coalesce((SELECT sum(n) FROM t), 0) + 10000)))) AS BIGINT) gain FROM s LEFT JOIN t USING (b)),
f AS (SELECT doc_id, count(*) n, sum(gain) weight FROM dw JOIN bk USING (w) JOIN g USING (b) GROUP BY 1),
sc AS (SELECT d.doc_id, coalesce(f.n, 0) n_features, CAST(coalesce(weight, 0) AS BIGINT) weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) score
  FROM documents d LEFT JOIN f USING (doc_id)),
rk AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) r, count(*) OVER () n FROM sc WHERE n_features >= 20)
SELECT sc.doc_id, n_features, weight, score, CASE WHEN r <= n * 10 // 100 THEN r END AS rank FROM sc LEFT JOIN rk USING (doc_id)
"""

QUERIES = {"op11_importance_resampling": op11_importance_resampling}
ORACLES = {"op11_importance_resampling": SQL}
