"""op3: all documents mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platewise.llm.common import table
from platewise.llm.mixture import mix_sources


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))[0].drop("source")


def mixture_sql(sized: str) -> str:
    """SQL over ``sized``, a SELECT of doc_id, source, size; doc_id must be unique."""
    return f"""
WITH sized AS ({sized}),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM s0),
s2 AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s1),
s3 AS (SELECT *, CAST((SELECT sum(source_size) FROM s2) - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl FROM s2),
s4 AS (SELECT *, coalesce(least(CAST(cap AS DOUBLE), (SELECT lvl FROM s3 WHERE cap >= lvl * weight ORDER BY cap / weight, sid LIMIT 1) * weight), 0.0) AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(greatest(1, round(source_size / greatest(32.0::DOUBLE, source_size / 131072.0::DOUBLE))) AS BIGINT) ELSE 0 END AS blocks FROM s4),
s6 AS (SELECT *, CASE WHEN blocks > 0 THEN CAST(round(target * blocks / source_size) AS BIGINT) ELSE 0 END AS wanted FROM s5),
s7 AS (SELECT *, CAST(sum(wanted) OVER (ORDER BY sid ROWS UNBOUNDED PRECEDING) - wanted AS BIGINT) AS lo FROM s6),
pts AS (SELECT i, CAST((CAST(i AS HUGEINT) * 712544676207699905) % 1152921504606846976 AS BIGINT) AS p FROM range((SELECT CAST(coalesce(sum(wanted), 0) AS BIGINT) FROM s7)) t(i)),
s8 AS (SELECT *, CAST(CAST(lo AS HUGEINT) * 1152921504606846976 // (SELECT greatest(1, sum(wanted)) FROM s7)::HUGEINT AS BIGINT) AS p0,
  CAST(CAST(lo + wanted AS HUGEINT) * 1152921504606846976 // (SELECT greatest(1, sum(wanted)) FROM s7)::HUGEINT AS BIGINT) AS p1 FROM s7),
sl AS (SELECT sid, blocks, row_number() OVER (PARTITION BY sid ORDER BY i) - 1 AS rnk FROM pts JOIN s8 ON p >= p0 AND p < p1),
tm AS (SELECT sid, rnk % blocks AS block, count(*) AS times FROM sl WHERE rnk < 3 * blocks GROUP BY ALL),
d AS (SELECT doc_id, size, s7.*, CAST(sum(size) OVER (PARTITION BY sid ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS a
  FROM sized JOIN s7 ON sized.source IS NOT DISTINCT FROM s7.source),
bl AS (SELECT sid, b, CASE WHEN b < source_size % blocks THEN b * (source_size // blocks + 1) ELSE source_size % blocks + b * (source_size // blocks) END AS b0,
    source_size // blocks + CASE WHEN b < source_size % blocks THEN 1 ELSE 0 END AS n FROM (SELECT *, unnest(range(blocks)) AS b FROM s7)),
pc AS (SELECT doc_id, sum((least(b0 + n, a + size) - greatest(b0, a)) * times) AS taken
  FROM d JOIN bl ON d.sid = bl.sid AND b0 < a + size AND b0 + n > a JOIN tm ON tm.sid = bl.sid AND tm.block = bl.b GROUP BY 1)
SELECT d.doc_id, d.size, d.source_size, d.target, CAST(coalesce(pc.taken, 0) AS BIGINT) AS taken FROM d LEFT JOIN pc USING (doc_id)
"""


ORACLE = mixture_sql(r"SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents")

QUERIES = {"op3_mix_sources": op3_mix_sources}
ORACLES = {"op3_mix_sources": ORACLE}
