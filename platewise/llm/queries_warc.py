"""op2: pages written as archives and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platewise.llm.common import landed, table
from platewise.llm.warc import read_archives, write_archives


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = landed(write_archives(table(spark, sf_dir, "pages")), "archives")
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  list_reduce(list_transform(range(8), lambda i: list_reduce(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, i * 5 + 1, 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1)), lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM f
"""

QUERIES = {"op2_warc": op2_warc}
ORACLES = {"op2_warc": ORACLE}
