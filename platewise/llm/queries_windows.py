"""op13: passages of fifty words that a smaller document holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platewise.llm.common import table
from platewise.llm.windows import remove_passages


def op13_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id").drop("kept")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM places),
least AS (SELECT h, min(doc_id) AS d FROM windows GROUP BY h),
starts AS (SELECT doc_id, i FROM windows JOIN least USING (h) WHERE d < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
marked AS (SELECT e.doc_id, e.i, word, max(CASE WHEN s.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY e.doc_id ORDER BY e.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM each e LEFT JOIN starts s ON s.doc_id = e.doc_id AND s.i = e.i),
sums AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i) AS kept FROM marked GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN sums USING (doc_id)
"""

QUERIES = {"op13_passage_dedup": op13_passage_dedup}
ORACLES = {"op13_passage_dedup": ORACLE}
