"""op7: near-duplicate documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platewise.llm.common import table
from platewise.llm.minhash import near_duplicates


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, least=85).withColumnRenamed("id", "doc_id")


def near_sql(docs: str, words: int, least: int) -> str:
    """SQL over ``docs``, a SELECT of doc_id, text."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM ({docs})),
sh AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[i:i + {words - 1}], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {least} * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM sym UNION SELECT r.a, l.b FROM reach r JOIN sym l ON r.b = l.a),
comp AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.component_id, w.doc_id) AS component_id, coalesce(comp.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.a = w.doc_id
"""


QUERIES = {"op7_minhash_near_dedup": op7_minhash_near_dedup}
ORACLES = {"op7_minhash_near_dedup": near_sql("SELECT doc_id, text FROM documents", 3, 85)}
