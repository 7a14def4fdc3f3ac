"""op5: licences of all documents, laid out as files of a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import table
from platewise.llm.licenses import LEAST_COSINE, TEMPLATES, scan_licenses

# Documents have no paths. Each source is a tree: a thousand ids to a directory and fifty to one below; the first
# document of either is its licence file.
_PATH = """concat(coalesce(source, 'none'), '/d', cast(doc_id div 1000 as string),
  if(doc_id % 1000 = 0, '/LICENSE', concat('/e', cast(doc_id div 50 as string), if(doc_id % 50 = 0, '/LICENSE', concat('/', cast(doc_id as string), '.txt')))))"""


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(_PATH).alias("path"))
    found = scan_licenses(docs)
    # A document without an id has no path; such documents are one file.
    found = found.withColumnRenamed("path", "_path")
    return docs.select("doc_id", "path").join(found, F.col("path").eqNullSafe(F.col("_path"))).drop("_path")


_VALUES = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))
_TERMS = r"regexp_extract_all(lower({}), '[a-z0-9]+(?:\.[0-9]+)*')"
_NAME = r"regexp_extract(path, '([^/]*)$', 1)"

ORACLE = rf"""
WITH t(t, license, text) AS (VALUES {_VALUES}),
tt AS (SELECT t, license, unnest({_TERMS.format("text")}) AS term FROM t),
idf AS (SELECT term, ln((1.0::DOUBLE + {len(TEMPLATES)}) / (1.0::DOUBLE + count(DISTINCT t))) + 1 AS idf FROM tt GROUP BY 1),
tw AS (SELECT t, license, term, count(*) * any_value(idf) AS w FROM tt JOIN idf USING (term) GROUP BY ALL),
tn AS (SELECT t, license, term, w / sqrt(sum(w * w) OVER (PARTITION BY t)) AS w FROM tw),
f AS (SELECT doc_id, text, concat(coalesce(source, 'none'), '/d', doc_id // 1000, CASE WHEN doc_id % 1000 = 0 THEN '/LICENSE' ELSE concat('/e', doc_id // 50,
  CASE WHEN doc_id % 50 = 0 THEN '/LICENSE' ELSE concat('/', doc_id, '.txt') END) END) AS path FROM documents),
held AS (SELECT DISTINCT path, line FROM (
    SELECT path, unnest(string_split(text, chr(10))) AS line FROM f WHERE text IS NOT NULL UNION ALL SELECT path, text FROM f WHERE {_NAME} IN ('LICENSE', 'LICENCE', 'COPYING', 'NOTICE'))
  WHERE regexp_matches(line, '(?i)licen[sc]e|copyright|redistribut|permission is hereby|spdx')),
u AS (SELECT line, term, count(*) AS tf FROM (SELECT line, unnest({_TERMS.format("line")}) AS term FROM (SELECT DISTINCT line FROM held)) GROUP BY ALL),
uw AS (SELECT line, term, tf * coalesce(idf, ln(1.0::DOUBLE + {len(TEMPLATES)}) + 1) AS w FROM u LEFT JOIN idf USING (term)),
un AS (SELECT line, term, w / sqrt(sum(w * w) OVER (PARTITION BY line)) AS w FROM uw),
sc AS (SELECT line, t, license, round(sum(un.w * tn.w), 6) AS score FROM un JOIN tn USING (term) GROUP BY ALL HAVING round(sum(un.w * tn.w), 6) >= {LEAST_COSINE}),
own AS (SELECT path, license AS own, score FROM held JOIN sc USING (line) QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
d AS (SELECT doc_id, path, own, score, regexp_replace(path, '/[^/]*$', '') AS dir FROM f LEFT JOIN own USING (path)),
g AS (SELECT dir AS above, own AS given FROM d WHERE own IS NOT NULL AND {_NAME} = 'LICENSE'),
nr AS (SELECT d.path, g.above, g.given FROM d JOIN g ON starts_with(d.dir || '/', g.above || '/') WHERE d.own IS NULL QUALIFY row_number() OVER (PARTITION BY d.path ORDER BY length(g.above) DESC) = 1)
SELECT doc_id, path, own, score, coalesce(own, given) AS license, CASE WHEN own IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, above AS directory
FROM d LEFT JOIN nr USING (path)
"""

QUERIES = {"op5_licenses": op5_licenses}
ORACLES = {"op5_licenses": ORACLE}
