"""op11: collocations by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platewise.llm.common import table
from platewise.llm.phrases import collocations


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY 1),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
f AS (SELECT lang, phrase, max(m) AS m, CAST(count(*) AS HUGEINT) AS a FROM grams GROUP BY lang, phrase HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS s FROM f WHERE m > 1),
cuts AS (SELECT lang, phrase, a, k, array_to_string(s[1:k], ' ') AS p, array_to_string(s[k + 1:m], ' ') AS q FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, x.a AS l, y.a AS r, n, (1000 * cuts.a * n) // (x.a * y.a) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p JOIN f y ON y.lang = cuts.lang AND y.phrase = q JOIN totals ON totals.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT lang, array_to_string(s[i:i + j - 1], ' ') AS phrase, a FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM c WHERE m > 2))),
over AS (SELECT lang, phrase, max(a) AS over FROM held GROUP BY ALL),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM best b LEFT JOIN over o ON o.lang = b.lang AND o.phrase = b.phrase WHERE over IS NULL OR 100 * over < 100 * b.a)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

QUERIES = {"op11_collocations": op11_collocations}
ORACLES = {"op11_collocations": ORACLE}
