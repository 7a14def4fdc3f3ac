"""Archive tables derived from the supplied ones.

Each is one SELECT that Spark and DuckDB both evaluate, so that a query and its SQL start from the same rows. Tables
of the supplied data are written {name}.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIXTURES: dict[str, str] = {
    # Archive index: four instruments, forty volumes; some rows are malformed, some name files to be skipped.
    "image_index": """
SELECT event_id AS row_ord, user_id % 40 AS vol_ord,
  CASE user_id % 4 WHEN 0 THEN 'coiss' WHEN 1 THEN 'gossi' WHEN 2 THEN 'nhlorri' ELSE 'vgiss' END AS instrument,
  CASE user_id % 4 WHEN 0 THEN concat('COISS_', 2001 + user_id % 40) WHEN 1 THEN concat('GO_', lpad(CAST(user_id % 40 AS STRING), 4, '0'))
    WHEN 2 THEN concat('NHJULO_', 1001 + user_id % 40) ELSE concat('VGISS_', 5101 + user_id % 40) END AS volume,
  CASE WHEN event_id % 37 = 5 THEN concat('browse/', event_id, '.IMG')
    WHEN user_id % 4 = 0 THEN concat('data/1294561143_1295221348/', CASE WHEN event_type IN ('click', 'view') THEN 'N' ELSE 'W' END, 1294000000 + event_id * 2, '_1.', CASE WHEN event_id % 41 = 7 THEN 'TXT' ELSE 'IMG' END)
    WHEN user_id % 4 = 1 THEN concat(CASE event_id % 4 WHEN 0 THEN 'G1/IO/' WHEN 1 THEN 'REDO/E4/EUROPA/' WHEN 2 THEN 'EARTH/' ELSE 'X9/IO/' END, 'C', lpad(CAST(349670000 + event_id AS STRING), 10, '0'), 'R.', CASE WHEN event_id % 41 = 7 THEN 'TXT' ELSE 'LBL' END)
    WHEN user_id % 4 = 2 THEN concat('data/20150714_029914/lor_', lpad(CAST(299140000 + event_id AS STRING), 10, '0'), '_0x630_', CASE WHEN event_id % 41 = 7 THEN 'hdr' ELSE 'sci' END, '.lbl')
    ELSE concat('DATA/C20621XX/C', 2000000 + event_id % 1000000, CASE WHEN event_id % 3 = 0 THEN '_RAW' ELSE '_GEOMED' END, '.LBL') END AS filespec,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'BOTSIM' ELSE 'NACONLY' END AS shutter_mode_id
FROM {events}""",
    # One camera's sequence, in time: numbers are seconds divided by the usual gap.
    "sequence": """
SELECT user_id % 12 AS vol_ord, event_id AS row_ord,
  concat(CASE WHEN event_id % 2 = 0 THEN 'N' ELSE 'W' END, 1294000000 + event_id + CAST(floor(value) AS BIGINT) % 3) AS img_name,
  1294000000 + event_id + CAST(floor(value) AS BIGINT) % 3 AS img_num,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'BOTSIM' ELSE 'NACONLY' END AS shutter_mode_id
FROM {events}""",
    # Result documents of the navigation pass.
    "navigation": """
SELECT event_id AS image_ord, concat('v', user_id % 20, '/i', event_id) AS results_path_stub,
  CASE WHEN event_type = 'error' OR event_id % 11 = 3 THEN 'error' ELSE 'success' END AS status,
  CASE WHEN event_id % 11 <> 3 THEN NULL WHEN event_id % 3 = 0 THEN 'SPICE(CKINSUFFDATA): no pointing' WHEN event_id % 3 = 1 THEN 'SPICE(SPKINSUFFDATA) found' ELSE 'cannot read label' END AS status_exception,
  CASE WHEN event_id % 13 = 1 THEN NULL WHEN event_id % 13 = 2 THEN '[1.5]' WHEN event_id % 13 = 3 THEN '["a", 2.0]' ELSE concat('[', CAST(event_id % 7 - 3 AS STRING), '.25, ', CAST(event_id % 5 - 2 AS STRING), '.5]') END AS offset_json,
  concat('t', event_id % 3, '_', CAST(user_id % 5 - 2 AS STRING), '.5_', CAST(event_id % 5 - 2 AS STRING), '.25') AS file_stub,
  CAST(value AS DOUBLE) AS value
FROM {events}""",
    # Metadata of the plane pass, for some of the images; ring pixels; what an inventory knows of some bodies.
    "backplanes": """
SELECT o_custkey AS image_ord, CAST(count(*) AS BIGINT) AS n_planes, max(o_orderstatus) AS kind FROM {orders} GROUP BY o_custkey""",
    "ring_pixels": """
SELECT l_orderkey % 50 AS image_ord, CAST(l_linenumber AS BIGINT) AS ring, l_partkey % 8 AS v, l_suppkey % 8 AS u, CAST(l_quantity AS DOUBLE) AS value, l_returnflag <> 'R' AS valid, CAST(l_quantity AS DOUBLE) * 2.0 AS distance, 'RADIUS' AS plane FROM {lineitem}""",
    "inventory": """
SELECT s_suppkey % 50 AS image_ord, s_suppkey // 50 AS body_ord, s_nationkey * 3 AS center_u, s_nationkey * 5 AS center_v, s_suppkey * 11 AS range, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey + 1 END AS u_pixel_size, s_nationkey + 2 AS v_pixel_size FROM {supplier}""",
    # Catalogues of three ranks on one sphere; jitter makes duplicates between them.
    "stars": """
SELECT 0 AS catalog_rank, 'a' AS catalog, c_custkey AS unique_number, CAST(NULL AS STRING) AS name, CAST((c_custkey * 7919) % 360000 AS DOUBLE) / 1000.0 AS ra, CAST((c_custkey * 104729) % 120000 AS DOUBLE) / 1000.0 - 60.0 AS dec,
  4.0 + CAST((c_custkey * 31) % 800 AS DOUBLE) / 100.0 AS vmag FROM {customer}
UNION ALL
SELECT 1, 'b', p_partkey, concat('P  ', p_partkey, ' '), CAST((p_partkey * 7919) % 360000 AS DOUBLE) / 1000.0 + CAST(p_partkey % 5 AS DOUBLE) / 2000.0, CAST((p_partkey * 104729) % 120000 AS DOUBLE) / 1000.0 - 60.0,
  4.0 + CAST((p_partkey * 31) % 800 AS DOUBLE) / 100.0 + CAST(p_partkey % 4 AS DOUBLE) FROM {part}
UNION ALL
SELECT 2, 'c', s_suppkey, NULL, CAST((s_suppkey * 7919) % 360000 AS DOUBLE) / 1000.0, CAST((s_suppkey * 104729) % 120000 AS DOUBLE) / 1000.0 - 60.0 + CAST(s_suppkey % 3 AS DOUBLE) / 1500.0, 4.0 + CAST((s_suppkey * 31) % 800 AS DOUBLE) / 100.0 FROM {supplier}""",
    # Fields of view; some cross right ascension 0.
    "fields": """
SELECT CAST(n_nationkey AS BIGINT) AS image_ord, concat('f', n_nationkey) AS image_id, CAST((n_nationkey * 47) % 360 AS DOUBLE) AS ra_min, CAST((n_nationkey * 47 + 20) % 360 AS DOUBLE) AS ra_max,
  CAST((n_nationkey * 13) % 90 AS DOUBLE) - 55.0 AS dec_min, CAST((n_nationkey * 13) % 90 AS DOUBLE) - 40.0 AS dec_max FROM {nation}""",
    # The same catalogues with flags; some stars have no magnitude. Cameras of narrow and wide fields around stars.
    "catalog": """
SELECT catalog_rank, unique_number, ra, dec, CASE WHEN unique_number % 29 = 3 THEN NULL ELSE vmag END AS vmag, unique_number % 11 = 4 AS double, CASE WHEN unique_number % 7 = 2 THEN NULL ELSE catalog_rank = 1 AND unique_number % 13 = 5 END AS galaxy
FROM (SELECT 0 AS catalog_rank, c_custkey AS unique_number, CAST((c_custkey * 7919) % 360000 AS DOUBLE) / 1000.0 AS ra, CAST((c_custkey * 104729) % 120000 AS DOUBLE) / 1000.0 - 60.0 AS dec, 4.0 + CAST((c_custkey * 31) % 800 AS DOUBLE) / 100.0 AS vmag FROM {customer}
  UNION ALL SELECT 1, o_orderkey, CAST((o_orderkey * 6151) % 360000 AS DOUBLE) / 1000.0, CAST((o_orderkey * 86028) % 120000 AS DOUBLE) / 1000.0 - 60.0, 4.0 + CAST((o_orderkey * 47) % 1000 AS DOUBLE) / 100.0 FROM {orders}) c""",
    "cameras": """
SELECT image_ord, CASE WHEN ra - half < 0 THEN ra - half + 360.0 ELSE ra - half END AS ra_min, CASE WHEN ra + half >= 360.0 THEN ra + half - 360.0 ELSE ra + half END AS ra_max, dec - half AS dec_min, dec + half AS dec_max,
  CASE WHEN image_ord % 5 = 0 THEN NULL ELSE CAST(image_ord % 6 AS DOUBLE) + 2.5 END AS mag_min, CASE WHEN image_ord % 7 = 0 THEN NULL ELSE CAST(image_ord % 6 AS DOUBLE) + 5.75 END AS mag_max
FROM (SELECT s_suppkey AS image_ord, CAST((s_suppkey * 7919) % 360000 AS DOUBLE) / 1000.0 AS ra, CAST((s_suppkey * 104729) % 120000 AS DOUBLE) / 1000.0 - 60.0 AS dec, CASE s_suppkey % 4 WHEN 0 THEN 0.175 WHEN 1 THEN 0.9 WHEN 2 THEN 3.0 ELSE 12.5 END AS half FROM {supplier}) s""",
    # Features valid between times, open at either end or both; images with times.
    "timed_features": """
SELECT p_partkey AS feature_key, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE SECONDS((1073000000 + (p_partkey * 7919333) % 400000000)) END AS start_time,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE SECONDS((1073000000 + (p_partkey * 7919333) % 400000000 + CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN (p_partkey * 104729) % 100000 WHEN 2 THEN (p_partkey * 104729) % 9000000 ELSE (p_partkey * 7919) % 200000000 END)) END AS end_time FROM {part}""",
    "timed_images": """
SELECT s_suppkey AS image_ord, CASE WHEN s_suppkey % 19 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN SECONDS((1073000000 + (s_suppkey * 7919333) % 400000000)) ELSE SECONDS((1073000000 + (s_suppkey * 15838667) % 400000000)) END AS obs_time FROM {supplier}""",
    # Ring features with a validity and modes; images with a time and a radius range.
    "features": """
SELECT p_partkey AS feature_key, CASE WHEN p_partkey % 7 = 0 THEN 'ARC' WHEN p_partkey % 2 = 0 THEN 'GAP' ELSE 'RINGLET' END AS feature_type, p_name AS name,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 1994 + p_partkey % 7 END AS start_year, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 1997 + p_partkey % 6 END AS end_year,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 80000.0 + CAST((p_partkey * 997) % 60000 AS DOUBLE) END AS inner_a,
  CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE 80000.0 + CAST((p_partkey * 997) % 60000 AS DOUBLE) + CAST(p_size AS DOUBLE) END AS outer_a FROM {part}""",
    "ring_images": """
SELECT n_nationkey AS image_ord, 1995 + n_nationkey % 7 AS obs_year, 75000.0 + CAST(n_nationkey * 1000 AS DOUBLE) AS min_radius, 78000.0 + CAST(n_nationkey * 1700 AS DOUBLE) AS max_radius, 0.5 + CAST(n_nationkey AS DOUBLE) / 10.0 AS resolution FROM {nation}""",
    # Pixels of 8 x 8 planes: fifty images, each with several bodies.
    "pixels": """
SELECT vec_id % 50 AS image_ord, vec_id // 50 AS body_ord, p // 8 AS v, p % 8 AS u, x AS value, x > 0 AS valid, CAST((vec_id * 37) % 100 AS DOUBLE) AS distance
FROM (SELECT vec_id, CAST(px AS BIGINT) AS p, CAST(x AS DOUBLE) AS x FROM {pixel_source}) s""",
    # Pairs of an image and a model, both 8 x 8.
    "trials": """
SELECT l_returnflag AS template, CAST(l_quantity AS BIGINT) % 10 - 5 AS u_offset, l_linenumber - 4 AS v_offset, l_orderkey AS trial_ord, l_linenumber AS line, l_extendedprice / 1000.0 - 40.0 AS diff_u, l_discount * 100.0 - 5.0 AS diff_v, l_tax AS twist FROM {lineitem}""",
}
#: Written differently in the two dialects.
SPARK = {"//": "div", "SECONDS(": "timestamp_seconds(", "{pixel_source}": "(SELECT vec_id, posexplode(embedding) AS (px, x) FROM {embeddings})"}
DUCK = {"SECONDS(": "make_timestamp(1000000 * ", "{pixel_source}": "(SELECT vec_id, unnest(range(len(embedding))) AS px, unnest(embedding) AS x FROM {embeddings})"}


def _written(name: str, words: dict[str, str]) -> str:
    sql = FIXTURES[name]
    for a, b in words.items():
        sql = sql.replace(a, b)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = _written(name, SPARK)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def with_(*names: str) -> str:
    """WITH clause that defines fixtures for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', _written(n, DUCK))})" for n in names)
