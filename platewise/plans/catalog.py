"""Queries over the selection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.functions import names as N
from platewise.operators import catalog as C
from platewise.plans.fixtures import fixture, with_

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_TWO, _THREE = (", ".join(f"'{x}'" for x in t) for t in (N.TWO_LEVELS, N.THREE_LEVELS))
_NAMED = with_("image_index") + rf""", parts AS (SELECT *, string_split(filespec, '/') AS s, CASE WHEN upper(string_split(filespec, '/')[1]) = 'REDO' THEN list_slice(string_split(filespec, '/'), 2, 9) ELSE string_split(filespec, '/') END AS r FROM image_index),
held AS (SELECT *, CASE WHEN upper(r[1]) IN ({_TWO}) THEN r[2] WHEN upper(r[1]) IN ({_THREE}) THEN r[3] END AS h FROM parts),
named AS (SELECT *, CASE instrument
    WHEN 'coiss' THEN CASE WHEN len(s) = 3 AND upper(s[1]) = 'DATA' AND length(s[2]) = 21 AND s[2][11] = '_' THEN 'ok' ELSE 'error' END
    WHEN 'gossi' THEN CASE WHEN len(s) NOT BETWEEN 2 AND 4 OR h IS NULL THEN 'error' WHEN suffix(h, '.LBL') THEN 'ok' ELSE 'skip' END
    WHEN 'nhlorri' THEN CASE WHEN len(s) = 3 AND upper(s[1]) = 'DATA' AND length(s[2]) = 15 AND s[2][9] = '_' AND regexp_matches(s[3], '_(sci|eng)\.lbl$') THEN 'ok' ELSE 'error' END
    ELSE CASE WHEN NOT (len(s) = 3 AND upper(s[1]) = 'DATA' AND length(s[2]) = 8 AND s[2][1] = 'C') THEN 'error' WHEN suffix(s[3], '_GEOMED.LBL') THEN 'ok' ELSE 'skip' END END AS o1,
  CASE instrument WHEN 'coiss' THEN string_split(s[3], '.')[1] WHEN 'gossi' THEN regexp_replace(h, '\.[^.]*$', '') WHEN 'nhlorri' THEN substr(s[3], 1, 14) ELSE string_split(s[3], '_GEOMED')[1] END AS nm,
  CASE instrument WHEN 'coiss' THEN regexp_matches(filespec, '\.IMG$') WHEN 'nhlorri' THEN regexp_matches(filespec, '_(sci|eng)\.lbl$') ELSE regexp_matches(filespec, '\.LBL$') END AS good_label FROM held),
entries AS (SELECT row_ord, vol_ord, instrument, volume, filespec, shutter_mode_id, outcome, CASE WHEN good_label THEN lb END AS label,
    CASE WHEN good_label THEN CASE instrument WHEN 'nhlorri' THEN replace(lb, '.lbl', '.fit') ELSE replace(lb, '.LBL', '.IMG') END END AS image, CASE WHEN outcome = 'ok' THEN nm END AS img_name,
    CASE WHEN outcome = 'ok' THEN CAST(CASE instrument WHEN 'nhlorri' THEN substr(nm, 5, 10) WHEN 'vgiss' THEN substr(nm, 2, 7) ELSE substr(nm, 2, 10) END AS BIGINT) END AS img_num,
    regexp_replace(concat(volume, '/', filespec), '\.[^./]*$', '') AS stub
  FROM (SELECT *, CASE WHEN instrument = 'coiss' THEN replace(filespec, '.IMG', '_CALIB.LBL') ELSE filespec END AS lb,
    CASE WHEN o1 <> 'ok' THEN o1 WHEN NOT good_label THEN 'error'
      WHEN NOT regexp_matches(replace(upper(nm), '_CALIB', ''), CASE instrument WHEN 'coiss' THEN '^[NW][0-9]{{10}}(_[0-9]{{1,2}})?$' WHEN 'gossi' THEN '^C[0-9]{{10}}[RS]$' WHEN 'nhlorri' THEN '^LOR_[0-9]{{10}}$' ELSE '^C[0-9]{{7}}$' END) THEN 'error'
      ELSE 'ok' END AS outcome FROM named))
"""
_COLS = "row_ord, vol_ord, volume, img_name, img_num"


def _entries(spark, sf_dir):
    return C.entries(fixture(spark, sf_dir, "image_index"))


def _good(spark, sf_dir):
    return C.quarantine(_entries(spark, sf_dir))[0]


def _cols(df):
    return df.select(*_COLS.split(", "))


@query(_NAMED + "SELECT row_ord, label, image, img_name, img_num, stub, outcome FROM entries")
def p01_p07_entries(spark, sf_dir):
    return _entries(spark, sf_dir).select("row_ord", "label", "image", "img_name", "img_num", "stub", "outcome")


@query(_NAMED + """SELECT DISTINCT volume, v AS volume_path, concat(v, '/', volume, '_index.lbl') AS index_path FROM (SELECT volume, CASE instrument WHEN 'coiss' THEN concat('COISS_', volume[7], 'xxx/', volume)
  WHEN 'gossi' THEN concat('GO_0xxx/', volume) WHEN 'nhlorri' THEN concat('NHxxLO_xxxx/', volume) ELSE concat('VGISS_', volume[7], 'xxx/', volume) END AS v FROM image_index)""")
def p06_volume_paths(spark, sf_dir):
    df, i, v = fixture(spark, sf_dir, "image_index"), F.col("instrument"), F.col("volume")
    return df.select("volume", N.volume_path(i, v).alias("volume_path"), N.index_path(i, v).alias("index_path")).distinct()


@query(_NAMED + """, b AS (SELECT row_ord, img_name, regexp_extract(img_name, '^([^_.]*)', 1) AS base FROM entries WHERE instrument = 'coiss' AND outcome = 'ok'),
  l AS (SELECT *, concat(substr(base, 2), lower(base[1])) AS part, concat(lpad(CAST(CAST(substr(base, 2, 10) AS BIGINT) // 1000000 AS STRING), 4, '0'), 'xxxxxx/', lpad(CAST(CAST(substr(base, 2, 10) AS BIGINT) // 10000 AS STRING), 6, '0'), 'xxxx/') AS dir FROM b)
  SELECT row_ord, concat('urn:nasa:pds:bundle:data:', part) AS data_lid, concat('urn:nasa:pds:bundle:data:', part, '::1.0') AS data_lidvid, concat('urn:nasa:pds:bundle:browse:', part) AS browse_lid, dir AS directory, concat(dir, part) AS stub,
    concat(part, '_backplanes.lblx') AS label_file, concat(part, '_backplanes.fits') AS data_file, concat(part, '_supplemental.txt') AS supplemental_file FROM l""")
def p08_p09_p11_product_ids(spark, sf_dir):
    name, part = F.col("img_name"), N.lid_part(F.col("img_name"))
    df = _good(spark, sf_dir).filter("instrument = 'coiss'")
    files = [F.concat(part, F.lit(f"_{x}")).alias(a) for x, a in (("backplanes.lblx", "label_file"), ("backplanes.fits", "data_file"), ("supplemental.txt", "supplemental_file"))]
    return df.select("row_ord", N.product_id(name, "bundle", "data").alias("data_lid"), N.product_id(name, "bundle", "data", "1.0").alias("data_lidvid"), N.product_id(name, "bundle", "browse").alias("browse_lid"), N.bundle_directory(name).alias("directory"), N.bundle_stub(name).alias("stub"), *files)


_VOLUMES = [f"COISS_{2001 + i}" for i in range(0, 40, 4)]


@query(_NAMED + f"SELECT {_COLS} FROM entries WHERE outcome = 'ok' AND volume IN ('COISS_2001', 'COISS_2009')")
def p20_volume_list(spark, sf_dir):
    return _cols(C.volumes(_good(spark, sf_dir), "COISS_2009, COISS_2001", _VOLUMES))


@query(_NAMED + f"SELECT {_COLS} FROM entries WHERE outcome = 'ok' AND volume BETWEEN 'COISS_2005' AND 'COISS_2021' AND instrument = 'coiss'")
def p21_volume_range(spark, sf_dir):
    return _cols(C.volume_range(_good(spark, sf_dir), "COISS_2005", "COISS_2021", _VOLUMES))


@query(_NAMED + f"SELECT {_COLS} FROM entries WHERE outcome = 'ok' AND instrument = 'coiss' AND img_num BETWEEN 1294000100 AND 1294001500")
def p22_number_range(spark, sf_dir):
    return _cols(C.number_range(_good(spark, sf_dir).filter("instrument = 'coiss'"), 1294000100, 1294001500))


@query(_NAMED + f""", e AS (SELECT * FROM entries WHERE outcome = 'ok' AND instrument = 'coiss'), stop AS (SELECT vol_ord AS sv, row_ord AS sr FROM e WHERE img_num > 1294001500 ORDER BY 1, 2 LIMIT 1)
  SELECT {_COLS} FROM e LEFT JOIN stop ON true WHERE img_num BETWEEN 1294000100 AND 1294001500 AND (sv IS NULL OR vol_ord < sv OR vol_ord = sv AND row_ord < sr)""")
def p23_number_prefix(spark, sf_dir):
    return _cols(C.number_range(_good(spark, sf_dir).filter("instrument = 'coiss'"), 1294000100, 1294001500, cut="prefix"))


@query(_NAMED + f"SELECT {_COLS} FROM entries WHERE outcome = 'ok' AND img_name[1] = 'W'")
def p25_camera(spark, sf_dir):
    return _cols(C.camera(_good(spark, sf_dir), "WAC"))


@query(_NAMED + "SELECT instrument, outcome, count(*) AS n FROM entries WHERE outcome <> 'ok' GROUP BY ALL")
def p26_quarantine(spark, sf_dir):
    return C.quarantine(_entries(spark, sf_dir))[1].groupBy("instrument", "outcome").agg(F.count("*").alias("n"))


@query(_NAMED + f"SELECT {_COLS} FROM entries WHERE outcome = 'ok' ORDER BY vol_ord, row_ord LIMIT 25")
def p27_first_images(spark, sf_dir):
    return _cols(C.first_images(_good(spark, sf_dir), 25, 40, None))


@query(_NAMED + f""", e AS (SELECT *, count(*) OVER (PARTITION BY vol_ord) AS n, (CAST(CAST('0x' || substr(md5(concat(vol_ord, '|', row_ord, '|', 7)), 1, 8) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS q FROM entries WHERE outcome = 'ok')
  SELECT {_COLS} FROM e ORDER BY ln(q) * n DESC, vol_ord, row_ord LIMIT 30""")
def p28_random_images(spark, sf_dir):
    return _cols(C.random_images(_good(spark, sf_dir), 30, seed=7))


_LIKE = "SELECT DISTINCT concat(CASE WHEN event_id % 2 = 0 THEN 'n' ELSE 'W' END, 129400, event_id % 10, substr('0123456789', CAST(event_id % 7 + 1 AS INT), CAST(event_id % 2 + 1 AS INT))) AS name FROM events WHERE event_type = 'error'"


@query(_NAMED + f", want AS ({_LIKE}) SELECT {_COLS} FROM entries e WHERE outcome = 'ok' AND EXISTS (SELECT 1 FROM want WHERE starts_with(lower(e.img_name), lower(want.name)))")
def j01_names(spark, sf_dir):
    names = spark.sql(_LIKE.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return _cols(C.named_like(_good(spark, sf_dir), names))


@query(_NAMED + f"SELECT {_COLS} FROM entries e WHERE outcome = 'ok' AND regexp_replace(filespec, '\\.[^./]*$', '') IN (SELECT regexp_replace(filespec, '\\.[^./]*$', '') FROM image_index WHERE row_ord % 9 = 0)")
def j02_specs(spark, sf_dir):
    wanted = fixture(spark, sf_dir, "image_index").filter("row_ord % 9 = 0").select(F.regexp_replace("filespec", r"\.[^./]*$", ".XYZ").alias("filespec"))
    return _cols(C.with_specs(_good(spark, sf_dir), wanted))


@query(with_("sequence") + """, RECURSIVE_BASE AS (SELECT 1), l AS (SELECT *, CASE WHEN shutter_mode_id = 'BOTSIM' AND lag(shutter_mode_id) OVER w = 'BOTSIM' AND abs(img_num - lag(img_num) OVER w) <= 30 THEN 0 ELSE 1 END AS nw, coalesce(lead(shutter_mode_id) OVER w = 'BOTSIM', false) AS nx FROM sequence WINDOW w AS (PARTITION BY vol_ord ORDER BY row_ord)),
  r AS (SELECT *, sum(nw) OVER (PARTITION BY vol_ord ORDER BY row_ord ROWS UNBOUNDED PRECEDING) AS run FROM l),
  i AS (SELECT *, row_number() OVER (PARTITION BY vol_ord, run ORDER BY row_ord) - 1 AS i, count(*) OVER (PARTITION BY vol_ord, run) AS n FROM r),
  s AS (SELECT *, i % 2 = 0 AND i = n - 1 AS single, i // 2 AS pr FROM i),
  k AS (SELECT *, first(img_name) OVER p AS fn, first(row_ord) OVER p AS grp FROM s WHERE NOT (single AND shutter_mode_id = 'BOTSIM' AND nx) WINDOW p AS (PARTITION BY vol_ord, run, pr ORDER BY row_ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
  SELECT row_ord, grp, CAST(CASE WHEN NOT starts_with(fn, 'N') AND NOT single THEN 1 - i % 2 ELSE i % 2 END AS BIGINT) AS place FROM k""".replace("RECURSIVE_BASE AS (SELECT 1), ", ""))
def w01_pairs(spark, sf_dir):
    return C.pair_exposures(fixture(spark, sf_dir, "sequence"), slop=30).select("row_ord", "grp", "place")


_REGISTRY = [("coiss", "ArchiveIndex", "iss"), ("gossi", "ArchiveIndex", "ssi"), ("nhlorri", "ArchiveIndex", "lorri"), ("sim", "Simulated", "sim")]


@query(_NAMED + f"""SELECT i.instrument AS dataset, d.c AS dataset_class, d.n AS instrument, count(*) AS images FROM image_index i LEFT JOIN (VALUES {', '.join(map(str, _REGISTRY))}) d(dataset, c, n) ON d.dataset = i.instrument GROUP BY ALL""")
def j19_registry(spark, sf_dir):
    df = fixture(spark, sf_dir, "image_index").select(F.col("instrument").alias("dataset"))
    return C.registry(_REGISTRY, df).groupBy("dataset", "dataset_class", "instrument").agg(F.count("*").alias("images"))
