"""Queries over observations, labels, time scales, stars and rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.functions import formats as X
from platewise.functions import labels as B
from platewise.functions import names as N
from platewise.functions import rings as M
from platewise.functions import times as T
from platewise.operators import fields as L
from platewise.operators import rings as G
from platewise.operators import stars as S
from platewise.plans.catalog import _NAMED, _entries
from platewise.plans.fixtures import fixture, table, with_

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_DAYS = ", ".join(f"('{d}')" for d in T.LEAP_DAYS)
# Times from 1997 on, one per event.
_ET = f"""WITH lp AS (SELECT epoch(CAST(d AS TIMESTAMP)) AS s FROM (VALUES {_DAYS}) t(d)), tm AS (SELECT event_id AS image_ord, user_id, event_type, value, ts - to_days(CAST(event_id % 10000 AS INTEGER)) AS utc FROM events),
  sc AS (SELECT *, epoch_us(utc) / 1e6 AS s FROM tm), tt AS (SELECT *, s + 9 + (SELECT count(*) FROM lp WHERE lp.s <= sc.s) + 32.184::DOUBLE - 946728000 AS tt FROM sc),
  et AS (SELECT *, tt + 1.657e-3 * sin(6.239996::DOUBLE + 1.99096871e-7 * tt + 1.671e-2 * sin(6.239996::DOUBLE + 1.99096871e-7 * tt)) AS et FROM tt)"""


def _times(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_id", "image_ord")
    utc = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) - (F.col("image_ord") % 10000) * 86400000000)
    return e.withColumn("utc", utc).withColumn("et", T.et_from_utc(utc))


@query(_ET + " SELECT image_ord, round(et, 4) AS et, strftime(make_timestamp(CAST(round(epoch_us(utc) / 1000.0) * 1000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%g') AS text FROM et")
def f04_times(spark, sf_dir):
    return _times(spark, sf_dir).select("image_ord", F.round("et", 4).alias("et"), T.utc_from_et(F.col("et")).alias("text"))


@query("""WITH d AS (SELECT event_id, (event_id * 7919 * 1000000 + user_id) % 400000000000 AS us FROM events)
  SELECT event_id, CASE us // 86400000000 WHEN 0 THEN '' WHEN 1 THEN '1 day, ' ELSE concat(us // 86400000000, ' days, ') END || (us % 86400000000 // 3600000000) || printf(':%02d:%02d', us // 60000000 % 60, us // 1000000 % 60) || CASE WHEN us % 1000000 = 0 THEN '' ELSE printf('.%06d', us % 1000000) END AS elapsed FROM d""")
def f05_elapsed(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("us", (F.col("event_id") * 7919 * 1000000 + F.col("user_id")) % 400000000000)
    return e.select("event_id", T.elapsed(F.timestamp_micros(F.lit(0).cast("long")), F.timestamp_micros("us")).alias("elapsed"))


def _observations(spark, sf_dir):
    kinds = F.element_at(F.array(*(F.lit(k) for k in ("coiss", "vgiss", "gossi", "nhlorri"))), (F.col("user_id") % 4 + 1).cast("int"))
    o = _times(spark, sf_dir).withColumns({"instrument": kinds, "detector": F.when(F.col("image_ord") % 2 == 0, "NAC").otherwise("WAC"), "spacecraft": F.col("user_id") % 2 + 1})
    return o.withColumns({"image_url": F.concat(F.lit("archive/v/i"), "image_ord", F.lit(".img")), "start_et": F.col("et"), "end_et": F.col("et") + 8, "clock_start": F.col("image_ord").cast("string"), "clock_stop": (F.col("image_ord") + 9).cast("string"), "exposure": F.col("value"), "filters": F.array("event_type")})


@query(_ET + """, o AS (SELECT *, ['coiss', 'vgiss', 'gossi', 'nhlorri'][user_id % 4 + 1] AS kind, CASE WHEN image_ord % 2 = 0 THEN 'NAC' ELSE 'WAC' END AS det FROM et)
  SELECT image_ord, concat('i', image_ord, '.img') AS image_name, concat('urn:nasa:pds:context:instrument_host:spacecraft.', CASE kind WHEN 'coiss' THEN 'co' WHEN 'vgiss' THEN concat('vg', user_id % 2 + 1) WHEN 'gossi' THEN 'go' ELSE 'nh' END) AS instrument_host_lid,
  concat('urn:nasa:pds:context:instrument:', CASE kind WHEN 'coiss' THEN concat('iss', lower(det[1]), 'a.co') WHEN 'vgiss' THEN concat('vg', user_id % 2 + 1, '.iss', lower(det[1])) WHEN 'gossi' THEN 'go.ssi' ELSE 'nh.lorri' END) AS instrument_lid,
  strftime(make_timestamp(CAST(round(epoch_us(utc) / 1000.0) * 1000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%g') AS start_time_utc, round(et + 4, 4) AS midtime_et, CASE WHEN kind = 'coiss' THEN image_ord + 4.5::DOUBLE END AS midtime_scet,
  CASE kind WHEN 'gossi' THEN 'SSI' WHEN 'nhlorri' THEN 'LORRI' ELSE det END AS camera, CASE WHEN kind = 'nhlorri' THEN '' ELSE event_type END AS filters FROM o""")
def p12_public_metadata(spark, sf_dir):
    m = L.public_metadata(_observations(spark, sf_dir))
    return m.select("image_ord", "image_name", "instrument_host_lid", "instrument_lid", "start_time_utc", F.round("midtime_et", 4).alias("midtime_et"), "midtime_scet", "camera", F.array_join("filters", ",").alias("filters"))


@query(_ET + " SELECT event_type, round(min(et), 4) AS start_et, round(max(et) + 8, 4) AS end_et FROM et GROUP BY 1")
def a28_time_extent(spark, sf_dir):
    x = L.time_extent(_observations(spark, sf_dir), ["event_type"])
    return x.select("event_type", F.round("start_et", 4).alias("start_et"), F.round("end_et", 4).alias("end_et"))


_MARGIN = " ".join(f"WHEN kind = '{k}'{f' AND det = {chr(39)}{d}{chr(39)}' if d else ''}{f' AND height = {h}' if h else ''} THEN [{v}, {u}]" for k, d, h, v, u in L.MARGINS)


@query(f"WITH o AS (SELECT event_id AS image_ord, ['coiss', 'vgiss', 'gossi', 'nhlorri', 'sim'][user_id % 5 + 1] AS kind, CASE WHEN event_id % 2 = 0 THEN 'NAC' ELSE 'WAC' END AS det, [256, 512, 800, 1000, 1024][event_id % 5 + 1] AS height FROM events), m AS (SELECT image_ord, CASE {_MARGIN} END AS m FROM o) SELECT image_ord, m[1] AS margin_v, m[2] AS margin_u FROM m")
def p13_margins(spark, sf_dir):
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    o = table(spark, sf_dir, "events").select(F.col("event_id").alias("image_ord"), pick(("coiss", "vgiss", "gossi", "nhlorri", "sim"), F.col("user_id")).alias("instrument"), F.when(F.col("event_id") % 2 == 0, "NAC").otherwise("WAC").alias("detector"), pick((256, 512, 800, 1000, 1024), F.col("event_id")).alias("height"))
    return L.with_margins(o).select("image_ord", "margin_v", "margin_u")


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN round(CAST(p_retailprice AS DOUBLE) / 10000, 9) END AS factor FROM part")
def p14_calibration_factor(spark, sf_dir):
    label = F.when(F.col("p_partkey") % 9 == 0, "UNCALIBRATED").otherwise(F.concat(F.lit("FOR (I/F)*10000., MULTIPLY DN VALUE BY  "), F.col("p_retailprice").cast("string"), F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(L.calibration_factor(label), 9).alias("factor"))


@query("SELECT c_custkey, round(degrees(c_custkey / 700.0::DOUBLE), 6) AS sub_solar_lon, round(degrees(c_nationkey / 30.0::DOUBLE), 6) AS phase_angle FROM customer")
def p16_body_facts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") / 700.0).alias("sub_solar_lon"), (F.col("c_nationkey") / 30.0).alias("phase_angle"))
    return L.body_facts(c, ("sub_solar_lon", "phase_angle")).select("c_custkey", F.round("sub_solar_lon", 6).alias("sub_solar_lon"), F.round("phase_angle", 6).alias("phase_angle"))


@query(_NAMED + """SELECT row_ord, CASE img_name[1] WHEN 'N' THEN 'Narrow' ELSE 'Wide' END AS camera_width, concat('urn:nasa:pds:b1:data:', substr(string_split(img_name, '_')[1], 2), lower(img_name[1]), '::1.0') AS data_lidvid, concat('Backplanes for ', img_name) AS title,
  shutter_mode_id, CASE WHEN row_ord % 3 = 0 THEN 'CL1' ELSE '' END AS filter_name_1, CASE WHEN row_ord % 5 = 0 THEN 'x' ELSE 'N/A' END AS limitations, '-1' AS expected_maximum_full_well, '999' AS malgo, 86 AS n_variables FROM entries WHERE instrument = 'coiss' AND outcome = 'ok'""")
def p10_label_variables(spark, sf_dir):
    e = _entries(spark, sf_dir).filter("instrument = 'coiss' AND outcome = 'ok'")
    row = F.map_from_entries(F.filter(F.array(F.struct(F.lit("SHUTTER_MODE_ID").alias("k"), F.col("shutter_mode_id").alias("v")), F.when(F.col("row_ord") % 3 == 0, F.struct(F.lit("FILTER1").alias("k"), F.lit("CL1").alias("v"))), F.when(F.col("row_ord") % 5 == 0, F.struct(F.lit("LIMITATIONS").alias("k"), F.lit("x").alias("v")))), lambda x: x.isNotNull()))
    v = B.name_variables(F.col("img_name"), "b1") | B.time_variables(F.lit(None), F.lit(None), F.lit(None)) | B.row_variables(row)
    own = lambda n: v[B.NAMESPACE + n].alias(n)
    return e.select("row_ord", v["CAMERA_WIDTH"].alias("camera_width"), v["DATA_LIDVID"].alias("data_lidvid"), v["TITLE"].alias("title"), own("shutter_mode_id"), own("filter_name_1"), own("limitations"), own("expected_maximum_full_well"), v[B.NAMESPACE + "inst_cmprs_param_malgo"].alias("malgo"), F.lit(len(v)).alias("n_variables"))


@query("SELECT o_orderkey, CASE WHEN t = '' THEN '' WHEN ltrim(t, '0') = '' THEN '0' ELSE ltrim(t, '0') END AS stripped FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE lpad(CAST(o_orderkey % 7 * (o_orderkey % 1000) AS VARCHAR), 9, '0') END AS t FROM orders)")
def f01_strip_zeros(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    t = F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(F.lpad((F.col("o_orderkey") % 7 * (F.col("o_orderkey") % 1000)).cast("string"), 9, "0"))
    return o.select("o_orderkey", N.strip_zeros(t).alias("stripped"))


_HMS = "printf('%02d', CAST({0} // 3600000 AS BIGINT)) || 'h' || printf('%02d', CAST({0} // 60000 % 60 AS BIGINT)) || 'm' || printf('%06.3f', {0} % 60000 / 1000.0) || 's'"


@query(with_("stars") + f""", a AS (SELECT catalog_rank, unique_number, CAST(floor(degrees(radians(ra)) / 15 * 3600000 + 0.5) AS BIGINT) % 86400000 AS h, degrees(radians(dec * 4)) AS d FROM stars), b AS (SELECT *, CAST(floor(abs(d) * 3600000 + 0.5) AS BIGINT) AS m FROM a), c AS (SELECT *, m >= 648000000 AS turned FROM b), e AS (SELECT *, CASE WHEN turned THEN 1296000000 - m ELSE m END AS s FROM c)
  SELECT catalog_rank, unique_number, {_HMS.format("h")} AS ra_text, CASE WHEN (d < 0) <> turned THEN '-' ELSE '+' END || printf('%03d', CAST(s // 3600000 AS BIGINT)) || 'd' || printf('%02d', CAST(s // 60000 % 60 AS BIGINT)) || 'm' || printf('%06.3f', s % 60000 / 1000.0) || 's' AS dec_text FROM e""")
def f02_f03_angle_texts(spark, sf_dir):
    return fixture(spark, sf_dir, "stars").select("catalog_rank", "unique_number", X.ra_hms(F.radians("ra")).alias("ra_text"), X.dec_dms(F.radians(F.col("dec") * 4)).alias("dec_text"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'XX' ELSE substr(regexp_replace(CASE WHEN c_custkey % 4 = 1 THEN 'g' ELSE '' END || c_mktsegment, '^g', ''), 1, 2) END AS class, round(10.5 + ln(c_custkey + 1) / ln(2.512), 6) AS narrow, round(10.7 + ln((c_custkey + 1) / 26.0::DOUBLE) / ln(2.512), 6) AS wide, round(1 - (c_nationkey - 6) / 8.0::DOUBLE / 2, 6) AS reliability FROM customer")
def f06_f10_f11_star_numbers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    text = F.when(F.col("c_custkey") % 6 != 0, F.concat(F.when(F.col("c_custkey") % 4 == 1, "g").otherwise(""), "c_mktsegment"))
    limit = lambda camera: F.round(X.usable_magnitude(F.lit(camera), (F.col("c_custkey") + 1).cast("double")), 6)
    return c.select("c_custkey", X.spectral_class(text).alias("class"), limit("N").alias("narrow"), limit("W").alias("wide"), F.round(X.reliability(F.col("c_nationkey").cast("double"), F.lit(14.0)), 6).alias("reliability"))


_CLASS = "(SELECT CASE r_regionkey WHEN 0 THEN 'G0' WHEN 1 THEN 'A1' WHEN 2 THEN 'B2' WHEN 3 THEN 'K3' ELSE 'M4' END AS class, 3000.0::DOUBLE + r_regionkey * 900 AS t, r_regionkey / 4.0::DOUBLE AS bv FROM region)"


@query(with_("stars") + f""", a AS (SELECT catalog_rank, unique_number, vmag, CASE catalog_rank WHEN 0 THEN 'ybsc' ELSE 'ucac4' END AS cat, CASE WHEN unique_number % 3 = 0 THEN NULL ELSE 4000.0 + unique_number % 100 END AS temp, ['G0', 'gA1', 'B2', 'K3', 'M4'][unique_number % 5 + 1] AS sc, CASE WHEN unique_number % 4 = 0 THEN NULL ELSE 0.25 END AS b_v, CASE WHEN unique_number % 2 = 0 THEN vmag + 1 END AS jv, CASE WHEN unique_number % 7 <> 0 THEN vmag + 2 END AS jb FROM stars),
  b AS (SELECT *, CASE WHEN cat = 'ybsc' THEN vmag ELSE jv END AS v1, CASE WHEN cat = 'ybsc' THEN vmag + coalesce(b_v, 0) ELSE jb END AS b1, CASE WHEN temp IS NULL THEN 'G0' ELSE sc END AS k FROM a)
  SELECT catalog_rank, unique_number, coalesce(temp, t) AS temperature, temp IS NULL AS temperature_faked, k AS spectral_class, round(CASE WHEN v1 IS NULL OR b1 IS NULL THEN vmag ELSE v1 END, 6) AS johnson_mag_v, round(CASE WHEN v1 IS NULL OR b1 IS NULL THEN vmag + bv ELSE b1 END, 6) AS johnson_mag_b, v1 IS NULL OR b1 IS NULL AS johnson_mag_faked FROM b JOIN {_CLASS} ON class = regexp_replace(k, '^g', '')""")
def f08_star_defaults(spark, sf_dir):
    n = F.col("unique_number")
    s = fixture(spark, sf_dir, "stars").withColumns({
        "catalog": F.when(F.col("catalog_rank") == 0, "ybsc").otherwise("ucac4"), "temperature": F.when(n % 3 != 0, 4000.0 + n % 100), "spectral_class": F.element_at(F.array(*map(F.lit, ("G0", "gA1", "B2", "K3", "M4"))), (n % 5 + 1).cast("int")),
        "b_v": F.when(n % 4 != 0, 0.25), "johnson_mag_v": F.when(n % 2 == 0, F.col("vmag") + 1), "johnson_mag_b": F.when(n % 7 != 0, F.col("vmag") + 2),
    })
    r = F.col("r_regionkey")
    classes = table(spark, sf_dir, "region").select(F.when(r == 0, "G0").when(r == 1, "A1").when(r == 2, "B2").when(r == 3, "K3").otherwise("M4").alias("spectral_class"), (3000.0 + r * 900).alias("class_temperature"), (r / 4.0).alias("class_b_v"))
    d = S.with_defaults(s, classes)
    return d.select("catalog_rank", "unique_number", "temperature", "temperature_faked", "spectral_class", F.round("johnson_mag_v", 6).alias("johnson_mag_v"), F.round("johnson_mag_b", 6).alias("johnson_mag_b"), "johnson_mag_faked")


@query(with_("stars") + " SELECT unique_number % 40 AS image_ord, catalog AS catalog_name, unique_number, round(ra, 6) AS ra, round(dec, 6) AS dec, round(vmag, 6) AS vmag, unique_number % 9 - 4 AS movement_u, 0 AS movement_v FROM stars")
def p15_star_lists(spark, sf_dir):
    n, s = F.col("unique_number"), fixture(spark, sf_dir, "stars")
    none = {c: F.lit(None).cast("string") for c in S.STAR_FIELDS if c not in ("catalog_name", "unique_number", "ra", "dec", "vmag", "u", "v", "movement_u", "movement_v")}
    s = s.withColumns({**none, "image_ord": n % 40, "catalog_name": F.col("catalog"), "ra_pm": F.radians("ra"), "dec_pm": F.radians("dec"), "u": n % 100, "v": n % 77, "u1": n % 100, "v1": n % 77, "u2": n % 100 + n % 9 - 4, "v2": n % 77})
    out = S.listed_stars(S.star_lists(s))
    return out.select("image_ord", "catalog_name", "unique_number", *(F.round(c, 6).alias(c) for c in ("ra", "dec", "vmag")), "movement_u", F.col("movement_v").cast("int").alias("movement_v"))


@query(with_("pixels") + """, st AS (SELECT c_custkey AS star, c_custkey % 50 AS image_ord, c_custkey % 40 * 0.5::DOUBLE AS v, c_custkey % 29 * 0.75::DOUBLE AS u FROM customer),
  h AS (SELECT star, min(body_ord) AS b FROM st JOIN pixels p ON p.image_ord = st.image_ord AND p.valid AND p.v + 1 > st.v - 2 AND p.v < st.v + 2 AND p.u + 1 > st.u - 2 AND p.u < st.u + 2 GROUP BY 1)
  SELECT star, CASE WHEN b IS NULL THEN '' ELSE concat('BODY: B', b) END AS conflicts FROM st LEFT JOIN h USING (star)""")
def j08_body_conflicts(spark, sf_dir):
    k = F.col("c_custkey")
    stars = table(spark, sf_dir, "customer").select(k.alias("star"), (k % 50).alias("image_ord"), (k % 40 * 0.5).alias("v"), (k % 29 * 0.75).alias("u"))
    bodies = fixture(spark, sf_dir, "pixels").filter("valid").withColumn("body", F.concat(F.lit("B"), F.col("body_ord").cast("string")))
    return S.body_conflicts(stars, bodies, 2.0).select("star", "conflicts")


_STAR = with_("trials") + ", st AS (SELECT trial_ord, line, CAST(trial_ord % 64 AS DOUBLE) AS u, CAST(trial_ord % 50 AS DOUBLE) AS v, 5 AS psf, CASE WHEN line = 6 THEN NULL ELSE trial_ord % 64 + 0.5 + diff_v / 4 END AS opt_u, CASE WHEN line = 6 THEN NULL ELSE trial_ord % 50 + diff_v / 5 END AS opt_v, CASE WHEN line = 2 THEN 'STAR' ELSE '' END AS conflicts FROM trials)"


def _measured(spark, sf_dir):
    t = fixture(spark, sf_dir, "trials")
    k, found = F.col("trial_ord"), F.col("line") != 6
    return t.select("trial_ord", "line", (k % 64).cast("double").alias("u"), (k % 50).cast("double").alias("v"), F.lit(5).alias("psf"), F.when(found, k % 64 + 0.5 + F.col("diff_v") / 4).alias("opt_u"), F.when(found, k % 50 + F.col("diff_v") / 5).alias("opt_v"), F.when(F.col("line") == 2, "STAR").otherwise("").alias("conflicts"))


@query(_STAR + """, m AS (SELECT *, u + 0.5 AS su, v - 0.25 AS sv FROM st), c AS (SELECT *, CASE WHEN conflicts <> '' THEN conflicts WHEN su < 5 OR su > 60 - 5 OR sv < 5 OR sv > 48 - 5 THEN 'REFINEMENT EDGE' WHEN opt_u IS NULL THEN 'REFINEMENT FAILED' ELSE '' END AS mark FROM m)
  SELECT mark, count(*) AS n, round(sum(CASE WHEN mark = '' THEN opt_u - su END), 4) AS du, round(sum(CASE WHEN mark = '' THEN opt_v - sv END), 4) AS dv FROM c GROUP BY 1""")
def p47_refinement_marks(spark, sf_dir):
    s = S.refinement_marks(_measured(spark, sf_dir).withColumn("du", F.lit(0.5)).withColumn("dv", F.lit(-0.25)), 48, 60)
    return s.groupBy(F.col("conflicts").alias("mark")).agg(F.count("*").alias("n"), F.round(F.sum("diff_u"), 4).alias("du"), F.round(F.sum("diff_v"), 4).alias("dv"))


@query(_STAR + " SELECT trial_ord, line, round(opt_u - u, 6) AS diff_u, round(opt_v - v, 6) AS diff_v FROM st WHERE u >= 5 AND u <= 55 AND v >= 5 AND v <= 43 AND opt_u >= 3 AND opt_u <= 57 AND opt_v >= 3 AND opt_v <= 45 AND abs(opt_u - u) <= 1.2 AND abs(opt_v - v) <= 1.2 AND line * 2 >= 1.5 * 4")
def p48_twist_accepted(spark, sf_dir):
    s = _measured(spark, sf_dir).withColumn("peak", F.col("line") * 2).withColumn("background", F.lit(4))
    return S.twist_accepted(s, 48, 60, clip=3, peak_factor=1.5, most=1.2).select("trial_ord", "line", F.round("diff_u", 6).alias("diff_u"), F.round("diff_v", 6).alias("diff_v"))


@query(_STAR + " SELECT trial_ord, line FROM st WHERE opt_u IS NOT NULL AND u > 2 AND u < 57 AND v > 2 AND v < 45 AND u - 1 > 2 AND v + 1.5 < 45")
def p45_p46_off_edges(spark, sf_dir):
    s = _measured(spark, sf_dir).withColumns({"ra": F.col("opt_u"), "dec": F.col("v"), "vmag": F.col("u"), "v0": F.col("v"), "u0": F.col("u") - 1, "v1": F.col("v") + 1.5, "u1": F.col("u")})
    return L.off_edges(s, 48, 60).select("trial_ord", "line")


_FEAT = with_("features", "ring_images")


def _modes(a, key):
    """Modes of an edge: a first one with a radius, one without, now and then one that is unsound; none for a missing edge."""
    one = lambda mode, axis: F.struct(mode.cast("int").alias("mode"), axis.alias("a"))
    some = F.array(one(F.lit(1), F.when(key % 11 == 0, -a).otherwise(a)), one(F.when(key % 13 != 0, F.lit(2)), F.lit(None).cast("double")))
    return F.when(key % 17 == 0, F.slice(some, 1, 0)).when(a.isNotNull(), some)


def _mode_features(spark, sf_dir):
    f = fixture(spark, sf_dir, "features")
    return f.withColumn("inner_data", _modes(F.col("inner_a"), F.col("feature_key"))).withColumn("outer_data", _modes(F.col("outer_a"), F.col("feature_key") + 1))


_SOUND = ", ".join(f"""CASE WHEN ({k}) % 17 = 0 THEN false WHEN {c}_a IS NULL THEN true ELSE ({k}) % 11 <> 0 AND ({k}) % 13 <> 0 END AS {c}_ok, ({k}) % 17 = 0 OR {c}_a IS NOT NULL AS {c}_given""" for c, k in (("inner", "feature_key"), ("outer", "feature_key + 1")))
_SOUND = _FEAT + f", so AS (SELECT *, {_SOUND} FROM features), sf AS (SELECT * FROM so WHERE feature_type IN ('GAP', 'RINGLET') AND (inner_given OR outer_given) AND inner_ok AND outer_ok)"


@query(_SOUND + " SELECT feature_key FROM sf")
def p49_valid_modes(spark, sf_dir):
    return G.valid_mode_features(_mode_features(spark, sf_dir)).select("feature_key")


@query(_SOUND + " SELECT image_ord, feature_key FROM sf JOIN ring_images ON coalesce(inner_a BETWEEN min_radius AND max_radius, true) AND coalesce(outer_a BETWEEN min_radius AND max_radius, true)")
def j10_modes_in_radius(spark, sf_dir):
    near = G.valid_mode_features(_mode_features(spark, sf_dir)).crossJoin(F.broadcast(fixture(spark, sf_dir, "ring_images")))
    ok = G.modes_in_radius(F.col("inner_data"), F.col("min_radius"), F.col("max_radius")) & G.modes_in_radius(F.col("outer_data"), F.col("min_radius"), F.col("max_radius"))
    return near.filter(ok).select("image_ord", "feature_key")


@query(_FEAT + " SELECT feature_key, CASE WHEN feature_key % 17 = 0 THEN 0 WHEN inner_a IS NULL THEN NULL WHEN feature_key % 13 = 0 THEN 1 ELSE 2 END AS n_radial, CASE WHEN feature_key % 17 <> 0 THEN CASE WHEN feature_key % 11 = 0 THEN -inner_a ELSE inner_a END END AS base FROM features")
def f14_f15_modes(spark, sf_dir):
    wide = F.transform("inner_data", lambda m: F.struct(m["mode"].alias("mode"), m["a"].alias("a"), *(F.lit(1.0).alias(c) for c in ("ae", "long_peri", "rate_peri", "amplitude", "phase", "pattern_speed"))))
    f = _mode_features(spark, sf_dir).withColumn("m", wide)
    return f.select("feature_key", F.when(F.col("m").isNotNull(), F.size(M.radial_modes(F.col("m")))).alias("n_radial"), M.base_radius(F.col("m")).alias("base"))


_EDGE = _FEAT + """, ed AS (SELECT feature_key, feature_key % 25 AS image_ord, feature_type = 'GAP' AS above, coalesce(outer_a, 90000.0) AS a FROM features),
  bd AS (SELECT l_orderkey % 25 AS image_ord, l_partkey AS feature_key, l_quantity / 10.0::DOUBLE AS resolution FROM lineitem), rs AS (SELECT image_ord, feature_key, min(resolution) AS lo, max(resolution) AS hi FROM bd GROUP BY ALL),
  er AS (SELECT ed.*, coalesce(lo, 0.0) AS lo, coalesce(hi, 0.0) AS hi FROM ed LEFT JOIN rs USING (image_ord, feature_key))"""


def _edges(spark, sf_dir):
    f = fixture(spark, sf_dir, "features")
    e = f.select("feature_key", (F.col("feature_key") % 25).alias("image_ord"), F.lit("E").alias("label"), (F.col("feature_type") == "GAP").alias("above"), F.coalesce("outer_a", F.lit(90000.0)).alias("a"))
    border = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 25).alias("image_ord"), F.col("l_partkey").alias("feature_key"), F.lit("E").alias("label"), (F.col("l_quantity") / 10.0).cast("double").alias("resolution"))
    return G.edge_resolutions(e, border)


@query(_EDGE + " SELECT feature_key, round(lo, 6) AS min_resolution, round(hi, 6) AS max_resolution FROM er")
def a18_edge_resolutions(spark, sf_dir):
    return _edges(spark, sf_dir).select("feature_key", F.round("min_resolution", 6).alias("min_resolution"), F.round("max_resolution", 6).alias("max_resolution"))


@query(_EDGE + " SELECT feature_key, round(lo * 30, 6) AS width, round(lo * 3, 6) AS least_width FROM er WHERE lo <> 0")
def f18_fade_extent(spark, sf_dir):
    return G.fade_extent(_edges(spark, sf_dir), 30.0, 3.0).select("feature_key", F.round("width", 6).alias("width"), F.round("least_width", 6).alias("least_width"))


_FADE = """, px AS (SELECT er.*, k, a + k * 0.6::DOUBLE AS r, 0.5 + feature_key % 4 AS res, 1.0 + feature_key % 3 AS w FROM er, unnest([-7, -4, -2, -1, 0, 1, 2, 4, 7]) t(k)), p AS (SELECT *, r - res / 2 AS lo_, r + res / 2 AS hi_, CASE WHEN above THEN a + w ELSE a - w END AS far FROM px),
  q AS (SELECT *, CASE WHEN above THEN lo_ <= a AND a < hi_ ELSE lo_ < a AND a <= hi_ END AS he, CASE WHEN above THEN lo_ <= far AND far < hi_ ELSE lo_ < far AND far <= hi_ END AS hf FROM p)
  SELECT feature_key, k, round(greatest(0.0, least(1.0, CASE WHEN he AND hf THEN w / 2 / res
    WHEN he AND above THEN ((1 + a / w) * (hi_ - a) + (a * a - hi_ * hi_) / (2 * w)) / res WHEN hf AND above THEN ((1 + a / w) * (far - lo_) + (lo_ * lo_ - far * far) / (2 * w)) / res
    WHEN he THEN ((1 - a / w) * (a - lo_) + (a * a - lo_ * lo_) / (2 * w)) / res WHEN hf THEN ((1 - a / w) * (hi_ - far) + (hi_ * hi_ - far * far) / (2 * w)) / res
    WHEN above AND a < lo_ AND far > hi_ THEN ((1 + a / w) * (hi_ - lo_) + (lo_ * lo_ - hi_ * hi_) / (2 * w)) / res
    WHEN NOT above AND a > hi_ AND far < lo_ THEN ((1 - a / w) * (hi_ - lo_) + (hi_ * hi_ - lo_ * lo_) / (2 * w)) / res ELSE 0.0 END)), 4) AS shade FROM q"""


@query(_EDGE + _FADE)
def f13_edge_fade(spark, sf_dir):
    k = F.col("feature_key")
    e = _edges(spark, sf_dir).withColumn("k", F.explode(F.array(*(F.lit(i) for i in (-7, -4, -2, -1, 0, 1, 2, 4, 7)))))
    shade = G.edge_fade(F.col("a") + F.col("k") * 0.6, F.col("a"), F.col("above"), 1.0 + k % 3, 0.5 + k % 4)
    return e.select("feature_key", "k", F.round(shade, 4).alias("shade"))


@query("SELECT c_custkey, round(CASE WHEN c_custkey % 3 = 0 OR c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN degrees(c_nationkey / 9.0::DOUBLE) ELSE c_nationkey / 9.0::DOUBLE END, 6) AS value, CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE 600 END AS body FROM customer")
def f25_f27_units_and_ids(spark, sf_dir):
    k = F.col("c_custkey")
    unit = F.when(k % 3 == 0, "rad").when(k % 3 == 2, "km")
    name = F.when(k % 2 == 0, "Solar_Longitude").otherwise("RADIUS")
    known = F.when(k % 5 == 0, k).otherwise(600)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(M.in_degrees(F.col("c_nationkey") / 9.0, unit, name), 6).alias("value"), M.body_id(F.col("c_name"), known).alias("body"))
