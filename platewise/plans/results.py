"""Queries over result documents, planes and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.functions import formats as X
from platewise.operators import planes as P
from platewise.operators import results as R
from platewise.plans.fixtures import fixture, with_

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_NAV = with_("navigation")
_OFF = _NAV + """, o AS (SELECT *, CASE WHEN offset_json IS NULL THEN 'null' WHEN json_array_length(offset_json) <> 2 THEN 'wrong_length' WHEN TRY_CAST(offset_json ->> 0 AS DOUBLE) IS NULL OR TRY_CAST(offset_json ->> 1 AS DOUBLE) IS NULL THEN 'wrong_type' ELSE 'ok' END AS offset_outcome FROM navigation),
  off AS (SELECT *, CASE WHEN offset_outcome = 'ok' THEN TRY_CAST(offset_json ->> 0 AS DOUBLE) END AS dv, CASE WHEN offset_outcome = 'ok' THEN TRY_CAST(offset_json ->> 1 AS DOUBLE) END AS du FROM o)"""
_PARSED = _OFF + ", p AS (SELECT *, regexp_extract(file_stub, '^(.+)_(-?[0-9]+\\.?[0-9]*)_(-?[0-9]+\\.?[0-9]*)$', 1) AS template, CAST(regexp_extract(file_stub, '^(.+)_(-?[0-9]+\\.?[0-9]*)_(-?[0-9]+\\.?[0-9]*)$', 2) AS DOUBLE) AS u, CAST(regexp_extract(file_stub, '^(.+)_(-?[0-9]+\\.?[0-9]*)_(-?[0-9]+\\.?[0-9]*)$', 3) AS DOUBLE) AS v FROM off WHERE status = 'success' AND offset_outcome = 'ok'), l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY template, u, v ORDER BY results_path_stub DESC) = 1)"


def _nav(spark, sf_dir):
    return fixture(spark, sf_dir, "navigation")


def _parsed(spark, sf_dir):
    good = R.offsets(R.successful(_nav(spark, sf_dir))[0]).filter("offset_outcome = 'ok'")
    t, u, v = X.parsed_name(F.col("file_stub"))
    return good.withColumn("template", t).withColumn("u", u).withColumn("v", v)


@query(_NAV + " SELECT image_ord FROM navigation WHERE status = 'success'")
def p29_status_gate(spark, sf_dir):
    return R.successful(_nav(spark, sf_dir))[0].select("image_ord")


@query(_NAV + " SELECT CASE WHEN contains(status_exception, 'SPICE(CKINSUFFDATA)') OR contains(status_exception, 'SPICE(SPKINSUFFDATA)') OR contains(status_exception, 'SPICE(NOFRAMECONNECT)') THEN 'missing_spice_data' ELSE 'image_read_error' END AS error, count(*) AS n FROM navigation WHERE status_exception IS NOT NULL GROUP BY 1")
def p30_error_classes(spark, sf_dir):
    return _nav(spark, sf_dir).select(R.error_class(F.col("status_exception")).alias("error")).filter("error IS NOT NULL").groupBy("error").agg(F.count("*").alias("n"))


@query(_OFF + " SELECT image_ord, offset_outcome, dv, du FROM off")
def p33_offset_validation(spark, sf_dir):
    return R.offsets(_nav(spark, sf_dir)).select("image_ord", "offset_outcome", "dv", "du")


@query(_OFF + " SELECT image_ord, dv IS NULL AS defaulted, coalesce(dv, 0.0) AS dv, coalesce(du, 0.0) AS du FROM off")
def p34_offset_default(spark, sf_dir):
    return R.offsets_or_zero(R.offsets(_nav(spark, sf_dir))).select("image_ord", "defaulted", "dv", "du")


@query(with_("trials") + " SELECT template, u_offset, count(*) AS n FROM trials WHERE u_offset >= -3 AND u_offset <= 2 AND v_offset <= 1 GROUP BY ALL")
def p35_offset_box(spark, sf_dir):
    return R.in_box(fixture(spark, sf_dir, "trials"), (-3, 2), (None, 1)).groupBy("template", "u_offset").agg(F.count("*").alias("n"))


@query(_PARSED + " SELECT image_ord, u, v FROM p WHERE starts_with(template, 't1')")
def p36_f21_template_prefix(spark, sf_dir):
    return _parsed(spark, sf_dir).filter(F.col("template").startswith("t1")).select("image_ord", "u", "v")


@query("SELECT p_partkey FROM part WHERE regexp_matches(lower(p_type), '^.*brass$') OR regexp_matches(lower(p_type), '^small.*')")
def p37_glob_selection(spark, sf_dir):
    return R.matching(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_type", ["*BRASS", "Small*"]).select("p_partkey")


_BACK = with_("navigation", "backplanes")


@query(_BACK + " SELECT image_ord, status, n_planes FROM navigation JOIN backplanes USING (image_ord)")
def j12_metadata_join(spark, sf_dir):
    return R.with_results(_nav(spark, sf_dir).select("image_ord", "status"), fixture(spark, sf_dir, "backplanes").select("image_ord", "n_planes"), "image_ord")[0]


@query(_BACK + " SELECT image_ord, results_path_stub FROM navigation WHERE image_ord NOT IN (SELECT image_ord FROM backplanes)")
def j13_u04_missing_results(spark, sf_dir):
    return R.with_results(_nav(spark, sf_dir).select("image_ord", "results_path_stub"), fixture(spark, sf_dir, "backplanes"), "image_ord")[1]


@query(_NAV + " SELECT status, count(*) AS images FROM navigation GROUP BY 1")
def a26_run_summary(spark, sf_dir):
    return R.run_summary(_nav(spark, sf_dir))


@query(with_("trials") + " SELECT trial_ord AS image_ord, arg_max(twist, [CASE WHEN line = 7 THEN 1.0 ELSE 0.0 END, diff_v, -u_offset, -diff_u]) AS best_twist FROM trials GROUP BY 1")
def w23_final_result(spark, sf_dir):
    t = fixture(spark, sf_dir, "trials").select(F.col("trial_ord").alias("image_ord"), F.col("twist").alias("technique"), F.lit(0.0).alias("dv"), F.lit(0.0).alias("du"), (F.col("line") == 7).alias("is_manual"), F.col("diff_v").alias("confidence"), F.struct("u_offset", "diff_u").alias("_t"))
    t = t.withColumn("technique_ord", F.col("_t.u_offset") * 100000.0 + F.col("_t.diff_u"))
    return R.final_result(t).select("image_ord", F.col("technique").alias("best_twist"))


@query(_PARSED + " SELECT template, u, v, results_path_stub FROM l")
def w17_last_result(spark, sf_dir):
    return R.last_result(_parsed(spark, sf_dir)).select("template", "u", "v", "results_path_stub")


@query(_PARSED + ", ax AS (SELECT * FROM (SELECT DISTINCT template, u FROM l) JOIN (SELECT DISTINCT template, v FROM l) USING (template)) SELECT template, u, v, du - u AS error_u, dv - v AS error_v FROM ax LEFT JOIN l USING (template, u, v)")
def w21_j18_error_grid(spark, sf_dir):
    return R.error_grid(R.last_result(_parsed(spark, sf_dir)))


_PIX = with_("pixels") + ", px AS (SELECT *, 'LONGITUDE' AS plane, 'rad' AS units FROM pixels UNION ALL SELECT image_ord, body_ord, v, u, value * 10, valid, distance, 'RADIUS', 'km' FROM pixels)"
PLANES = ("LONGITUDE", "RADIUS")


def _px(spark, sf_dir):
    p = fixture(spark, sf_dir, "pixels")
    return p.withColumns({"plane": F.lit("LONGITUDE"), "units": F.lit("rad")}).unionByName(p.withColumns({"value": F.col("value") * 10, "plane": F.lit("RADIUS"), "units": F.lit("km")}))


_STATS = _PIX + ", st AS (SELECT image_ord, body_ord, plane, min(CASE WHEN units = 'rad' THEN degrees(value) ELSE value END) AS lo, max(CASE WHEN units = 'rad' THEN degrees(value) ELSE value END) AS hi FROM px WHERE valid GROUP BY ALL)"
_GATED = with_("pixels", "navigation") + ", px AS (SELECT *, 'LONGITUDE' AS plane, 'rad' AS units FROM pixels UNION ALL SELECT image_ord, body_ord, v, u, value * 10, valid, distance, 'RADIUS', 'km' FROM pixels)"


@query(_GATED + """, n AS (SELECT *, row_number() OVER (PARTITION BY image_ord, plane, v, u ORDER BY CAST(distance AS FLOAT), body_ord) AS k FROM px WHERE valid AND image_ord IN (SELECT image_ord FROM navigation WHERE status = 'success')),
  st AS (SELECT image_ord, body_ord, plane, min(CASE WHEN units = 'rad' THEN degrees(value) ELSE value END) AS lo, max(CASE WHEN units = 'rad' THEN degrees(value) ELSE value END) AS hi FROM n WHERE k = 1 GROUP BY ALL)
  SELECT image_ord, body_ord, round(max(lo) FILTER (plane = 'LONGITUDE'), 9) AS longitude_min, round(max(hi) FILTER (plane = 'LONGITUDE'), 9) AS longitude_max, round(max(lo) FILTER (plane = 'RADIUS'), 9) AS radius_min, round(max(hi) FILTER (plane = 'RADIUS'), 9) AS radius_max FROM st GROUP BY ALL""")
def plane_statistics(spark, sf_dir):
    good = R.successful(_nav(spark, sf_dir))[0].select("image_ord")
    # The planes of a body share mask and distance, so the nearest source is found once a pixel.
    front = P.nearest(fixture(spark, sf_dir, "pixels").withColumn("plane", F.lit("all")).join(good, "image_ord", "left_semi"))
    each = F.explode(F.array(F.struct(F.lit("LONGITUDE").alias("plane"), F.lit("rad").alias("units"), F.col("value")), F.struct(F.lit("RADIUS").alias("plane"), F.lit("km").alias("units"), (F.col("value") * 10).alias("value"))))
    front = front.withColumn("_p", each).select("image_ord", "body_ord", "_p.*", F.lit(True).alias("valid"))
    rows = P.index_rows(P.statistics(front), PLANES)
    return rows.select("image_ord", "body_ord", *(F.round(f"{p}_{c}", 9).alias(f"{p.lower()}_{c}") for p in PLANES for c in ("min", "max")))


@query(_STATS + ' SELECT image_ord, body_ord, plane, round(lo, 9) AS "min", round(hi, 9) AS "max" FROM st')
def a01_plane_ranges(spark, sf_dir):
    return P.statistics(_px(spark, sf_dir)).select("image_ord", "body_ord", "plane", F.round("min", 9).alias("min"), F.round("max", 9).alias("max"))


@query(_PIX + " SELECT image_ord, plane, v, u, body_ord, round(value, 9) AS value FROM px WHERE valid QUALIFY row_number() OVER (PARTITION BY image_ord, plane, v, u ORDER BY CAST(distance AS FLOAT), body_ord) = 1")
def w02_u02_nearest_source(spark, sf_dir):
    return P.nearest(_px(spark, sf_dir)).select("image_ord", "plane", "v", "u", "body_ord", F.round("value", 9).alias("value"))


_RINGS = with_("pixels", "ring_pixels")


@query(_RINGS + ", b AS (SELECT image_ord, v, u, min(distance) AS f FROM pixels WHERE valid GROUP BY ALL) SELECT image_ord, ring, count(*) AS n FROM ring_pixels LEFT JOIN b USING (image_ord, v, u) WHERE f IS NULL OR f >= distance GROUP BY ALL")
def j15_occlusion(spark, sf_dir):
    return P.unoccluded(fixture(spark, sf_dir, "ring_pixels"), fixture(spark, sf_dir, "pixels")).groupBy("image_ord", "ring").agg(F.count("*").alias("n"))


@query(_RINGS + ", px AS (SELECT *, 'LONGITUDE' AS plane FROM pixels UNION ALL SELECT *, 'RADIUS' FROM pixels) SELECT DISTINCT a.image_ord, a.plane FROM px a JOIN ring_pixels b ON a.image_ord = b.image_ord AND a.plane = b.plane")
def j16_collisions(spark, sf_dir):
    return P.collisions(_px(spark, sf_dir), fixture(spark, sf_dir, "ring_pixels"))


@query(_PIX + " SELECT image_ord, body_ord, count(*) AS pixels FROM (SELECT image_ord, body_ord, v, u, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS k, count(*) AS n FROM (SELECT *, valid AND (plane = 'RADIUS' OR v < 6) AS ok FROM px) GROUP BY ALL) WHERE k > 0 AND k < n GROUP BY ALL")
def a21_mask_disagreement(spark, sf_dir):
    return P.mask_disagreement(_px(spark, sf_dir).withColumn("valid", F.col("valid") & ((F.col("plane") == "RADIUS") | (F.col("v") < 6))))


@query(_PIX + " SELECT image_ord, count(*) AS covered FROM (SELECT DISTINCT image_ord, v, u FROM pixels WHERE valid) GROUP BY 1")
def a21_mask_union(spark, sf_dir):
    return P.mask_union(fixture(spark, sf_dir, "pixels"))


@query(_PIX + " SELECT image_ord, plane FROM (SELECT image_ord, plane, CASE WHEN plane = 'RADIUS' AND image_ord % 3 = 0 THEN 0 ELSE value END AS x FROM px) GROUP BY ALL HAVING bool_or(x IS NULL OR x <> 0)")
def p43_nonzero_planes(spark, sf_dir):
    return P.nonzero_planes(_px(spark, sf_dir).withColumn("value", F.when((F.col("plane") == "RADIUS") & (F.col("image_ord") % 3 == 0), 0.0).otherwise(F.col("value"))))


@query(_PIX + " SELECT image_ord, plane, CASE WHEN plane = 'LONGITUDE' THEN 0.0 ELSE 0.0 END AS low, round(CASE WHEN plane = 'LONGITUDE' THEN 360.0 ELSE max(value) END, 9) AS high FROM px WHERE valid GROUP BY image_ord, plane")
def a30_display_range(spark, sf_dir):
    return P.display_range(_px(spark, sf_dir)).select("image_ord", "plane", "low", F.round("high", 9).alias("high"))


@query(with_("stars") + """ SELECT catalog_rank, unique_number, CASE WHEN name IS NULL OR trim(name) = '' THEN CAST(unique_number AS STRING) ELSE regexp_replace(trim(name), ' +', ' ', 'g') END AS display_name, round(power(2.512, 4 - vmag), 9) AS flux, printf('%.5f', ra) AS ra_text, regexp_replace(regexp_replace(printf('%.6f', dec), '0+$', ''), '\\.$', '') AS dec_text FROM stars""")
def f07_f09_f19_f22_star_texts(spark, sf_dir):
    s = fixture(spark, sf_dir, "stars")
    return s.select("catalog_rank", "unique_number", X.display_name(F.col("name"), F.col("unique_number")).alias("display_name"), F.round(X.relative_flux(F.col("vmag")), 9).alias("flux"), X.five_decimals(F.col("ra")).alias("ra_text"), X.offset_text(F.col("dec")).alias("dec_text"))
