"""Queries over fields of view and composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators import fields as L
from platewise.operators import planes as P
from platewise.plans.fixtures import fixture, with_

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_PX = with_("pixels") + ", bd AS (SELECT image_ord, body_ord, any_value(distance) AS distance, CAST(min(v) * 37 + body_ord % 9 * 20 - 60 AS DOUBLE) AS u0 FROM pixels GROUP BY image_ord, body_ord)"


def _bodies(spark, sf_dir):
    return fixture(spark, sf_dir, "pixels").groupBy("image_ord", "body_ord").agg(F.first("distance").alias("distance"), (F.min("v") * 37 + F.col("body_ord") % 9 * 20 - 60).cast("double").alias("u0"))


@query("""WITH c AS (SELECT user_id AS image_ord, CAST((user_id * 31 + event_id % 3 * 9) % 360 AS DOUBLE) AS ra, CAST(user_id % 60 AS DOUBLE) - CAST(event_id % 5 AS DOUBLE) AS dec FROM events),
  g AS (SELECT image_ord, min(ra) AS lo, max(ra) AS hi, min(ra) FILTER (ra > 180) AS far, max(ra) FILTER (ra < 180) AS near, min(dec) AS dec_min, max(dec) AS dec_max FROM c GROUP BY 1)
  SELECT image_ord, CASE WHEN hi - lo > 180 THEN far ELSE lo END AS ra_min, CASE WHEN hi - lo > 180 THEN near ELSE hi END AS ra_max, dec_min, dec_max FROM g""")
def a02_ra_dec_limits(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return L.ra_dec_limits(e.select(F.col("user_id").alias("image_ord"), ((F.col("user_id") * 31 + F.col("event_id") % 3 * 9) % 360).cast("double").alias("ra"), ((F.col("user_id") % 60).cast("double") - (F.col("event_id") % 5).cast("double")).alias("dec")))


@query(_PX + " SELECT image_ord, body_ord AS closest FROM bd QUALIFY row_number() OVER (PARTITION BY image_ord ORDER BY distance, body_ord) = 1")
def a03_closest(spark, sf_dir):
    return L.closest(_bodies(spark, sf_dir))


@query(_PX + " SELECT image_ord, body_ord, row_number() OVER (PARTITION BY image_ord ORDER BY distance, body_ord) AS place FROM bd")
def w16_by_distance(spark, sf_dir):
    return L.by_distance(_bodies(spark, sf_dir)).select("image_ord", "body_ord", F.col("place").cast("long").alias("place"))


@query(_PX + " SELECT image_ord, body_ord, greatest(u0, 0.0) AS u_lo, least(u0 + 30, 63.0) AS u_hi, floor(u0 - 1.5) AS slop_lo, ceil(u0 + 31.5) AS slop_hi FROM bd WHERE u0 <= 63 AND u0 + 30 >= 0")
def p38_p39_p41_boxes(spark, sf_dir):
    b, u0, u1 = _bodies(spark, sf_dir), F.col("u0"), F.col("u0") + 30
    zero, last = F.lit(0.0), F.lit(63.0)
    lo, hi = P.clipped(u0, u1, zero, last)
    slo, shi = L.slopped(u0, u1)
    return b.filter(P.overlaps(u0, u1, zero, last, (zero, last, zero, last))).select("image_ord", "body_ord", lo.alias("u_lo"), hi.alias("u_hi"), slo.cast("double").alias("slop_lo"), shi.cast("double").alias("slop_hi"))


@query(with_("pixels", "inventory") + " SELECT s.image_ord, s.body_ord, round(s.hi, 6) AS hi, center_u, center_v FROM (SELECT image_ord, body_ord, max(value) AS hi FROM pixels WHERE valid GROUP BY ALL) s LEFT JOIN inventory USING (image_ord, body_ord)")
def j14_inventory(spark, sf_dir):
    stats = fixture(spark, sf_dir, "pixels").filter("valid").groupBy("image_ord", "body_ord").agg(F.round(F.max("value"), 6).alias("hi"))
    return L.with_inventory(stats, fixture(spark, sf_dir, "inventory").select("image_ord", "body_ord", "center_u", "center_v"))


@query(_PX + " SELECT image_ord, body_ord, round(greatest(coalesce(max(value) FILTER (valid), 0.0), 1e-12), 9) AS scale FROM pixels GROUP BY ALL")
def a32_peak_scales(spark, sf_dir):
    return L.peak_scales(fixture(spark, sf_dir, "pixels")).select("image_ord", "body_ord", F.round("scale", 9).alias("scale"))


@query(_PX + """, sc AS (SELECT image_ord, body_ord, greatest(coalesce(max(value) FILTER (valid), 0.0), 1e-12) AS scale FROM pixels GROUP BY ALL), cf AS (SELECT image_ord, body_ord, 1.0 / (1 + distance) AS confidence FROM bd), tt AS (SELECT image_ord, sum(confidence) AS total FROM cf GROUP BY 1)
  SELECT image_ord, body_ord, v, u, round(CASE WHEN valid THEN value / scale * confidence / total ELSE 0 END, 6) AS value, round(CASE WHEN valid THEN confidence / total ELSE 0 END, 6) AS weighted_mask FROM pixels JOIN sc USING (image_ord, body_ord) JOIN cf USING (image_ord, body_ord) JOIN tt USING (image_ord)""")
def w04_composite(spark, sf_dir):
    c = L.composite(fixture(spark, sf_dir, "pixels"), _confidences(spark, sf_dir))
    return c.select("image_ord", "body_ord", "v", "u", F.round("value", 6).alias("value"), F.round("weighted_mask", 6).alias("weighted_mask"))


def _confidences(spark, sf_dir):
    return _bodies(spark, sf_dir).select("image_ord", "body_ord", (1.0 / (1 + F.col("distance"))).alias("confidence"))


@query(_PX + """, sc AS (SELECT image_ord, body_ord, greatest(coalesce(max(value) FILTER (valid), 0.0), 1e-12) AS scale FROM pixels GROUP BY ALL), cf AS (SELECT image_ord, body_ord, 1.0 / (1 + distance) AS confidence FROM bd), tt AS (SELECT image_ord, sum(confidence) AS total FROM cf GROUP BY 1),
  fr AS (SELECT p.*, confidence / total AS w, value / scale AS x FROM pixels p JOIN sc USING (image_ord, body_ord) JOIN cf USING (image_ord, body_ord) JOIN tt USING (image_ord) QUALIFY row_number() OVER (PARTITION BY image_ord, v, u ORDER BY CASE WHEN valid THEN distance ELSE 'inf'::DOUBLE END, body_ord) = 1)
  SELECT image_ord, v, u, body_ord AS front, round(CASE WHEN valid THEN x * w ELSE 0 END, 6) AS value, valid, round(CASE WHEN valid THEN w ELSE 0 END, 6) AS weighted_mask FROM fr""")
def w03_front_model(spark, sf_dir):
    f = L.front_model(fixture(spark, sf_dir, "pixels"), _confidences(spark, sf_dir))
    return f.select("image_ord", "v", "u", "front", F.round("value", 6).alias("value"), "valid", F.round("weighted_mask", 6).alias("weighted_mask"))


@query(with_("navigation") + " SELECT image_ord FROM navigation WHERE abs(value) % 50 < 9 AND abs(image_ord % 30 - 15) < 9")
def p42_inside_margin(spark, sf_dir):
    n = fixture(spark, sf_dir, "navigation")
    return n.filter(L.inside_margin(F.abs("value") % 50, F.col("image_ord") % 30 - 15, F.lit(10), F.lit(10))).select("image_ord")
