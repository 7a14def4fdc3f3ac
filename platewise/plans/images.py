"""Queries over pixels, correlation and trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators import correlate as C
from platewise.operators import pixels as P
from platewise.operators import trials as T
from platewise.plans.fixtures import fixture, with_

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# One 8 x 8 image per vector.
_I = with_("pixels") + ", im AS (SELECT body_ord * 50 + image_ord AS image_ord, v, u, value, valid FROM pixels)"


def _images(spark, sf_dir):
    return fixture(spark, sf_dir, "pixels").select((F.col("body_ord") * 50 + F.col("image_ord")).alias("image_ord"), "v", "u", "value", "valid")


def _rounded(df, *keys):
    return df.select(*keys, F.round("value", 6).alias("value"))


@query(_I + " SELECT image_ord, v, u, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS value FROM im WINDOW w AS (PARTITION BY image_ord)")
def a15_normalized(spark, sf_dir):
    return _rounded(P.normalized(_images(spark, sf_dir)), "image_ord", "v", "u")


@query(_I + " SELECT image_ord, v // 2 AS v, u // 4 AS u, round(avg(value), 6) AS value FROM im GROUP BY ALL")
def a16_block_mean(spark, sf_dir):
    return _rounded(P.blocks(_images(spark, sf_dir), 2, 4), "image_ord", "v", "u")


@query(_I + " SELECT image_ord, v // 4 AS v, u // 4 AS u, round(max(value), 6) AS value FROM im GROUP BY ALL")
def a17_block_max(spark, sf_dir):
    return _rounded(P.blocks(_images(spark, sf_dir), 4, 4, "max"), "image_ord", "v", "u")


@query(_I + " SELECT image_ord, v * 2 + i AS v, u * 2 + j AS u, round(value, 6) AS value FROM im, range(2) a(i), range(2) b(j)")
def w19_zoomed(spark, sf_dir):
    return _rounded(P.zoomed(_images(spark, sf_dir), 2), "image_ord", "v", "u")


@query(_I + " SELECT a.image_ord, a.v, a.u, round(coalesce(b.value, 0.0), 6) AS value FROM im a LEFT JOIN im b ON a.image_ord = b.image_ord AND a.v = b.v + 2 AND a.u = b.u - 1")
def w18_s10_shifted(spark, sf_dir):
    return _rounded(P.shifted(_images(spark, sf_dir), 2, -1, 8, 8), "image_ord", "v", "u")


@query(_I + """, g AS (SELECT *, lag(value) OVER a AS vb, lead(value) OVER a AS va, lag(value) OVER b AS ub, lead(value) OVER b AS ua FROM im WINDOW a AS (PARTITION BY image_ord, u ORDER BY v), b AS (PARTITION BY image_ord, v ORDER BY u)),
  d AS (SELECT image_ord, v, u, CASE WHEN vb IS NULL THEN va - value WHEN va IS NULL THEN value - vb ELSE (va - vb) / 2 END AS gv, CASE WHEN ub IS NULL THEN ua - value WHEN ua IS NULL THEN value - ub ELSE (ua - ub) / 2 END AS gu FROM g)
  SELECT image_ord, v, u, round(gv, 6) AS gv, round(gu, 6) AS gu, round(sqrt(gv * gv + gu * gu), 6) AS magnitude FROM d""")
def w07_gradient(spark, sf_dir):
    return P.gradient(_images(spark, sf_dir)).select("image_ord", "v", "u", *(F.round(c, 6).alias(c) for c in ("gv", "gu", "magnitude")))


@query(_I + " SELECT a.image_ord, count(*) AS n FROM im a WHERE a.valid AND EXISTS (SELECT 1 FROM im b WHERE b.image_ord = a.image_ord AND NOT b.valid AND abs(a.v - b.v) + abs(a.u - b.u) = 1) GROUP BY 1")
def w09_limb(spark, sf_dir):
    return P.limb(_images(spark, sf_dir)).filter("limb").groupBy("image_ord").agg(F.count("*").alias("n"))


_MIRROR = "CASE WHEN {0} < 0 THEN -1 - ({0}) WHEN {0} >= 8 THEN 15 - ({0}) ELSE {0} END"
_NEAR = _I + f", near AS (SELECT a.image_ord, a.v, a.u, a.value, b.value AS x FROM im a, range(-1, 2) p(i), range(-1, 2) q(j) JOIN im b ON b.image_ord = a.image_ord AND b.v = {_MIRROR.format('a.v + i')} AND b.u = {_MIRROR.format('a.u + j')})"


@query(_NEAR + " SELECT image_ord, v, u, round(value, 6) AS value FROM near GROUP BY image_ord, v, u, value HAVING value = max(x) AND value >= 0")
def w10_local_maxima(spark, sf_dir):
    return _rounded(P.local_maxima(_images(spark, sf_dir), 1, 8, 8, 0.0), "image_ord", "v", "u")


@query(_NEAR + " SELECT image_ord, v, u, round(value - quantile_cont(x, 0.5), 6) AS value FROM near GROUP BY image_ord, v, u, value")
def w11_minus_median(spark, sf_dir):
    return _rounded(P.minus_median(_images(spark, sf_dir), 1, 8, 8), "image_ord", "v", "u")


@query(_I + """, q AS (SELECT image_ord, quantile_cont(value, 0.05) AS b, quantile_cont(value, 0.95) AS w FROM im GROUP BY 1)
  SELECT image_ord, v, u, CAST(least(255, floor(greatest(0.0, least(1.0, (value - b) / (CASE WHEN w = b THEN b + 0.01 ELSE w END - b))) * 256)) AS BIGINT) AS level FROM im JOIN q USING (image_ord)""")
def a29_f24_stretched(spark, sf_dir):
    return P.stretched(_images(spark, sf_dir), 0.05, 0.95).select("image_ord", "v", "u", "level")


_S = _I + """, md AS (SELECT image_ord - 1 AS pair, v, u, value FROM im WHERE image_ord > 0 AND valid), sp AS (SELECT pair, dy, dx, v + dy AS v, u + dx AS u, value AS m FROM md, range(-2, 3) a(dy), range(-2, 3) b(dx)),
  sm AS (SELECT s.pair, dy, dx, sum(coalesce(i.value, 0) * m) AS im, sum(coalesce(i.value, 0)) AS i, sum(coalesce(i.value, 0) * coalesce(i.value, 0)) AS ii, sum(m) AS m, sum(m * m) AS mm, count(*) AS w FROM sp s LEFT JOIN im i ON i.image_ord = s.pair AND i.v = s.v AND i.u = s.u GROUP BY s.pair, dy, dx),
  sf AS (SELECT pair, dy, dx, im - w * (i / w) * (m / w) AS numerator, (im - w * (i / w) * (m / w)) / (w * sqrt(greatest(0.0, ii / w - (i / w) * (i / w)) * greatest(0.0, mm / w - (m / w) * (m / w))) + 1e-12) AS ncc FROM sm)"""


def _surface(spark, sf_dir):
    im = _images(spark, sf_dir)
    image = im.select(F.col("image_ord").alias("pair"), "v", "u", "value")
    model = im.filter("image_ord > 0").select((F.col("image_ord") - 1).alias("pair"), "v", "u", "value", F.col("valid").alias("mask"))
    return C.surface(image, model, 2)


@query(_S + " SELECT pair, dy, dx, round(numerator, 6) AS numerator, round(ncc, 6) AS ncc FROM sf")
def j17_a08_a09_correlation(spark, sf_dir):
    return _surface(spark, sf_dir).select("pair", F.col("dy").cast("long").alias("dy"), F.col("dx").cast("long").alias("dx"), F.round("numerator", 6).alias("numerator"), F.round("ncc", 6).alias("ncc"))


_PK = _S + """, p0 AS (SELECT pair, dy AS py, dx AS px, numerator FROM sf QUALIFY row_number() OVER (PARTITION BY pair ORDER BY numerator DESC, dy, dx) = 1),
  p1 AS (SELECT pair, dy, dx, numerator FROM (SELECT sf.* FROM sf JOIN p0 USING (pair) WHERE sqrt(power(dy - py, 2) + power(dx - px, 2)) > 1.5) QUALIFY row_number() OVER (PARTITION BY pair ORDER BY numerator DESC, dy, dx) = 1),
  pk AS (SELECT pair, 0 AS place, py, px FROM p0 UNION ALL SELECT pair, 1, dy, dx FROM p1)"""


@query(_PK + " SELECT pair, place, py AS dy, px AS dx FROM pk")
def w12_peaks(spark, sf_dir):
    p = C.top_peaks(_surface(spark, sf_dir), 2, 1.5)
    return p.select("pair", F.col("place").cast("long").alias("place"), F.col("dy").cast("long").alias("dy"), F.col("dx").cast("long").alias("dx"))


def _quality_sql(expr):
    return _PK + f" SELECT k.pair, k.place, round({expr}, 4) AS quality FROM pk k JOIN sf t ON t.pair = k.pair AND t.dy = k.py AND t.dx = k.px JOIN sf s ON s.pair = k.pair GROUP BY k.pair, k.place"


_FAR = "CASE WHEN sqrt(power(s.dy - k.py, 2) + power(s.dx - k.px, 2)) > 1.5 THEN s.ncc END"


def _quality(spark, sf_dir, metric):
    s = _surface(spark, sf_dir)
    q = C.quality(s, C.top_peaks(s, 2, 1.5), metric, 1.5)
    return q.select("pair", F.col("place").cast("long").alias("place"), F.round("quality", 4).alias("quality"))


@query(_quality_sql(f"(any_value(t.ncc) - avg({_FAR})) / (stddev_pop({_FAR}) + 1e-12)"))
def a10_x03_psr(spark, sf_dir):
    return _quality(spark, sf_dir, "psr")


@query(_quality_sql("any_value(t.ncc) / (sqrt(sum(s.ncc * s.ncc)) + 1e-12)"))
def a12_per(spark, sf_dir):
    return _quality(spark, sf_dir, "per")


_T = with_("trials")


@query(_T + " SELECT template, u_offset, trial_ord, line, diff_u FROM trials QUALIFY diff_u <= quantile_cont(diff_u, 0.9) OVER (PARTITION BY template, u_offset)")
def a22_percentile_clip(spark, sf_dir):
    return T.percentile_clipped(fixture(spark, sf_dir, "trials"), ["template", "u_offset"], "diff_u", 0.9).select("template", "u_offset", "trial_ord", "line", "diff_u")


_E = _T + ", er AS (SELECT trial_ord, twist, sqrt(sum(power(sqrt(diff_u * diff_u + diff_v * diff_v) * atan2(sin(diff_v), cos(diff_v)), 2))) / count(*) AS error FROM trials GROUP BY ALL)"


def _errors(spark, sf_dir):
    t = fixture(spark, sf_dir, "trials").withColumn("magnitude", F.sqrt(F.col("diff_u") * F.col("diff_u") + F.col("diff_v") * F.col("diff_v"))).withColumn("diff_angle", F.col("diff_v"))
    return T.twist_error(t, ["trial_ord", "twist"])


@query(_E + " SELECT trial_ord, twist, round(error, 5) AS error FROM er")
def a23_twist_error(spark, sf_dir):
    return _errors(spark, sf_dir).select("trial_ord", "twist", F.round("error", 5).alias("error"))


@query(_E + " SELECT trial_ord, twist, round(error, 5) AS error, round(twist - 0.02, 6) AS low, round(twist + 0.02, 6) AS high FROM (SELECT trial_ord, twist, round(error, 5) AS error FROM er) QUALIFY row_number() OVER (PARTITION BY trial_ord ORDER BY error, twist) = 1")
def w20_narrowed_range(spark, sf_dir):
    e = _errors(spark, sf_dir).withColumn("error", F.round("error", 5))
    n = T.narrowed(e, ["trial_ord"], 0.01)
    return n.select("trial_ord", "twist", "error", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(_T + """ SELECT round(avg(twist), 6) AS twist_mean, round(stddev_pop(twist), 6) AS twist_std, round(quantile_cont(twist, 0.5), 6) AS twist_median, min(twist) AS twist_min, max(twist) AS twist_max,
  round(avg(sin(twist) * 724.0), 5) AS rotation_mean, round(stddev_pop(sin(twist) * 724.0), 5) AS rotation_std, round(quantile_cont(sin(twist) * 724.0, 0.5), 5) AS rotation_median, round(min(sin(twist) * 724.0), 5) AS rotation_min, round(max(sin(twist) * 724.0), 5) AS rotation_max FROM trials""")
def a25_corpus_summary(spark, sf_dir):
    s = T.corpus_summary(fixture(spark, sf_dir, "trials"), 724.0)
    return s.select(*(F.round(c, 5 if c.startswith("rot") else 6).alias(c) for c in s.columns))
