"""Queries over stars and rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators import rings as G
from platewise.operators import stars as S
from platewise.plans.fixtures import fixture, with_

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_FOUND = with_("stars", "fields") + ", found AS (SELECT * FROM stars JOIN fields ON CASE WHEN ra_min <= ra_max THEN ra BETWEEN ra_min AND ra_max ELSE ra >= ra_min OR ra <= ra_max END AND dec BETWEEN dec_min AND dec_max)"
_SIZES = [(5.0, 21), (7.0, 13), (9.5, 9)]


def _found(spark, sf_dir):
    return S.stars_in_fields(fixture(spark, sf_dir, "stars"), fixture(spark, sf_dir, "fields"))


@query(_FOUND + " SELECT image_id, catalog_rank, unique_number FROM found")
def j03_j04_s08_stars_in_fields(spark, sf_dir):
    return _found(spark, sf_dir).select("image_id", "catalog_rank", "unique_number")


@query(with_("stars") + " SELECT catalog_rank, unique_number, CASE WHEN vmag < 5 THEN 21 WHEN vmag < 7 THEN 13 WHEN vmag < 9.5 THEN 9 ELSE 9 END AS psf FROM stars")
def j05_psf_size(spark, sf_dir):
    return fixture(spark, sf_dir, "stars").select("catalog_rank", "unique_number", S.psf_size(F.col("vmag"), _SIZES).alias("psf"))


_DUP = "abs(a.ra - b.ra) < 5.0::DOUBLE / 3600.0::DOUBLE AND abs(a.dec - b.dec) < 5.0::DOUBLE / 3600.0::DOUBLE AND abs(a.vmag - b.vmag) < 3"


@query(with_("stars") + f""", s0 AS (SELECT * FROM stars WHERE catalog_rank = 0), s1 AS (SELECT * FROM stars b WHERE catalog_rank = 1), s2 AS (SELECT * FROM stars b WHERE catalog_rank = 2),
  k1 AS (SELECT * FROM s1 b WHERE NOT EXISTS (SELECT 1 FROM s0 a WHERE {_DUP})),
  n0 AS (SELECT a.* REPLACE (coalesce(a.name, (SELECT arg_min(b.name, b.dec) FROM s1 b WHERE b.name IS NOT NULL AND {_DUP})) AS name) FROM s0 a),
  u AS (SELECT * FROM n0 UNION ALL SELECT * FROM k1), k2 AS (SELECT * FROM s2 b WHERE NOT EXISTS (SELECT 1 FROM u a WHERE {_DUP}))
  SELECT catalog_rank, unique_number, name FROM u UNION ALL SELECT catalog_rank, unique_number, name FROM k2""")
def j06_u01_duplicates(spark, sf_dir):
    return S.without_duplicates(fixture(spark, sf_dir, "stars")).select("catalog_rank", "unique_number", "name")


@query(_FOUND + " SELECT image_ord, catalog_rank, unique_number, row_number() OVER (PARTITION BY image_ord ORDER BY power(2.512, 4 - vmag) DESC, catalog_rank * 10000000 + unique_number) AS place FROM found QUALIFY place <= 20")
def w05_brightest(spark, sf_dir):
    df = _found(spark, sf_dir).withColumn("dn", F.pow(F.lit(2.512), 4 - F.col("vmag"))).withColumn("v", F.col("catalog_rank") * 10000000 + F.col("unique_number"))
    return S.brightest(df, 20).select("image_ord", "catalog_rank", "unique_number", F.col("place").cast("long").alias("place"))


@query(_FOUND + """, c AS (SELECT image_ord, catalog_rank, CAST(floor(vmag) AS BIGINT) AS bucket, count(*) AS n FROM found GROUP BY ALL), k AS (SELECT * FROM c QUALIFY coalesce(sum(n) OVER (PARTITION BY image_ord, catalog_rank ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 5)
  SELECT image_ord, catalog_rank, bucket, n FROM k""")
def w06_enough(spark, sf_dir):
    df = _found(spark, sf_dir).withColumn("bucket", F.floor("vmag").cast("long"))
    return S.enough(df, 5).groupBy("image_ord", "catalog_rank", "bucket").agg(F.count("*").alias("n"))


_BOX = _FOUND + ", bx AS (SELECT image_ord, catalog_rank * 10000000 + unique_number AS star, dec * 10 AS v, dec * 10 - 4 AS v0, dec * 10 + 4 AS v1, ra * 10 - 4 AS u0, ra * 10 + 4 AS u1, vmag FROM found)"


@query(_BOX + """, m AS (SELECT a.image_ord, a.star AS x, b.star AS y, b.vmag - a.vmag < 2 AS both_ FROM bx a JOIN bx b ON a.image_ord = b.image_ord AND (a.v < b.v OR a.v = b.v AND a.star < b.star) AND a.v0 <= b.v1 AND b.v0 <= a.v1 AND a.u0 <= b.u1 AND b.u0 <= a.u1)
  SELECT image_ord, x AS star FROM m WHERE both_ UNION SELECT image_ord, y FROM m""")
def j07_overlaps(spark, sf_dir):
    v, u = F.col("dec") * 10, F.col("ra") * 10
    df = _found(spark, sf_dir).select("image_ord", (F.col("catalog_rank") * 10000000 + F.col("unique_number")).alias("star"), v.alias("v"), (v - 4).alias("v0"), (v + 4).alias("v1"), (u - 4).alias("u0"), (u + 4).alias("u1"), "vmag")
    return S.overlap_marks(df)


_T = with_("trials") + ", t AS (SELECT template, u_offset, trial_ord, line, diff_u, diff_v, 1.0 - twist AS reliability FROM trials)"


@query(_T + """, m AS (SELECT *, quantile_cont(diff_u, 0.5) OVER (PARTITION BY template, u_offset) AS med FROM t)
  SELECT template, u_offset, count(*) AS n, round(min(diff_u), 6) AS "min", round(max(diff_u), 6) AS "max", round(avg(diff_u), 6) AS mean, round(stddev_pop(diff_u), 6) AS std, round(any_value(med), 6) AS median, round(1.4826 * quantile_cont(abs(diff_u - med), 0.5), 6) AS mad_std FROM m GROUP BY ALL""")
def a04_a05_summary(spark, sf_dir):
    s = S.summary(fixture(spark, sf_dir, "trials"), ["template", "u_offset"], "diff_u")
    return s.select("template", "u_offset", "n", *(F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std", "median", "mad_std")))


_OUT = _T + """, m AS (SELECT *, count(*) OVER g AS n, quantile_cont(diff_u, 0.5) OVER g AS mu, quantile_cont(diff_v, 0.5) OVER g AS mv FROM t WINDOW g AS (PARTITION BY template, u_offset)),
  d AS (SELECT *, quantile_cont(abs(diff_u - mu), 0.5) OVER g AS du, quantile_cont(abs(diff_v - mv), 0.5) OVER g AS dv FROM m WINDOW g AS (PARTITION BY template, u_offset)),
  o AS (SELECT *, coalesce(n >= 3 AND 0.6745 * abs(diff_u - mu) / nullif(du, 0) / reliability > 1.3, false) OR coalesce(n >= 3 AND 0.6745 * abs(diff_v - mv) / nullif(dv, 0) / reliability > 1.3, false) AS outlier FROM d)"""


def _outliers(spark, sf_dir):
    t = fixture(spark, sf_dir, "trials").withColumn("reliability", 1.0 - F.col("twist"))
    return S.outliers(t, ["template", "u_offset"], ("diff_u", "diff_v"), 1.3)


@query(_OUT + " SELECT template, u_offset, count(*) FILTER (outlier) AS outliers FROM o GROUP BY ALL")
def a06_outliers(spark, sf_dir):
    return _outliers(spark, sf_dir).groupBy("template", "u_offset").agg(F.count_if("outlier").alias("outliers"))


@query(_OUT + " SELECT template, u_offset, round(quantile_cont(diff_u, 0.5), 6) AS diff_u_shift, round(quantile_cont(diff_v, 0.5), 6) AS diff_v_shift, round(stddev_pop(diff_u), 6) AS diff_u_sigma, round(stddev_pop(diff_v), 6) AS diff_v_sigma FROM o WHERE NOT outlier GROUP BY ALL")
def a07_refined_offset(spark, sf_dir):
    r = S.refined(_outliers(spark, sf_dir), ["template", "u_offset"])
    return r.select("template", "u_offset", *(F.round(c, 6).alias(c) for c in ("diff_u_shift", "diff_v_shift", "diff_u_sigma", "diff_v_sigma")))


_RING = with_("features", "ring_images") + """, ok AS (SELECT * FROM features WHERE upper(feature_type) IN ('GAP', 'RINGLET') AND (inner_a IS NOT NULL OR outer_a IS NOT NULL)),
  tm AS (SELECT * FROM ok JOIN ring_images ON (start_year IS NULL OR start_year <= obs_year) AND (end_year IS NULL OR obs_year < end_year)),
  rd AS (SELECT * FROM tm WHERE coalesce(inner_a BETWEEN min_radius AND max_radius, true) AND coalesce(outer_a BETWEEN min_radius AND max_radius, true)),
  ed AS (SELECT image_ord, feature_key, resolution, CASE WHEN feature_type = 'GAP' THEN 'IEG' ELSE 'IER' END AS label, inner_a AS a, feature_type <> 'GAP' AS shade_above FROM rd WHERE inner_a IS NOT NULL
    UNION ALL SELECT image_ord, feature_key, resolution, CASE WHEN feature_type = 'GAP' THEN 'OEG' ELSE 'OER' END, outer_a, feature_type = 'GAP' FROM rd WHERE outer_a IS NOT NULL)"""


def _rings(spark, sf_dir):
    return G.in_radius(G.in_time(G.valid_features(fixture(spark, sf_dir, "features")), fixture(spark, sf_dir, "ring_images")))


@query(_RING + " SELECT image_ord, feature_key FROM tm")
def j09_p49_valid_in_time(spark, sf_dir):
    return G.in_time(G.valid_features(fixture(spark, sf_dir, "features")), fixture(spark, sf_dir, "ring_images")).select("image_ord", "feature_key")


@query(_RING + " SELECT image_ord, feature_key FROM rd")
def j10_inside_radius(spark, sf_dir):
    return _rings(spark, sf_dir).select("image_ord", "feature_key")


@query(_RING + " SELECT image_ord, feature_key, label, a, shade_above FROM ed")
def a19_edges(spark, sf_dir):
    return G.edges(_rings(spark, sf_dir)).select("image_ord", "feature_key", "label", "a", "shade_above")


@query(_RING + """, h AS (SELECT e.image_ord, e.feature_key, e.label, min(o.a) AS near FROM ed e JOIN ed o ON e.image_ord = o.image_ord AND CASE WHEN e.shade_above THEN o.a > e.a AND o.a <= e.a + 100 ELSE o.a < e.a AND o.a >= e.a - 100 END GROUP BY ALL)
  SELECT image_ord, feature_key, label, CASE WHEN near IS NULL THEN 100.0 ELSE abs(near - a) / 2 END AS fade_width FROM ed LEFT JOIN h USING (image_ord, feature_key, label) WHERE CASE WHEN near IS NULL THEN 100.0 ELSE abs(near - a) / 2 END >= 5""")
def j11_a20_fade_widths(spark, sf_dir):
    return G.fade_widths(G.edges(_rings(spark, sf_dir)), 100.0, 5.0).select("image_ord", "feature_key", "label", "fade_width")


@query(_RING + " SELECT image_ord, feature_key, label, k, round(greatest(0.0, least(1.0, 0.5 + CASE WHEN shade_above THEN 1.0 ELSE -1.0 END * (a + k * 0.25 - a) / resolution)), 6) AS shade FROM ed, unnest([-2, 0, 1]) t(k)")
def f12_shades(spark, sf_dir):
    e = G.edges(_rings(spark, sf_dir)).withColumn("k", F.explode(F.array(F.lit(-2), F.lit(0), F.lit(1))))
    shade = G.antialiased(F.col("a") + F.col("k") * 0.25, F.col("a"), F.col("shade_above"), F.col("resolution"))
    return e.select("image_ord", "feature_key", "label", "k", F.round(shade, 6).alias("shade"))


@query(_RING + " SELECT image_ord, count(*) AS features, string_agg(concat(name, ':', feature_type), ',' ORDER BY concat(name, ':', feature_type)) AS listing FROM rd GROUP BY 1")
def a33_feature_summary(spark, sf_dir):
    return G.summary(_rings(spark, sf_dir))
