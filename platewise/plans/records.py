"""Queries over sinks, tasks, candidates, planes by configuration and array helpers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from platewise.functions import names as N
from platewise.operators import catalog as C
from platewise.operators import correlate as K
from platewise.operators import fields as L
from platewise.operators import pixels as P
from platewise.operators import planes as A
from platewise.operators import results as R
from platewise.operators import trials as T
from platewise.plans.catalog import _NAMED, _entries
from platewise.plans.fixtures import fixture, table, with_
from platewise.plans.images import _FAR, _I, _NEAR, _PK, _S, _images, _quality_sql, _surface
from platewise.plans.results import _BACK, _NAV, _PIX, _STATS, _nav, _px
from platewise.session import scratch
from platewise.sources import files as S
from platewise.streaming import tasks as Q

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def s01_index_columns(spark, sf_dir):
    return S.index_table(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_orderstatus"])


@query(_NAMED + "SELECT concat('set-', img_name, '-', row_ord) AS task_id, 'set' AS dataset_name, 1 AS n_files, image AS image_file_url, stub AS results_path_stub FROM entries WHERE outcome = 'ok'")
def s11_tasks(spark, sf_dir):
    good = C.quarantine(_entries(spark, sf_dir))[0].withColumn("grp", F.col("row_ord")).withColumn("place", F.lit(0))
    t = S.tasks(good, "set")
    return t.select("task_id", "dataset_name", F.size("files").alias("n_files"), *(F.element_at("files", 1)[c].alias(c) for c in ("image_file_url", "results_path_stub")))


_TEXT = "regexp_replace(regexp_replace(printf('%.6f', {0}), '0+$', ''), '\\.$', '')"


@query(f"SELECT concat(b, '_', {_TEXT.format('u')}, '_', {_TEXT.format('v')}) AS task_id, b AS template, u, v FROM (SELECT DISTINCT p_brand AS b FROM part), (SELECT -0.5::DOUBLE + i * 0.25::DOUBLE AS u FROM range(5) a(i)), (SELECT 0.0::DOUBLE + j * 0.5::DOUBLE AS v FROM range(3) c(j))")
def s12_j18_task_grid(spark, sf_dir):
    templates = table(spark, sf_dir, "part").select(F.col("p_brand").alias("template")).distinct()
    return T.task_grid(spark, templates, (-0.5, 0.5, 0.25), (0.0, 1.0, 0.5)).select("task_id", "template", "u", "v")


@query(_NAV + """ SELECT 'set' AS dataset, string_split(results_path_stub, '/')[1] AS volume, results_path_stub, concat('{"image_ord":', image_ord, ',"status":"', status, '"', CASE WHEN status_exception IS NULL THEN '' ELSE concat(',"status_exception":"', status_exception, '"') END, '}') AS document FROM navigation""")
def s13_result_documents(spark, sf_dir):
    return R.result_documents(_nav(spark, sf_dir).select("results_path_stub", "image_ord", "status", "status_exception"), "set")


@query(_PIX + """, v AS (SELECT image_ord, plane, v, u, CASE WHEN plane = 'RADIUS' AND image_ord % 3 = 0 THEN 0 ELSE value END AS value FROM px WHERE body_ord = 0), ids AS (SELECT image_ord, v, u, CASE WHEN image_ord % 4 = 0 THEN 0 ELSE 600 + body_ord END AS id FROM pixels WHERE body_ord = 0),
  al AS (SELECT image_ord, 0 AS plane_ord, 'BODY_ID_MAP' AS plane, '' AS units, id AS value FROM ids WHERE image_ord IN (SELECT image_ord FROM ids WHERE id <> 0)
    UNION ALL SELECT image_ord, 1, plane, CASE plane WHEN 'RADIUS' THEN 'km' ELSE '' END, value FROM v WHERE (image_ord, plane) IN (SELECT image_ord, plane FROM v GROUP BY ALL HAVING bool_or(value IS NULL OR value <> 0)))
  SELECT image_ord, plane_ord, plane AS "PLANE", units, count(*) AS n, round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)), 3) AS total FROM al GROUP BY ALL""")
def s14_p44_plane_table(spark, sf_dir):
    px = _px(spark, sf_dir).filter("body_ord = 0").withColumn("value", F.when((F.col("plane") == "RADIUS") & (F.col("image_ord") % 3 == 0), 0.0).otherwise(F.col("value")))
    ids = fixture(spark, sf_dir, "pixels").filter("body_ord = 0").withColumn("body_id", F.when(F.col("image_ord") % 4 == 0, 0).otherwise(600 + F.col("body_ord")))
    t = A.plane_table(px, ids, {"RADIUS": "km"})
    return t.groupBy("image_ord", "plane_ord", "PLANE", "units").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("double")), 3).alias("total"))


@query(with_("pixels", "ring_pixels", "inventory") + """, b AS (SELECT image_ord, body_ord, CAST(floor(min(value) * 1000) AS BIGINT) AS lo, CAST(floor(max(value) * 1000) AS BIGINT) AS hi FROM pixels WHERE valid GROUP BY ALL),
  e AS (SELECT image_ord, concat('B', body_ord) AS body, concat('"B', body_ord, '":{"backplanes":{"X":{"min":', lo, ',"max":', hi, '}}', CASE WHEN center_v IS NULL THEN '' ELSE concat(',"center_uv":[', center_v, ',', center_u, '],"center_range":', range) END, CASE WHEN u_pixel_size IS NULL THEN '' ELSE concat(',"size_uv":[', u_pixel_size, ',', v_pixel_size, ']') END, '}') AS t FROM b LEFT JOIN inventory USING (image_ord, body_ord)),
  bs AS (SELECT image_ord, string_agg(t, ',' ORDER BY body) AS t FROM e GROUP BY 1), rs AS (SELECT image_ord, concat('"rings":{"backplanes":{"RADIUS":{"min":', CAST(min(value) AS BIGINT), ',"max":', CAST(max(value) AS BIGINT), '}}}') AS r FROM ring_pixels WHERE valid GROUP BY 1)
  SELECT image_ord, concat('{', CASE WHEN t IS NULL THEN '' ELSE concat('"bodies":{', t, '}') END, CASE WHEN t IS NULL OR r IS NULL THEN '' ELSE ',' END, coalesce(r, ''), '}') AS document FROM bs FULL JOIN rs USING (image_ord)""")
def s15_statistics_documents(spark, sf_dir):
    whole = lambda c, k=1: F.floor(F.col(c) * k).cast("long").alias(c)
    px = fixture(spark, sf_dir, "pixels").withColumns({"plane": F.lit("X"), "units": F.lit("km")})
    bodies = A.statistics(px).select("image_ord", F.concat(F.lit("B"), "body_ord").alias("body"), "plane", whole("min", 1000), whole("max", 1000))
    rings = A.statistics(fixture(spark, sf_dir, "ring_pixels").withColumn("units", F.lit("km")), ("image_ord", "plane")).select("image_ord", "plane", whole("min"), whole("max"))
    return A.statistics_documents(bodies, rings, fixture(spark, sf_dir, "inventory").withColumn("body", F.concat(F.lit("B"), "body_ord")))


@query(_BACK + """ SELECT image_ord, concat('{"navigation":{"status":"', status, '"},"backplanes":{"n_planes":', n_planes, ',"kind":"', kind, '"}}') AS document FROM navigation JOIN backplanes USING (image_ord)""")
def s16_supplemental(spark, sf_dir):
    return S.supplemental(_nav(spark, sf_dir).select("image_ord", "status"), fixture(spark, sf_dir, "backplanes"), "image_ord")


@query(_NAMED + """SELECT 'P' AS "Member Status", concat('urn:nasa:pds:b1:data:', substr(string_split(img_name, '_')[1], 2), lower(img_name[1]), '::1.0') AS "LIDVID_LID" FROM entries WHERE instrument = 'coiss' AND outcome = 'ok'""")
def s17_collection(spark, sf_dir):
    return S.collection(C.quarantine(_entries(spark, sf_dir))[0].filter("instrument = 'coiss'"), "b1", "data")


@query(_STATS + """ SELECT image_ord, body_ord, coalesce(printf('%.5f', round(max(lo) FILTER (plane = 'LONGITUDE'), 9)), '') AS "LONGITUDE_min", coalesce(printf('%.5f', round(max(hi) FILTER (plane = 'LONGITUDE'), 9)), '') AS "LONGITUDE_max", '' AS "PHASE_min", '' AS "PHASE_max" FROM st GROUP BY ALL""")
def s18_global_index(spark, sf_dir):
    rows = A.index_rows(A.statistics(_px(spark, sf_dir)), ("LONGITUDE", "PHASE"))
    return S.global_index(rows.select("image_ord", "body_ord", *(F.round(c, 9).alias(c) for c in rows.columns[2:])), ["image_ord", "body_ord"])


@query(with_("trials") + """ SELECT concat('a/v', line, '/', template, trial_ord, '.IMG') AS url, concat(template, trial_ord) AS img_name, printf('%8.5f', twist) AS twist, printf('%9.5f', diff_u) AS rotation_error, printf('%8.3f', CAST(u_offset AS DOUBLE)) AS int_offset_x, printf('%8.3f', CAST(v_offset AS DOUBLE)) AS int_offset_y, printf('%8.3f', u_offset + 0.125::DOUBLE) AS opt_offset_x, printf('%8.3f', v_offset - 0.125::DOUBLE) AS opt_offset_y, printf('%9.5f', diff_v) AS error FROM trials WHERE line <> 3""")
def s19_twist_rows(spark, sf_dir):
    t, d = fixture(spark, sf_dir, "trials"), lambda c: c.cast("double")
    t = t.select(F.concat(F.lit("a/v"), "line", F.lit("/"), "template", "trial_ord", F.lit(".IMG")).alias("url"), F.when(F.col("line") != 3, F.col("twist").cast("double")).alias("twist"), F.col("diff_u").cast("double").alias("rotation_error"), d(F.col("u_offset")).alias("int_offset_x"), d(F.col("v_offset")).alias("int_offset_y"), (F.col("u_offset") + 0.125).alias("opt_offset_x"), (F.col("v_offset") - 0.125).alias("opt_offset_y"), F.col("diff_v").cast("double").alias("error"))
    return R.twist_rows(t)


_FILE = "struct<image_file_url:string,label_file_url:string,results_path_stub:string>"
_TASK = "WITH t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'r' END AS root, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 'Other' ELSE 'COISS' END AS ds, o_orderkey % 3 AS n, o_orderkey % 5 AS lack FROM orders), e AS (SELECT *, CASE WHEN root IS NULL THEN 'no_nav_root' WHEN ds IS NULL THEN 'no_dataset_name' WHEN ds = 'Other' THEN 'unknown_dataset' WHEN n = 0 THEN 'no_files' WHEN lack = 1 THEN 'no_image_file_url' WHEN lack = 2 THEN 'no_label_file_url' WHEN lack = 3 THEN 'no_results_path_stub' END AS error FROM t)"


def _tasks(spark, sf_dir):
    k = F.col("o_orderkey")
    lack = lambda i, text: F.when(k % 5 != i, F.lit(text))
    one = F.struct(lack(1, "i").alias("image_file_url"), lack(2, "l").alias("label_file_url"), lack(3, "s").alias("results_path_stub"))
    files = F.array_repeat(one, (k % 3).cast("int"))
    return table(spark, sf_dir, "orders").select(k.cast("string").alias("task_id"), F.when(k % 11 != 0, "r").alias("nav_root"), F.when(k % 7 == 1, "Other").when(k % 7 > 1, "COISS").alias("dataset_name"), files.alias("files"))


@query(_TASK + " SELECT CAST(k AS VARCHAR) AS task_id, error, n = 1 AS single FROM e")
def p31_p32_t01_validated_tasks(spark, sf_dir):
    return Q.validated(_tasks(spark, sf_dir), ("coiss",)).select("task_id", "error", R.one_image(F.col("files")).alias("single"))


@query(_TASK + " SELECT CAST(k AS VARCHAR) AS task_id, 'COISS' AS dataset_name, 'i' AS image_file_url FROM e, range(2) r(i) WHERE error IS NULL AND r.i < n")
def t02_task_files(spark, sf_dir):
    return Q.files_of(Q.validated(_tasks(spark, sf_dir), ("coiss",))).select("task_id", "dataset_name", "image_file_url")


@query(_TASK + " SELECT coalesce(error, 'valid') AS status, count(*) AS count FROM e GROUP BY 1")
def t03_status_counts(spark, sf_dir):
    return Q.status_counts(Q.validated(_tasks(spark, sf_dir), ("coiss",)))


@query("SELECT p_partkey, p_size * (p_partkey % 4) >= 9 AS large FROM part")
def p40_large_enough(spark, sf_dir):
    zero = F.lit(0)
    return table(spark, sf_dir, "part").select("p_partkey", L.large_enough(zero, F.col("p_size"), zero, F.col("p_partkey") % 4, 9.0).alias("large"))


@query("""WITH b AS (SELECT p_partkey AS k, p_partkey % 300 - 100 AS a, p_size + p_partkey % 50 AS w, p_partkey % 280 - 90 AS c FROM part), s AS (SELECT *, CAST(trunc(w * 0.05::DOUBLE) AS BIGINT) AS sl FROM b), x AS (SELECT k, greatest(-10, least(109, a - sl)) AS ua, greatest(-10, least(109, a + w + sl)) AS ub, greatest(-5, least(84, c)) AS va, greatest(-5, least(84, c)) AS vb FROM s)
  SELECT k, CASE WHEN ua = ub AND ua = 109 THEN ua - 1 ELSE ua END AS u_min, CASE WHEN ua = ub AND ua = -10 THEN ub + 1 ELSE ub END AS u_max, CASE WHEN va = 84 THEN va - 1 ELSE va END AS v_min, CASE WHEN va = -5 THEN vb + 1 ELSE vb END AS v_max,
  CASE WHEN ua = ub AND ua = 109 THEN ua - 1 ELSE ua END >= 10 AND CASE WHEN ua = ub AND ua = -10 THEN ub + 1 ELSE ub END <= 89 AND CASE WHEN va = 84 THEN va - 1 ELSE va END >= 5 AND CASE WHEN va = -5 THEN vb + 1 ELSE vb END <= 74 AS visible FROM x""")
def p41_body_box(spark, sf_dir):
    k = F.col("p_partkey")
    b = table(spark, sf_dir, "part").select(k.alias("k"), (k % 300 - 100).alias("u_min"), (k % 300 - 100 + F.col("p_size") + k % 50).alias("u_max"), (k % 280 - 90).alias("v_min"), (k % 280 - 90).alias("v_max"))
    return L.body_box(b, 80, 100, 5, 10).select("k", "u_min", "u_max", "v_min", "v_max", "visible")


_MOONS = [("Earth", "MOON"), ("Mars", "DEIMOS"), ("Mars", "PHOBOS")]


@query("""WITH i AS (SELECT c_custkey, ['earth', 'MARS', 'Venus'][c_custkey % 3 + 1] AS planet FROM customer), m AS (SELECT * FROM (VALUES ('EARTH', 'MOON', 0), ('MARS', 'DEIMOS', 1), ('MARS', 'PHOBOS', 2), ('EARTH', 'EARTH', -1), ('MARS', 'MARS', -1)) t(p, body, body_place))
  SELECT c_custkey, body, body_place FROM i JOIN m ON p = upper(planet)""")
def j20_satellites(spark, sf_dir):
    i = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, ("earth", "MARS", "Venus"))), (F.col("c_custkey") % 3 + 1).cast("int")).alias("planet"))
    return L.satellites(i, _MOONS).select("c_custkey", "body", "body_place")


@query(_NAMED + "SELECT row_ord FROM entries WHERE outcome = 'ok' AND shutter_mode_id = 'BOTSIM'")
def x05_extra_condition(spark, sf_dir):
    return C.extra(C.quarantine(_entries(spark, sf_dir))[0], lambda df: df["shutter_mode_id"] == "BOTSIM").select("row_ord")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 16 > 8 THEN l_partkey % 16 - 16 ELSE l_partkey % 16 END AS shift FROM lineitem")
def w15_signed(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", K.signed(F.col("l_partkey") % 16, 16).alias("shift"))


@query(_quality_sql("any_value(t.ncc) / (avg(s.ncc) + 1e-12)").replace("round(any_value", "round(1e-3::DOUBLE * any_value"))
def a11_pmr(spark, sf_dir):
    s = _surface(spark, sf_dir)
    q = K.quality(s, K.top_peaks(s, 2, 1.5), "pmr", 1.5)
    return q.select("pair", F.col("place").cast("long").alias("place"), F.round(1e-3 * F.col("quality"), 4).alias("quality"))


@query(_PK + ", q AS (SELECT pair, place, py, px, round(numerator, 6) AS quality FROM (SELECT p.*, sf.numerator FROM pk p JOIN sf ON sf.pair = p.pair AND sf.dy = p.py AND sf.dx = p.px)), s AS (SELECT *, quality - 0.5 * sqrt(power(py - 1, 2) + power(px + 1, 2)) AS score FROM q), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY pair ORDER BY score DESC, place) = 1), al AS (SELECT DISTINCT vec_id AS pair FROM embeddings) SELECT pair, coalesce(py, 0) AS dy, coalesce(px, 0) AS dx, coalesce(round(score, 5), '-inf'::DOUBLE) AS score FROM al LEFT JOIN b USING (pair)")
def w13_best_candidate(spark, sf_dir):
    p = K.top_peaks(_surface(spark, sf_dir), 2, 1.5).withColumn("quality", F.round("peak", 6))
    b = K.best_candidate(p, 0.5, (1.0, -1.0), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pair")))
    return b.select("pair", F.col("dy").cast("long").alias("dy"), F.col("dx").cast("long").alias("dx"), F.round("score", 5).alias("score"))


@query(_S.replace("AS numerator, (im", "AS numerator, (im").replace("greatest(0.0, mm / w - (m / w) * (m / w))", "greatest(0.0, (mm - 2 * (m / w) * m + 400 * (m / w) * (m / w)) / w)") + " SELECT pair, dy, dx, round(ncc, 6) AS ncc FROM sf")
def a09_padded_correlation(spark, sf_dir):
    im = _images(spark, sf_dir)
    model = im.filter("image_ord > 0").select((F.col("image_ord") - 1).alias("pair"), "v", "u", "value", F.col("valid").alias("mask"))
    s = K.surface(im.select(F.col("image_ord").alias("pair"), "v", "u", "value"), model, 2, padded=400)
    return s.select("pair", F.col("dy").cast("long").alias("dy"), F.col("dx").cast("long").alias("dx"), F.round("ncc", 6).alias("ncc"))


@query(_S.replace("i.value", "(i.value * i.v)").replace("value AS m FROM md", "value * 2 AS m FROM md") + " SELECT pair, dy, dx, round(numerator, 5) AS numerator FROM sf")
def x04_filtered_correlation(spark, sf_dir):
    im = _images(spark, sf_dir)
    model = im.filter("image_ord > 0").select((F.col("image_ord") - 1).alias("pair"), "v", "u", "value", F.col("valid").alias("mask"))
    s = K.surface(im.select(F.col("image_ord").alias("pair"), "v", "u", "value"), model, 2, image_filter=lambda d: d.withColumn("value", F.col("value") * F.col("v")), model_filter=lambda d: d.withColumn("value", F.col("value") * 2))
    return s.select("pair", F.col("dy").cast("long").alias("dy"), F.col("dx").cast("long").alias("dx"), F.round("numerator", 5).alias("numerator"))


_BOUNDED = _S + """, ar AS (SELECT pair, dy, dx, ncc FROM sf), p0 AS (SELECT * FROM ar QUALIFY row_number() OVER (PARTITION BY pair ORDER BY ncc DESC, dy, dx) = 1 AND ncc > 0),
  l1 AS (SELECT a.* FROM ar a JOIN p0 p ON p.pair = a.pair AND (abs(a.dy - p.dy) > 1 OR abs(a.dx - p.dx) > 1)), p1 AS (SELECT * FROM l1 QUALIFY row_number() OVER (PARTITION BY pair ORDER BY ncc DESC, dy, dx) = 1 AND ncc > 0)
  SELECT pair, 0 AS place, dy, dx, round(ncc, 6) AS peak FROM p0 WHERE abs(dy) < 2 AND abs(dx) < 2
  UNION ALL SELECT b.pair, 1, b.dy, b.dx, round(b.ncc, 6) FROM p1 b JOIN p0 a USING (pair) WHERE abs(b.dy) < 2 AND abs(b.dx) < 2 AND NOT (abs(b.dx - a.dx) = 2 AND abs(b.dy - a.dy) <= 1 OR abs(b.dy - a.dy) = 2 AND abs(b.dx - a.dx) <= 1)"""


@query(_BOUNDED)
def w22_bounded_peaks(spark, sf_dir):
    p = K.bounded_peaks(_surface(spark, sf_dir), (0, 0), (2, 2), 2, 1)
    return p.select("pair", F.col("place").cast("int").alias("place"), F.col("dy").cast("long").alias("dy"), F.col("dx").cast("long").alias("dx"), F.round("peak", 6).alias("peak"))


_GRAD = _I + """, g AS (SELECT *, lag(value) OVER a AS vb, lead(value) OVER a AS va, lag(value) OVER b AS ub, lead(value) OVER b AS ua FROM im WINDOW a AS (PARTITION BY image_ord, u ORDER BY v), b AS (PARTITION BY image_ord, v ORDER BY u)),
  d AS (SELECT image_ord, CASE WHEN vb IS NULL THEN va - value WHEN va IS NULL THEN value - vb ELSE (va - vb) / 2 END AS gv, CASE WHEN ub IS NULL THEN ua - value WHEN ua IS NULL THEN value - ub ELSE (ua - ub) / 2 END AS gu FROM g),
  f AS (SELECT image_ord, sum(gu * gu) * 4 AS a, sum(gv * gv) * 4 AS d, sum(gu * gv) * 4 AS b FROM d GROUP BY 1)"""


@query(_GRAD + " SELECT image_ord, round(d / (a * d - b * b), 6) AS cov_xx, round(-b / (a * d - b * b), 6) AS cov_xy, round(a / (a * d - b * b), 6) AS cov_yy FROM f")
def a13_fisher_covariance(spark, sf_dir):
    im = _images(spark, sf_dir)
    c = K.fisher_covariance(im, im.select("image_ord").distinct().withColumn("sigma_n", F.lit(0.5)))
    return c.select("image_ord", *(F.round(x, 6).alias(x) for x in ("cov_xx", "cov_xy", "cov_yy")))


@query(_I + """, n AS (SELECT image_ord, v, u, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS x FROM im WINDOW w AS (PARTITION BY image_ord)), r AS (SELECT a.image_ord, a.x - b.x AS r FROM n a JOIN n b ON b.image_ord = a.image_ord + 1 AND a.v = b.v AND a.u = b.u), m AS (SELECT *, quantile_cont(r, 0.5) OVER (PARTITION BY image_ord) AS md FROM r)
  SELECT image_ord, round(1.4826 * quantile_cont(abs(r - md), 0.5), 6) AS sigma_n FROM m GROUP BY 1""")
def a14_residual_noise(spark, sf_dir):
    im = _images(spark, sf_dir)
    n = K.residual_noise(im, im.filter("image_ord > 0").withColumn("image_ord", F.col("image_ord") - 1))
    return n.select("image_ord", F.round("sigma_n", 6).alias("sigma_n"))


@query("""WITH l AS (SELECT l_orderkey AS pair, l_linenumber AS level, (l_partkey % 9 - 4) * power(2, l_linenumber - 1) / 16.0::DOUBLE AS y, (l_suppkey % 7 - 3) * power(2, l_linenumber - 1) / 16.0::DOUBLE AS x FROM lineitem), a AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY pair ORDER BY level, y, x) = 1),
  c AS (SELECT l.pair, round(max(sqrt(power(l.y - a.y, 2) + power(l.x - a.x, 2))), 6) AS consistency FROM l JOIN a USING (pair) GROUP BY 1)
  SELECT pair, consistency, o_custkey % 12 < 6 OR consistency > 2 AS spurious FROM c JOIN orders ON o_orderkey = pair WHERE pair NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def w14_pyramid_consistency(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("level"), ((F.col("l_partkey") % 9 - 4) / 16.0).alias("dy"), ((F.col("l_suppkey") % 7 - 3) / 16.0).alias("dx"))
    twice = l.groupBy("pair", "level").agg(F.count("*").alias("n")).filter("n > 1").select("pair")
    finals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair"), (F.col("o_custkey") % 12).alias("quality"))
    c = K.pyramid_consistency(l.join(twice, "pair", "left_anti"), finals)
    return c.select("pair", F.round("consistency", 6).alias("consistency"), "spurious")


@query(with_("trials") + """, a AS (SELECT template, u_offset, count(*) AS n, quantile_cont(diff_v, 0.5) AS mv, quantile_cont(diff_u, 0.5) AS mu FROM trials GROUP BY ALL), b AS (SELECT template, u_offset, count(*) AS n, avg(diff_v) AS av, avg(diff_u) AS au FROM trials WHERE line > 1 GROUP BY ALL)
  SELECT template, u_offset, round(1.5 - mv, 6) AS dv, round(2.5 - mu, 6) AS du, round(av, 6) AS mean_v, round(au, 6) AS mean_u FROM a JOIN b USING (template, u_offset) WHERE a.n >= 5 AND b.n >= 5""")
def a24_median_adjusted(spark, sf_dir):
    t = fixture(spark, sf_dir, "trials").withColumn("dv", F.lit(1.5)).withColumn("du", F.lit(2.5))
    m = T.median_adjusted(t, t.filter("line > 1"), ["template", "u_offset"], 5)
    return m.select("template", "u_offset", *(F.round(c, 6).alias(c) for c in ("dv", "du", "mean_v", "mean_u")))


_CONFIG = [{"name": "far", "method": "range", "units": "km"}, {"name": "low", "method": "level", "units": "rad"}]


@query(with_("pixels") + " SELECT image_ord, body_ord, v, u, plane, units, round(CASE plane WHEN 'far' THEN distance * 2 ELSE value - 1 END, 6) AS value FROM pixels, (VALUES ('far', 'km'), ('low', 'rad')) t(plane, units)")
def x02_configured_planes(spark, sf_dir):
    p = A.configured_planes(fixture(spark, sf_dir, "pixels"), _CONFIG, {"range": lambda d: d["distance"] * 2, "level": lambda d: d["value"] - 1})
    return p.select("image_ord", "body_ord", "v", "u", "plane", "units", F.round("value", 6).alias("value"))


@query(_PIX + " SELECT image_ord, plane, round(coalesce(min(value) FILTER (valid AND body_ord % 3 <> 0 AND image_ord % 5 <> 0), 0.0), 6) AS low, round(CASE WHEN count(*) FILTER (valid AND body_ord % 3 <> 0 AND image_ord % 5 <> 0) = 0 THEN 1.0 ELSE max(value) FILTER (valid AND body_ord % 3 <> 0 AND image_ord % 5 <> 0) END, 6) AS high FROM px GROUP BY ALL")
def a30_relative_range(spark, sf_dir):
    p = _px(spark, sf_dir).withColumn("body_id", F.when(F.col("image_ord") % 5 == 0, 0).otherwise(F.col("body_ord") % 3))
    r = A.relative_range(p)
    return r.select("image_ord", "plane", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(with_("stars", "features") + ", m AS (SELECT 'stars' AS kind, 0 AS kind_ord, unique_number AS id FROM stars UNION ALL SELECT 'bodies', 1, vec_id FROM embeddings UNION ALL SELECT 'rings', 2, feature_key FROM features) SELECT kind, kind_ord, count(*) AS n, sum(id)::BIGINT AS ids FROM m GROUP BY ALL")
def u03_all_models(spark, sf_dir):
    one = lambda df, c: df.select(F.col(c).alias("id"))
    m = L.all_models({"stars": one(fixture(spark, sf_dir, "stars"), "unique_number"), "bodies": one(table(spark, sf_dir, "embeddings"), "vec_id"), "rings": one(fixture(spark, sf_dir, "features"), "feature_key")})
    return m.groupBy("kind", "kind_ord").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(_I + " SELECT p.image_ord, g.v, g.u, round(coalesce(i.value, -1.0), 6) AS value FROM (SELECT DISTINCT image_ord FROM im) p, (SELECT v, u FROM range(12) a(v), range(10) b(u)) g LEFT JOIN im i ON i.image_ord = p.image_ord AND i.v = g.v - 2 AND i.u = g.u - 1")
def w18_padded(spark, sf_dir):
    return P.padded(_images(spark, sf_dir), 2, 1, 8, 8, -1.0).select("image_ord", "v", "u", F.round("value", 6).alias("value"))


@query(_I + " SELECT image_ord, v - 2 AS v, u - 1 AS u, round(value, 6) AS value FROM im WHERE v BETWEEN 2 AND 5 AND u BETWEEN 1 AND 6")
def w18_unpadded(spark, sf_dir):
    return P.unpadded(_images(spark, sf_dir), 2, 1, 8, 8).select("image_ord", "v", "u", F.round("value", 6).alias("value"))


@query(_I + " SELECT image_ord, v - 2 AS v, u - 1 AS u, round(value, 6) AS value FROM im WHERE v BETWEEN 2 AND 4 AND u BETWEEN 1 AND 5")
def w18_cropped(spark, sf_dir):
    return P.cropped(_images(spark, sf_dir), 8, 8, 3, 5).select("image_ord", "v", "u", F.round("value", 6).alias("value"))


@query(_I + " SELECT p.image_ord, g.v, g.u, round(coalesce(i.value, 0.0), 6) AS value FROM (SELECT DISTINCT image_ord FROM im) p, (SELECT v, u FROM range(6) a(v), range(10) b(u)) g LEFT JOIN im i ON i.image_ord = p.image_ord AND i.v = g.v AND i.u = g.u")
def w18_at_top_left(spark, sf_dir):
    return P.at_top_left(_images(spark, sf_dir), 6, 10).select("image_ord", "v", "u", F.round("value", 6).alias("value"))


@query(_NEAR.replace("range(-1, 2)", "range(-2, 3)").replace("JOIN im b ON", "JOIN im b ON sqrt(i * i + j * j) <= 2.5 AND") + " SELECT image_ord, v, u, round(value - quantile_cont(x, 0.5), 6) AS value FROM near GROUP BY image_ord, v, u, value")
def w11_minus_median_circle(spark, sf_dir):
    return P.minus_median(_images(spark, sf_dir), 2, 8, 8, "circle").select("image_ord", "v", "u", F.round("value", 6).alias("value"))


@query(_I + """, q AS (SELECT image_ord, valid, quantile_cont(value, 0.1) AS b, quantile_cont(value, 0.9) AS w FROM im GROUP BY ALL)
  SELECT image_ord, v, u, CAST(least(255, floor(greatest(0.0, least(1.0, (value - b) / (CASE WHEN w = b THEN b + 0.01 ELSE w END - b))) * 256)) AS BIGINT) AS level FROM im JOIN q USING (image_ord, valid)""")
def a29_stretched_regions(spark, sf_dir):
    return P.stretched(_images(spark, sf_dir), 0.1, 0.9, regions=("valid",)).select("image_ord", "v", "u", "level")


_PLUGGED = N.Archive(N.InstrumentProfile("lineup", r"\.TAB$", (".TAB", ".LBL"), (".LBL", ".DAT"), r"^L\d{8}$", (2, 8), ("LINE_", 0, "xxx")), r"^run/(.*)\.TAB$")
# An archive whose names and numbers no pattern of a profile can give: numbers count in base 36, cameras are P and Q, and
# exposures of one second of two cameras are pairs.
_BUILT = N.Archive(
    N.InstrumentProfile("base36", "", ("", ""), ("", ""), "", (1, 1), ("", 0, "")),
    label=lambda spec: F.concat(spec, F.lit(".lblx")), image=lambda label: F.regexp_replace(label, r"\.lblx$", ".fits"), name=lambda spec: F.when(F.length(spec) >= 5, F.concat(F.upper(F.substring(spec, 1, 1)), F.lit("-"), F.upper(F.substring(spec, 2, 20)))),
    valid=lambda name: name.rlike("^[PQ]-[0-9A-Z]+$"), number=lambda name: F.conv(F.substring(name, 3, 20), 36, 10), volume=lambda v: F.concat(F.lit("b36/"), v), cameras={"left": "P", "right": "Q"},
    pair=lambda df: df.withColumn("grp", F.min("row_ord").over(Window.partitionBy("volume", "img_num"))).withColumn("place", F.when(F.col("img_name").startswith("P"), 0).otherwise(1).cast("long")),
    variables={"SIDE": lambda df: F.when(df["img_name"].startswith("P"), "left").otherwise("right"), "ROUND": lambda df: (df["img_num"] % 10).cast("string")},
)


@query("SELECT o_orderkey AS row_ord, CASE WHEN o_orderkey % 5 <> 0 THEN concat('L', lpad(CAST(o_orderkey AS VARCHAR), 8, '0')) END AS img_name, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS img_num, concat('LINE_xxx/V', o_custkey % 9) AS volume_path, concat('run/', CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE 'L' END, lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), '.DAT') AS image, CASE WHEN o_orderkey % 5 = 0 THEN 'error' ELSE 'ok' END AS outcome FROM orders")
def x01_plugged_archive(spark, sf_dir):
    archives = N.plugged(_PLUGGED)
    k = F.col("o_orderkey")
    spec = F.concat(F.lit("run/"), F.when(k % 5 == 0, "X").otherwise("L"), F.lpad(k.cast("string"), 8, "0"), F.lit(".TAB"))
    index = table(spark, sf_dir, "orders").select(k.alias("row_ord"), F.lit("lineup").alias("instrument"), F.concat(F.lit("V"), F.col("o_custkey") % 9).alias("volume"), spec.alias("filespec"))
    return C.entries(index, archives).select("row_ord", "img_name", "img_num", N.volume_path(F.col("instrument"), F.col("volume"), archives).alias("volume_path"), "image", "outcome")


_B36 = r"""WITH RECURSIVE x AS (SELECT c_custkey AS k, c_custkey // 2 + 46656 AS n, c_nationkey AS volume, CASE WHEN c_custkey % 13 = 0 THEN '!' WHEN c_custkey % 2 = 0 THEN 'P' ELSE 'Q' END AS side FROM customer),
  d AS (SELECT DISTINCT n, n AS left_, '' AS t FROM x UNION ALL SELECT n, left_ // 36, '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'[left_ % 36 + 1] || t FROM d WHERE left_ > 0), b AS (SELECT n, t FROM d WHERE left_ = 0),
  ok AS (SELECT x.*, side || '-' || t AS img_name FROM x JOIN b USING (n) WHERE side <> '!')"""


@query(_B36 + """ SELECT k AS row_ord, 'base36' AS instrument, img_name, n AS img_num, min(k) OVER (PARTITION BY volume, n) AS grp, CASE side WHEN 'P' THEN 0 ELSE 1 END AS place, CASE side WHEN 'P' THEN 'left' ELSE 'right' END AS "SIDE", CAST(n % 10 AS VARCHAR) AS "ROUND" FROM ok
  UNION ALL SELECT o_orderkey, 'lineup', concat('L', lpad(CAST(o_orderkey AS VARCHAR), 8, '0')), o_orderkey, o_orderkey, 0, NULL, NULL FROM orders""")
def x01_plugged_builders(spark, sf_dir):
    k = F.col("c_custkey")
    spec = F.concat(F.when(k % 13 == 0, "!").when(k % 2 == 0, "p").otherwise("q"), F.conv((F.floor(k / 2) + 46656).cast("string"), 10, 36))
    one = table(spark, sf_dir, "customer").select(k.alias("row_ord"), F.lit("base36").alias("instrument"), F.col("c_nationkey").cast("string").alias("volume"), spec.alias("filespec"))
    k = F.col("o_orderkey")
    two = table(spark, sf_dir, "orders").select(k.alias("row_ord"), F.lit("lineup").alias("instrument"), F.lit("V").alias("volume"), F.concat(F.lit("run/L"), F.lpad(k.cast("string"), 8, "0"), F.lit(".TAB")).alias("filespec"))
    archives = N.plugged(_PLUGGED, _BUILT)
    good = C.quarantine(C.entries(one.unionByName(two), archives))[0]
    return C.label_variables(C.archive_groups(good, archives), archives).select("row_ord", "instrument", "img_name", "img_num", "grp", "place", "SIDE", "ROUND")


@query(_B36 + " SELECT k AS row_ord, img_name FROM ok WHERE side = 'Q'")
def x01_p25_plugged_camera(spark, sf_dir):
    k = F.col("c_custkey")
    spec = F.concat(F.when(k % 13 == 0, "!").when(k % 2 == 0, "p").otherwise("q"), F.conv((F.floor(k / 2) + 46656).cast("string"), 10, 36))
    index = table(spark, sf_dir, "customer").select(k.alias("row_ord"), F.lit("base36").alias("instrument"), F.col("c_nationkey").cast("string").alias("volume"), spec.alias("filespec"))
    archives = N.plugged(_BUILT)
    return C.archive_camera(C.quarantine(C.entries(index, archives))[0], "right", archives).select("row_ord", "img_name")


# Files are written from the tables first, then read by the source.


@query("SELECT concat('data/s', s_suppkey, '.IMG') AS filespec FROM supplier UNION ALL SELECT concat('data/n', n_nationkey, '.IMG') FROM nation")
def s02_spec_list(spark, sf_dir):
    at = scratch(spark)
    table(spark, sf_dir, "supplier").select("s_name", F.concat(F.lit("data/s"), "s_suppkey", F.lit(".IMG")).alias("primaryfilespec")).write.csv(f"{at}/a", header=True)
    table(spark, sf_dir, "nation").select(F.concat(F.lit("data/n"), "n_nationkey", F.lit(".IMG")).alias("Primary File Spec"), "n_name").write.csv(f"{at}/b", header=True)
    return S.spec_list(spark, [f"{at}/a", f"{at}/b"])


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN concat('x', c_custkey) ELSE concat('N', c_custkey) END AS name, c_custkey % 3 <> 0 AS valid FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0")
def s03_name_list(spark, sf_dir):
    at, k = scratch(spark), F.col("c_custkey")
    line = F.when(k % 5 == 0, F.concat(F.lit("# N"), k)).when(k % 7 == 0, "").otherwise(F.concat(F.when(k % 3 == 0, "  x").otherwise("N"), k, F.lit(" note")))
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(at)
    good, bad = S.name_list(spark, at, F.col("name").startswith("N"))
    return good.withColumn("valid", F.lit(True)).unionByName(bad.select(F.element_at(F.split("line", " "), 1).alias("name"), F.lit(False).alias("valid")))


#: Files that one task writes.
DOCUMENTS_A_TASK = 200


def _document_files(spark, sf_dir):
    """One JSON document per supplier, some of them broken."""
    at, k = scratch(spark), F.col("s_suppkey")
    text = F.when(k % 9 == 0, "{broken").otherwise(F.to_json(F.struct(k.alias("image_ord"), F.when(k % 2 == 0, "success").otherwise("error").alias("status"))))
    suppliers = table(spark, sf_dir, "supplier")
    # Their bytes are few and their files are not: by size alone Spark would write all of them in one task.
    files = max(1, suppliers.count() // DOCUMENTS_A_TASK)
    suppliers.select(k.alias("id"), text.alias("value")).repartition(files, "id").write.partitionBy("id").text(at)
    return at


@query("SELECT s_suppkey AS image_ord, CASE WHEN s_suppkey % 2 = 0 THEN 'success' ELSE 'error' END AS status, true AS sound FROM supplier WHERE s_suppkey % 9 <> 0 UNION ALL SELECT s_suppkey, NULL, false FROM supplier WHERE s_suppkey % 9 = 0")
def s04_s05_s06_documents(spark, sf_dir):
    good, bad = S.documents(spark, _document_files(spark, sf_dir), "image_ord long, status string", "*.txt")
    number = F.regexp_extract("file", r"id=(\d+)", 1).cast("long")
    return good.select("image_ord", "status", F.lit(True).alias("sound")).unionByName(bad.select(number.alias("image_ord"), F.lit(None).cast("string").alias("status"), F.lit(False).alias("sound")))


@query("""SELECT image_ord, CAST(length(t) AS BIGINT) AS length, md5(t) AS md5, 2 AS lines FROM (SELECT s_suppkey AS image_ord, concat(CASE WHEN s_suppkey % 9 = 0 THEN '{broken' ELSE concat('{"image_ord":', s_suppkey, ',"status":"', CASE WHEN s_suppkey % 2 = 0 THEN 'success' ELSE 'error' END, '"}') END, chr(10)) AS t FROM supplier)""")
def s07_s20_file_facts(spark, sf_dir):
    at = _document_files(spark, sf_dir)
    found = S.files_below(spark, at, "*.txt").join(S.file_facts(spark, at, "*.txt").drop("length"), "path")
    return found.select(F.regexp_extract("path", r"id=(\d+)", 1).cast("long").alias("image_ord"), "length", "md5", "lines")
