import re
from functools import partial

from pyspark.sql import functions as F

from platewise.functions.formats import five_decimals
from platewise.operators import correlate as C
from platewise.operators import pyramid as Y
from platewise.operators import rings as G
from platewise.operators import stars as S
from platewise.operators import trials as T
from platewise.operators.blocks import block_join


def dealt(df):
    """What the shuffles of a plan are keyed by, without the numbers of columns."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return {re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text)}


def images(spark, n=5, pairs=3, lacking=()):
    px = [(p, v, u, float((v * 7 + u * 5 + p * 3 + v * u) % 11), (v + u + p) % 3 > 0) for p in range(pairs) for v in range(n) for u in range(n)]
    df = spark.createDataFrame(px, "pair long, v long, u long, value double, mask boolean")
    return df.filter(~F.struct("v", "u").isin([F.struct(F.lit(v).cast("long").alias("v"), F.lit(u).cast("long").alias("u")) for v, u in lacking]) if lacking else F.lit(True)).drop("mask"), df, px


def test_only_pixels_are_shuffled_for_a_surface(spark):
    image, model, _ = images(spark)
    s = C.surface(image, model, 2)
    assert dealt(s) == {"pair"}
    assert dealt(C.quality(s, C.top_peaks(s, 2, 1.5), "psr", 1.5)) == {"pair"}
    assert dealt(C.bounded_peaks(s, (0, 0), (2, 2), 2, 1)) == {"pair"}


def test_surface_where_pixels_of_the_image_lack(spark):
    lacking = [(0, 0), (2, 3), (4, 4), (1, 0)]
    image, model, px = images(spark, lacking=lacking)
    at = {(p, v, u): x for p, v, u, x, _ in px if (v, u) not in lacking}
    got = {(r["pair"], r["dy"], r["dx"]): r["numerator"] for r in C.surface(image, model, 2).collect()}
    for p in range(3):
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                m = [(at.get((p, v + dy, u + dx), 0.0), x) for q, v, u, x, mask in px if q == p and mask]
                want = sum(a * b for a, b in m) - sum(a for a, _ in m) * sum(b for _, b in m) / len(m)
                assert abs(got[p, dy, dx] - want) < 1e-9
    assert len(got) == 75


def test_quality_leaves_out_peaks_beside_the_surface(spark):
    s = spark.createDataFrame([(0, y, x, float(y + 2 * x)) for y in range(3) for x in range(3)], "pair long, dy int, dx int, ncc double")
    peaks = spark.createDataFrame([(0, 0, 2, 2), (0, 1, 9, 9)], "pair long, place int, dy int, dx int")
    got = C.quality(s, peaks, "pmr").collect()
    assert [(r["place"], round(r["quality"], 9)) for r in got] == [(0, 2.0)]


def test_windows_of_a_pyramid_stay_with_their_image(spark):
    image, model, _ = images(spark, 8)
    assert dealt(Y.pyramid(image, 2, 8, 8, key="pair")) == {"pair"}
    assert Y.pyramid_search(image, model, 2, 4, 8, 8).count() == 3


def test_box_sums_look_their_corners_up_where_they_are(spark):
    image, model, _ = images(spark, 8)
    boxes = model.select("pair").distinct().withColumns({"v0": F.lit(1), "v1": F.lit(5), "u0": F.lit(2), "u1": F.lit(6)})
    assert dealt(Y.box_sums(image, boxes, 2, 8, 8)) == {"pair"}
    assert dealt(Y.box_surface(image, model, boxes, 2, 8, 8)) == {"pair"}


def test_grids_of_a_twist_search_are_never_broadcast(spark):
    seen = []
    stars = spark.createDataFrame([(i, 1.0, 0.1 * i) for i in range(4)], "image long, magnitude double, angle double")

    def measure(grid):
        e = T.twist_error(grid.join(stars, "image").withColumn("diff_angle", F.col("angle") - F.col("twist")), ["image", "twist", "step"])
        seen.append(e._jdf.queryExecution().executedPlan().toString())
        return e

    ranges = spark.createDataFrame([(i, -0.5, 0.5) for i in range(4)], "image long, low double, high double")
    assert T.converged(ranges, measure, ["image"], divisions=8, precision=0.01, passes=3).count() == 4
    assert len(seen) == 3 and not any("BroadcastHashJoin" in p for p in seen)


def test_a_pixel_under_many_bodies_meets_a_star_once(spark):
    stars = spark.createDataFrame([(0, "a", 5.0, 5.0), (0, "b", 50.0, 50.0), (1, "c", 5.0, 5.0)], "image_ord long, star string, v double, u double")
    bodies = spark.createDataFrame([(0, b, f"B{b}", 5, 5) for b in range(9, 0, -1)], "image_ord long, body_ord long, body string, v long, u long")
    got = S.body_conflicts(stars, bodies, 2.0)
    assert {r["star"]: r["conflicts"] for r in got.collect()} == {"a": "BODY: B1", "b": "", "c": ""}
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate [image_ord") == 2  # pixels before the join, stars after it


def test_fade_widths_of_a_crowded_strip(spark):
    rows = [(i, f"f{k}", "x", 1000.0 + (k * 37 % 101) * 1.5, k % 2 == 0) for i in range(2) for k in range(150)]
    df = spark.createDataFrame(rows, "image_ord long, feature_key string, label string, a double, shade_above boolean")
    out = G.fade_widths(df, 100.0, 0.0)
    got = {(r["image_ord"], r["feature_key"]): r["fade_width"] for r in out.collect()}
    for i, k, _, a, above in rows:
        near = min((b for j, _, _, b, _ in rows if j == i and (a < b <= a + 100 if above else a - 100 <= b < a)), default=None)
        assert got[i, k] == (100.0 if near is None else abs(near - a) / 2)
    assert len(got) == 300 and "Join Inner" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_five_decimals_are_those_of_the_stored_number(spark):
    xs = [k / 1e6 * s for k in (5, 15, 25, 1000005, 1000015, 359999995, 123456785, 2675) for s in (1, -1)] + [0.015625, 0.046875, -0.015625, 0.0, 1e-9, -1e-9, 359.999999, 12.5, 1e12]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [(r["x"], r["t"]) for r in df.select("x", five_decimals(F.col("x")).alias("t")).collect()] == [(x, "%.5f" % x) for x in xs]


def test_block_join_makes_the_rows_of_the_join(spark):
    left = spark.createDataFrame([(k, i) for k in range(4) for i in range(40 if k == 1 else 3)] + [(2, 0)] * 30, "k long, x long")
    right = spark.createDataFrame([(k, 100 + i) for k in range(1, 5) for i in range(50 if k == 1 else 2)], "k long, y long")
    rows = sorted(map(tuple, left.join(right, "k").select("k", "x", "y").collect()))
    for block, pairs in ((7, 100), (1, 50), (1000, 100), (4096, 10**6)):
        got = block_join(left, right, ["k"], block=block, pairs=pairs)
        assert got.columns == ["k", "x", "y"] and sorted(map(tuple, got.collect())) == rows
    assert block_join(left.limit(0), right, ["k"], pairs=1).count() == 0


def shares(df):
    """Shares of the rows that the tasks make."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return [x / sum(n) for x in n]


def test_a_bin_of_time_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(G, "block_join", partial(block_join, block=16, pairs=1000))
    features = spark.range(200).selectExpr("id AS feature_key", "CAST(NULL AS timestamp) AS start_time", "CAST(NULL AS timestamp) AS end_time")
    images = spark.range(200).selectExpr("id AS image_ord", "timestamp_seconds(1100000000 + id) AS obs_time")
    found = G.in_validity(features, images)
    assert found.count() == 40_000 and found.distinct().count() == 40_000
    assert max(shares(found)) < 0.2


def test_a_cell_of_the_sky_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(S, "block_join", partial(block_join, block=16, pairs=1000))
    stars = spark.range(200).selectExpr("id AS n", "100.0D + id / 100000.0D AS ra", "10.0D AS dec", "5.0D AS vmag", "false AS double", "false AS galaxy")
    fields = spark.range(200).selectExpr("id AS image", "99.0D AS ra_min", "100.001D + id / 100000.0D AS ra_max", "9.0D AS dec_min", "10.1D AS dec_max", "CAST(NULL AS double) AS mag_min", "CAST(NULL AS double) AS mag_max")
    found = S.catalog_search(stars, fields)
    rows = sorted(map(tuple, found.select("n", "image").collect()))
    assert rows == [(n, i) for n in range(200) for i in range(200) if 100.0 + n / 100000.0 <= 100.001 + i / 100000.0]
    assert max(shares(found)) < 0.2


def written(df):
    """Rows that the shuffles of a plan write when it runs."""
    df.collect()

    def below(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return below(node.executedPlan())
        own = node.metrics().get("shuffleRecordsWritten")
        inner = [node.plan()] if "QueryStage" in name else [node.children().apply(k) for k in range(node.children().size())]
        return (own.get().value() if own.isDefined() else 0) + sum(map(below, inner))

    return below(df._jdf.queryExecution().executedPlan())


def test_rows_are_written_a_few_times_whatever_they_meet(spark, monkeypatch):
    for module in (G, S):
        monkeypatch.setattr(module, "block_join", partial(block_join, block=16, pairs=1000))
    left, right = spark.range(400).selectExpr("id AS x", "1 AS k"), spark.range(400).selectExpr("id AS y", "1 AS k")
    joined = block_join(left, right, ["k"], block=16, pairs=1000)
    assert joined.count() == 160_000 and written(joined) <= 4 * 800
    features = spark.range(400).selectExpr("id AS feature_key", "CAST(NULL AS timestamp) AS start_time", "CAST(NULL AS timestamp) AS end_time")
    images = spark.range(400).selectExpr("id AS image_ord", "timestamp_seconds(1100000000 + id) AS obs_time")
    assert written(G.in_validity(features, images)) <= 4 * 800
    stars = spark.range(400).selectExpr("id AS n", "100.0D AS ra", "10.0D AS dec", "5.0D AS vmag", "false AS double", "false AS galaxy")
    fields = spark.range(400).selectExpr("id AS image", "99.9D AS ra_min", "100.1D AS ra_max", "9.9D AS dec_min", "10.1D AS dec_max", "CAST(NULL AS double) AS mag_min", "CAST(NULL AS double) AS mag_max")
    assert written(S.catalog_search(stars, fields)) <= 4 * 800 * 4  # a field touches up to four cells


def test_spans_of_like_length_meet_few_packs(spark):
    left = spark.range(3000).selectExpr("id AS k", "id * 1000 AS a", "id * 1000 + IF(id % 100 = 0, 1000000, 10) AS b")
    right = spark.range(3000).selectExpr("id AS n", "id * 1000 + 5 AS at", "map('n', id) AS more")
    met = block_join(left, right, [], block=16, pairs=10**6, span=("a", "b", "at"))
    assert met.columns == ["k", "n", "more"] and met.count() < 3000 * 3000 / 20
    found = {(r["k"], r["n"]) for r in met.collect()}
    assert found >= {(k, k) for k in range(3000)} | {(k, n) for k in range(0, 3000, 100) for n in range(k, min(k + 1000, 3000))}
    assert len(found) == met.count()
    assert block_join(left.limit(0), right, [], span=("a", "b", "at")).count() == 0
