import math
import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from platewise.operators import correlate as C
from platewise.operators import pixels as P
from platewise.operators import pyramid as Y
from platewise.operators import rings as G
from platewise.operators import stars as S
from platewise.operators import trials as T


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def blobs(n, shift, seed):
    """An n x n image of some smooth blobs, and the model that it shows moved by ``shift``."""
    r = random.Random(seed)
    spots = [(r.uniform(n * 0.3, n * 0.7), r.uniform(n * 0.3, n * 0.7), r.uniform(1.5, 3), r.uniform(1, 3)) for _ in range(5)]
    at = lambda v, u: sum(h * math.exp(-((v - a) ** 2 + (u - b) ** 2) / (2 * s * s)) for a, b, s, h in spots)
    model = [(v, u, at(v, u)) for v in range(n) for u in range(n)]
    return [(v, u, at(v - shift[0], u - shift[1])) for v in range(n) for u in range(n)], model


@pytest.fixture(scope="module")
def pairs(spark):
    shifts = [(0, 0), (5, -3), (-4, 4), (1, 6)]
    image, model = [], []
    for k, s in enumerate(shifts):
        i, m = blobs(24, s, k)
        image += [(k, *p) for p in i]
        model += [(k, v, u, x, 6 <= v < 18 and 6 <= u < 18) for v, u, x in m]
    i, m = spark.createDataFrame(image, "pair long, v long, u long, value double"), spark.createDataFrame(model, "pair long, v long, u long, value double, mask boolean")
    return i.cache(), m.cache(), shifts


def test_pyramid_finds_what_the_full_search_finds(pairs):
    image, model, shifts = pairs
    got = {r["pair"]: r for r in Y.pyramid_search(image, model, levels=3, reach=8, n_v=24, n_u=24).collect()}
    full = C.surface(image, model, 8).groupBy("pair").agg(F.max_by(F.struct("dy", "dx"), "ncc").alias("b")).select("pair", "b.*").collect()
    assert {p: (r["dy"], r["dx"]) for p, r in got.items()} == {r["pair"]: (r["dy"], r["dx"]) for r in full} == dict(enumerate(shifts))
    assert all([s["level"] for s in r["path"]] == [3, 2, 1] and r["ncc"] > 0.99 for r in got.values())
    with pytest.raises(ValueError):
        Y.pyramid_search(image, model, 2, 4, 24, 24, metric="none")


def test_finer_levels_read_few_shifts(spark, pairs, monkeypatch):
    image, model, _ = pairs
    seen = []
    real = Y.correlated
    monkeypatch.setattr(Y, "correlated", lambda m, i: (seen.append(m.count()), real(m, i))[1])
    Y.pyramid_search(image, model, levels=3, reach=8, n_v=24, n_u=24)
    pixels = [Y.pyramid(model.withColumn("mask", F.col("mask").cast("double")), 3, 24, 24, ("value", "mask"), "pair").filter(F.round("mask", 9) > 0.5).filter(F.col("level") == k).count() for k in (3, 2, 1)]
    assert seen == [25 * n for n in pixels]  # against 289 shifts a pixel in full


def test_empty_masks_and_empty_tables(spark, pairs):
    image, model, _ = pairs
    assert Y.pyramid_search(image, model.withColumn("mask", F.lit(False)), 2, 4, 24, 24).collect() == []
    assert Y.pyramid_search(image.limit(0), model.limit(0), 2, 4, 24, 24).collect() == []


def test_box_sums_are_those_of_the_full_surface(pairs):
    image, model, shifts = pairs
    boxes = model.filter("mask").groupBy("pair").agg(*(f(F.col(c)).alias(n) for f, c, n in ((F.min, "v", "v0"), (F.max, "v", "v1"), (F.min, "u", "u0"), (F.max, "u", "u1"))))
    want = {(r["pair"], r["dy"], r["dx"]): r["ncc"] for r in C.surface(image, model, 9).collect()}
    got = {(r["pair"], r["dy"], r["dx"]): r["ncc"] for r in Y.box_surface(image, model.drop("mask"), boxes, 9, 24, 24).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    lookups = Y.box_sums(image, boxes, 9, 24, 24)
    assert re.search(r"Window", plan(lookups)) and lookups.count() == 4 * 19 * 19


def test_frames_join_no_pixels(spark):
    px = [(k, v, u, float((v * 7 + u * 5 + k * 3) % 11)) for k in range(2) for v in range(5) for u in range(4)]
    df = spark.createDataFrame(px, "image_ord long, v long, u long, value double")
    value = {(k, v, u): x for k, v, u, x in px}
    mirror = lambda x, n: x if 0 <= x < n else mirror(-1 - x if x < 0 else 2 * n - 1 - x, n)

    def box(k, v, u, r, circle=False):
        return [value[k, mirror(v + i, 5), mirror(u + j, 4)] for i in range(-r, r + 1) for j in range(-r, r + 1) if not circle or math.hypot(i, j) <= r + 0.5]

    for r in (1, 3, 6):  # the last is wider than the image: it is mirrored more than once
        top, low = P.box_extreme(df, r, 5, 4), P.box_extreme(df, r, 5, 4, largest=False)
        assert {tuple(x)[:3]: x["value"] for x in top.collect()} == {k: max(box(*k, r)) for k in value}
        assert {tuple(x)[:3]: x["value"] for x in low.collect()} == {k: min(box(*k, r)) for k in value}
        for circle in (False, True):
            med = P.minus_median(df, r, 5, 4, "circle" if circle else "square")
            assert {(x["image_ord"], x["v"], x["u"]): x["value"] for x in med.collect()} == {k: value[k] - sorted(b := box(*k, r, circle))[len(b) // 2] for k in value}
    for out in (top, med, P.local_maxima(df, 1, 5, 4)):
        assert "Join" not in plan(out)


def test_catalog_search(spark):
    r = random.Random(6)
    stars = [(i, r.uniform(0, 360), r.uniform(-90, 90), None if i % 17 == 0 else r.uniform(2, 12), i % 5 == 0 or None, i % 7 == 0) for i in range(3000)]
    stars += [(9000 + i, 10.0 + i * 1e-4, 20.0, 2.0 + i % 10, False, False) for i in range(200)] + [(9500, None, 1.0, 3.0, False, False), (9501, 0.0, -90.0, 5.0, False, False), (9502, 359.9999, 90.0, 5.0, False, False)]
    fields = [(0, 9.5, 10.5, 19.5, 20.5, 3.5, 4.5), (1, 9.5, 10.5, 19.5, 20.5, None, None), (2, 350.0, 12.0, -30.0, 30.0, None, 6.0), (3, 359.0, 0.5, -90.0, 90.0, 4.0, None), (4, 100.0, 101.0, 0.0, 1.0, 50.0, 60.0), (5, 0.0, 360.0, -90.0, 90.0, 5.0, 5.0), (6, 40.0, 30.0, -10.0, 10.0, 9.0, 3.0)]
    s, f = spark.createDataFrame(stars, "n long, ra double, dec double, vmag double, double boolean, galaxy boolean"), spark.createDataFrame(fields, "image long, ra_min double, ra_max double, dec_min double, dec_max double, mag_min double, mag_max double")
    for doubles, galaxies in ((True, False), (False, True)):
        want = {
            (g, n) for n, ra, dec, m, two, galaxy in stars for g, r0, r1, d0, d1, m0, m1 in fields
            if ra is not None and (doubles or not two) and (galaxies or not galaxy) and (r0 <= ra <= r1 if r0 <= r1 else ra >= r0 or ra <= r1) and d0 <= dec <= d1 and (m0 is None or m is not None and m >= m0) and (m1 is None or m is not None and m <= m1)
        }
        for crowded in (10_000, 5):
            found = [(x["image"], x["n"]) for x in S.catalog_search(s, f, doubles, galaxies, crowded).collect()]
            assert len(found) == len(set(found)) and set(found) == want


def test_small_fields_read_few_stars(spark):
    s = spark.range(200_000).select((F.col("id") * 7919 % 360000 / 1000.0).alias("ra"), (F.col("id") * 104729 % 120000 / 1000.0 - 60).alias("dec"), (F.col("id") % 90 / 10.0).alias("vmag"), F.lit(False).alias("double"), F.lit(False).alias("galaxy"))
    f = spark.createDataFrame([(i, 13.0 * i, 13.0 * i + 1.0, -40.0 + i, -39.0 + i, 0.0, 20.0) for i in range(25)], "image long, ra_min double, ra_max double, dec_min double, dec_max double, mag_min double, mag_max double")
    found = S.catalog_search(s, f)
    met = found._jdf.queryExecution().optimizedPlan()
    assert "Cartesian" not in met.toString()
    cells = f.count() * 3 * 3 * (S.FINE_CELL**2) * 200_000 / (360 * 120)  # stars of the cells that the fields touch
    assert found.count() * 10 > cells


def test_validity_in_time(spark):
    r = random.Random(2)
    t0 = datetime(1990, 1, 1, tzinfo=timezone.utc)
    when = lambda s: t0 + timedelta(seconds=s)
    spans = [(None, None), (0, None), (None, 10), (5, 5), (5, 6), (5, 5.5), (-9, 10**9), (10**9, 0)]
    spans += [(a, a + 10 ** r.uniform(0, 9)) for a in (r.uniform(-(10**8), 10**9) for _ in range(300))] + [(r.uniform(0, 10**9), None) for _ in range(20)] + [(None, r.uniform(0, 10**9)) for _ in range(20)]
    times = [0, 5, 5.25, 5.5, 9.999999, 10, 10**9 - 1, 2**26, 2**30] + [r.uniform(0, 10**9) for _ in range(100)]
    spans += [(t, t + 1) for t in times[:20]] + [(t - 1, t) for t in times[:20]]
    spans = [(None if a is None else round(a, 6), None if b is None else round(b, 6)) for a, b in spans]
    times = [round(t, 6) for t in times]
    f = spark.createDataFrame([(i, a if a is None else when(a), b if b is None else when(b)) for i, (a, b) in enumerate(spans)], "feature_key long, start_time timestamp, end_time timestamp")
    i = spark.createDataFrame([(k, when(t)) for k, t in enumerate(times)] + [(999, None)], "image_ord long, obs_time timestamp")
    got = [(x["feature_key"], x["image_ord"]) for x in G.in_validity(f, i).select("feature_key", "image_ord").collect()]
    want = {(k, n) for k, (a, b) in enumerate(spans) for n, t in enumerate(times) if (a is None or a <= t) and (b is None or t < b)}
    assert len(got) == len(set(got)) and set(got) == want
    assert G.in_validity(f, i.limit(0)).collect() == [] and G.in_validity(f.limit(0), i).collect() == []


def test_validities_take_few_bins(spark):
    f = spark.sql("SELECT id AS feature_key, timestamp_seconds(-1000000000 + id * 977) AS start_time, CAST(NULL AS TIMESTAMP) AS end_time FROM range(50)")
    i = spark.sql("SELECT id AS image_ord, timestamp_seconds(id * 3155760000) AS obs_time FROM range(2)")  # a century
    bins = re.search(r"_level", plan(G.in_validity(f, i)))
    assert bins and G.in_validity(f, i).count() == 100


def test_border_atop(spark):
    n = 9
    px = [(1, v, u, None if (v, u) == (4, 4) else math.hypot(v - 4, u - 4)) for v in range(n) for u in range(n)] + [(2, 0, u, float(u)) for u in range(4)]
    edges = [(1, "a", "IER", 2.6), (1, "b", "OER", 3.0), (2, "c", "IER", 1.5), (2, "d", "IER", 2.0), (2, "e", "IER", 7.0), (3, "f", "IER", 1.0)]
    p, e = spark.createDataFrame(px, "image_ord long, v long, u long, value double"), spark.createDataFrame(edges, "image_ord long, feature_key string, label string, a double")
    got = {(x["image_ord"], x["feature_key"], x["v"], x["u"]) for x in G.border_atop(p, e).collect()}
    value = {(k, v, u): x for k, v, u, x in px}
    want = set()
    for k, key, _, a in edges:
        for (image, v, u), x in value.items():
            near = [value.get((image, v + i, u + j)) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))]
            if image == k and x is not None and (x == a or any(y is not None and (x - a) * (y - a) < 0 and abs(x - a) <= abs(y - a) for y in near)):
                want.add((k, key, v, u))
    assert got == want
    assert {x[3] for x in got if x[1] == "c"} == {1, 2} and {x[3] for x in got if x[1] == "d"} == {2} and not [x for x in got if x[1] in "ef"]


def test_converged(spark):
    ranges = spark.createDataFrame([("a", -1.0, 1.0), ("b", 0.0, 0.01), ("c", -1.0, 1.0), ("d", -1.0, 1.0)], "image string, low double, high double")
    target = F.when(F.col("image") == "a", 0.3).when(F.col("image") == "b", 0.0047).when(F.col("image") == "d", 5.0)  # c has no error anywhere
    tries = []

    def measure(grid):
        tries.append(grid.count())
        return grid.withColumn("error", F.abs(F.col("twist") - target))

    got = {r["image"]: r for r in T.converged(ranges, measure, ["image"], divisions=10, precision=0.002, passes=6).collect()}
    assert got.keys() == {"a", "b", "d"} and abs(got["a"]["twist"] - 0.3) <= 0.002 and abs(got["b"]["twist"] - 0.0047) <= 0.0005 + 1e-9
    assert got["b"]["passes"] == 1 and got["a"]["passes"] == 6 and tries[0] == 44 and tries[1] == 22  # settled ranges have left


def test_twist_ties_go_to_the_smaller_trial(spark):
    ranges = spark.createDataFrame([("a", -1.0, 1.0)], "image string, low double, high double")
    got = T.converged(ranges, lambda g: g.withColumn("error", F.lit(1.0)), ["image"], divisions=4, precision=10.0).collect()
    assert [(r["twist"], r["passes"]) for r in got] == [(-1.0, 1)]
