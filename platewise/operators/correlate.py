"""Correlation of images with models in direct space, peaks and their quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators.pixels import gradient, normalized
from platewise.operators.stars import summary as robust_summary

EPS = 1e-12


def surface(image: DataFrame, model: DataFrame, reach: int, padded: int | None = None, image_filter: Callable[[DataFrame], DataFrame] | None = None, model_filter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Masked normalized correlation of image (pair, v, u, value) and model (pair, v, u, value, mask)
    for every whole-pixel shift up to reach: pair, dy, dx, numerator, ncc.

    Model pixels under the mask meet the image of their pair, and only then are spread over the shifts: pixels are shuffled
    once, and the sums of a pair stay where they are. Image pixels outside the frame count as 0. With ``padded``, the
    pixels of a padded frame, the model's variance is taken over that frame, the model being 0 outside its mask. X04:
    filters are applied to both sides first.
    """
    image = image if image_filter is None else image.transform(image_filter)
    model = model if model_filter is None else model.transform(model_filter)
    shifts = F.sequence(F.lit(-reach), F.lit(reach))
    m = model.filter("mask").select("pair", "v", "u", F.col("value").alias("m"))
    m = with_frames(m, image).withColumn("dy", F.explode(shifts)).withColumn("dx", F.explode(shifts))
    return _summed(m.withColumn("i", in_frame(F.col("v") + F.col("dy"), F.col("u") + F.col("dx"))), padded)


def correlated(m: DataFrame, image: DataFrame, padded: int | None = None) -> DataFrame:
    """The surface from model pixels m (pair, dy, dx, v, u, m), each at the image pixel that it meets at its shift. Pixels
    that come from a join by pair aren't shuffled."""
    return _summed(with_frames(m, image).withColumn("i", in_frame(F.col("v"), F.col("u"))), padded)


def _summed(s: DataFrame, padded: int | None) -> DataFrame:
    s = s.select("pair", "dy", "dx", "m", F.coalesce("i", F.lit(0.0)).alias("i"))
    s = s.groupBy("pair", "dy", "dx").agg(F.sum(F.col("i") * F.col("m")).alias("im"), F.sum("i").alias("i"), F.sum(F.col("i") * F.col("i")).alias("ii"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.count("*").alias("w"))
    return scored(s, padded)


def with_frames(df: DataFrame, image: DataFrame, *values: str) -> DataFrame:
    """df with the image (pair, v, u, value) of its pair beside every row, for ``in_frame``: _v and _u, its first row and
    column, _n, its columns, and _px, the pixels of the smallest frame around it, row by row, null where one is missing.

    A pair's image is one array, as large as its frame. Pixels are dealt by pair before they are gathered, and rows by
    pair meet them by a merge, so that what follows by pair is neither shuffled nor sorted again.
    """
    x = F.struct(*values) if values else F.col("value")
    px = image.repartition("pair").groupBy("pair").agg(F.min("v").alias("_v"), F.max("v").alias("_v1"), F.min("u").alias("_u"), F.max("u").alias("_u1"), F.sort_array(F.collect_list(F.struct("v", "u", x.alias("x")))).alias("_all"))
    n = F.col("_u1") - F.col("_u") + 1
    px = px.select("pair", "_v", "_u", n.alias("_n"), ((F.col("_v1") - F.col("_v") + 1) * n).alias("_size"), "_all")
    # Where pixels are missing, every place of the frame gets an empty one that stands behind the real one.
    place = lambda p: (p["v"] - F.col("_v")) * F.col("_n") + p["u"] - F.col("_u")
    nothing = F.when(F.lit(False), F.element_at("_all", 1)["x"])
    real = F.transform("_all", lambda p: F.struct(place(p).cast("long").alias("k"), F.lit(0).alias("o"), p["x"].alias("x")))
    empty = F.transform(F.sequence(F.lit(0).cast("long"), (F.col("_size") - 1).cast("long")), lambda k: F.struct(k.alias("k"), F.lit(1).alias("o"), nothing.alias("x")))
    full = F.size("_all") == F.col("_size")
    px = px.withColumn("_both", F.when(~full, F.sort_array(F.concat(real, empty))))
    first = lambda p, at: (at == 0) | (F.get("_both", at - 1)["k"] != p["k"])
    sparse = F.transform(F.filter("_both", first), lambda p: p["x"])
    px = px.select("pair", "_v", "_u", "_n", F.when(full, F.transform("_all", lambda p: p["x"])).otherwise(sparse).alias("_px"))
    return df.join(px.hint("merge"), "pair", "left")


def in_frame(v: Column, u: Column) -> Column:
    """The pixel at (v, u) of the image beside a row; null outside its frame."""
    at = (v - F.col("_v")) * F.col("_n") + u - F.col("_u")
    return F.when((u - F.col("_u")).between(0, F.col("_n") - 1), F.get("_px", at.cast("int")))


def scored(s: DataFrame, padded: int | None = None) -> DataFrame:
    """pair, dy, dx, numerator, ncc from the sums im, i, ii, m, mm over w pixels."""
    mean_i, mean_m = F.col("i") / F.col("w"), F.col("m") / F.col("w")
    var_i = F.greatest(F.lit(0.0), F.col("ii") / F.col("w") - mean_i * mean_i)
    frame = F.col("w") if padded is None else F.lit(padded)
    var_m = F.greatest(F.lit(0.0), (F.col("mm") - 2 * mean_m * F.col("m") + frame * mean_m * mean_m) / F.col("w"))
    numerator = F.col("im") - F.col("w") * mean_i * mean_m
    return s.select("pair", "dy", "dx", numerator.alias("numerator"), (numerator / (F.col("w") * F.sqrt(var_i * var_m) + EPS)).alias("ncc"))


def top_peaks(s: DataFrame, k: int = 5, radius: float = 5.0, value: str = "numerator") -> DataFrame:
    """K peaks of every pair, each the largest outside the circles around those before; ties go to the first
    place. The surface of a pair, which its reach bounds, is one array in order of value, read once for all peaks."""
    order = F.struct((-F.col(value)).alias("o"), "dy", "dx")
    by_pair = s.filter(F.col(value).isNotNull()).groupBy("pair").agg(F.array_sort(F.collect_list(order)).alias("c"))

    def apart(p: Column, q: Column) -> Column:
        return F.sqrt(F.pow(p["dy"] - q["dy"], 2) + F.pow(p["dx"] - q["dx"], 2)) > radius

    # A place is taken if it lies apart from all taken before it; the array holds no place before a larger one.
    none = F.slice(F.col("c"), 1, 0)
    taken = F.aggregate("c", none, lambda found, p: F.when((F.size(found) < k) & F.forall(found, lambda q: apart(p, q)), F.concat(found, F.array(p))).otherwise(found))
    out = by_pair.select("pair", F.posexplode(taken).alias("place", "p"))
    return out.select("pair", "place", F.col("p.dy").alias("dy"), F.col("p.dx").alias("dx"), (-F.col("p.o")).alias("peak"))


def _background(c: str, guard: float) -> Column:
    far = F.sqrt(F.pow(F.col("dy") - F.col("py"), 2) + F.pow(F.col("dx") - F.col("px"), 2)) > guard
    return F.when(far, F.col(c))


#: Quality of a peak, from the surface c and the peak value, which one row or each holds.
METRICS: dict[str, Callable[[str, float], Column]] = {
    "psr": lambda c, guard: (F.max("peak") - F.avg(_background(c, guard))) / (F.stddev_pop(_background(c, guard)) + EPS),
    "pmr": lambda c, guard: F.max("peak") / (F.avg(c) + EPS),
    "per": lambda c, guard: F.max("peak") / (F.sqrt(F.sum(F.col(c) * F.col(c))) + EPS),
}


def quality(s: DataFrame, peaks: DataFrame, metric: str = "psr", guard: float = 5.0, value: str = "ncc") -> DataFrame:
    """Quality of every peak (pair, place, dy, dx) on the surface."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    at = peaks.select("pair", "place", F.col("dy").alias("py"), F.col("dx").alias("px"))
    here = (F.col("dy") == F.col("py")) & (F.col("dx") == F.col("px"))
    met = at.join(s.hint("merge"), "pair").withColumn("peak", F.when(here, F.col(value)))
    found = met.groupBy("pair", "place", F.col("py").alias("dy"), F.col("px").alias("dx")).agg(METRICS[metric](value, guard).alias("quality"), F.bool_or(here).alias("_on"))
    return found.filter("_on").drop("_on")


def best_candidate(found: DataFrame, weight: float, prior: tuple[float, float] = (0.0, 0.0), pairs: DataFrame | None = None) -> DataFrame:
    """The peak with the largest quality less weight times its distance from the prior offset. A pair of ``pairs``
    without any gets offset 0 and quality minus infinity."""
    distance = F.sqrt(F.pow(F.col("dy") - prior[0], 2) + F.pow(F.col("dx") - prior[1], 2))
    scored = found.withColumn("score", F.col("quality") - weight * distance)
    best = scored.groupBy("pair").agg(F.max_by(F.struct("dy", "dx", "quality", "score"), F.struct("score", (-F.col("place")).alias("p"))).alias("b")).select("pair", "b.*")
    if pairs is None:
        return best
    none = F.lit(float("-inf"))
    return pairs.select("pair").distinct().join(best, "pair", "left").select("pair", F.coalesce("dy", F.lit(0)).alias("dy"), F.coalesce("dx", F.lit(0)).alias("dx"), F.coalesce("quality", none).alias("quality"), F.coalesce("score", none).alias("score"))


def signed(index: Column, size: int) -> Column:
    """Displacement of an index into a periodic array."""
    return F.when(index > size // 2, index - size).otherwise(index)


def fisher_covariance(aligned: DataFrame, noise: DataFrame, keys: tuple[str, ...] = ("image_ord",)) -> DataFrame:
    """cov_xx, cov_xy and cov_yy of the offset of a model (pixels aligned with the image) under noise of sigma_n: the
    inverse of the sums of gradient products over the variance; 1e6 on the diagonal where they are nearly singular."""
    g = gradient(aligned).groupBy(*keys).agg(F.sum(F.col("gu") * F.col("gu")).alias("sxx"), F.sum(F.col("gv") * F.col("gv")).alias("syy"), F.sum(F.col("gu") * F.col("gv")).alias("sxy"))
    scale = 1.0 / (F.col("sigma_n") * F.col("sigma_n") + 1e-18)
    f = g.join(noise.select(*keys, "sigma_n"), list(keys)).select(*keys, *((F.col(c) * scale).alias(c) for c in ("sxx", "sxy", "syy")))
    half, turn = (F.col("sxx") + F.col("syy")) / 2, F.sqrt(F.pow((F.col("sxx") - F.col("syy")) / 2, 2) + F.col("sxy") * F.col("sxy"))
    large, small = half + turn, F.abs(half - turn)
    singular = large > 1e10 * small
    a, d, b = F.col("sxx") + 1e-12, F.col("syy") + 1e-12, F.col("sxy")
    det = F.nullif(a * d - b * b, F.lit(0.0))
    return f.select(*keys, F.when(singular, 1e6).otherwise(d / det).alias("cov_xx"), F.when(singular, 0.0).otherwise(-b / det).alias("cov_xy"), F.when(singular, 1e6).otherwise(a / det).alias("cov_yy"))


def residual_noise(image: DataFrame, model: DataFrame) -> DataFrame:
    """sigma_n of every image: 1.4826 times the median deviation of normalized image less normalized aligned model;
    where that is next to nothing the standard deviation, 1e-6 at least."""
    m = normalized(model).select("image_ord", "v", "u", F.col("value").alias("_m"))
    r = normalized(image).join(m, ["image_ord", "v", "u"]).select("image_ord", (F.col("value") - F.col("_m")).alias("r"))
    s = robust_summary(r, ["image_ord"], "r")
    return s.select("image_ord", F.when(F.col("mad_std") <= EPS, F.greatest("std", F.lit(1e-6))).otherwise(F.col("mad_std")).alias("sigma_n"))


def pyramid_consistency(levels: DataFrame, finals: DataFrame, least_quality: float = 6.0, most: float = 2.0) -> DataFrame:
    """Final results (pair, quality and more) with consistency, the largest distance of the offsets (pair, level, dy,
    dx) of all levels, scaled by two to the level less one, from that of level 1, and spurious: poor or inconsistent."""
    scale = F.pow(F.lit(2.0), F.col("level") - 1)
    x = levels.select("pair", "level", (F.col("dy") * scale).alias("y"), (F.col("dx") * scale).alias("x"))
    last = x.groupBy("pair").agg(F.min_by(F.struct("y", "x"), "level").alias("l"))
    far = x.join(last, "pair").groupBy("pair").agg(F.max(F.hypot(F.col("y") - F.col("l.y"), F.col("x") - F.col("l.x"))).alias("consistency"))
    return finals.join(far, "pair").withColumn("spurious", (F.col("quality") < least_quality) | (F.col("consistency") > most))


def bounded_peaks(s: DataFrame, least: tuple[int, int], most: tuple[int, int], k: int, margin: int, value: str = "ncc") -> DataFrame:
    """Up to k peaks (pair, place, dy, dx, peak) among shifts of at most ``most`` (v, u), without the hole of less
    than ``least``. Every peak blacks out a square of ``margin`` around it. A pair ends at a peak that isn't unique or not
    above 0; peaks at the border of the area, or next to an earlier square, count as tries and are left out.

    The area of a pair is bounded and lies in one array.
    """
    area = s.filter(F.abs("dy").between(0, most[0]) & F.abs("dx").between(0, most[1]))
    hole = F.lit(least[0] != 0 and least[1] != 0) & (F.abs("dy") < least[0]) & (F.abs("dx") < least[1])
    by_pair = area.groupBy("pair").agg(F.collect_list(F.when(~hole, F.struct(F.col(value).alias("c"), "dy", "dx"))).alias("c"))
    step = F.array().cast("array<struct<c:double,dy:int,dx:int>>")
    state = F.struct(F.col("c").cast("array<struct<c:double,dy:int,dx:int>>").alias("left"), step.alias("tries"), F.lit(False).alias("over"))

    def one(z: Column, _: Column) -> Column:
        top = F.array_max(z["left"])
        alone = F.size(F.filter(z["left"], lambda p: p["c"] == top["c"])) == 1
        go = ~z["over"] & top.isNotNull() & alone & (top["c"] > 0)
        rest = F.filter(z["left"], lambda p: (F.abs(p["dy"] - top["dy"]) > margin) | (F.abs(p["dx"] - top["dx"]) > margin))
        return F.struct(F.when(go, rest).otherwise(z["left"]).alias("left"), F.when(go, F.concat(z["tries"], F.array(top))).otherwise(z["tries"]).alias("tries"), (~go).alias("over"))

    tries = F.aggregate(F.sequence(F.lit(1), F.lit(k)), state, one, lambda z: z["tries"])
    out = by_pair.select("pair", tries.alias("t")).select("pair", "t", F.posexplode("t").alias("place", "p"))

    def beside(q: Column) -> Column:
        dy, dx = F.abs(q["dy"] - F.col("p.dy")), F.abs(q["dx"] - F.col("p.dx"))
        return ((dx == margin + 1) & (dy <= margin)) | ((dy == margin + 1) & (dx <= margin))

    good = (F.abs("p.dy") != most[0]) & (F.abs("p.dx") != most[1]) & ~F.exists(F.slice("t", F.lit(1), F.col("place")), beside)
    return out.filter(good).select("pair", "place", F.col("p.dy").alias("dy"), F.col("p.dx").alias("dx"), F.col("p.c").alias("peak"))
