"""Coarse-to-fine correlation over a pyramid of blurred, thinned images, and sums over boxes from running sums.

Images are rows (keys, v, u, value), models have a mask too. A level is a column: level 1 has the full size, each further
one half of it. The coarsest level is searched in full; every finer one only at the few shifts around twice the best of
the level before, so a model pixel meets (2 refine + 1)**2 image pixels a level instead of (2 reach + 1)**2.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.operators.correlate import METRICS, correlated, in_frame, scored, with_frames
from platewise.operators.pixels import framed
from platewise.session import landed


def weights(sigma: float) -> list[float]:
    """Gaussian weights at distances 0, 1, ... up to four sigma; both sides together add up to 1."""
    g = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(int(4 * sigma + 0.5) + 1)]
    total = g[0] + 2 * sum(g[1:])
    return [x / total for x in g]


def blurred(px: DataFrame, sigma: float, n_v: int, n_u: int, values: tuple[str, ...] = ("value",), key: str = "image_ord") -> DataFrame:
    """Values smoothed by a Gaussian, one axis after the other; the image is mirrored at its borders."""
    g = weights(sigma)
    w = F.array(*(F.lit(x) for x in g))

    def smooth(c: str):
        near = F.collect_list(F.struct(F.col("_p").alias("p"), F.col(c).alias("x")))
        return lambda frame: F.aggregate(near.over(frame), F.lit(0.0), lambda acc, e: acc + e["x"] * F.element_at(w, (F.abs(e["p"] - F.col("_p")) + 1).cast("int")))

    for axis, n in (("v", n_v), ("u", n_u)):
        px = framed(px, axis, n, len(g) - 1, {c: smooth(c) for c in values}, key)
    return px


def pyramid(px: DataFrame, levels: int, n_v: int, n_u: int, values: tuple[str, ...] = ("value",), key: str = "image_ord") -> DataFrame:
    """key, level, v, u and values: the image at levels 1 to ``levels``, blurred by half the step and thinned by it."""
    # Dealt by image once; windows along either axis find their pixels there.
    out, px = None, px.select(key, "v", "u", *values).repartition(key)
    for level in range(1, levels + 1):
        s = 2 ** (level - 1)
        b = blurred(px, s / 2, n_v, n_u, values, key).filter((F.col("v") % s == 0) & (F.col("u") % s == 0))
        b = b.select(key, F.lit(level).alias("level"), F.floor(F.col("v") / s).alias("v"), F.floor(F.col("u") / s).alias("u"), *values)
        out = b if out is None else out.unionByName(b)
    return out


def pyramid_search(image: DataFrame, model: DataFrame, levels: int, reach: int, n_v: int, n_u: int, refine: int = 2, metric: str = "psr", guard: float = 1.5) -> DataFrame:
    """J17, A08, A09 coarse to fine: per pair the best shift dy, dx (of equal ones the first) of the full size, its ncc, its
    quality on the shifts around it, and path, the best shift of every level from the coarsest on.

    image (pair, v, u, value), model (pair, v, u, value, mask), both n_v x n_u. Masks are blurred, too, and hold where
    more than half is left. Values are ranked to nine decimals. Pairs whose mask is empty on the coarsest level have no row.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    images = pyramid(image, levels, n_v, n_u, key="pair")
    models = pyramid(model.withColumn("mask", F.when(F.col("mask"), 1.0).otherwise(0.0)), levels, n_v, n_u, ("value", "mask"), "pair")
    models = models.filter(F.round("mask", 9) > 0.5)
    found = None
    for level in range(levels, 0, -1):
        i, m = (x.filter(F.col("level") == level).drop("level") for x in (images, models))
        near = -(-reach // 2 ** (level - 1)) if found is None else refine
        shifts = m.select("pair").distinct().withColumn("_y", F.lit(0)).withColumn("_x", F.lit(0)) if found is None else found.select("pair", (2 * F.col("dy")).alias("_y"), (2 * F.col("dx")).alias("_x"))
        steps = F.sequence(F.lit(-near), F.lit(near))
        around = lambda c: F.explode(F.transform(steps, lambda d: F.col(c) + d))
        shifts = shifts.withColumn("dy", around("_y")).withColumn("dx", around("_x"))
        # Shifts are many more than the rows that they come from: a merge, whatever their estimated size.
        spread = m.join(shifts.select("pair", "dy", "dx").hint("merge"), "pair")
        s = correlated(spread.select("pair", "dy", "dx", (F.col("v") + F.col("dy")).alias("v"), (F.col("u") + F.col("dx")).alias("u"), F.col("value").alias("m")), i)
        ranked = F.struct(F.round("ncc", 9).alias("r"), (-F.col("dy")).alias("y"), (-F.col("dx")).alias("x"))
        best = s.groupBy("pair").agg(F.max_by(F.struct("dy", "dx", "ncc"), ranked).alias("b"), F.collect_list(F.struct("dy", "dx", "ncc")).alias("_near"))
        best = best.select("pair", "b.*", "_near")
        step = F.array(F.struct(F.lit(level).alias("level"), "dy", "dx"))
        path = step if found is None else F.concat("path", step)
        best = best if found is None else best.join(found.select("pair", "path").hint("merge"), "pair")
        # One row a pair; finer levels and the path read it, and nothing before it runs again.
        found = landed(best.withColumn("path", path))
    # The last surface is as small as the neighbourhood of one shift.
    last = found.select("pair", "dy", "dx", "ncc", "path", F.explode("_near").alias("e")).select("pair", F.col("dy").alias("py"), F.col("dx").alias("px"), F.col("ncc").alias("peak"), "path", F.col("e.dy").alias("dy"), F.col("e.dx").alias("dx"), F.col("e.ncc").alias("c"))
    return last.groupBy("pair", F.col("py").alias("dy"), F.col("px").alias("dx")).agg(F.first("peak").alias("ncc"), METRICS[metric]("c", guard).alias("quality"), F.first("path").alias("path"))


def running_sums(image: DataFrame, key: str = "pair") -> DataFrame:
    """Per pixel the sums of the values (i) and of their squares (ii) of all pixels up to it on both axes."""
    down, along = (W.partitionBy(key, o).orderBy(a).rowsBetween(W.unboundedPreceding, 0) for a, o in (("v", "u"), ("u", "v")))
    first = image.repartition(key).select(key, "v", "u", F.sum("value").over(down).alias("i"), F.sum(F.col("value") * F.col("value")).over(down).alias("ii"))
    return first.select(key, "v", "u", F.sum("i").over(along).alias("i"), F.sum("ii").over(along).alias("ii"))


def box_sums(image: DataFrame, boxes: DataFrame, reach: int, n_v: int, n_u: int) -> DataFrame:
    """Pair, dy, dx, i, ii and w: sums of the image and of its square over a box (pair, v0, v1, u0, u1, ends included) at
    every shift up to ``reach``, from four running sums instead of all pixels; outside the image they are 0. w is the
    number of pixels of the box."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    at = with_frames(boxes, running_sums(image), "i", "ii").withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    return at.select("pair", "dy", "dx", *_box_totals(n_v, n_u))


def _box_totals(n_v: int, n_u: int) -> tuple[Column, ...]:
    """i, ii and w of a box at a shift, its running sums beside it."""
    inside = lambda x, n: F.greatest(F.lit(-1), F.least(x, F.lit(n - 1)))
    v0, v1 = inside(F.col("v0") - 1 + F.col("dy"), n_v), inside(F.col("v1") + F.col("dy"), n_v)
    u0, u1 = inside(F.col("u0") - 1 + F.col("dx"), n_u), inside(F.col("u1") + F.col("dx"), n_u)
    at = lambda v, u, c: F.coalesce(in_frame(v, u)[c], F.lit(0.0))
    total = lambda c: (at(v1, u1, c) - at(v0, u1, c) - at(v1, u0, c) + at(v0, u0, c)).alias(c)
    return total("i"), total("ii"), ((F.col("v1") - F.col("v0") + 1) * (F.col("u1") - F.col("u0") + 1)).alias("w")


def box_surface(image: DataFrame, model: DataFrame, boxes: DataFrame, reach: int, n_v: int, n_u: int) -> DataFrame:
    """A09 for masks that are boxes: pair, dy, dx, numerator, ncc as ``correlate.surface`` gives; only the products of model and
    image are summed pixel by pixel."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    inside = model.join(boxes.hint("merge"), "pair").filter(F.col("v").between(F.col("v0"), F.col("v1")) & F.col("u").between(F.col("u0"), F.col("u1"))).select("pair", "v", "u", "value")
    spread = with_frames(inside.withColumnRenamed("value", "_m"), image).withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    spread = spread.withColumn("value", in_frame(F.col("v") + F.col("dy"), F.col("u") + F.col("dx")))
    products = spread.groupBy("pair", "dy", "dx").agg(F.coalesce(F.sum(F.col("value") * F.col("_m")), F.lit(0.0)).alias("im"), F.sum("_m").alias("m"), F.sum(F.col("_m") * F.col("_m")).alias("mm"))
    summed = with_frames(boxes, running_sums(image), "i", "ii")
    s = products.join(summed.hint("merge"), "pair").select("pair", "dy", "dx", "im", "m", "mm", *_box_totals(n_v, n_u))
    return scored(s)
