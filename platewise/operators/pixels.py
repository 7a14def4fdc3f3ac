"""Operators on images as rows (image_ord, v, u, value): shifts, blocks, gradients, masks, stretches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPS = 1e-12


def normalized(px: DataFrame) -> DataFrame:
    """(value - mean) / population std over the image; 0 where the std is tiny."""
    s = px.groupBy("image_ord").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return px.join(s, "image_ord").withColumn("value", F.when(F.col("_s") < EPS, 0.0).otherwise((F.col("value") - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


BLOCK_METHODS: dict[str, Callable[[str], Column]] = {"mean": F.avg, "min": F.min, "max": F.max}


def blocks(px: DataFrame, ay: int, ax: int, method: str = "mean") -> DataFrame:
    """Blocks of ay x ax pixels, by mean, min or max."""
    if method not in BLOCK_METHODS:
        raise ValueError(f"unknown method {method!r}")
    return px.groupBy("image_ord", F.floor(F.col("v") / ay).alias("v"), F.floor(F.col("u") / ax).alias("u")).agg(BLOCK_METHODS[method]("value").alias("value"))


def zoomed(px: DataFrame, factor: int) -> DataFrame:
    """Every pixel repeated factor x factor times."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    out = px.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    return out.withColumn("v", F.col("v") * factor + F.col("_i")).withColumn("u", F.col("u") * factor + F.col("_j")).drop("_i", "_j")


def grid(images: DataFrame, n_v: int, n_u: int) -> DataFrame:
    """All pixels of images (a frame of image_ord)."""
    return images.withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_v - 1).cast("long")))).withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_u - 1).cast("long"))))


def shifted(px: DataFrame, dv: int, du: int, n_v: int, n_u: int, fill: float = 0.0) -> DataFrame:
    """The image moved by whole pixels; what moves in is ``fill``, what moves out is lost."""
    moved = px.select("image_ord", (F.col("v") + dv).alias("v"), (F.col("u") + du).alias("u"), "value").filter(F.col("v").between(0, n_v - 1) & F.col("u").between(0, n_u - 1))
    return grid(px.select("image_ord").distinct(), n_v, n_u).join(moved, ["image_ord", "v", "u"], "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def padded(px: DataFrame, margin_v: int, margin_u: int, n_v: int, n_u: int, fill: float = 0.0) -> DataFrame:
    """Images with a margin of ``fill`` at every edge, the old pixels in the middle."""
    moved = px.select("image_ord", (F.col("v") + margin_v).alias("v"), (F.col("u") + margin_u).alias("u"), "value")
    return grid(px.select("image_ord").distinct(), n_v + 2 * margin_v, n_u + 2 * margin_u).join(moved, ["image_ord", "v", "u"], "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def unpadded(px: DataFrame, margin_v: int, margin_u: int, n_v: int, n_u: int) -> DataFrame:
    """Images without their margins; n_v and n_u are the sizes with them."""
    inside = F.col("v").between(margin_v, n_v - 1 - margin_v) & F.col("u").between(margin_u, n_u - 1 - margin_u)
    return px.filter(inside).withColumn("v", F.col("v") - margin_v).withColumn("u", F.col("u") - margin_u)


def cropped(px: DataFrame, n_v: int, n_u: int, to_v: int, to_u: int) -> DataFrame:
    """The middle of images, to_v x to_u pixels of n_v x n_u; the odd pixel stays at the end."""
    v0, u0 = (n_v - to_v) // 2, (n_u - to_u) // 2
    inside = F.col("v").between(v0, v0 + to_v - 1) & F.col("u").between(u0, u0 + to_u - 1)
    return px.filter(inside).withColumn("v", F.col("v") - v0).withColumn("u", F.col("u") - u0)


def at_top_left(px: DataFrame, to_v: int, to_u: int) -> DataFrame:
    """Images placed at (0, 0) of to_v x to_u zeros; what is beyond is lost."""
    kept = px.filter((F.col("v") < to_v) & (F.col("u") < to_u)).select("image_ord", "v", "u", "value")
    return grid(px.select("image_ord").distinct(), to_v, to_u).join(kept, ["image_ord", "v", "u"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def gradient(px: DataFrame) -> DataFrame:
    """Gv, gu (central differences, one-sided at borders) and their magnitude."""
    def along(axis: str, other: str) -> Column:
        w = W.partitionBy("image_ord", other).orderBy(axis)
        before, after = F.lag("value").over(w), F.lead("value").over(w)
        return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - F.col("value")).when(after.isNull(), F.col("value") - before).otherwise((after - before) / 2)

    return px.withColumn("gv", along("v", "u")).withColumn("gu", along("u", "v")).withColumn("magnitude", F.hypot("gv", "gu"))


def limb(px: DataFrame) -> DataFrame:
    """Valid pixels with an invalid neighbour above, below, left or right; outside the image counts as valid."""
    def invalid(axis: str, other: str, f) -> Column:
        return F.coalesce(~f("valid").over(W.partitionBy("image_ord", other).orderBy(axis)), F.lit(False))

    near = invalid("v", "u", F.lag) | invalid("v", "u", F.lead) | invalid("u", "v", F.lag) | invalid("u", "v", F.lead)
    return px.withColumn("limb", F.col("valid") & near)


def reflected(x: Column, n: int) -> Column:
    """An index outside 0..n-1 mirrored at the border, the border pixel twice."""
    return F.when(x < 0, -1 - x).when(x >= n, 2 * n - 1 - x).otherwise(x)


def framed(px: DataFrame, axis: str, n: int, radius: int, out: dict[str, Callable], key: str = "image_ord") -> DataFrame:
    """Columns from the pixels within ``radius`` along an axis of n pixels, each as a function of the window that frames them;
    the image is mirrored at its borders. A border pixel stands at its mirrored places as well (column _p), so that no
    pixel is joined with another."""
    places = []
    for k in range(-(-(radius + n) // (2 * n)) + 1):
        for turn in sorted({k, -k}):
            places += [(F.col(axis) + 2 * n * turn, turn == 0), (2 * n * turn - 1 - F.col(axis), False)]
    places = F.array(*(F.struct(p.cast("long").alias("p"), F.lit(own).alias("own")) for p, own in places))
    near = px.withColumn("_at", F.explode(F.filter(places, lambda e: e["p"].between(-radius, n - 1 + radius))))
    near = near.withColumn("_p", F.col("_at.p")).withColumn("_own", F.col("_at.own")).drop("_at")
    frame = W.partitionBy(key, "u" if axis == "v" else "v").orderBy("_p").rangeBetween(-radius, radius)
    return near.withColumns({c: f(frame) for c, f in out.items()}).filter("_own").drop("_p", "_own")


def box_extreme(px: DataFrame, radius: int, n_v: int, n_u: int, largest: bool = True) -> DataFrame:
    """Largest or least value in a square of side 2 radius + 1, one axis after the other."""
    f = F.max if largest else F.min
    for axis, n in (("v", n_v), ("u", n_u)):
        px = framed(px, axis, n, radius, {"value": lambda w: f("value").over(w)})
    return px.select("image_ord", "v", "u", "value")


def local_maxima(px: DataFrame, radius: int, n_v: int, n_u: int, tolerance: float = 1.0) -> DataFrame:
    """Pixels that are the largest of their box, and at least tolerance times what the box has at least."""
    px = px.withColumn("_top", F.col("value")).withColumn("_low", F.col("value"))
    for axis, n in (("v", n_v), ("u", n_u)):
        px = framed(px, axis, n, radius, {"_top": lambda w: F.max("_top").over(w), "_low": lambda w: F.min("_low").over(w)})
    return px.filter((F.col("value") == F.col("_top")) & (F.col("value") >= F.col("_low") * tolerance)).drop("_top", "_low")


def minus_median(px: DataFrame, radius: int, n_v: int, n_u: int, footprint: str = "square") -> DataFrame:
    """The value less the median of its square, or of the circle of radius + 0.5 in it. A pixel gathers its column and
    then the columns beside it, so a row holds the (2 radius + 1)**2 values of its own box at most."""
    if footprint not in ("square", "circle"):
        raise ValueError(f"unknown footprint {footprint!r}")
    cell = lambda c: F.collect_list(F.struct(F.col("_p").alias("p"), F.col(c).alias("x")))
    column = lambda w: F.transform(cell("value").over(w), lambda e: F.struct((e["p"] - F.col("_p")).alias("i"), e["x"].alias("x")))
    inside = lambda i, j: F.lit(True) if footprint == "square" else i * i + j * j <= (radius + 0.5) ** 2

    def box(w):
        values = lambda e: F.transform(F.filter(e["x"], lambda c: inside(c["i"], e["p"] - F.col("_p"))), lambda c: c["x"])
        return F.sort_array(F.flatten(F.transform(cell("_box").over(w), values)))

    px = framed(px, "v", n_v, radius, {"_box": column})
    px = framed(px, "u", n_u, radius, {"_box": box})
    middle = lambda k: F.element_at("_box", k.cast("int"))
    n = F.size("_box")
    return px.withColumn("value", F.col("value") - (middle(F.floor((n + 1) / 2)) + middle(F.floor(n / 2) + 1)) / 2).drop("_box")


def stretched(px: DataFrame, low: float = 0.001, high: float = 0.999, gamma: float = 1.0, regions: tuple[str, ...] = ()) -> DataFrame:
    """Level 0..255 of every pixel between two quantiles of its image, or of its region of the image where
    columns name one; equal quantiles are set 0.01 apart."""
    keys = ["image_ord", *regions]
    q = px.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(low), F.lit(high))).alias("_q"))
    black, white = F.col("_q")[0], F.col("_q")[1]
    white = F.when(white == black, black + 0.01).otherwise(white)
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - black) / (white - black)))
    return px.join(q, keys).withColumn("level", F.least(F.lit(255), F.floor(F.pow(x, F.lit(gamma)) * 256)).cast("long")).drop("_q")
