"""Fields of view: limits, bodies inside them, box arithmetic and model composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.functions.times import utc_from_et


def ra_dec_limits(corners: DataFrame) -> DataFrame:
    """Limits of corner directions (image_ord, ra, dec in degrees). If right ascension spans more than 180 degrees
    the field crosses 0, and the limits are the least beyond 180 and the largest below."""
    g = corners.groupBy("image_ord").agg(F.min("ra").alias("_lo"), F.max("ra").alias("_hi"), F.min(F.when(F.col("ra") > 180, F.col("ra"))).alias("_far"), F.max(F.when(F.col("ra") < 180, F.col("ra"))).alias("_near"), F.min("dec").alias("dec_min"), F.max("dec").alias("dec_max"))
    wraps = F.col("_hi") - F.col("_lo") > 180
    return g.select("image_ord", F.when(wraps, F.col("_far")).otherwise(F.col("_lo")).alias("ra_min"), F.when(wraps, F.col("_near")).otherwise(F.col("_hi")).alias("ra_max"), "dec_min", "dec_max")


def closest(bodies: DataFrame) -> DataFrame:
    """The body of least distance (below 1e38) of every image, the first in order on a tie."""
    return bodies.filter(F.col("distance") < 1e38).groupBy("image_ord").agg(F.min_by("body_ord", F.struct("distance", "body_ord")).alias("closest"))


def by_distance(bodies: DataFrame) -> DataFrame:
    """Place of every body of an image from near to far."""
    return bodies.withColumn("place", F.row_number().over(W.partitionBy("image_ord").orderBy("distance", "body_ord")))


def with_inventory(stats: DataFrame, inventory: DataFrame) -> DataFrame:
    """Statistics of bodies with what the inventory knows of them; null where it knows nothing."""
    return stats.join(inventory, ["image_ord", "body_ord"], "left")


def satellites(images: DataFrame, bodies: list[tuple[str, str]]) -> DataFrame:
    """Candidate bodies of every image's planet, the planet first; planets in any case, unknown ones have none.
    The list is short and fixed."""
    rows = [(p.upper(), b, i) for i, (p, b) in enumerate(bodies)]
    dim = images.sparkSession.createDataFrame(rows, "_planet string, body string, body_place int")
    found = images.join(F.broadcast(dim), F.upper("planet") == F.col("_planet"), "left").drop("_planet")
    self = images.withColumn("body", F.upper("planet")).withColumn("body_place", F.lit(-1)).filter(F.upper("planet").isin(*{p for p, _, _ in rows}))
    return found.filter("body IS NOT NULL").unionByName(self)


def peak_scales(models: DataFrame) -> DataFrame:
    """The largest value under every model's mask, 1e-12 at least."""
    return models.groupBy("image_ord", "body_ord").agg(F.greatest(F.coalesce(F.max(F.when(F.col("valid"), F.col("value"))), F.lit(0.0)), F.lit(1e-12)).alias("scale"))


def composite(models: DataFrame, confidences: DataFrame) -> DataFrame:
    """Per model pixel value / scale * confidence over the sum of the image's confidences, and the mask weighted
    alike, between 0 and 1. Pixels outside the mask are 0."""
    m = models.join(peak_scales(models), ["image_ord", "body_ord"]).join(confidences, ["image_ord", "body_ord"])
    total = confidences.groupBy("image_ord").agg(F.sum("confidence").alias("_total"))
    weight = F.when(F.col("_total") > 0, F.col("confidence") / F.col("_total")).otherwise(F.col("confidence"))
    m = m.join(total, "image_ord").withColumn("_w", F.when(F.col("valid"), weight).otherwise(0.0))
    m = m.withColumn("value", F.when(F.col("valid"), F.col("value") / F.col("scale")).otherwise(0.0) * F.col("_w"))
    return m.withColumn("weighted_mask", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_w")))).select(*models.columns, "weighted_mask")


def front_model(models: DataFrame, confidences: DataFrame) -> DataFrame:
    """Per pixel the model of least range, the first in order on a tie, with its composite value and mask. A model
    has no range outside its mask, so a pixel that no model covers takes the first one, with value 0."""
    c = composite(models, confidences).withColumn("_range", F.when(F.col("valid"), F.coalesce("distance", F.lit(float("inf")))).otherwise(float("inf")))
    best = F.min_by(F.struct(F.col("body_ord").alias("front"), "value", "valid", "weighted_mask", F.col("_range").alias("range")), F.struct("_range", "body_ord"))
    return c.groupBy("image_ord", "v", "u").agg(best.alias("b")).select("image_ord", "v", "u", "b.*")


def all_models(results: dict[str, DataFrame]) -> DataFrame:
    """Results of all kinds of models, in the order given (stars, bodies, rings, Titan): kind, kind_ord and the
    columns of the results."""
    out = None
    for k, (kind, df) in enumerate(results.items()):
        one = df.withColumn("kind", F.lit(kind)).withColumn("kind_ord", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


# Margins (v, u) of the extended field of view by instrument, detector and image height; a null matches all.
MARGINS = (
    ("coiss", "NAC", 256, 13, 25), ("coiss", "NAC", 512, 25, 50), ("coiss", "NAC", 1024, 50, 100), ("coiss", "WAC", 256, 5, 10), ("coiss", "WAC", 512, 5, 10), ("coiss", "WAC", 1024, 5, 10),
    ("gossi", None, None, 200, 200), ("nhlorri", None, 256, 15, 15), ("nhlorri", None, 512, 30, 30), ("nhlorri", None, 1024, 60, 60), ("vgiss", None, 1000, 400, 400), ("sim", None, None, 50, 50),
)


def with_margins(images: DataFrame, margins: tuple = MARGINS) -> DataFrame:
    """margin_v and margin_u of images (instrument, detector, height); null for a height that isn't known. The table
    of margins is short and fixed."""
    v = u = F.lit(None).cast("int")
    for instrument, detector, height, mv, mu in reversed(margins):
        ok = F.col("instrument") == instrument
        if detector is not None:
            ok = ok & (F.upper("detector") == detector)
        if height is not None:
            ok = ok & (F.col("height") == height)
        v, u = F.when(ok, mv).otherwise(v), F.when(ok, mu).otherwise(u)
    return images.withColumn("margin_v", v).withColumn("margin_u", u)


def body_box(bodies: DataFrame, n_v: int, n_u: int, margin_v: int, margin_u: int, share: float = 0.05) -> DataFrame:
    """Boxes (u_min, u_max, v_min, v_max, of any type) of bodies in whole pixels, widened by a share of their size,
    clipped to the extended field of view, a single row or column at its border made two, and visible: the box stays in
    the image wherever the margin allows the image to move."""
    out = bodies
    for axis, n, margin in (("u", n_u, margin_u), ("v", n_v, margin_v)):
        lo, hi = (F.col(f"{axis}_{end}").cast("long") for end in ("min", "max"))
        slop = ((hi - lo) * share).cast("long")
        first, last = -margin, n - 1 + margin
        clip = lambda x: F.greatest(F.lit(first), F.least(F.lit(last), x))  # noqa: E731, B023
        a, b = clip(lo - slop), clip(hi + slop)
        out = out.withColumn(f"_{axis}a", F.when((a == b) & (a == last), a - 1).otherwise(a)).withColumn(f"_{axis}b", F.when((a == b) & (a == first), b + 1).otherwise(b))
    seen = (F.col("_ua") >= margin_u) & (F.col("_ub") <= n_u - 1 - margin_u) & (F.col("_va") >= margin_v) & (F.col("_vb") <= n_v - 1 - margin_v)
    out = out.withColumn("visible", seen)
    for axis in ("u", "v"):
        out = out.withColumn(f"{axis}_min", F.col(f"_{axis}a")).withColumn(f"{axis}_max", F.col(f"_{axis}b")).drop(f"_{axis}a", f"_{axis}b")
    return out


BODY_ANGLES = ("sub_solar_lon", "sub_solar_lat", "sub_observer_lon", "sub_observer_lat", "phase_angle")


def body_facts(bodies: DataFrame, angles: tuple[str, ...] = BODY_ANGLES) -> DataFrame:
    """The angles of bodies in degrees."""
    return bodies.withColumns({c: F.degrees(c) for c in angles})


def calibration_factor(label: Column) -> Column:
    """What DN values are multiplied by, from the text of a label; null where it says none."""
    return F.regexp_replace(label, r"FOR \(I/F\)\*10000\., MULTIPLY DN VALUE BY", "").try_cast("double") / 10000


# Identifiers of spacecraft and instruments; {n} is the spacecraft's number, {d} the detector's letter.
HOSTS = {"coiss": ("co", "iss{d}a.co"), "vgiss": ("vg{n}", "vg{n}.iss{d}"), "gossi": ("go", "go.ssi"), "nhlorri": ("nh", "nh.lorri")}


def public_metadata(images: DataFrame) -> DataFrame:
    """What is published of images (instrument, detector, spacecraft, image_url, start_et, end_et, clock_start and
    clock_stop as texts, exposure, filters): names, identifiers, times in both scales and the spacecraft clock with its
    mean. Clocks are known for coiss only; other instruments have nulls there."""
    kind, letter = F.col("instrument"), F.lower(F.substring("detector", 1, 1))
    host = instrument = F.lit(None).cast("string")
    for name, (h, i) in HOSTS.items():
        filled = lambda t: F.replace(F.replace(F.lit(t), F.lit("{n}"), F.coalesce(F.col("spacecraft").cast("string"), F.lit(""))), F.lit("{d}"), letter)
        host, instrument = F.when(kind == name, filled(h)).otherwise(host), F.when(kind == name, filled(i)).otherwise(instrument)
    clock = lambda c: F.when(kind == "coiss", F.col(c).try_cast("double"))
    middle = (F.col("start_et") + F.col("end_et")) / 2
    return images.select(
        "image_ord", F.col("image_url").alias("image_path"), F.element_at(F.split("image_url", "/"), -1).alias("image_name"),
        F.concat(F.lit("urn:nasa:pds:context:instrument_host:spacecraft."), host).alias("instrument_host_lid"), F.concat(F.lit("urn:nasa:pds:context:instrument:"), instrument).alias("instrument_lid"),
        utc_from_et(F.col("start_et")).alias("start_time_utc"), utc_from_et(middle).alias("midtime_utc"), utc_from_et(F.col("end_et")).alias("end_time_utc"),
        F.col("start_et").alias("start_time_et"), middle.alias("midtime_et"), F.col("end_et").alias("end_time_et"),
        clock("clock_start").alias("start_time_scet"), ((clock("clock_start") + clock("clock_stop")) / 2).alias("midtime_scet"), clock("clock_stop").alias("end_time_scet"),
        F.when(kind == "gossi", "SSI").when(kind == "nhlorri", "LORRI").otherwise(F.col("detector")).alias("camera"), F.col("exposure").alias("exposure_time"), F.when(kind == "nhlorri", F.array().cast("array<string>")).otherwise(F.col("filters")).alias("filters"),
    )


def time_extent(images: DataFrame, keys: list[str], start: str = "start_et", end: str = "end_et") -> DataFrame:
    """Earliest start and latest end of every collection."""
    return images.groupBy(*keys).agg(F.min(start).alias(start), F.max(end).alias(end))


def slopped(lo: Column, hi: Column, share: float = 0.05) -> tuple[Column, Column]:
    """A box side widened by a share of its size at both ends, to whole pixels."""
    size = hi - lo
    return F.floor(lo - size * share), F.ceil(hi + size * share)


def large_enough(u0: Column, u1: Column, v0: Column, v1: Column, least: float = 9.0) -> Column:
    """P40."""
    return (u1 - u0) * (v1 - v0) >= least


def inside_margin(dv: Column, du: Column, margin_v: Column, margin_u: Column) -> Column:
    """The offset lies strictly inside the extended field of view, one pixel from its border."""
    return (F.abs(dv) < margin_v - 1) & (F.abs(du) < margin_u - 1)


def off_edges(df: DataFrame, n_v: int, n_u: int) -> DataFrame:
    """Stars with position and brightness whose PSF box stays inside the image at the middle and at both ends
    of their motion (v, u, v0, u0, v1, u1, psf)."""
    half = F.floor(F.col("psf") / 2)
    ok = F.col("ra").isNotNull() & F.col("dec").isNotNull() & F.col("vmag").isNotNull()
    for s in ("", "0", "1"):
        ok = ok & (F.col(f"v{s}") > half) & (F.col(f"v{s}") < n_v - 1 - half) & (F.col(f"u{s}") > half) & (F.col(f"u{s}") < n_u - 1 - half)
    return df.filter(ok)
