"""Per-pixel planes: merging by nearest source, occlusion, statistics and the global index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def statistics(pixels: DataFrame, keys: tuple[str, ...] = ("image_ord", "body_ord", "plane")) -> DataFrame:
    """Least and largest valid value of every plane, radians in degrees; planes without valid pixels have no row."""
    x = F.when(F.col("units") == "rad", F.degrees("value")).otherwise(F.col("value"))
    return pixels.filter("valid").groupBy(*keys).agg(F.min(x).alias("min"), F.max(x).alias("max"))


def nearest(pixels: DataFrame) -> DataFrame:
    """Per image, pixel and plane the valid source of least distance, the first in order on a tie. One combined
    minimum, no sort."""
    best = F.min_by(F.struct("body_ord", "value", "distance"), F.struct(F.col("distance").cast("float").alias("d"), "body_ord"))
    return pixels.filter("valid").groupBy("image_ord", "plane", "v", "u").agg(best.alias("b")).select("image_ord", "plane", "v", "u", "b.*")


def unoccluded(rings: DataFrame, bodies: DataFrame) -> DataFrame:
    """Ring pixels that no nearer body covers; a tie keeps the ring."""
    front = bodies.filter("valid").groupBy("image_ord", "v", "u").agg(F.min("distance").alias("_front"))
    seen = F.col("_front").isNull() | (F.col("_front") >= F.col("distance"))
    return rings.join(front, ["image_ord", "v", "u"], "left").filter(seen).drop("_front")


def collisions(bodies: DataFrame, rings: DataFrame) -> DataFrame:
    """Planes that both sources deliver; must be empty."""
    return bodies.select("image_ord", "plane").distinct().join(rings.select("image_ord", "plane").distinct(), ["image_ord", "plane"])


def mask_disagreement(pixels: DataFrame) -> DataFrame:
    """Bodies with pixels that are valid in some planes and not in others, with their number."""
    per = pixels.groupBy("image_ord", "body_ord", "v", "u").agg(F.count_if("valid").alias("ok"), F.count("*").alias("planes"))
    return per.filter("ok > 0 AND ok < planes").groupBy("image_ord", "body_ord").agg(F.count("*").alias("pixels"))


def mask_union(pixels: DataFrame) -> DataFrame:
    """Covered pixels of every image."""
    return pixels.filter("valid").select("image_ord", "v", "u").distinct().groupBy("image_ord").agg(F.count("*").alias("covered"))


def nonzero_planes(pixels: DataFrame) -> DataFrame:
    """Planes with a value that is not 0; a null (NaN) is not 0."""
    return pixels.groupBy("image_ord", "plane").agg(F.bool_or(F.col("value").isNull() | (F.col("value") != 0)).alias("any")).filter("any").drop("any")


def index_rows(stats: DataFrame, planes: tuple[str, ...], keys: tuple[str, ...] = ("image_ord", "body_ord")) -> DataFrame:
    """One row per image and body, two columns for every configured plane (fixed list, so nothing is pivoted)."""
    out = []
    for p in planes:
        out += [F.max(F.when(F.col("plane") == p, F.col(c))).alias(f"{p}_{c}") for c in ("min", "max")]
    return stats.groupBy(*keys).agg(*out)


def display_range(pixels: DataFrame) -> DataFrame:
    """Range to show a plane with: fixed for longitudes, latitudes and angles, from 0 for radii, else what is there."""
    name = F.lower("plane")
    lo, hi = F.min("value"), F.max("value")
    g = pixels.filter("valid").groupBy("image_ord", "plane").agg(lo.alias("_lo"), hi.alias("_hi"))
    low = F.when(name.contains("longitude"), 0.0).when(name.contains("latitude"), -90.0).when(name.contains("angle"), 0.0).when(name.contains("radius"), 0.0).otherwise(F.col("_lo"))
    high = F.when(name.contains("longitude"), 360.0).when(name.contains("latitude"), 90.0).when(name.contains("angle"), 180.0).otherwise(F.col("_hi"))
    return g.select("image_ord", "plane", low.alias("low"), high.alias("high"))


def relative_range(pixels: DataFrame) -> DataFrame:
    """Least and largest value of every plane where it is valid and some body is seen (body_id is not 0), at least
    1e-6 apart; 0 and 1 for a plane without such pixels."""
    seen = F.when(F.col("valid") & (F.col("body_id") != 0), F.col("value"))
    g = pixels.groupBy("image_ord", "plane").agg(F.min(seen).alias("_lo"), F.max(seen).alias("_hi"))
    return g.select("image_ord", "plane", F.coalesce("_lo", F.lit(0.0)).alias("low"), F.when(F.col("_lo").isNull(), 1.0).when(F.col("_hi") <= F.col("_lo"), F.col("_lo") + 1e-6).otherwise(F.col("_hi")).alias("high"))


def overlaps(u0: Column, u1: Column, v0: Column, v1: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """The rectangle touches the field of view (first and last columns and rows)."""
    return (u0 <= box[1]) & (u1 >= box[0]) & (v0 <= box[3]) & (v1 >= box[2])


def clipped(lo: Column, hi: Column, least: Column, most: Column) -> tuple[Column, Column]:
    """Both ends inside the field of view; the caller drops what is empty."""
    return F.greatest(lo, least), F.least(hi, most)


def body_maps(pixels: DataFrame) -> DataFrame:
    """Body-id maps (image_ord, v, u, body_id) of images in which some id is not 0."""
    some = pixels.groupBy("image_ord").agg(F.bool_or(F.coalesce("body_id", F.lit(0)) != 0).alias("_any")).filter("_any").drop("_any")
    return pixels.select("image_ord", "v", "u", "body_id").join(some, "image_ord", "left_semi")


def plane_table(pixels: DataFrame, maps: DataFrame, units: dict[str, str]) -> DataFrame:
    """The planes of images as they are written: plane_ord, PLANE, units, v, u, value. The map of body ids comes
    first, where it is not empty; then the planes that aren't all zero, in upper case, with their units (a short list)."""
    kept = pixels.join(nonzero_planes(pixels), ["image_ord", "plane"], "left_semi")
    named = F.coalesce(F.create_map(*(F.lit(x) for kv in units.items() for x in kv))[F.col("plane")], F.lit("")) if units else F.lit("")
    planes = kept.select("image_ord", F.lit(1).alias("plane_ord"), F.upper("plane").alias("PLANE"), named.alias("units"), "v", "u", F.col("value").cast("float").alias("value"))
    ids = body_maps(maps).select("image_ord", F.lit(0).alias("plane_ord"), F.lit("BODY_ID_MAP").alias("PLANE"), F.lit("").alias("units"), "v", "u", F.col("body_id").cast("float").alias("value"))
    return ids.unionByName(planes)


def write_planes(table: DataFrame, path: str) -> None:
    """The planes as Parquet, a folder per plane, so that a reader of one plane reads no other."""
    table.repartition("PLANE", "image_ord").sortWithinPartitions("image_ord", "v", "u").write.mode("overwrite").partitionBy("PLANE").parquet(path)


def read_planes(spark: SparkSession, path: str, planes: list[str] | None = None) -> DataFrame:
    """Written planes, all or some of them by name in any case; the folders of the others aren't read."""
    df = spark.read.schema("image_ord long, plane_ord int, units string, v long, u long, value float, PLANE string").parquet(path)
    return df if planes is None else df.filter(F.col("PLANE").isin([p.upper() for p in planes]))


def statistics_documents(bodies: DataFrame, rings: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per image the document {bodies, rings} as JSON: ranges of the planes by body, with centre (v, u), range and
    size where the inventory (center_u, center_v, range, u_pixel_size, v_pixel_size) knows them, and those of the rings.

    bodies (image_ord, body, plane, min, max) and rings (image_ord, plane, min, max) are statistics of planes.
    """
    ranges = F.map_from_entries(F.array_sort(F.collect_list(F.struct("plane", F.struct("min", "max").alias("r"))))).alias("backplanes")
    facts = inventory.select("image_ord", "body", F.array("center_v", "center_u").alias("center_uv"), F.col("range").alias("center_range"), F.when(F.col("u_pixel_size").isNotNull() & F.col("v_pixel_size").isNotNull(), F.array("u_pixel_size", "v_pixel_size")).alias("size_uv"))
    by_name = lambda x, y: F.when(x["body"] < y["body"], -1).when(x["body"] > y["body"], 1).otherwise(0)
    b = bodies.groupBy("image_ord", "body").agg(ranges).join(facts, ["image_ord", "body"], "left")
    b = b.groupBy("image_ord").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("body", F.struct("backplanes", "center_uv", "center_range", "size_uv").alias("e"))), by_name)).alias("bodies"))
    r = rings.groupBy("image_ord").agg(ranges).select("image_ord", F.struct("backplanes").alias("rings"))
    return b.join(r, "image_ord", "full").select("image_ord", F.to_json(F.struct("bodies", "rings")).alias("document"))


def configured_planes(pixels: DataFrame, config: list[dict], methods: dict[str, Callable[[DataFrame], Column]]) -> DataFrame:
    """The planes that a list of {name, method, units} asks for, one row per pixel and plane (plane, units, value
    added). A plane without method or units, and a method that isn't known, are errors before anything runs."""
    made = []
    for plane in config:
        for field in ("method", "units"):
            if plane.get(field) is None:
                raise ValueError(f"plane {plane['name']!r} has no {field}")
        if plane["method"] not in methods:
            raise ValueError(f"plane {plane['name']!r}: unknown method {plane['method']!r}")
        made.append(F.struct(F.lit(plane["name"]).alias("plane"), F.lit(plane["units"]).alias("units"), methods[plane["method"]](pixels).cast("double").alias("value")))
    return pixels.withColumn("_p", F.explode(F.array(*made))).select(*(c for c in pixels.columns if c != "value"), "_p.*")
