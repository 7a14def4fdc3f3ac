"""Star catalogues: box search, duplicates between catalogues, overlaps, limits and robust statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.functions.formats import spectral_class
from platewise.operators.blocks import block_join

RA_CELL, DEC_CELL = 15.0, 5.0
#: The band of stars without magnitude, and of all stars of a cell that isn't crowded.
NO_BAND = -1000
#: Pixels of the cells in which star boxes of an image are compared.
BOX_CELL = 64.0
#: Degrees within which stars of two catalogues may be one, and magnitudes.
SAME_DEGREES, SAME_MAGNITUDES = 5.0 / 3600.0, 3.0


def in_ra(ra: Column, lo: Column, hi: Column) -> Column:
    """Inside [lo, hi], or across 0 if lo > hi."""
    return F.when(lo <= hi, ra.between(lo, hi)).otherwise((ra >= lo) | (ra <= hi))


def stars_in_fields(stars: DataFrame, fields: DataFrame) -> DataFrame:
    """Stars inside each field's box. Fields are cut into cells of the sky, stars lie in one cell: an equality join
    and then the exact test."""
    last = int(360 / RA_CELL) - 1
    cell = lambda c, size: F.floor(F.col(c) / size)
    ras = F.when(F.col("ra_min") <= F.col("ra_max"), F.sequence(cell("ra_min", RA_CELL), cell("ra_max", RA_CELL))).otherwise(F.concat(F.sequence(cell("ra_min", RA_CELL), F.lit(last).cast("long")), F.sequence(F.lit(0).cast("long"), cell("ra_max", RA_CELL))))
    f = fields.withColumn("_r", F.explode(F.array_distinct(ras))).withColumn("_d", F.explode(F.sequence(cell("dec_min", DEC_CELL), cell("dec_max", DEC_CELL))))
    s = stars.withColumn("_r", cell("ra", RA_CELL)).withColumn("_d", cell("dec", DEC_CELL))
    exact = in_ra(F.col("ra"), F.col("ra_min"), F.col("ra_max")) & F.col("dec").between(F.col("dec_min"), F.col("dec_max"))
    return s.join(f, ["_r", "_d"]).filter(exact).drop("_r", "_d")


#: Cells of the sky, in degrees: fine ones for fields of up to SMALL_FIELD degrees, coarse ones for larger fields.
FINE_CELL, COARSE_CELL, SMALL_FIELD = 0.5, 8.0, 2.0
#: Stars of a cell from which on it is split into bands of MAGNITUDE_BAND.
CROWDED, MAGNITUDE_BAND = 10_000, 1.0


def catalog_search(stars: DataFrame, fields: DataFrame, doubles: bool = True, galaxies: bool = False, crowded: int = CROWDED) -> DataFrame:
    """Stars (ra, dec, vmag, double, galaxy) in the box of each field (ra_min, ra_max, dec_min, dec_max) and in
    its range of magnitudes (mag_min, mag_max; null sets no limit). Ends are included, and ra_min > ra_max crosses 0.

    Doubles and galaxies are left out unless asked for; an unknown flag is none. A star without magnitude is in no limited
    range; one without place is nowhere. Fields are cut into cells of the sky of a size that suits them, and stars meet
    them by cell; cells of more than ``crowded`` stars are known beforehand (at most one for each cell of the sky) and
    are split by magnitude, so that a narrow range reads few of their stars. Stars and fields of a cell are joined in blocks.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    seen = stars.filter(F.col("ra").isNotNull() & F.col("dec").isNotNull())
    seen = seen if doubles else seen.filter(~flag("double"))
    seen = seen if galaxies else seen.filter(~flag("galaxy"))
    width = F.when(F.col("ra_min") <= F.col("ra_max"), F.col("ra_max") - F.col("ra_min")).otherwise(F.col("ra_max") + 360 - F.col("ra_min"))
    small = (width <= SMALL_FIELD) & (F.col("dec_max") - F.col("dec_min") <= SMALL_FIELD)
    exact = in_ra(F.col("ra"), F.col("ra_min"), F.col("ra_max")) & F.col("dec").between(F.col("dec_min"), F.col("dec_max"))
    bright = F.col("mag_min").isNull() | F.coalesce(F.col("vmag") >= F.col("mag_min"), F.lit(False))
    faint = F.col("mag_max").isNull() | F.coalesce(F.col("vmag") <= F.col("mag_max"), F.lit(False))
    ends = seen.agg(F.floor(F.min("vmag") / MAGNITUDE_BAND).alias("_b0"), F.floor(F.max("vmag") / MAGNITUDE_BAND).alias("_b1"))
    out = None
    for size, part in ((FINE_CELL, fields.filter(small)), (COARSE_CELL, fields.filter(~small))):
        last = math.ceil(360 / size) - 1
        r = lambda c: F.greatest(F.lit(0), F.least(F.floor(F.col(c) / size), F.lit(last))).cast("int")  # noqa: B023, E731
        d = lambda c: F.floor(F.col(c) / size).cast("int")  # noqa: B023, E731
        s = seen.withColumn("_r", r("ra")).withColumn("_d", d("dec"))
        full = F.broadcast(s.groupBy("_r", "_d").count().filter(F.col("count") > crowded).select("_r", "_d", F.lit(True).alias("_full")))
        band = F.when(F.col("_full"), F.coalesce(F.floor(F.col("vmag") / MAGNITUDE_BAND).cast("int"), F.lit(NO_BAND))).otherwise(NO_BAND)
        s = s.join(full, ["_r", "_d"], "left").withColumn("_b", band).drop("_full")
        turn = F.when(F.col("ra_min") <= F.col("ra_max"), F.sequence(r("ra_min"), r("ra_max"))).otherwise(F.concat(F.sequence(r("ra_min"), F.lit(last)), F.sequence(F.lit(0), r("ra_max"))))
        f = part.withColumn("_r", F.explode(F.array_distinct(turn))).withColumn("_d", F.explode(F.sequence(d("dec_min"), d("dec_max"))))
        f = f.join(full, ["_r", "_d"], "left").crossJoin(F.broadcast(ends))
        b0 = F.greatest(F.coalesce(F.floor(F.col("mag_min") / MAGNITUDE_BAND), F.col("_b0")), F.col("_b0"))
        b1 = F.least(F.coalesce(F.floor(F.col("mag_max") / MAGNITUDE_BAND), F.col("_b1")), F.col("_b1"))
        bands = F.when(F.col("_full") & (b0 <= b1), F.concat(F.sequence(b0.cast("int"), b1.cast("int")), F.array(F.lit(NO_BAND)))).otherwise(F.array(F.lit(NO_BAND)))
        f = f.withColumn("_b", F.explode(bands)).drop("_full", "_b0", "_b1")
        met = block_join(s, f, ["_r", "_d", "_b"]).filter(exact & bright & faint).drop("_r", "_d", "_b")
        out = met if out is None else out.unionByName(met)
    return out


def psf_size(vmag: Column, sizes: list[tuple[float, int]]) -> Column:
    """Size of the least threshold strictly above the magnitude, else that of the largest one."""
    sizes = sorted(sizes)
    out = F.lit(sizes[-1][1])
    for limit, size in reversed(sizes):
        out = F.when(vmag < limit, size).otherwise(out)
    return out


def without_duplicates(stars: DataFrame) -> DataFrame:
    """Stars of the union of catalogues without those that a catalogue of higher precedence has.

    A kept star without a name takes the name of the removed one of least declination. Catalogues are taken in order
    of rank; candidates come from equal cells, the earlier stars lying in their own cell and the eight around it.
    """
    ranks = sorted(r[0] for r in stars.select("catalog_rank").distinct().collect())
    cell = lambda c: F.floor(F.col(c) / SAME_DEGREES)
    around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    kept = None
    for rank in ranks:
        new = stars.filter(F.col("catalog_rank") == rank)
        if kept is None:
            kept = new
            continue
        old = kept.select(F.col("catalog_rank").alias("_rank"), F.col("unique_number").alias("_num"), F.col("ra").alias("_ra"), F.col("dec").alias("_dec"), F.col("vmag").alias("_vmag"), cell("ra").alias("_cr"), cell("dec").alias("_cd"))
        old = old.withColumn("_i", F.explode(around)).withColumn("_j", F.explode(around)).withColumn("_cr", F.col("_cr") + F.col("_i")).withColumn("_cd", F.col("_cd") + F.col("_j"))
        same = (F.abs(F.col("ra") - F.col("_ra")) < SAME_DEGREES) & (F.abs(F.col("dec") - F.col("_dec")) < SAME_DEGREES) & (F.abs(F.col("vmag") - F.col("_vmag")) < SAME_MAGNITUDES)
        pairs = new.withColumn("_cr", cell("ra")).withColumn("_cd", cell("dec")).join(old, ["_cr", "_cd"]).filter(same)
        names = pairs.filter("name IS NOT NULL").groupBy(F.col("_rank").alias("catalog_rank"), F.col("_num").alias("unique_number")).agg(F.min_by("name", "dec").alias("_name"))
        fresh = new.join(pairs.select("catalog_rank", "unique_number").distinct(), ["catalog_rank", "unique_number"], "left_anti")
        named = kept.join(names, ["catalog_rank", "unique_number"], "left").withColumn("name", F.coalesce("name", "_name")).drop("_name")
        kept = named.unionByName(fresh)
    return stars if kept is None else kept


def brightest(df: DataFrame, n: int = 100) -> DataFrame:
    """The n brightest stars of every image, by dn and then v."""
    return df.withColumn("place", F.row_number().over(W.partitionBy("image_ord").orderBy(F.desc("dn"), "v"))).filter(F.col("place") <= n)


def enough(df: DataFrame, most: int) -> DataFrame:
    """Magnitude buckets of an image and catalogue until the earlier ones hold ``most`` stars."""
    counts = df.groupBy("image_ord", "catalog_rank", "bucket").agg(F.count("*").alias("_n"))
    w = W.partitionBy("image_ord", "catalog_rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).filter(F.col("_before") < most)
    return df.join(counts.drop("_n", "_before"), ["image_ord", "catalog_rank", "bucket"], "left_semi")


def overlap_marks(df: DataFrame) -> DataFrame:
    """Stars (image_ord, star, v0, v1, u0, u1, v, vmag) whose box meets another's.

    Of two, ordered by v and star, both are marked if the later is less than 2 magnitudes fainter, else the later.
    """
    order, cell = F.struct("v", "star"), lambda c: F.floor(F.col(c) / BOX_CELL)
    # Boxes meet in the cell that holds the corner of least v and u of what they share.
    at = df.withColumn("_cv", F.explode(F.sequence(cell("v0"), cell("v1")))).withColumn("_cu", F.explode(F.sequence(cell("u0"), cell("u1"))))
    keys = ["image_ord", "_cv", "_cu"]
    a = at.select(*keys, *(F.col(c).alias(f"a_{c}") for c in ("star", "v0", "v1", "u0", "u1", "vmag")), order.alias("a_o"))
    b = at.select(*keys, *(F.col(c).alias(f"b_{c}") for c in ("star", "v0", "v1", "u0", "u1", "vmag")), order.alias("b_o"))
    corner = lambda c: F.floor(F.greatest(f"a_{c}", f"b_{c}") / BOX_CELL)
    meet = a.join(b, keys).filter("a_o < b_o AND a_v0 <= b_v1 AND b_v0 <= a_v1 AND a_u0 <= b_u1 AND b_u0 <= a_u1")
    meet = meet.filter((corner("v0") == F.col("_cv")) & (corner("u0") == F.col("_cu")))
    both = F.when(F.col("b_vmag") - F.col("a_vmag") < 2, F.array("a_star", "b_star")).otherwise(F.array("b_star"))
    return meet.select("image_ord", F.explode(both).alias("star")).distinct()


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """N, min, max, mean, std (population), median and mad_std (1.4826 times the median deviation)."""
    first = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    dev = df.join(first, keys).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    return dev.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.first("median").alias("median"), (1.4826 * F.percentile("_d", F.lit(0.5))).alias("mad_std"))


def outliers(df: DataFrame, keys: list[str], axes: tuple[str, ...], sigmas: float) -> DataFrame:
    """Adds outlier. The score of an axis is 0.6745 |x - median| / MAD over the reliability; groups of fewer than
    three, or of MAD 0, have none."""
    med = df.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.percentile(a, F.lit(0.5)).alias(f"_m_{a}") for a in axes))
    x = df.join(med, keys)
    mad = x.groupBy(*keys).agg(*(F.percentile(F.abs(F.col(a) - F.col(f"_m_{a}")), F.lit(0.5)).alias(f"_mad_{a}") for a in axes))
    x = x.join(mad, keys)
    bad = F.lit(False)
    for a in axes:
        score = 0.6745 * F.abs(F.col(a) - F.col(f"_m_{a}")) / F.nullif(F.col(f"_mad_{a}"), F.lit(0.0)) / F.col("reliability")
        bad = bad | F.coalesce((F.col("_n") >= 3) & (score > sigmas), F.lit(False))
    return x.withColumn("outlier", bad).select(*df.columns, "outlier")


def refined(df: DataFrame, keys: list[str]) -> DataFrame:
    """Median and population std of the differences that are no outliers; groups without any have no row."""
    return df.filter("NOT outlier").groupBy(*keys).agg(*(F.percentile(c, F.lit(0.5)).alias(f"{c}_shift") for c in ("diff_u", "diff_v")), *(F.stddev_pop(c).alias(f"{c}_sigma") for c in ("diff_u", "diff_v")))


def with_defaults(stars: DataFrame, classes: DataFrame, default: str = "G0") -> DataFrame:
    """Stars (ra, dec, vmag, temperature, spectral_class, b_v, johnson_mag_v, johnson_mag_b, catalog) with what
    they lack, and flags of what was made up; stars without a place or a magnitude are dropped.

    A star without a temperature gets that of the default class, and the class; one without both Johnson magnitudes gets
    vmag, and vmag plus the colour of its class. In catalogue ybsc the Johnson magnitudes are vmag and vmag plus b_v.
    ``classes`` (spectral_class, class_temperature, class_b_v) has a row per class, some hundreds at most.
    """
    ybsc = F.col("catalog") == "ybsc"
    s = stars.dropna(subset=["ra", "dec", "vmag"])
    s = s.withColumn("johnson_mag_v", F.when(ybsc, F.col("vmag")).otherwise(F.col("johnson_mag_v"))).withColumn("johnson_mag_b", F.when(ybsc, F.col("vmag") + F.coalesce("b_v", F.lit(0.0))).otherwise(F.col("johnson_mag_b")))
    s = s.withColumn("temperature_faked", F.col("temperature").isNull()).withColumn("johnson_mag_faked", F.col("johnson_mag_v").isNull() | F.col("johnson_mag_b").isNull())
    s = s.withColumn("spectral_class", F.when(F.col("temperature_faked"), default).otherwise(F.col("spectral_class")))
    s = s.withColumn("_class", spectral_class(F.col("spectral_class")))
    s = s.join(F.broadcast(classes.withColumnRenamed("spectral_class", "_class")), "_class", "left")
    s = s.withColumn("temperature", F.coalesce("temperature", "class_temperature"))
    s = s.withColumn("johnson_mag_b", F.when(F.col("johnson_mag_faked"), F.col("vmag") + F.col("class_b_v")).otherwise(F.col("johnson_mag_b"))).withColumn("johnson_mag_v", F.when(F.col("johnson_mag_faked"), F.col("vmag")).otherwise(F.col("johnson_mag_v")))
    return s.drop("_class", "class_temperature", "class_b_v")


STAR_FIELDS = ("catalog_name", "unique_number", "pretty_name", "ra", "dec", "vmag", "johnson_mag_v", "johnson_mag_b", "johnson_mag_faked", "temperature", "temperature_faked", "spectral_class", "conflicts", "u", "v", "movement_v", "movement_u")


def star_lists(stars: DataFrame) -> DataFrame:
    """Per image the list of its stars as a result document holds it, in order of v and number: positions (ra_pm and
    dec_pm, in radians) in degrees, the motion from start (u1, v1) to end (u2, v2). No more stars than one image has."""
    s = stars.withColumn("ra", F.degrees("ra_pm")).withColumn("dec", F.degrees("dec_pm")).withColumn("movement_u", F.col("u2") - F.col("u1")).withColumn("movement_v", F.col("v2") - F.col("v1"))
    listed = F.array_sort(F.collect_list(F.struct(F.struct("v", "unique_number").alias("o"), F.struct(*STAR_FIELDS).alias("s"))))
    return s.groupBy("image_ord").agg(F.transform(listed, lambda x: x["s"]).alias("star_list"))


def listed_stars(documents: DataFrame) -> DataFrame:
    """One row per star of result documents (image_ord, star_list)."""
    return documents.select("image_ord", F.explode("star_list").alias("s")).select("image_ord", "s.*")


def body_conflicts(stars: DataFrame, bodies: DataFrame, margin: float = 5.0) -> DataFrame:
    """Stars (image_ord, star, v, u) with conflicts: 'BODY: name' of the first body (body_ord, body, v, u of its
    pixels) that covers a pixel within ``margin`` of the star, else empty.

    Of the bodies that cover a pixel only the first counts. Pixels lie in one cell, a star asks the cells its square touches.
    """
    size = 2 * margin + 1
    cell = lambda c: F.floor(c / size)
    ask = stars.select("image_ord", "star", F.col("v").alias("_v"), F.col("u").alias("_u"))
    for axis in ("v", "u"):
        ask = ask.withColumn(f"_c{axis}", F.explode(F.sequence(cell(F.col(f"_{axis}") - margin - 1), cell(F.col(f"_{axis}") + margin))))
    covered = bodies.groupBy("image_ord", "v", "u").agg(F.min(F.struct("body_ord", "body")).alias("_b"))
    at = covered.withColumn("_cv", cell(F.col("v"))).withColumn("_cu", cell(F.col("u")))
    near = lambda a, b: (a + 1 > b - margin) & (a < b + margin)
    hit = ask.join(at, ["image_ord", "_cv", "_cu"]).filter(near(F.col("v"), F.col("_v")) & near(F.col("u"), F.col("_u")))
    first = hit.groupBy("image_ord", "star").agg(F.min("_b").alias("_b"))
    return stars.join(first, ["image_ord", "star"], "left").withColumn("conflicts", F.when(F.col("_b").isNotNull(), F.concat(F.lit("BODY: "), F.col("_b.body"))).otherwise("")).drop("_b")


def refinement_marks(stars: DataFrame, n_v: int, n_u: int) -> DataFrame:
    """Conflicts of stars (u, v, du, dv, psf, opt_u, opt_v, conflicts) after the search for their positions:
    'REFINEMENT EDGE' if the moved star lies within its PSF size of a border, 'REFINEMENT FAILED' if nothing was found,
    and diff_u, diff_v of the others. Stars with a conflict keep it."""
    u, v = F.col("u") + F.col("du"), F.col("v") + F.col("dv")
    edge = (u < F.col("psf")) | (u > n_u - F.col("psf")) | (v < F.col("psf")) | (v > n_v - F.col("psf"))
    free = F.coalesce("conflicts", F.lit("")) == ""
    s = stars.withColumn("conflicts", F.when(~free, F.col("conflicts")).when(edge, "REFINEMENT EDGE").when(F.col("opt_u").isNull() | F.col("opt_v").isNull(), "REFINEMENT FAILED").otherwise(""))
    clear = F.col("conflicts") == ""
    return s.withColumn("diff_u", F.when(clear, F.col("opt_u") - u)).withColumn("diff_v", F.when(clear, F.col("opt_v") - v))


def twist_accepted(stars: DataFrame, n_v: int, n_u: int, *, clip: float, peak_factor: float, most: float = 1.5) -> DataFrame:
    """Measured stars (u, v, psf, opt_u, opt_v, peak, background) inside the image, not clipped, moved by at most
    ``most`` pixels either way and bright enough, with diff_u and diff_v."""
    def inside(x: str, n: int, margin) -> Column:
        return (F.col(x) >= margin) & (F.col(x) <= n - margin)

    s = stars.withColumn("diff_u", F.col("opt_u") - F.col("u")).withColumn("diff_v", F.col("opt_v") - F.col("v"))
    ok = inside("u", n_u, F.col("psf")) & inside("v", n_v, F.col("psf")) & inside("opt_u", n_u, clip) & inside("opt_v", n_v, clip)
    return s.filter(ok & (F.abs("diff_u") <= most) & (F.abs("diff_v") <= most) & (F.col("peak") >= F.col("background") * peak_factor))
