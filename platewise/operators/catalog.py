"""Selection of images from archive index tables, and the pairing of simultaneous exposures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.functions import names as N


def entries(index: DataFrame, archives: dict[str, N.Archive] = N.ARCHIVES) -> DataFrame:
    """Index rows (instrument, volume, filespec, ...) with label, image, img_name, img_num, stub and outcome.

    outcome is ok, skip (not an image of interest) or error (malformed label, specification or name). X01: archives may be a
    choice with plug-ins.
    """
    kind, spec = F.col("instrument"), F.col("filespec")
    (label, good), (name, state) = N.label_spec(kind, spec, archives), N.image_name(kind, spec, archives)
    df = index.withColumns({"_label": label, "_good": good, "_stem": name, "_state": state})
    df = df.withColumn("_valid", N.name_valid(kind, F.col("_stem"), archives))
    df = df.withColumn("outcome", F.when(F.col("_state") != "ok", F.col("_state")).when(F.col("_good") & F.col("_valid"), "ok").otherwise("error"))
    df = df.withColumns({"label": F.when(F.col("_good"), F.col("_label")), "img_name": F.when(F.col("outcome") == "ok", F.col("_stem"))})
    df = df.withColumns({"image": N.image_spec(kind, F.col("label"), archives), "img_num": F.when(F.col("outcome") == "ok", N.image_digits(kind, F.col("_stem"), archives)), "stub": N.results_path_stub(F.col("volume"), spec)})
    return df.drop("_label", "_good", "_stem", "_state", "_valid")


def quarantine(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows and rejected ones."""
    return found.filter("outcome = 'ok'"), found.filter("outcome <> 'ok'")


def volumes(df: DataFrame, wanted: list[str] | str, known: list[str]) -> DataFrame:
    """P20: rows of the wanted volumes (a list, or text with commas); an unknown volume is an error."""
    asked = sorted(v.strip() for v in wanted.split(",")) if isinstance(wanted, str) else list(wanted)
    if unknown := [v for v in asked if v not in known]:
        raise ValueError(f"unknown volume {unknown[0]!r}")
    return df.filter(F.col("volume").isin(*asked))


def volume_range(df: DataFrame, first: str | None, last: str | None, known: list[str]) -> DataFrame:
    """Rows of volumes between two, by their place in the archive's list, both included."""
    for v in (first, last):
        if v is not None and v not in known:
            raise ValueError(f"unknown volume {v!r}")
    lo, hi = known.index(first) if first else 0, known.index(last) if last else len(known) - 1
    return df.filter(F.col("volume").isin(*known[lo : hi + 1]))


def number_range(df: DataFrame, first: int | None = None, last: int | None = None, cut: str = "filter") -> DataFrame:
    """Image numbers between two, both included.

    cut='prefix' also drops everything from the first row (by vol_ord, row_ord) whose number exceeds ``last``, later
    volumes included, as a sequential scan would; the place of that row is one combined minimum.
    """
    if cut not in ("filter", "prefix"):
        raise ValueError(f"cut is filter or prefix, not {cut!r}")
    out = df
    if last is not None and cut == "prefix":
        stop = df.agg(F.min(F.when(F.col("img_num") > last, F.struct("vol_ord", "row_ord"))).alias("_stop"))
        out = df.crossJoin(F.broadcast(stop)).filter(F.col("_stop").isNull() | (F.struct("vol_ord", "row_ord") < F.col("_stop"))).drop("_stop")
    if first is not None:
        out = out.filter(F.col("img_num") >= first)
    return out if last is None else out.filter(F.col("img_num") <= last)


def camera(df: DataFrame, which: str | None) -> DataFrame:
    """P25: narrow (nac) or wide (wac) angle camera, by the first letter of the name."""
    if which is None:
        return df
    letters = {"nac": "N", "wac": "W"}
    if which.lower() not in letters:
        raise ValueError(f"unknown camera {which!r}")
    return df.filter(F.col("img_name").startswith(letters[which.lower()]))


def archive_camera(df: DataFrame, which: str | None, archives: dict[str, N.Archive] = N.ARCHIVES) -> DataFrame:
    """The rows of a camera by the first letter that each archive gives its names; archives without that camera have
    none, and a camera that no archive has is an error."""
    if which is None:
        return df
    letters = {name: a.cameras[which.lower()] for name, a in archives.items() if which.lower() in a.cameras}
    if not letters:
        raise ValueError(f"unknown camera {which!r}")
    mine = N.by_instrument(F.col("instrument"), lambda a: F.lit(letters.get(a.profile.name)), archives)
    return df.filter(F.coalesce(F.startswith("img_name", mine), F.lit(False)))


def archive_groups(df: DataFrame, archives: dict[str, N.Archive] = N.ARCHIVES) -> DataFrame:
    """Grp and place of the rows, by the pairing of each archive that has one; other rows stand alone."""
    paired = {name: a.pair for name, a in archives.items() if a.pair}
    out = df.filter(~F.coalesce(F.col("instrument").isin(list(paired)), F.lit(False))).withColumn("grp", F.col("row_ord")).withColumn("place", F.lit(0).cast("long"))
    for name, pair in paired.items():
        out = out.unionByName(pair(df.filter(F.col("instrument") == name)))
    return out


def label_variables(df: DataFrame, archives: dict[str, N.Archive]) -> DataFrame:
    """The rows with the label variables that their archives' plug-ins add; null in the rows of the others."""
    names = sorted({v for a in archives.values() for v in a.variables})
    return df.withColumns({v: N.by_instrument(F.col("instrument"), lambda a: a.variables[v](df) if v in a.variables else F.lit(None), archives) for v in names})  # noqa: B023


def first_images(df: DataFrame, *limits: int | None) -> DataFrame:
    """The first rows in archive order, as many as the least limit; a top-k, not a sort of the archive."""
    given = [x for x in limits if x is not None]
    return df.orderBy("vol_ord", "row_ord").limit(min(given)) if given else df


def random_images(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """N images without replacement, volumes being about equally likely whatever their size.

    An image's key is log(u) / w with u from a hash of its place and the seed and w one over the rows of its volume;
    the n largest keys are taken. The counts are combined before they are shuffled.
    """
    per_volume = df.groupBy("vol_ord").agg(F.count("*").alias("_rows"))
    digest = F.md5(F.concat_ws("|", "vol_ord", "row_ord", F.lit(seed)).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    keyed = df.join(per_volume, "vol_ord").withColumn("_key", F.log(u) * F.col("_rows"))
    return keyed.orderBy(F.desc("_key"), "vol_ord", "row_ord").limit(n).drop("_key", "_rows")


def named_like(df: DataFrame, names: DataFrame) -> DataFrame:
    """Rows whose image name starts with one of the names (column name), in any case.

    Prefixes of every length that occurs are joined by equality: a row is tried once per length.
    """
    names = names.select(F.lower("name").alias("_want")).filter(F.length("_want") > 0).distinct()
    sizes = [r[0] for r in names.select(F.length("_want")).distinct().collect()]
    if not sizes:
        return df.filter(F.lit(False))
    lengths = F.array(*(F.lit(s) for s in sorted(sizes)))
    lower = F.lower("img_name")
    tried = df.withColumn("_try", F.explode(F.transform(lengths, lambda s: F.substring(lower, F.lit(1), s)))).join(names, F.col("_try") == F.col("_want"), "left_semi")
    return tried.drop("_try").dropDuplicates(["vol_ord", "row_ord"])


def with_specs(df: DataFrame, specs: DataFrame) -> DataFrame:
    """Rows whose specification is listed (column filespec); extensions don't count."""
    bare = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    wanted = specs.select(bare(F.col("filespec")).alias("_want")).distinct()
    return df.join(wanted, bare(F.col("filespec")) == F.col("_want"), "left_semi")


def extra(df: DataFrame, hook: Callable[[DataFrame], Column] | Column | None) -> DataFrame:
    """One more condition, a Column or a function that makes one."""
    return df if hook is None else df.filter(hook(df) if callable(hook) and not isinstance(hook, Column) else hook)


def pair_exposures(df: DataFrame, slop: int = 3, keep_unpaired: bool = False) -> DataFrame:
    """Simultaneous exposures. Adds grp (the row_ord that starts the group) and place (0, 1) to the rows.

    In a volume, two consecutive BOTSIM rows with numbers at most ``slop`` apart are a pair, greedily from the front,
    the narrow-angle image first if the earlier one is it; others stand alone. A link depends on two neighbours only,
    so pairs are the even and odd places of runs of links. A BOTSIM row left over whose next row is BOTSIM too is
    dropped unless keep_unpaired, as in a scan that forgets it.
    """
    by_volume = W.partitionBy("vol_ord").orderBy("row_ord")
    sim = F.col("shutter_mode_id") == "BOTSIM"
    link = sim & (F.lag("shutter_mode_id").over(by_volume) == "BOTSIM") & (F.abs(F.col("img_num") - F.lag("img_num").over(by_volume)) <= slop)
    df = df.withColumn("_new", F.when(F.coalesce(link, F.lit(False)), 0).otherwise(1)).withColumn("_next_sim", F.coalesce(F.lead("shutter_mode_id").over(by_volume) == "BOTSIM", F.lit(False)))
    df = df.withColumn("_run", F.sum("_new").over(by_volume.rowsBetween(W.unboundedPreceding, 0)))
    in_run = W.partitionBy("vol_ord", "_run").orderBy("row_ord")
    df = df.withColumn("_i", F.row_number().over(in_run) - 1).withColumn("_n", F.count("*").over(W.partitionBy("vol_ord", "_run")))
    df = df.withColumn("_single", F.col("_i") == F.col("_n") - 1).withColumn("_single", F.col("_single") & (F.col("_i") % 2 == 0))
    if not keep_unpaired:
        df = df.filter(~(F.col("_single") & sim & F.col("_next_sim")))
    df = df.withColumn("_pair", F.floor(F.col("_i") / 2))
    pair = W.partitionBy("vol_ord", "_run", "_pair").orderBy("row_ord")
    swap = ~F.first("img_name").over(pair.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).startswith("N") & ~F.col("_single")
    place = F.col("_i") % 2
    df = df.withColumn("grp", F.first("row_ord").over(pair.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).withColumn("place", F.when(swap, 1 - place).otherwise(place).cast("long"))
    return df.drop("_new", "_next_sim", "_run", "_i", "_n", "_single", "_pair")


def registry(datasets: list[tuple[str, str, str]], df: DataFrame, on: str = "dataset") -> DataFrame:
    """Class and instrument of every dataset name; unknown names keep nulls. The registry is a short list."""
    dim = df.sparkSession.createDataFrame(datasets, f"{on} string, dataset_class string, instrument string")
    return df.join(F.broadcast(dim), on, "left")
