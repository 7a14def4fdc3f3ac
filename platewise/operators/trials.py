"""Parameter sweeps: grids of tasks, twist errors and their summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.functions.formats import offset_text
from platewise.session import landed


def task_grid(spark: SparkSession, template: str | DataFrame, u: tuple[float, float, float], v: tuple[float, float, float]) -> DataFrame:
    """Tasks of a sweep over u and v (least, most, stride) for a template or a column of templates, with the id
    and JSON of each. The grid is a list of numbers and goes to every template."""
    def axis(name: str, least: float, most: float, stride: float) -> DataFrame:
        n = int((most - least) / stride + 1e-9) + 1
        return spark.range(n).select((F.lit(least) + F.col("id") * F.lit(stride)).alias(name))

    g = axis("u", *u).crossJoin(F.broadcast(axis("v", *v)))
    g = g.withColumn("template", F.lit(template)) if isinstance(template, str) else template.select("template").crossJoin(F.broadcast(g))
    g = g.withColumn("task_id", F.concat_ws("_", "template", offset_text(F.col("u")), offset_text(F.col("v"))))
    return g.withColumn("task", F.to_json(F.struct("task_id", F.struct("template", "u", "v").alias("data"))))


def percentile_clipped(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Rows whose value is at most the q-quantile of their group."""
    limit = df.groupBy(*keys).agg(F.percentile(value, F.lit(q)).alias("_limit"))
    return df.join(limit, keys).filter(F.col(value) <= F.col("_limit")).drop("_limit")


def twist_error(df: DataFrame, keys: list[str]) -> DataFrame:
    """Root of the sum of (magnitude times turned angle) squared over n; angles are wrapped."""
    turned = F.atan2(F.sin("diff_angle"), F.cos("diff_angle"))
    return df.groupBy(*keys).agg((F.sqrt(F.sum(F.pow(F.col("magnitude") * turned, 2))) / F.count("*")).alias("error"))


def narrowed(errors: DataFrame, keys: list[str], step: float) -> DataFrame:
    """Per group the trial of least error (the smaller trial on a tie; nulls aside) and the next range, two steps
    to either side."""
    best = errors.filter("error IS NOT NULL").groupBy(*keys).agg(F.min_by("twist", F.struct("error", "twist")).alias("twist"), F.min("error").alias("error"))
    return best.withColumn("low", F.col("twist") - 2 * step).withColumn("high", F.col("twist") + 2 * step)


def converged(ranges: DataFrame, measure: Callable[[DataFrame], DataFrame], keys: list[str], divisions: int, precision: float, passes: int = 10) -> DataFrame:
    """Keys, twist, error and passes: the trial of least error in ever narrower ranges (keys, low, high).

    Each pass tries ``divisions`` steps of every range that isn't settled, all at once; ``measure`` gives the error of each
    trial (keys, twist), null where there is none. The next range reaches two steps to either side of the best trial (of
    equal ones, to nine decimals, the smallest). A range settles with a step of ``precision`` or less, or with the last
    pass; one without any error is dropped. The state is a row a range, landed after each pass.
    """
    left, settled = ranges.select(*keys, "low", "high"), None
    for k in range(1, passes + 1):
        step = (F.col("high") - F.col("low")) / divisions
        grid = left.withColumn("step", step).withColumn("twist", F.explode(F.transform(F.sequence(F.lit(0), F.lit(divisions)), lambda i: F.col("low") + i * F.col("step"))))
        # The grid is many times the table that it comes from, whose size Spark goes by: it is never broadcast.
        errors = measure(grid.select(*keys, "twist", "step").hint("merge")).filter("error IS NOT NULL").withColumn("error", F.round("error", 9))
        best = errors.groupBy(*keys).agg(F.min_by(F.struct("twist", "error", "step"), F.struct("error", "twist")).alias("b")).select(*keys, "b.*")
        best = landed(best.withColumn("passes", F.lit(k)).withColumn("done", (F.col("step") <= precision) | F.lit(k == passes)))
        done = best.filter("done").select(*keys, "twist", "error", "passes")
        settled = done if settled is None else settled.unionByName(done)
        left = best.filter("NOT done").select(*keys, (F.col("twist") - 2 * F.col("step")).alias("low"), (F.col("twist") + 2 * F.col("step")).alias("high"))
        if k < passes and left.isEmpty():
            break
    return settled


def corpus_summary(df: DataFrame, corner: float) -> DataFrame:
    """Mean, std (population), median, least and largest twist, and the same of sin(twist) times the corner distance.

    The median is exact and weighs every value with its count, so that what one task orders are the counts of ranges of
    values: 4,096 of them between the extremes, and the values of the two ranges that hold the middle.
    """
    out, medians = [], None
    for name, x in (("twist", F.col("twist")), ("rotation", F.sin("twist") * corner)):
        out += [f(x).alias(f"{name}_{n}") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
        m = exact_median(df.select(x.alias("x")), "x").select(F.col("median").alias(f"{name}_median"))
        medians = m if medians is None else medians.crossJoin(m)
    found = df.agg(*out).crossJoin(medians)
    return found.select(*(f"{name}_{n}" for name in ("twist", "rotation") for n in ("mean", "std", "median", "min", "max")))


def exact_median(df: DataFrame, value: str, cells: int = 4096) -> DataFrame:
    """One row with the median of a column over the whole table, nulls aside, by counts in equal cells between its
    extremes and then by the counted values of the cells that hold the middle; null for an empty column."""
    x = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    at = x.crossJoin(F.broadcast(ends)).withColumn("cell", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(cells - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells))).otherwise(0))
    upto = W.orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    counted = at.groupBy("cell", "n").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(upto) - F.col("c"))
    middle = counted.filter((F.col("before") <= high) & (F.col("before") + F.col("c") > low)).select("cell", "before")
    values = at.join(F.broadcast(middle), "cell").groupBy("cell", "before", "n", "x").agg(F.count("*").alias("c"))
    inside = W.partitionBy("cell").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    values = values.withColumn("upto", F.col("before") + F.sum("c").over(inside)).withColumn("from", F.col("upto") - F.col("c"))
    pick = lambda k: F.max(F.when((F.col("from") <= k) & (F.col("upto") > k), F.col("x")))
    return values.agg(((pick(low) + pick(high)) / 2).alias("median"))


def median_adjusted(first: DataFrame, second: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Per trial the offset (dv, du) less the median differences (diff_v, diff_u) of its first measurement, and mean
    differences of the second one, which was taken at that offset; trials with fewer than ``least`` stars in either are
    dropped. Both are rows per star; offsets stand in the first."""
    med = first.groupBy(*keys).agg(F.count("*").alias("n_first"), F.first("dv").alias("dv"), F.first("du").alias("du"), *(F.percentile(c, F.lit(0.5)).alias(f"_{c}") for c in ("diff_v", "diff_u")))
    med = med.filter(F.col("n_first") >= least).select(*keys, "n_first", (F.col("dv") - F.col("_diff_v")).alias("dv"), (F.col("du") - F.col("_diff_u")).alias("du"))
    again = second.groupBy(*keys).agg(F.count("*").alias("n_second"), F.avg("diff_v").alias("mean_v"), F.avg("diff_u").alias("mean_u")).filter(F.col("n_second") >= least)
    return med.join(again, keys)
