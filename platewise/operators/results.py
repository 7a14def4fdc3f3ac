"""Result documents: classification, validation, joins and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Messages of a missing ephemeris.
MISSING = ("SPICE(CKINSUFFDATA)", "SPICE(SPKINSUFFDATA)", "SPICE(NOFRAMECONNECT)")


def error_class(message: Column) -> Column:
    """missing_spice_data or image_read_error; null without a message."""
    missing = F.lit(False)
    for m in MISSING:
        missing = missing | message.contains(m)
    return F.when(message.isNull(), None).when(missing, "missing_spice_data").otherwise("image_read_error")


def successful(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that go on, and those that don't (a null status is no success)."""
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    return docs.filter(ok), docs.filter(~ok)


def offsets(docs: DataFrame, column: str = "offset_json") -> DataFrame:
    """Adds dv, du and offset_outcome (ok, null, wrong_type, wrong_length) from a JSON text."""
    raw = F.from_json(F.col(column), T.ArrayType(T.StringType()))
    dv, du = (F.get(raw, F.lit(i)).try_cast("double") for i in (0, 1))
    state = F.when(F.col(column).isNull(), "null").when(raw.isNull(), "wrong_type").when(F.size(raw) != 2, "wrong_length").when(dv.isNull() | du.isNull(), "wrong_type").otherwise("ok")
    return docs.withColumn("offset_outcome", state).withColumn("dv", F.when(state == "ok", dv)).withColumn("du", F.when(state == "ok", du))


def offsets_or_zero(docs: DataFrame) -> DataFrame:
    """Null offsets count as (0, 0), with a warning flag."""
    return docs.withColumn("defaulted", F.col("dv").isNull()).withColumn("dv", F.coalesce("dv", F.lit(0.0))).withColumn("du", F.coalesce("du", F.lit(0.0)))


def in_box(df: DataFrame, u: tuple[float | None, float | None] = (None, None), v: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """Inclusive bounds, each optional."""
    for name, (lo, hi) in (("u_offset", u), ("v_offset", v)):
        if lo is not None:
            df = df.filter(F.col(name) >= lo)
        if hi is not None:
            df = df.filter(F.col(name) <= hi)
    return df


def matching(df: DataFrame, column: str, globs: list[str]) -> DataFrame:
    """Names that match any of the globs, in any case."""
    def regex(g: str) -> str:
        return "^" + "".join(".*" if c == "*" else "." if c == "?" else f"\\{c}" if not c.isalnum() and c != "_" else c for c in g.lower()) + "$"

    found = F.lit(False)
    for g in globs:
        found = found | F.lower(F.col(column)).rlike(regex(g))
    return df.filter(found)


def with_results(selection: DataFrame, results: DataFrame, key: str = "results_path_stub") -> tuple[DataFrame, DataFrame]:
    """The selection joined with its results, and what of it has none."""
    return selection.join(results, key), selection.join(results.select(key), key, "left_anti")


def run_summary(docs: DataFrame) -> DataFrame:
    """Images by status."""
    return docs.groupBy("status").agg(F.count("*").alias("images"))


def final_result(techniques: DataFrame) -> DataFrame:
    """Per image the technique of highest confidence, the first in order on a tie; a manual one wins always."""
    best = F.max_by(F.struct("technique", "dv", "du", "confidence"), F.struct("is_manual", "confidence", (-F.col("technique_ord")).alias("o")))
    return techniques.groupBy("image_ord").agg(best.alias("b")).select("image_ord", "b.*")


def result_documents(results: DataFrame, dataset: str, key: str = "results_path_stub") -> DataFrame:
    """One JSON document per image, failures too: dataset, volume (the first step of the path stub), stub, document.
    Fields without a value are left out of the document."""
    fields = [c for c in results.columns if c != key]
    return results.select(F.lit(dataset).alias("dataset"), F.substring_index(key, "/", 1).alias("volume"), F.col(key), F.to_json(F.struct(*fields)).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """Result documents as Parquet, a folder per dataset and volume."""
    documents.repartition("dataset", "volume").sortWithinPartitions("results_path_stub").write.mode("overwrite").partitionBy("dataset", "volume").parquet(path)


def read_documents(spark: SparkSession, path: str, dataset: str | None = None, volumes: list[str] | None = None) -> DataFrame:
    """Written documents, of one dataset and some volumes only if these are given; other folders aren't read."""
    df = spark.read.schema("results_path_stub string, document string, dataset string, volume string").parquet(path)
    df = df if dataset is None else df.filter(F.col("dataset") == dataset)
    return df if volumes is None else df.filter(F.col("volume").isin(volumes))


def replace_documents(documents: DataFrame, path: str) -> None:
    """As write_documents, but only the volumes at hand are replaced, each as a whole; others stay. A run that failed is
    repeated with no trace of what it wrote."""
    documents.repartition("dataset", "volume").sortWithinPartitions("results_path_stub").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "volume").parquet(path)


TWIST_COLUMNS = ("url", "img_name", "twist", "rotation_error", "int_offset_x", "int_offset_y", "opt_offset_x", "opt_offset_y", "error")


def twist_rows(results: DataFrame) -> DataFrame:
    """Rows of the results table of a twist search as texts, eight wide with three decimals for offsets and five for
    the rest; images without a result (null twist) are left out."""
    wide = lambda c, form: F.format_string(form, c).alias(c)
    name = F.substring_index(F.substring_index("url", "/", -1), ".", 1).alias("img_name")
    return results.filter(F.col("twist").isNotNull()).select("url", name, wide("twist", "%8.5f"), wide("rotation_error", "%9.5f"), *(wide(c, "%8.3f") for c in TWIST_COLUMNS[4:8]), wide("error", "%9.5f"))


def last_result(results: DataFrame) -> DataFrame:
    """Per template and cell the result that comes last by its path."""
    return results.groupBy("template", "u", "v").agg(F.max_by(F.struct("results_path_stub", "dv", "du"), "results_path_stub").alias("r")).select("template", "u", "v", "r.*")


def error_grid(results: DataFrame) -> DataFrame:
    """Found minus original at every cell of all u and v of a template; null where nothing was found."""
    # The axes of a template are short lists, gathered in one pass over the results.
    axes = results.groupBy("template").agg(F.collect_set("u").alias("us"), F.collect_set("v").alias("vs"))
    axes = axes.select("template", F.explode("us").alias("u"), "vs").select("template", "u", F.explode("vs").alias("v"))
    return axes.join(results, ["template", "u", "v"], "left").select("template", "u", "v", (F.col("du") - F.col("u")).alias("error_u"), (F.col("dv") - F.col("v")).alias("error_v"))


# Error codes of tasks. P31: the first check that fails names the error.
TASK_CHECKS = ("no_nav_root", "no_dataset_name", "unknown_dataset", "no_files", "no_image_file_url", "no_label_file_url", "no_results_path_stub")


def task_error(nav_root: Column, dataset: Column, known: tuple[str, ...], files: Column) -> Column:
    """Error code of a task, or null. files is an array of structs."""
    def lacks(field: str) -> Column:
        return F.exists(files, lambda f: f[field].isNull())

    tests = (nav_root.isNull(), dataset.isNull(), ~F.lower(dataset).isin(*known), files.isNull() | (F.size(files) == 0), lacks("image_file_url"), lacks("label_file_url"), lacks("results_path_stub"))
    out = F.lit(None).cast("string")
    for code, failed in reversed(list(zip(TASK_CHECKS, tests))):
        out = F.when(F.coalesce(failed, F.lit(False)), code).otherwise(out)
    return out


def one_image(files: Column) -> Column:
    """P32."""
    return F.coalesce(F.size(files) == 1, F.lit(False))
