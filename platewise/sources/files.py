"""Reading index tables, lists and result documents; writing listings, documents and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions.formats import five_decimals
from platewise.functions.names import product_id

SPEC_COLUMNS = ("Primary File Spec", "primaryfilespec")


def index_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Wanted columns of a Parquet index partitioned by dataset and volume; the rest is never read."""
    return spark.read.parquet(path).select(*columns)


def fixed_width(spark: SparkSession, path: str, fields: list[tuple[str, int, int, str]]) -> DataFrame:
    """A table of fixed columns (name, first byte from 1, width, type), to be landed as Parquet once."""
    lines = spark.read.text(path)
    return lines.select(*(F.trim(F.substring("value", at, width)).try_cast(kind).alias(name) for name, at, width, kind in fields))


#: Volume of an index file or its label, by path.
INDEX_PATH = r"([^/]+)_index\.[a-zA-Z]+$"
#: Bytes that end a line of an index.
LINE_END = 2


def volume_texts(spark: SparkSession, path: str, glob: str, volume: str = INDEX_PATH, whole: bool = False) -> DataFrame:
    """volume, value: the lines of the text files below a folder, or each file as one text, with the volume that the path
    names."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=whole)
    return texts.select(F.regexp_extract(F.col("_metadata.file_path"), volume, 1).alias("volume"), "value")


def label_layouts(labels: DataFrame) -> DataFrame:
    """Of label texts (volume, value) the layout of the table: volume, record_bytes and layout, a map from the name of a
    column to its first byte (from 1) and bytes. Of repeated names the first counts; a column without either is none."""
    of = lambda c, key: F.regexp_extract(c, rf"(?m)^\s*{key}\s*=\s*\"?([^\"\r\n]*?)\"?\s*$", 1)
    number = lambda c, key: of(c, key).try_cast("int")
    blocks = F.regexp_extract_all("value", F.lit(r"(?s)OBJECT\s*=\s*COLUMN\s(.*?)END_OBJECT"), 1)
    columns = F.transform(blocks, lambda b: F.struct(of(b, "NAME").alias("name"), number(b, "START_BYTE").alias("start"), number(b, "BYTES").alias("bytes")))
    columns = F.filter(columns, lambda c: (c["name"] != "") & c["start"].isNotNull() & c["bytes"].isNotNull())
    names = F.array_distinct(F.transform(columns, lambda c: c["name"]))
    first = F.transform(names, lambda n: F.element_at(F.filter(columns, lambda c: c["name"] == n), 1))
    layout = F.map_from_entries(F.transform(first, lambda c: F.struct(c["name"], F.struct(c["start"].alias("start"), c["bytes"].alias("bytes")))))
    return labels.select("volume", number(F.col("value"), "RECORD_BYTES").alias("record_bytes"), layout.alias("layout"))


def labelled_index(labels: DataFrame, lines: DataFrame, columns: dict[str, str], line_end: int = LINE_END) -> tuple[DataFrame, DataFrame]:
    """The wanted columns (name to type) of the index lines (volume, value) of many volumes, each cut as its own label
    (volume, value) says; and the lines that can't be read, with a reason.

    Only the bytes of wanted columns are cut out. Texts lose quotes and spaces around them, blank numbers are null. A line is
    malformed if it has no label, if the label lacks a wanted column or a length, if it isn't as long as the label says, or
    if a number isn't one. Labels are as few as volumes.
    """
    layouts = label_layouts(labels)
    data = F.encode("value", "utf-8")
    at = lambda c, part: F.col("layout")[c][part]
    raw = {c: F.trim(F.regexp_replace(F.trim(F.substr(data, at(c, "start"), at(c, "bytes")).cast("string")), '^"|"$', "")) for c in columns}
    lacking = F.array_compact(F.array(*(F.when(at(c, "start").isNull(), F.lit(c)) for c in columns)))
    length = F.when(F.col("record_bytes").isNull(), "label without a length").when(F.octet_length("value") + line_end != F.col("record_bytes"), "wrong length")
    known = F.when(F.col("layout").isNull(), "no label").when(F.size(lacking) > 0, F.concat(F.lit("label without "), F.array_join(lacking, ", "))).otherwise(length)
    cut = lines.join(F.broadcast(layouts), "volume", "left").withColumn("reason", known).select("volume", "value", "reason", *(F.when(F.col("reason").isNull(), x).alias(c) for c, x in raw.items()))
    typed = {c: F.col(c) if t == "string" else F.when(F.col(c) != "", F.col(c)).try_cast(t) for c, t in columns.items()}
    wrong = F.array_compact(F.array(*(F.when((F.col(c) != "") & typed[c].isNull(), F.lit(c)) for c, t in columns.items() if t != "string"))) if any(t != "string" for t in columns.values()) else F.array().cast("array<string>")
    cut = cut.withColumn("reason", F.coalesce("reason", F.when(F.size(wrong) > 0, F.concat(F.lit("not a number: "), F.array_join(wrong, ", ")))))
    return cut.filter("reason IS NULL").select("volume", *(typed[c].alias(c) for c in columns)), cut.filter("reason IS NOT NULL").select("volume", "value", "reason")


def spec_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """File specifications of CSV files, from the first column with a known heading; none is an error."""
    out = None
    for p in paths:
        df = spark.read.csv(p, header=True)
        known = [c for c in df.columns if c in SPEC_COLUMNS]
        if not known:
            raise ValueError(f"{p}: no column {' or '.join(SPEC_COLUMNS)}")
        one = df.select(F.col(f"`{known[0]}`").alias("filespec"))
        out = one if out is None else out.unionByName(one)
    return out


def name_list(spark: SparkSession, path: str, valid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Names of a text file, one a line up to the first space, without blank lines and those with #; and lines whose name
    is not valid (a condition on the column name), with their file."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    names = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("name", F.element_at(F.split("line", " "), 1))
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    return names.filter(ok).select("name"), names.filter(~ok).select("file", "line")


def documents(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """One JSON document a file, from all folders below; and the files that can't be read, for a look."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    sound = F.try_parse_json("value").isNotNull()
    return texts.filter(sound).select(F.from_json("value", schema).alias("d"), "file").select("d.*", "file"), texts.filter(~sound).select("file", "value")


def files_below(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Path and length of the files below a folder; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")


def file_facts(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Path, length, MD5 and number of lines of the files below a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return df.select("path", "length", F.md5("content").alias("md5"), (F.size(F.split(F.decode("content", "utf-8"), "\n"))).alias("lines"))


def collection(images: DataFrame, bundle: str, kind: str) -> DataFrame:
    """Member listing of a collection, by image name."""
    return images.select(F.lit("P").alias("Member Status"), product_id(F.col("img_name"), bundle, kind, "1.0").alias("LIDVID_LID"), "img_name").orderBy("img_name").drop("img_name")


def global_index(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Index rows with numbers as text of five decimals, empty for null."""
    return rows.select(*keys, *(five_decimals(F.col(c)).alias(c) for c in rows.columns if c not in keys))


def supplemental(navigation: DataFrame, backplanes: DataFrame, key: str = "results_path_stub") -> DataFrame:
    """One JSON text {navigation, backplanes} per image that has both."""
    whole = lambda df, name: df.select(key, F.struct(*(c for c in df.columns if c != key)).alias(name))
    both = whole(navigation, "navigation").join(whole(backplanes, "backplanes"), key)
    return both.select(key, F.to_json(F.struct("navigation", "backplanes")).alias("document"))


def tasks(groups: DataFrame, dataset: str) -> DataFrame:
    """One task per image group (grp, img_name, label, image, stub): its id, the files and their number."""
    files = F.sort_array(F.collect_list(F.struct("place", F.col("image").alias("image_file_url"), F.col("label").alias("label_file_url"), F.col("stub").alias("results_path_stub"), "img_name")))
    g = groups.groupBy("vol_ord", "grp").agg(files.alias("files"))
    return g.select(F.concat_ws("-", F.lit(dataset), F.element_at("files", 1)["img_name"], "grp").alias("task_id"), F.lit(dataset).alias("dataset_name"), F.transform("files", lambda f: f.dropFields("place")).alias("files"))
