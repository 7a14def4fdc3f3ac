"""Queries that write and read again: streams of tasks, labelled indexes, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators import planes as A
from platewise.operators import results as R
from platewise.plans.fixtures import fixture, table, with_
from platewise.plans.records import _NAV, _TASK, _nav, _tasks
from platewise.session import scratch
from platewise.sources import files as S
from platewise.streaming import tasks as Q

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _served(spark, sf_dir):
    """The tasks of all orders, each delivered one to three times, in two shipments; the stream is stopped in between and
    started again. The second shipment repeats tasks of the first."""
    at, k = scratch(spark), F.col("task_id").cast("long")
    sent = F.timestamp_seconds(F.lit(1704067200) + k % 40000)
    tasks = _tasks(spark, sf_dir).withColumn("sent", sent).withColumn("again", F.explode(F.sequence(F.lit(0), (k % 3).cast("int"))))
    for shipment in (0, 1):
        late = (k + F.col("again")) % 2 == 1
        tasks.filter(late if shipment else ~late).drop("again").write.mode("append").json(f"{at}/inbox")
        Q.serve(spark, f"{at}/inbox", f"{at}/outbox", f"{at}/checkpoint", ("coiss",), "2 days", files_at_once=4).awaitTermination()
    return f"{at}/outbox"


@query(_TASK + " SELECT coalesce(error, 'valid') AS status, CAST(count(*) AS BIGINT) AS count FROM e GROUP BY 1")
def t03_streamed_counts(spark, sf_dir):
    return Q.status_totals(spark, _served(spark, sf_dir))


@query(_TASK + " SELECT CAST(k AS VARCHAR) AS task_id, 'valid' AS status, count(*) AS n FROM e, range(2) r(i) WHERE error IS NULL AND r.i < n GROUP BY k UNION ALL SELECT CAST(k AS VARCHAR), error, 1 FROM e WHERE error IS NOT NULL")
def t01_streamed_tasks(spark, sf_dir):
    at = _served(spark, sf_dir)
    valid = spark.read.parquet(f"{at}/files").groupBy("task_id").agg(F.lit("valid").alias("status"), F.count("*").alias("n"))
    return valid.unionByName(spark.read.parquet(f"{at}/rejected").select("task_id", F.col("error").alias("status"), F.lit(1).cast("long").alias("n")))


# Volumes are nations; odd ones have another order of columns. Some lines are cut short, some hold no number.
_SHORT, _BAD = "c_custkey % 17 = 3", "c_custkey % 19 = 4"


def _index(spark, sf_dir):
    """Labels and lines of an index of all customers, written as text files."""
    at, n = scratch(spark), F.col("c_nationkey")
    column = lambda name, start, size, kind: f'  OBJECT = COLUMN\n    NAME = "{name}"\n    DATA_TYPE = {kind}\n    START_BYTE = {start}\n    BYTES = {size}\n  END_OBJECT = COLUMN\n'
    layout = lambda cs: "PDS_VERSION_ID = PDS3\nRECORD_BYTES = 64\nOBJECT = TABLE\n" + "".join(column(*c) for c in cs) + "END_OBJECT = TABLE\nEND"
    even = layout([("FILE_SPEC", 2, 20, "CHARACTER"), ("NUMBER", 24, 9, "ASCII_INTEGER"), ("LEVEL", 34, 12, "ASCII_REAL"), ("MODE", 48, 14, "CHARACTER")])
    odd = layout([("LEVEL", 1, 12, "ASCII_REAL"), ("MODE", 15, 14, "CHARACTER"), ("NUMBER", 31, 9, "ASCII_INTEGER"), ("FILE_SPEC", 42, 20, "CHARACTER")])
    label = F.concat(F.lit("V"), "c_nationkey").alias("volume")
    c = table(spark, sf_dir, "customer")
    c.select(label, F.when(n % 2 == 0, even).otherwise(odd).alias("value")).distinct().repartition("volume").write.partitionBy("volume").text(f"{at}/labels")
    spec = F.rpad(F.concat(F.lit("data/N"), "c_custkey", F.lit(".IMG")), 20, " ")
    number = F.when(F.expr(_BAD), F.lpad(F.lit("n/a"), 9, " ")).otherwise(F.lpad(F.col("c_custkey").cast("string"), 9, " "))
    level = F.lpad(F.format_string("%.2f", F.col("c_acctbal").cast("double")), 12, " ")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    mode = F.rpad("c_mktsegment", 14, " ")
    line = F.when(n % 2 == 0, F.concat_ws(",", quoted(spec), number, level, F.concat(F.lit(" "), mode))).otherwise(F.concat_ws(",", level, quoted(mode), number, quoted(spec)))
    line = F.when(F.expr(_SHORT), F.substring(line, 1, 40)).otherwise(F.rpad(line, 62, " "))
    c.select(label, line.alias("value")).repartition("volume").write.partitionBy("volume").text(f"{at}/tables")
    texts = lambda name, whole: S.volume_texts(spark, f"{at}/{name}", "*.txt", r"volume=([^/]+)", whole)
    return S.labelled_index(texts("labels", True), texts("tables", False), {"FILE_SPEC": "string", "NUMBER": "long", "LEVEL": "double"})


@query(f"SELECT concat('V', c_nationkey) AS volume, concat('data/N', c_custkey, '.IMG') AS spec, c_custkey AS number, CAST(round(c_acctbal, 2) AS DOUBLE) AS level FROM customer WHERE NOT {_SHORT} AND NOT {_BAD}")
def s01_labelled_index(spark, sf_dir):
    return _index(spark, sf_dir)[0].select("volume", F.col("FILE_SPEC").alias("spec"), F.col("NUMBER").alias("number"), F.col("LEVEL").alias("level"))


@query(f"SELECT concat('V', c_nationkey) AS volume, CASE WHEN {_SHORT} THEN 'wrong length' ELSE 'not a number: NUMBER' END AS reason, count(*) AS n FROM customer WHERE {_SHORT} OR {_BAD} GROUP BY ALL")
def s01_malformed_lines(spark, sf_dir):
    return _index(spark, sf_dir)[1].groupBy("volume", "reason").agg(F.count("*").alias("n"))


@query(_NAV + """ SELECT string_split(results_path_stub, '/')[1] AS volume, count(*) AS documents, sum(length(concat('{"image_ord":', image_ord, ',"status":"', status, '"', CASE WHEN status_exception IS NULL THEN '' ELSE concat(',"status_exception":"', status_exception, '"') END, '}'))) AS characters FROM navigation GROUP BY 1""")
def s13_written_documents(spark, sf_dir):
    at = scratch(spark)
    documents = R.result_documents(_nav(spark, sf_dir).select("results_path_stub", "image_ord", "status", "status_exception"), "set")
    R.replace_documents(documents, at)
    R.replace_documents(documents, at)  # a repeat of the run replaces what it wrote
    return R.read_documents(spark, at, "set").groupBy("volume").agg(F.count("*").alias("documents"), F.sum(F.length("document")).cast("long").alias("characters"))


_MERGED = with_("pixels") + ", near AS (SELECT image_ord, v, u, arg_min(body_ord, CAST(distance AS FLOAT) * 1000 + body_ord) AS body_ord, arg_min(value, CAST(distance AS FLOAT) * 1000 + body_ord) AS value FROM pixels WHERE valid GROUP BY ALL)"


@query(_MERGED + """ SELECT image_ord, 'BODY_ID_MAP' AS plane, '' AS units, count(*) AS n, round(sum(600.0::DOUBLE + body_ord), 3) AS total FROM near GROUP BY 1
  UNION ALL SELECT image_ord, 'RADIUS', 'km', count(*), round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)), 3) FROM near GROUP BY 1""")
def s14_written_planes(spark, sf_dir):
    at = scratch(spark)
    near = A.nearest(fixture(spark, sf_dir, "pixels").withColumn("plane", F.lit("radius")))
    A.write_planes(A.plane_table(near.select("image_ord", "plane", "v", "u", "value"), near.select("image_ord", "v", "u", (F.col("body_ord") + 600).alias("body_id")), {"radius": "km"}), at)
    t = A.read_planes(spark, at, ["body_id_map", "radius"])
    return t.groupBy("image_ord", F.col("PLANE").alias("plane"), "units").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("double")), 3).alias("total"))
