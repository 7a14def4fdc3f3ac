"""The stream of work items: validated, routed, opened to files and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from platewise.operators.results import task_error

FILE = "struct<image_file_url:string,label_file_url:string,results_path_stub:string>"
TASK = f"task_id string, nav_root string, dataset_name string, files array<{FILE}>"


def read_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Task documents as they arrive in a folder."""
    return spark.readStream.schema(TASK).json(folder)


def validated(tasks: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Adds error, the first failing check or null. Works on streams and tables alike."""
    return tasks.withColumn("error", task_error(F.col("nav_root"), F.col("dataset_name"), known, F.col("files")))


def files_of(tasks: DataFrame) -> DataFrame:
    """One row per file of a valid task."""
    return tasks.filter("error IS NULL").select("task_id", "dataset_name", F.explode("files").alias("f")).select("task_id", "dataset_name", "f.*")


def status_counts(tasks: DataFrame) -> DataFrame:
    """Tasks by outcome, for update mode."""
    return tasks.groupBy(F.coalesce("error", F.lit("valid")).alias("status")).count()


def route(tasks: DataFrame, valid: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Writes valid files and rejected tasks once each, to a folder per micro-batch that a repeat overwrites."""

    def write(batch: DataFrame, number: int) -> None:
        files_of(batch).write.mode("overwrite").parquet(f"{valid}/batch={number}")
        batch.filter("error IS NOT NULL").write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    return tasks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SENT_TASK = f"{TASK}, sent timestamp"


def read_deliveries(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """Task documents with the time they were sent, as they arrive in a folder; a task may be delivered again."""
    return spark.readStream.schema(SENT_TASK).option("maxFilesPerTrigger", files_at_once).json(folder)


def delivered_once(tasks: DataFrame, within: str) -> DataFrame:
    """The first delivery of each task. A task is remembered for ``within`` after it was sent, so the state holds the tasks
    of that time and no more; what is delivered later still counts as new, and what was sent before it is dropped as late."""
    return tasks.withWatermark("sent", within).dropDuplicatesWithinWatermark(["task_id"])


def serve(spark: SparkSession, inbox: str, outbox: str, checkpoint: str, known: tuple[str, ...], within: str, files_at_once: int = 1000) -> StreamingQuery:
    """A stream over what has arrived in the inbox: each task once, validated, to outbox/files (valid ones, a row a
    file), outbox/rejected and outbox/status (counts by outcome), a folder per micro-batch that a repeat overwrites.

    A restart with the same checkpoint goes on where the last run ended, with the tasks it remembers."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, rows in (("files", files_of(batch)), ("rejected", batch.filter("error IS NOT NULL").drop("files", "sent")), ("status", status_counts(batch))):
            rows.write.mode("overwrite").parquet(f"{outbox}/{name}/batch={number}")
        batch.unpersist()

    stream = validated(delivered_once(read_deliveries(spark, inbox, files_at_once), within), known)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_totals(spark: SparkSession, outbox: str) -> DataFrame:
    """Tasks by outcome over all micro-batches so far."""
    return spark.read.schema("status string, count long, batch long").parquet(f"{outbox}/status").groupBy("status").agg(F.sum("count").alias("count"))
