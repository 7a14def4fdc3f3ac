"""op4: repeated byte strings removed from all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platewise.llm.common import table
from platewise.llm.substrings import remove_repeats


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id").drop("kept")


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES: dict[str, str] = {}
