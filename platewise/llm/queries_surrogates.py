"""op6: private data of all documents replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import table
from platewise.llm.surrogates import replace_private


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_private(docs).select("doc_id", "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))


QUERIES = {"op6_surrogates": op6_surrogates}
ORACLES: dict[str, str] = {}
