"""op10: language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import table
from platewise.llm.language import Model, identify, train

FOLDS = 5


def fold(c: str = "doc_id"):
    """Fold of a row; a row without an id is not held out."""
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % FOLDS, F.lit(1))


def fitted(docs: DataFrame) -> Model:
    return train(docs.filter(fold() != 0))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fitted(docs)).select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
