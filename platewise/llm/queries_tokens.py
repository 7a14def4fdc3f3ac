"""op9: tokens of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platewise.llm.common import table
from platewise.llm.tokens import VOCABULARY, count_tokens, load_vocabulary


def op9_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), load_vocabulary(vocabulary))


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES: dict[str, str] = {}
