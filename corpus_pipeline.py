"""The corpus pipeline: five stages, each over what the one before kept.

Stages take any table with columns doc_id, text, source and lang, and more; all but the last return the columns they
got. Columns are renamed while an operator works, so none can clash with what the operator adds. Null texts have no
letters and go with the first stage; repeated rows get equal results, so rows that share an id and a text all stay or all
go; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import by_ids, landed, table
from platewise.llm.decontaminate import decontaminate
from platewise.llm.language import UNKNOWN, identify
from platewise.llm.minhash import near_duplicates
from platewise.llm.mixture import mix_sources
from platewise.llm.queries_language import fitted
from platewise.llm.surrogates import replace_private

#: A document stays if one language holds at least this share of its letters.
LEAST_SHARE = 0.5


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with columns _0, _1, ... and which is which."""
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _restored(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*(F.col(new).alias(old) for old, new in names.items()))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those in which no language holds LEAST_SHARE of the letters.

    The model is learned from the labelled documents of the corpus (null labels and texts aside).
    """
    model = fitted(table(spark, sf_dir, "documents"))
    plain, names = _plain(docs)
    found = identify(plain, model, text=names["text"], keep=tuple(names.values()))
    return _restored(found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE)), names)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of near-duplicates (five words, similarity 0.8)."""
    found = near_duplicates(docs.select("doc_id", "text"), words=5, least=80)
    gone = landed(found.filter("NOT kept").select(F.col("id").alias("_gone")).distinct(), "gone")
    plain, names = _plain(docs)
    plain = plain.withColumn("_gone", F.col(names["doc_id"]).cast("long"))
    return _restored(by_ids(plain, gone, "_gone", "left_anti"), names)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or the whole of a shorter one."""
    plain, names = _plain(docs)
    found = decontaminate(plain, table(spark, sf_dir, "benchmark"), text=names["text"], keep=tuple(names.values()))
    return _restored(found.filter("n_hit = 0"), names)


def private_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces private data in the texts; n_chars, if there is one, is counted anew."""
    plain, names = _plain(docs)
    out = replace_private(plain, text=names["text"], key_column=names["doc_id"])
    if "n_chars" in names:
        changed = F.when(F.col("n_entities") > 0, F.length(names["text"])).otherwise(F.col(names["n_chars"]))
        out = out.withColumn(names["n_chars"], changed.cast(docs.schema["n_chars"].dataType))
    return _restored(out, names)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents of which words are taken, with how many (taken, repeats counted) as one more column.

    taken replaces a column of that name. Rows that share an id count together.
    """
    docs = docs.drop("taken")
    taken = mix_sources(docs)[0].groupBy(F.col("doc_id").alias("_id")).agg(F.sum("taken").alias("_taken")).filter("_taken > 0")
    plain, names = _plain(docs)
    out = plain.join(taken, plain[names["doc_id"]].eqNullSafe(taken["_id"]))
    return _restored(out, names | {"taken": "_taken"})


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("private_data", private_data_stage),
    ("mixture", mixture_stage),
]

#: No SQL engine computes the language stage or the surrogates; tests/llm compares run() with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = landed(docs, f"stage-{name}")
    return docs
