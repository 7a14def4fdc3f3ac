"""What several operators of this subpackage share: tables, the shared folder, components of a link graph."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.session import ship

#: Words are maximal runs of other characters than space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master, which has one machine
    only, takes a temporary one; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def landed(df: DataFrame, what: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again: lineage ends there, and a lost executor
    costs a read. The files belong to the job's folder and go with it."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: So many ids (about 100 MB in a task's memory) are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000


def by_ids(df: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """left_semi or left_anti join with a landed frame of ids. While the ids are few the rows of df stay where they are."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids.hint("merge"), on, how)


SALTS = 16


def salted_join(big: DataFrame, small: DataFrame, on: list[str], salt: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """inner or left join of many rows with one row per key. Rows of big that share a key, however many, are spread over
    ``salts`` tasks by a hash of their column ``salt``; small, which is small against big, is repeated as often."""
    big = big.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.join(small, [*on, "_salt"], how).drop("_salt")


def reject_names(names: list[str], *outputs: str) -> None:
    """A kept column that is named (letter case aside) as an output is an error, as two columns of that name would be."""
    clash = {x.lower() for x in names} & {x.lower() for x in outputs}
    if clash or len({x.lower() for x in names}) < len(names):
        raise ValueError(f"columns to keep clash: {sorted(clash) or names}")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, known: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): one row (id, component_id) for each id that has an edge.

    component_id is the smallest id of the component. Each round hooks every vertex to its smallest neighbour, follows
    the hooks twice and contracts the edges; sums and minima are combined before they are shuffled, so a vertex with
    very many edges is no burden. Only vertices smaller than all their neighbours are left, which are few but in a star
    around a large id; that takes one round more. Empty edges give no rows; loops count.

    ``known`` is what an earlier call returned, for other edges: only edges between its components are then followed,
    and the result is that of all edges together. Where they join nothing, ids are added and no round is run.
    """
    edges = landed(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "edges")
    labels = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("component_id", F.col("id"))
    left = edges.filter("a <> b")
    if known is not None:
        labels = known.unionByName(labels.join(known, "id", "left_anti"))
        ka, kb = known.toDF("a", "pa"), known.toDF("b", "pb")
        mapped = left.join(ka, "a", "left").join(kb, "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        left = landed(mapped.filter("a <> b").distinct(), "edges")
    hooks = []
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        hook = left.union(left.select("b", "a")).groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("p"))
        # The hooks of vertices that others hook to; one without a smaller neighbour leads nowhere else.
        up = hook.filter("p < v").join(hook.select(F.col("p").alias("v")).distinct(), "v", "left_semi").toDF("p", "q")
        for _ in range(2):
            hook = salted_join(hook, up, ["p"], "v", "left").select("v", F.coalesce("q", "p").alias("p"))
        hooks.append(landed(hook, "hooks"))
        ha, hb = hooks[-1].toDF("a", "pa"), hooks[-1].toDF("b", "pb")
        left = left.join(ha, "a").join(hb, "b").filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        left = landed(left, "edges")
    else:
        raise RuntimeError("components did not settle")
    # A hook leads to a vertex of the next round, if that one had edges left. Very many ids may share a component by then.
    for hook in hooks:
        labels = salted_join(labels, hook.toDF("component_id", "p"), ["component_id"], "id", "left").select("id", F.coalesce("p", "component_id").alias("component_id"))
    return landed(labels, "labels")
