"""A training mix of sources with target weights, from DataFrame operations only.

Every source's documents are shuffled by a hash, laid end to end and cut into blocks of (within one word) equal size:
size / max(BLOCK_WORDS, size / MOST_BLOCKS) of them, so that a large source has MOST_BLOCKS blocks, whatever its size,
and meets its target within half a block. A schedule of slots is drawn from the golden-ratio sequence: the point of
slot i, taken through the cumulative numbers of wanted slots, names its source, so any stretch of the schedule holds
the sources in nearly their proportions. The n-th slot of a source takes its n-th block, over and over from the start
when the blocks run out. Points are fractions of POINTS in integers, so they stay distinct in a schedule of any length.

Running sums are taken in two steps, inside shards of about sqrt(n) rows and over the shards' sums, so that no task
has to order a whole source. The sources themselves, a row each, are ordered in one task: there may be some millions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.llm.common import WORD, landed

#: Points are numbers below 2 ** POINT_BITS; GOLDEN is the golden ratio's fraction of it.
POINT_BITS = 60
GOLDEN = 712544676207699905
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MOST_EPOCHS = 3
#: The least block, and the most blocks of a source.
BLOCK_WORDS, MOST_BLOCKS = 32, 1 << 17
#: Points are cut into 2 ** CELL_BITS cells when they are matched with sources.
CELL_BITS = 12


def _sharded(df: DataFrame, group: list[str], shard: str, order: list[Column], value: str) -> DataFrame:
    """Adds before: the sum of ``value`` over the group's rows that come earlier, and ord: the place in the shard."""
    w = W.partitionBy(*group, shard).orderBy(*order)
    df = df.withColumn("_in", F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col(value)).withColumn("ord", F.row_number().over(w))
    sums = df.groupBy(*group, shard).agg(F.sum(value).alias("_sum"))
    ws = W.partitionBy(*group).orderBy(shard).rowsBetween(W.unboundedPreceding, 0)
    sums = sums.withColumn("_before", F.sum("_sum").over(ws) - F.col("_sum")).drop("_sum")
    return df.join(sums, [*group, shard]).withColumn("before", F.col("_before") + F.col("_in")).drop("_in", "_before")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, block_words: int = BLOCK_WORDS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """One row per source (null is one): sid, weight, source_size, target, blocks, wanted (slots) and lo (slots before).

    Targets share the total of all sizes by weight; none exceeds ``most`` times its source's size, and what is cut
    off goes to the others by weight. With sources ordered by cap/weight, those before some place are at their cap
    and the others get weight times one common level.
    """
    n = len(weights)
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = F.lit(0)
    by_name = W.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("sid", (F.row_number().over(by_name) - 1).cast("long"))
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(x) for x in weights)), (F.col("sid") % n + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * most)
    by_ratio = W.partitionBy(one).orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(one)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after))
    s = s.withColumn("level", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "sid", "level"))).over(everything)["level"])
    s = s.withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.lit(0.0)))
    per_block = F.greatest(F.lit(float(block_words)), F.col("source_size") / most_blocks)
    s = s.withColumn("blocks", F.when(F.col("source_size") > 0, F.greatest(F.lit(1), F.round(F.col("source_size") / per_block)).cast("long")).otherwise(0))
    s = s.withColumn("wanted", F.when(F.col("blocks") > 0, F.round(F.col("target") * F.col("blocks") / F.nullif(F.col("source_size"), F.lit(0))).cast("long")).otherwise(0))
    return s.withColumn("lo", F.sum("wanted").over(by_name.rowsBetween(W.unboundedPreceding, 0)) - F.col("wanted")).drop("cap", "level")


def point(i: Column) -> Column:
    """i * GOLDEN modulo 2 ** POINT_BITS, in halves that don't overflow."""
    half = POINT_BITS // 2
    low = (1 << half) - 1
    lo, hi = i.bitwiseAND(F.lit(low)), F.shiftright(i, half)
    cross = (lo * F.lit(GOLDEN >> half) + hi * F.lit(GOLDEN & low)).bitwiseAND(F.lit(low))
    return (lo * F.lit(GOLDEN & low) + F.shiftleft(cross, half)).bitwiseAND(F.lit((1 << POINT_BITS) - 1))


def schedule(targets: DataFrame, slots: int, most: int = MOST_EPOCHS) -> DataFrame:
    """slot, sid, rank (among its source's slots), block and epoch; a slot beyond the last epoch is left out."""
    spark = targets.sparkSession
    points = spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("p"))
    points = points.withColumn("cell", F.shiftright("p", POINT_BITS - CELL_BITS))
    share = lambda c: F.expr(f"cast({c} AS decimal(19,0)) * cast({1 << POINT_BITS} AS decimal(19,0)) div cast({max(1, slots)} AS decimal(19,0))")
    reach = targets.filter("wanted > 0").select("sid", "blocks", share("lo").alias("lo"), share("(lo + wanted)").alias("hi"))
    reach = reach.withColumn("cell", F.explode(F.sequence(F.shiftright("lo", POINT_BITS - CELL_BITS), F.shiftright(F.col("hi") - 1, POINT_BITS - CELL_BITS))))
    s = points.join(reach, "cell").filter("p >= lo AND p < hi").select("slot", "sid", "blocks", F.lit(1).cast("long").alias("one"))
    s = s.withColumn("shard", F.floor(F.col("slot") / max(1, math.isqrt(slots))))
    s = _sharded(s, ["sid"], "shard", [F.col("slot")], "one").withColumnRenamed("before", "rank")
    s = s.filter(F.col("rank") < F.col("blocks") * most)
    return s.select("slot", "sid", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("epoch"))


def document_blocks(sized: DataFrame, targets: DataFrame, documents: int) -> DataFrame:
    """The sized rows with their source's facts, their place (shard, ord) and, one row a block they reach into, block,
    from_word, to_word (of the document). Empty documents have one row with null block."""
    x = sized.join(targets.drop("wanted", "lo"), sized.source.eqNullSafe(targets.source)).drop(targets.source)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    x = x.withColumn("key", key).withColumn("shard", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(max(1, math.isqrt(documents))) / F.lit(1 << 32)))
    x = _sharded(x, ["sid"], "shard", [F.col("key"), F.col("doc_id"), F.col("size")], "size").drop("key")
    # The first ``more`` blocks hold per + 1 words, the others per.
    blocks = F.nullif(F.col("blocks"), F.lit(0))  # of a source without words
    per, more = F.expr("source_size div nullif(blocks, 0)"), F.col("source_size") % blocks
    edge = more * (per + 1)
    q = F.floor(F.col("source_size") / blocks)

    def block_of(p: Column) -> Column:
        return F.when(p < edge, F.floor(p / (per + 1))).otherwise(more + F.floor((p - edge) / q))

    x = x.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(block_of(F.col("before")), block_of(F.col("before") + F.col("size") - 1)))))
    start = F.when(F.col("block") < more, F.col("block") * (per + 1)).otherwise(edge + (F.col("block") - more) * per)
    stop = start + per + F.when(F.col("block") < more, 1).otherwise(0)
    x = x.withColumn("from_word", F.greatest(start, F.col("before")) - F.col("before"))
    return x.withColumn("to_word", F.least(stop, F.col("before") + F.col("size")) - F.col("before"))


def sizes(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, source and size in words of every row; null texts have size 0."""
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mix_sources(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, block_words: int = BLOCK_WORDS, most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """The mix as two frames: (per document row, what the mix takes of it) and (per slot, the word ranges it takes).

    The first has doc_id, source, size, source_size, target and taken (words, repeats counted); the second slot, sid,
    epoch, block, doc_id, from_word, to_word. Null texts have size 0 and are never taken; null sources are one
    source. A very long text counts its words as any other. Repeated rows are rows of their own. Ties in the shuffle go to the smaller doc_id. An empty frame gives
    empty frames. Other columns don't matter. Nothing depends on the order of rows or on partitions.
    """
    sized = landed(sizes(docs, text, key, source), "sizes")
    targets = landed(source_targets(sized, weights, most, block_words, most_blocks), "targets")
    slots = targets.agg(F.sum("wanted")).first()[0] or 0
    parts = document_blocks(sized, targets, sized.count())
    plan = schedule(targets, slots, most)
    times = plan.groupBy("sid", "block").agg(F.count("*").alias("times"))
    words = F.coalesce((F.col("to_word") - F.col("from_word")) * F.col("times"), F.lit(0))
    taken = parts.join(times, ["sid", "block"], "left").groupBy("doc_id", "source", "sid", "shard", "ord", "size", "source_size", "target").agg(F.sum(words).alias("taken"))
    ranges = plan.join(parts, ["sid", "block"]).select("slot", "sid", "epoch", "block", "doc_id", "from_word", "to_word")
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken"), ranges
