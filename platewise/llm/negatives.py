"""Hard negatives by exact inner product, found on lists that the anchors of a cluster share.

Anchors are clustered by direction. For a cluster with centroid c and radius r (the largest angle between c and a member),
no member scores more than |a| * |x| * cos(max(0, angle(c, x) - r)) with a vector x. All vectors in the order of this bound
are the cluster's list; every member walks it until the bound of what follows is below the last score it still needs.

Spark deals a list out in segments of falling bound. The vectors of a segment meet the members that still walk, block
against block; each block is walked in the order of the bound, and the best of all blocks are put together before the
next segment begins. The ends of segments come from a sample of the vectors and decide only how much is compared:
the last segment holds the rest of the list.

Centroids, ends and radii are a few numbers for each cluster. A member is an anchor with the range of scores it seeks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.arrays import column
from platewise.llm.common import landed

POSITIVES = 5
NEGATIVES = 5
#: Percentage of its positive's score that a negative has at least.
LEAST_PERCENT = 80
SCALE = 256
#: Clusters of one vector length at most, and anchors for which there is one.
CLUSTERS = 64
ANCHORS = 64
#: Anchors and vectors on which centroids and segments rest, about.
SAMPLE = 20_000
#: Shares of a list at which segments end.
SEGMENTS = (1 / 16, 1 / 4, 1.0)
MEMBER_BLOCK = 4096
ROW_BLOCK = 8192
#: Vectors that a block compares at a time.
STEP = 512
#: Bounds are raised by so much (relative, and absolute) against rounding.
SLACK = 1e-9, 1e-6

PACKED = "id long, label {label}, q binary, d int, norm double"


def packed(vectors: DataFrame, scale: int) -> DataFrame:
    """id, label, q (32-bit components), d and norm of (id, label, v) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = column(batch, "v")
            x = np.floor(v.flatten().to_numpy(zero_copy_only=False) * float(scale))
            if len(x) and np.abs(x).max() >= 2**31:
                raise ValueError(f"components must be below {2**31} / {scale}")
            sizes = pa.compute.list_value_length(v).to_numpy()
            ends = np.cumsum(sizes)
            x32 = x.astype(np.int32)
            of = np.repeat(np.arange(len(sizes)), sizes)
            norm = np.sqrt(np.bincount(of, weights=x * x, minlength=len(sizes)))
            offsets = np.append(0, ends * 4).astype(np.int64)
            q = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(v), [None, pa.py_buffer(offsets), pa.py_buffer(x32)])
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "label"), q.cast(pa.binary()), pa.array(sizes.astype(np.int32)), pa.array(norm)], ["id", "label", "q", "d", "norm"])

    return vectors.mapInArrow(run, PACKED.format(label=vectors.schema["label"].dataType.simpleString()))


def wider(df: DataFrame, **more: str) -> str:
    """The frame's schema and more columns."""
    return ", ".join(f"{n} {t}" for n, t in [*df.dtypes, *more.items()])


def matrix(col: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """Packed vectors of one length as rows."""
    return np.frombuffer(b"".join(col.to_pylist()), np.int32).reshape(len(col), d).astype(np.float64)


def directions(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Directions of k clusters (or fewer) of the rows, by k-means on the sphere from spread starts."""
    u = directions(x)
    chosen = [0]
    near = u @ u[0]
    for _ in range(1, min(k, len(u))):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, u @ u[chosen[-1]])
    c = u[chosen]
    for _ in range(rounds):
        mine = (u @ c.T).argmax(1)
        c = directions(np.stack([u[mine == i].sum(0) if (mine == i).any() else c[i] for i in range(len(c))]))
    return c


@dataclass
class Lists:
    """The shared lists of the clusters of one vector length: centroids, radii, and bounds and shares of the segments."""

    centroid: np.ndarray
    radius: np.ndarray
    ends: np.ndarray | None = None
    shares: np.ndarray | None = None

    def angles(self, x: np.ndarray) -> np.ndarray:
        """Angles between rows and centroids; those of zero vectors are 0."""
        u = directions(x)
        a = np.arccos(np.clip(u @ self.centroid.T, -1, 1))
        a[~u.any(1)] = 0
        return a

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """For every row and cluster, the bound on its score with members of norm 1."""
        size = np.sqrt((x * x).sum(1, keepdims=True))
        return size * np.cos(np.maximum(0, self.angles(x) - self.radius))


def sampled(rows: DataFrame, n: int, sample: int) -> dict[int, np.ndarray]:
    """By length: about ``sample`` of the n vectors, picked by a hash of the id."""
    share = min(1.0, sample / max(1, n))
    t = rows.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < round(share * 1_000_000)).select("id", "q", "d").toArrow().sort_by("id")
    size = t["d"].to_numpy()
    return {int(d): matrix(t["q"].take(pa.array(np.flatnonzero(size == d))), int(d)) for d in np.unique(size)}


def clustered(anchors: DataFrame, model: dict[int, Lists]) -> DataFrame:
    """The anchors with c, the cluster of the nearest centroid, and their angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = column(batch, "d").to_numpy()
            c, angle = np.zeros(len(d), np.int32), np.zeros(len(d))
            for size in np.unique(d):
                some = np.flatnonzero(d == size)
                a = lists_of(model, int(size)).angles(matrix(column(batch, "q").take(pa.array(some)), int(size)))
                c[some], angle[some] = a.argmin(1), a.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c), pa.array(angle)], [*batch.schema.names, "c", "angle"])

    return anchors.mapInArrow(run, wider(anchors, c="int", angle="double"))


def lists_of(model: dict[int, Lists], d: int) -> Lists:
    """A length that the sample doesn't hold has one cluster around the first axis."""
    return model.get(d) or Lists(np.eye(1, d), np.full(1, np.pi))


def dealt(rows: DataFrame, model: dict[int, Lists], walking: set[tuple[int, int]], segment: int) -> DataFrame:
    """Of the vectors, a row for each cluster that still walks and has the vector in this segment: with c and bound b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = column(batch, "d").to_numpy()
            for size in np.unique(d).tolist():
                some = np.flatnonzero(d == size)
                lists = lists_of(model, size)
                b = lists.bounds(matrix(column(batch, "q").take(pa.array(some)), size))
                ends = np.full((len(lists.radius), len(SEGMENTS)), -np.inf) if lists.ends is None else lists.ends
                inside = b >= ends[:, segment]
                if segment:
                    inside &= b < ends[:, segment - 1]
                for c in range(len(lists.radius)):
                    if (size, c) in walking and inside[:, c].any():
                        r = np.flatnonzero(inside[:, c])
                        part = batch.take(pa.array(some[r]))
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(r), c, np.int32)), pa.array(b[r, c])], [*batch.schema.names, "c", "b"])

    return rows.mapInArrow(run, wider(rows, c="int", b="double"))


def walk(k: int, same: bool):
    """Over members (slot not null) and vectors of a block: the k best vectors of each member in its range of scores."""

    def run(t: pa.Table) -> pa.Table:
        is_row = t["slot"].is_null().to_numpy()
        mine, rows = t.filter(pa.array(~is_row)), t.filter(pa.array(is_row))
        names = ["anchor", "slot", "id", "score"]
        if not len(mine) or not len(rows):
            return pa.table([pa.array([], x) for x in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], names)
        d = mine["d"][0].as_py()
        rows = rows.take(pa.array(np.argsort(-rows["b"].to_numpy(), kind="stable")))
        a, x = matrix(mine["q"], d), matrix(rows["q"], d)
        top = max(np.abs(a).max(initial=0), np.abs(x).max(initial=0))
        if d * top * top >= 2**63:
            raise ValueError("inner products pass 64 bits")
        if d * top * top >= 2**53:
            a, x = a.astype(np.int64), x.astype(np.int64)
        anchor, slot, norm, lo, hi = (mine[n].to_numpy() for n in ("id", "slot", "norm", "lo", "hi"))
        lo = lo.copy()
        ids, b = rows["id"].to_numpy(), rows["b"].to_numpy()
        code = pa.concat_arrays([mine["label"].combine_chunks(), rows["label"].combine_chunks()]).dictionary_encode().indices.to_numpy()
        label_a, label_x = code[: len(mine)], code[len(mine) :]
        member, score, found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, 64
        while at < len(ids):
            bound = norm * b[at]
            on = np.flatnonzero(bound + np.abs(bound) * SLACK[0] + SLACK[1] >= lo)
            if not len(on):
                break
            s = slice(at, at + step)
            p = (a[on] @ x[s].T).astype(np.int64)
            fits = (p >= lo[on, None]) & (p <= hi[on, None]) & ((label_a[on, None] == label_x[s]) == same) & (anchor[on, None] != ids[s])
            i, j = np.nonzero(fits)
            if len(i):
                member, score, found = np.concatenate([member, on[i]]), np.concatenate([score, p[i, j]]), np.concatenate([found, ids[s][j]])
                order = np.lexsort((found, -score, member))
                member, score, found = member[order], score[order], found[order]
                rank = np.arange(len(member)) - np.searchsorted(member, member)
                last = rank == k - 1
                lo[member[last]] = score[last]
                keep = rank < k
                member, score, found = member[keep], score[keep], found[keep]
            at, step = at + step, min(2 * step, STEP)
        return pa.table([anchor[member], slot[member].astype(np.int32), found, score], names)

    return run


def search(rows: DataFrame, members: DataFrame, model: dict[int, Lists], counts: dict[int, int], k: int, same: bool, blocks: tuple[int, int]) -> DataFrame:
    """anchor, slot, id, score: of each member the k best vectors of the same or another label, ties by id, with scores from
    lo to hi. Members: id, slot, label, q, d, norm, c, lo, hi."""
    member_block, row_block = blocks
    spark = rows.sparkSession
    ends = [(d, c, [float(x) for x in e]) for d, m in model.items() for c, e in enumerate(m.ends)]
    ends = spark.createDataFrame(ends, "d int, c int, ends array<double>")
    walking = landed(members.join(F.broadcast(ends), ["d", "c"], "left"), "members")
    top = None
    for segment in range(len(SEGMENTS)):
        left = {(r["d"], r["c"]): r["n"] for r in walking.groupBy("d", "c").agg(F.count("*").alias("n")).collect()}
        if not left:
            break
        sizes = []
        for (d, c), n in left.items():
            share = float(model[d].shares[c, segment]) if d in model else 1.0
            sizes.append((d, c, -(-n // member_block), max(1, int(np.ceil(share * counts.get(d, 1) * 1.1 / row_block)))))
        sizes = F.broadcast(spark.createDataFrame(sizes, "d int, c int, mb int, rb int"))
        numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        m = walking.drop("ends").join(sizes, ["d", "c"]).withColumn("i", block("mb")).withColumn("j", F.explode(numbers("rb"))).withColumn("b", F.lit(None).cast("double"))
        x = dealt(rows, model, set(left), segment).join(sizes, ["d", "c"]).withColumn("j", block("rb")).withColumn("i", F.explode(numbers("mb")))
        x = x.withColumns({"slot": F.lit(None).cast("int"), "lo": F.lit(None).cast("long"), "hi": F.lit(None).cast("long")})
        met = m.unionByName(x).drop("mb", "rb").groupBy("d", "c", "i", "j").applyInArrow(walk(k, same), "anchor long, slot int, id long, score long")
        best = met if top is None else met.unionByName(top)
        best = best.withColumn("rank", F.expr("row_number() OVER (PARTITION BY anchor, slot ORDER BY score DESC, id)")).filter(F.col("rank") <= k).drop("rank")
        top = landed(best, "best")
        if segment + 1 < len(SEGMENTS):
            last = top.groupBy(F.col("anchor").alias("id"), "slot").agg(F.when(F.count("*") == k, F.min("score")).alias("last"))
            walking = walking.join(last, ["id", "slot"], "left").withColumn("lo", F.greatest("lo", F.coalesce("last", "lo"))).drop("last")
            # What follows has a smaller bound than the end of this segment.
            bound = F.col("norm") * F.coalesce(F.get("ends", F.lit(segment)), F.lit(float("-inf")))
            walking = landed(walking.filter(F.col("ends").isNotNull() & (bound + F.abs(bound) * SLACK[0] + SLACK[1] >= F.col("lo"))), "members")
    if top is None:
        return spark.createDataFrame([], "anchor long, slot int, id long, score long")
    return top


def hard_negatives(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST_PERCENT, scale: int = SCALE,
    anchors_: int = ANCHORS, sample: int = SAMPLE, blocks: tuple[int, int] = (MEMBER_BLOCK, ROW_BLOCK),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``every`` divides. A score is the inner product of components floor(scale * x); the
    positives of an anchor are its ``positives`` best other rows of the same label, and of each the negatives are the
    ``negatives`` best rows of another label with at least ``least`` percent of its score and no more than it; ties go by the
    smaller id. A positive below zero has none.

    Rows with a null id, label or vector or with a null or non-finite component take no part. Vectors of different length
    don't meet; empty ones score 0 with each other. Of rows that share an id, that with the smallest label and vector
    takes part. Components from 2**31 / scale on and scores past 64 bits are errors. Other columns don't matter; an empty
    frame gives no rows.
    """
    base = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = base.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    if (base.groupBy("id").count().agg(F.max("count")).first()[0] or 0) > 1:
        base = base.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*")
    rows = landed(packed(base, scale), "vectors")
    counts = {r["d"]: r["n"] for r in rows.groupBy("d").agg(F.count("*").alias("n")).collect()}
    anchors = landed(rows.filter(F.col("id") % every == 0), "anchors")
    n = anchors.count()
    known = {d: Lists(c, np.zeros(len(c))) for d, x in sampled(anchors, n, sample).items() for c in [centroids(x, min(CLUSTERS, -(-n // anchors_)))]}
    placed = landed(clustered(anchors, known), "anchors")
    for r in placed.groupBy("d", "c").agg(F.max("angle").alias("r")).collect():
        if r["d"] in known:
            known[r["d"]].radius[r["c"]] = r["r"] + 1e-9
    pool = sampled(rows, sum(counts.values()), sample)
    for d, lists in list(known.items()):
        if d not in pool:
            del known[d]
            continue
        b = lists.bounds(pool[d])
        lists.ends = np.stack([*(np.quantile(b, 1 - s, axis=0) for s in SEGMENTS[:-1]), np.full(b.shape[1], -np.inf)], 1)
        above = np.stack([(b >= e).mean(0) for e in lists.ends.T], 1)
        lists.shares = np.diff(above, prepend=0, axis=1)
    if set(known) != {r["d"] for r in placed.select("d").distinct().collect()}:  # lengths that the samples missed
        placed = placed.withColumn("c", F.when(F.col("d").isin(list(known)), F.col("c")).otherwise(0))
    seek = placed.drop("angle").withColumns({"slot": F.lit(0), "lo": F.lit(-(2**63) + 1), "hi": F.lit(2**63 - 1)})
    liked = search(rows, seek, known, counts, positives, True, blocks)
    liked = landed(liked.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.expr("row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id)").alias("slot")), "positives")
    low = F.expr(f"CAST(ceil(CAST(positive_score AS DECIMAL(20, 0)) * {least} / 100) AS BIGINT)")
    seek = placed.drop("angle").join(liked.select(F.col("anchor").alias("id"), "slot", low.alias("lo"), F.col("positive_score").alias("hi")).filter("lo <= hi"), "id")
    hard = search(rows, seek, known, counts, negatives, False, blocks)
    rank = F.expr("row_number() OVER (PARTITION BY anchor, slot ORDER BY score DESC, id)")
    hard = hard.select("anchor", "slot", rank.alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hard.join(liked, ["anchor", "slot"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
