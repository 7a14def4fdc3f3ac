"""Near-duplicate vectors by cosine, found with a forest of random-projection trees that overlap.

A tree splits at the median of a random projection; vectors within SPILL expected distances of a linked pair from the
threshold go to both sides. A node whose vectors lie too close together for a cut to shrink both sides clearly is a
leaf, compared block against block; other leaves hold about LEAF vectors. Directions and thresholds of the first levels
come from a bounded sample of the vectors; a leaf that still has more than MOST_LEAF vectors is split further, level
by level, at medians of all its vectors, so leaves don't grow with the table. Every vector is routed through every
tree, and all pairs in a leaf are compared in double precision. A pair meets in several leaves; it is counted in the
first of them (in the order of leaf numbers), which both its vectors know.

At the threshold a split separates a linked pair with probability of about 0.02, so ten trees of ten levels miss it
with probability 6e-8. Equal vectors are one class with a weight, and only the class enters the forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.llm.arrays import column
from platewise.llm.common import by_ids, components, landed, salted_join

TREES = 10
LEAF = 1024
BLOCK = 512
#: A larger leaf is split again.
MOST_LEAF = 4 * LEAF
#: A cut counts if neither side keeps more than this share of a node.
MOST_SHARE = 0.8
#: Trees are grown on about so many vectors, picked by a hash of the vector.
SAMPLE = 20_000
MOST_LEVELS = 24
#: Half the overlap of a split, in standard deviations of the projected distance of a pair at the threshold.
SPILL = 0.5
LEAST_COSINE = 0.95


@dataclass
class Tree:
    directions: np.ndarray  # levels x dimensions
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)  # its number, or -1


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def grow(sample: np.ndarray, vectors: int, first_leaf: int, spill: float, leaf: int, seed: int) -> tuple[Tree, int]:
    """A tree for about ``vectors`` vectors like the sample; its leaves are numbered from first_leaf on."""
    rng = np.random.default_rng(seed)
    d = rng.standard_normal((MOST_LEVELS, sample.shape[1]))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    tree, todo, leaves = Tree(d), [(np.arange(len(sample)), 0)], first_leaf
    projected = sample @ d.T
    k = 0
    while k < len(todo):
        idx, level = todo[k]
        k += 1
        cut = None
        if level < MOST_LEVELS and len(idx) >= 32 and len(idx) * vectors > leaf * len(sample):
            p = projected[idx, level]
            for q in (0.5, 0.35, 0.65):
                x = float(np.quantile(p, q))
                if max(np.mean(p < x + spill), np.mean(p >= x - spill)) <= MOST_SHARE:
                    cut = x
                    break
        if cut is None:
            tree.threshold.append(0.0), tree.left.append(-1), tree.right.append(-1), tree.leaf.append(leaves)
            leaves += 1
        else:
            tree.threshold.append(cut), tree.left.append(len(todo)), tree.right.append(len(todo) + 1), tree.leaf.append(-1)
            todo += [(idx[p < cut + spill], level + 1), (idx[p >= cut - spill], level + 1)]
    return tree, leaves


def route(x: np.ndarray, tree: Tree, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and leaf numbers: every leaf that each row of x goes to."""
    threshold, left, right, leaf = (np.array(a) for a in (tree.threshold, tree.left, tree.right, tree.leaf))
    row, node, out = np.arange(len(x)), np.zeros(len(x), np.int64), []
    p = x @ tree.directions.T
    for level in range(MOST_LEVELS + 1):
        end = leaf[node] >= 0
        out.append((row[end], leaf[node[end]]))
        row, node = row[~end], node[~end]
        if not len(row):
            break
        at = p[row, level]
        lo, hi = at < threshold[node] + spill, at >= threshold[node] - spill
        row, node = np.concatenate([row[lo], row[hi]]), np.concatenate([left[node[lo]], right[node[hi]]])
    return np.concatenate([r for r, _ in out]), np.concatenate([f for _, f in out])


def usable(c: str):
    """Not null or empty, no null or non-finite component, not all zero."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(c) > 0) & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def forest(classes: DataFrame, *, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, cosine: float = LEAST_COSINE) -> dict[int, tuple[list[Tree], float]]:
    """By dimension: trees grown on a sample of the classes, and the overlap."""
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    share = min(1.0, sample / max(1, sum(sizes.values())))
    picked = classes.filter(F.pmod(F.xxhash64("v"), F.lit(1_000_000_000)) < int(share * 1_000_000_000)).select("v").toArrow()
    rows: dict[int, list] = {}
    for v in picked["v"].to_pylist():
        rows.setdefault(len(v), []).append(v)
    out, leaves = {}, 0
    for d, n in sorted(sizes.items()):
        x = unit(np.array(rows[d])) if d in rows else np.zeros((0, d))
        spill = SPILL * np.sqrt(2 - 2 * cosine) / np.sqrt(d)
        grown = []
        for t in range(trees if len(x) else 1):
            tree, leaves = grow(x, n, leaves, spill, leaf, 1000 * d + t)
            grown.append(tree)
        out[d] = grown, spill
    return out


def matrix(col: pa.ChunkedArray | pa.Array, dimensions: int) -> np.ndarray:
    """Vectors of one dimension without nulls as rows."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def split_leaves(routed: DataFrame, most: int, spill: float) -> DataFrame:
    """id, w, v and leaves of routed vectors, with every leaf of more than ``most`` vectors split at the median of a
    random projection as often as both sides shrink clearly. ``spill`` is the overlap times the root of the dimension."""
    at = landed(routed.select("id", F.explode("leaves").alias("leaf")).withColumn("settled", F.lit(False)), "leaves")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, leaf = column(batch, "v"), column(batch, "leaf").to_numpy()
            size, p = np.diff(col.offsets.to_numpy()), np.zeros(batch.num_rows)
            for f in np.unique(leaf):
                rows = np.flatnonzero(leaf == f)
                d = int(size[rows[0]])
                direction = np.random.default_rng(abs(int(f))).standard_normal(d)
                p[rows] = unit(matrix(col.take(pa.array(rows)), d)) @ (direction / np.linalg.norm(direction)) * np.sqrt(d) / spill
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "leaf"), pa.array(p)], ["id", "leaf", "p"])

    for _ in range(8 * MOST_LEVELS):
        big = landed(at.filter("NOT settled").groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("leaf"), "large")
        if big.isEmpty():
            break
        mine, rest = by_ids(at, big, "leaf", "left_semi"), by_ids(at, big, "leaf", "left_anti")
        p = landed(mine.join(routed.select("id", "v"), "id").select("id", "leaf", "v").mapInArrow(project, "id long, leaf long, p double"), "projected")
        cut = p.groupBy("leaf").agg(F.percentile_approx("p", F.lit(0.5), F.lit(1000)).alias("x"))
        p = salted_join(p, cut, ["leaf"], "id").withColumn("low", F.col("p") < F.col("x") + 1).withColumn("high", F.col("p") >= F.col("x") - 1)
        share = p.groupBy("leaf").agg((F.greatest(F.count_if("low"), F.count_if("high")) > F.count("*") * MOST_SHARE).alias("stop"))
        p = salted_join(p, share, ["leaf"], "id")
        side = lambda k, yes: F.when(yes, F.xxhash64("leaf", F.lit(k)))
        to = F.when(F.col("stop"), F.array("leaf")).otherwise(F.array_compact(F.array(side(0, F.col("low")), side(1, F.col("high")))))
        at = landed(rest.unionByName(p.select("id", F.explode(to).alias("leaf"), F.col("stop").alias("settled"))), "leaves")
    else:
        raise RuntimeError("leaves did not settle")
    leaves = at.groupBy("id").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))
    return landed(routed.drop("leaves").join(leaves, "id"), "routed")


def links_in_block(cosine: float):
    """Over rows (id, w, v, leaves, leaf, side) of one pair of blocks of a leaf: per row, the weight of what it links
    with here first (n), and the row that stands for all that its links reach (b)."""

    def run(t: pa.Table) -> pa.Table:
        ids, w, side = t["id"].to_numpy(), t["w"].to_numpy(), t["side"].to_numpy()
        x = unit(matrix(t["v"], len(t["v"][0])))
        linked = x @ x.T >= cosine
        if side.min() != side.max():
            linked &= side[:, None] != side[None, :]
        np.fill_diagonal(linked, False)
        some = np.flatnonzero(linked.any(1))
        ids, w, linked = ids[some], w[some], linked[np.ix_(some, some)]
        here = t["leaf"][0].as_py()
        before = [[f for f in v if f < here] for v in t["leaves"].take(some).to_pylist()]
        number = {f: k for k, f in enumerate(sorted({f for v in before for f in v}))}
        met = np.zeros((len(some), len(number)), np.float32)
        for i, v in enumerate(before):
            met[i, [number[f] for f in v]] = 1
        first = linked & ~(met @ met.T > 0)
        label = np.arange(len(some))
        reach = linked | np.eye(len(some), dtype=bool)
        while len(some):
            new = np.where(reach, label[None, :], len(some)).min(1)
            new = new[new]
            if (new == label).all():
                break
            label = new
        return pa.table({"a": ids, "b": ids[label], "n": first @ w})

    return run


def near_vectors(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", cosine: float = LEAST_COSINE, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, sample: int = SAMPLE, most: int = MOST_LEAF) -> DataFrame:
    """id, n_links (other rows linked directly), component_id (smallest id reachable) and kept (id = component_id).

    Rows link if the cosine of their vectors is at least ``cosine``. Null, empty and zero vectors, and those with null
    or non-finite components, link with nothing, as do vectors of different length. Repeated rows are vectors of
    their own and link with each other; rows with a null id link with nothing and are kept. Other columns don't
    matter; an empty frame stays empty.
    """
    base = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    fit = usable("v") & F.col("id").isNotNull()
    good = base.filter(fit)
    classes = landed(good.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("w")), "vectors")
    model = forest(classes, trees=trees, sample=sample, leaf=leaf, cosine=cosine)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = column(batch, "v")
            size = np.diff(col.offsets.to_numpy())
            found = [(np.zeros(0, np.int64),) * 2]
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                x = unit(matrix(col.take(pa.array(rows)), int(d)))
                grown, spill = model[int(d)]
                for tree in grown:
                    r, f = route(x, tree, spill)
                    found.append((rows[r], f))
            row, leaf_ = (np.concatenate([f[k] for f in found]) for k in range(2))
            order = np.lexsort((leaf_, row))
            offsets = np.searchsorted(row[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "w"), col, pa.ListArray.from_arrays(pa.array(offsets), pa.array(leaf_[order].astype(np.int64)))], ["id", "w", "v", "leaves"])

    schema = classes.select("id", "w", "v").schema.add("leaves", T.ArrayType(T.LongType()))
    routed = landed(classes.select("id", "w", "v").mapInArrow(leaves, schema), "routed")
    large = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    if not large.isEmpty():
        routed = split_leaves(routed, most, SPILL * np.sqrt(2 - 2 * cosine))
    at = routed.withColumn("leaf", F.explode("leaves"))
    count = at.groupBy("leaf").agg(F.ceil(F.count("*") / block).alias("blocks"), F.count("*").alias("n")).filter("n > 1").drop("n")
    mine = F.pmod(F.xxhash64("id"), "blocks")
    spread = salted_join(at, count, ["leaf"], "id").withColumn("side", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("blocks", "other")
    found = landed(spread.groupBy("leaf", "i", "j").applyInArrow(links_in_block(cosine), "a long, b long, n long"), "links")
    linked = found.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    comp = components(found.select("a", "b")).withColumnRenamed("id", "cid")
    facts = classes.select("v", F.col("id").alias("cid"), "w").join(linked, "cid", "left").join(comp, "cid", "left")
    facts = facts.select("v", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "cid").alias("component_id"))
    # A vector that links with nothing learns nothing; one of a large class may be met very often.
    told = salted_join(good, facts.filter("n_links > 0"), ["v"], "id", "left")
    rows = told.unionByName(base.filter(~fit).withColumn("n_links", F.lit(None).cast("long")).withColumn("component_id", F.lit(None).cast("long")))
    rows = rows.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return rows.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
