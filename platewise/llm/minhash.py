"""Near-duplicate documents by Jaccard similarity of word shingles, found with a MinHash LSH forest.

Every document has TREES * DEPTH minhashes. Tree t sorts the documents by the signature rotated by t * DEPTH; the
neighbours in that order that share a prefix of DEPTH values or more form a region. A region of up to BLOCK documents
is compared in whole. A larger one is cut where neighbours share the fewest values: the depth grows, region by region,
until a part has BLOCK documents at most. All documents of a part are compared on their full shingle sets, so the
longest common prefixes are compared first.

The cuts only order the work: of every region that was cut, whatever the parts didn't join is then compared in whole,
the members outside the region's largest component with all members, block against block. So all pairs that share a
prefix of DEPTH values in any order are compared or in one component already, however large their region is.

Documents with equal sets are one class and only its smallest id enters the forest, so copies cost nothing. A pair
with similarity s is missed by all trees with probability (1 - s**DEPTH)**TREES: 3e-5 at 0.8, 4e-7 at 0.85. Shingles
are told apart by 64-bit hashes, sets by their size and 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.llm.arrays import U64, Chunk, chunks, column, lower_table, mix, nonspace_table, runs, string_hashes
from platewise.llm.common import by_ids, components, landed, salted_join

TREES, DEPTH = 20, 4
#: So many values beyond the first DEPTH order a region.
ORDER = 12
#: Trees (first, end) whose open regions are compared in whole at a time.
OPEN_ROUNDS = ((0, 1), (1, 4), (4, TREES))
#: Documents, and shingles of all of them, that are compared at a time (two documents at least).
BLOCK, BLOCK_SHINGLES = 256, 4_000_000
#: Columns of the incidence matrix that are multiplied at a time.
WIDTH = 8192


def shingles(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct shingles of k words, in order; a text of fewer words is one shingle."""
    low = lower_table()[c.data]
    start, end, row = runs(nonspace_table()[low], c.starts, c.ends)
    w = string_hashes(low, start, end)
    count = np.bincount(row, minlength=c.rows)
    size = np.minimum(count, k)[row] if len(row) else row
    last = np.cumsum(count)[row] if len(row) else row
    head = np.flatnonzero(np.arange(len(w)) + size <= last)
    size, h = size[head], mix(w[head] + U64(1))
    for j in range(1, k):
        more = np.flatnonzero(size > j)
        h[more] = mix(h[more] * U64(0x9FB21C651E98DF25) + w[head[more] + j])
    row = row[head]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)


def per_row(h: np.ndarray, row: np.ndarray, rows: int, f: np.ufunc) -> np.ndarray:
    out = np.zeros(rows, U64)
    if len(h):
        head = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[head]] = f.reduceat(h, head)
    return out


def signatures(docs: DataFrame, *, text: str, key: str, k: int) -> DataFrame:
    """id, n (distinct shingles), fp1 and fp2 (of the set) and sig (minhashes) of every row."""
    size = TREES * DEPTH
    a = multipliers(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(column(batch, "text")):
                row, h = shingles(c, k)
                n = np.bincount(row, minlength=c.rows)
                sig = np.stack([per_row(h * m, row, c.rows, np.minimum) >> U64(32) for m in a], 1).astype(np.uint32).view(np.int32)
                offsets = pa.array(np.arange(c.rows + 1, dtype=np.int32) * size)
                prints = (per_row(mix(h + U64(s)), row, c.rows, np.add).view(np.int64) for s in (11, 12))
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "id").slice(c.lo, c.rows), pa.array(n), *(pa.array(x) for x in prints), pa.ListArray.from_arrays(offsets, pa.array(sig.ravel()))],
                    ["id", "n", "fp1", "fp2", "sig"],
                )

    schema = T.StructType().add("id", "long").add("n", "long").add("fp1", "long").add("fp2", "long").add("sig", T.ArrayType(T.IntegerType()))
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """id, fp1, fp2 and the shingle hashes of (id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(column(batch, "text")):
                row, h = shingles(c, k)
                cut = np.searchsorted(row, np.arange(c.rows + 1))
                prints = (per_row(mix(h + U64(s)), row, c.rows, np.add).view(np.int64) for s in (11, 12))
                sets = pa.array([h[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([column(batch, "id").slice(c.lo, c.rows), *(pa.array(x) for x in prints), sets], ["id", "fp1", "fp2", "members"])

    return docs.mapInArrow(run, "id long, fp1 long, fp2 long, members binary")


def rotated(tree: Column, first: int, end: int) -> list[Column]:
    """Values first..end-1 of the signature as tree ``tree`` reads it."""
    return [F.element_at("sig", (tree * DEPTH + d) % (TREES * DEPTH) + 1) for d in range(first, end)]


def regions(reps: DataFrame) -> DataFrame:
    """tree, label, id, n (shingles), members (of the region) and key (what orders it) of all regions of two or more
    of the reps (id, n, sig)."""
    trees = F.explode(F.array(*(F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), *rotated(F.lit(t), 0, DEPTH)).alias("label")) for t in range(TREES))))
    members = reps.select("id", trees.alias("x")).select("id", "x.tree", "x.label")
    sized = members.groupBy("tree", "label").agg(F.count("*").alias("members")).filter("members > 1")
    found = salted_join(members, sized, ["tree", "label"], "id").join(reps, "id")
    return found.select("tree", "label", "id", "n", "members", F.array(*rotated(F.col("tree"), DEPTH, DEPTH + ORDER)).alias("key"))


def cut_regions(found: DataFrame, block: int, shingles_: int) -> DataFrame:
    """tree, label, part, id and whole (the part is the region) of the regions' members, but for those alone in their
    part. Rows are sorted across partitions, and each batch of the order is cut for itself, so no region is in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, label, ids, size, members = (column(batch, x).to_numpy() for x in ("tree", "label", "id", "n", "members"))
            key = column(batch, "key").flatten().to_numpy().reshape(len(ids), ORDER)
            same = np.cumprod(key[1:] == key[:-1], axis=1).sum(1) + DEPTH
            common = np.zeros(len(ids), np.int64)  # values shared with the row before
            common[1:] = np.where((tree[1:] == tree[:-1]) & (label[1:] == label[:-1]), same, 0)
            part, whole, open_ = np.full(len(ids), -1, np.int64), np.zeros(len(ids), bool), np.ones(len(ids), bool)
            for depth in range(DEPTH, DEPTH + ORDER + 2):
                if depth <= DEPTH + ORDER:
                    run_ = np.cumsum(common < depth) - 1
                else:  # equal in all: by number and by shingles
                    place = np.arange(len(ids)) - np.maximum.accumulate(np.where(common < depth - 1, np.arange(len(ids)), 0))
                    held = np.cumsum(size)
                    run_ = np.unique(np.stack([np.cumsum(common < depth - 1), place // block, held // shingles_]), axis=1, return_inverse=True)[1].ravel()
                rows, weight = np.bincount(run_), np.bincount(run_, weights=size)
                fits = open_ & ((rows <= block) & ((weight <= shingles_) | (rows <= 2)))[run_] if depth <= DEPTH + ORDER else open_
                part[fits] = run_[fits] * 64 + depth
                if depth == DEPTH:
                    whole = fits & (rows[run_] == members)
                open_ &= ~fits
                if not open_.any():
                    break
            _, which, rows = np.unique(part, return_inverse=True, return_counts=True)
            keep = np.flatnonzero(rows[which] > 1)
            first = np.full(len(rows), len(ids))
            np.minimum.at(first, which, np.arange(len(ids)))
            name = ids[first[which]]  # with the depth, a part is known by its first member
            yield pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in (tree, label)), pa.array(name[keep]), pa.array((part % 64)[keep]), pa.array(ids[keep]), pa.array(whole[keep])], ["tree", "label", "part", "depth", "id", "whole"])

    order = ["tree", "label", "key", "id"]
    return found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "tree int, label long, part long, depth long, id long, whole boolean")


def one_of_each(member: DataFrame) -> DataFrame:
    """Trees often give the same part again: one of each set of members is enough."""
    at = ["tree", "label", "part", "depth"]
    same = member.groupBy(*at).agg(F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("y"), F.count("*").alias("rows"))
    one = same.groupBy("x", "y", "rows").agg(F.min(F.struct(*at)).alias("r")).select("r.*")
    return member.join(one, at).select("id", "tree", "label", F.col("part").alias("i"), F.col("depth").alias("j"), F.lit(0).cast("long").alias("side"))


def open_block_pairs(uncut: DataFrame, comp: DataFrame, block: int, shingles_: int) -> DataFrame:
    """id, tree, label, i, j and side: of regions (tree, label, id, n) that the components (id, component_id) don't join
    yet, blocks of the members outside the largest component (numbered first) against all blocks. Pairs inside the
    largest one are settled."""
    at = uncut.join(comp, "id", "left").select("id", "n", "tree", "label", F.coalesce("component_id", "id").alias("c"))
    sizes = at.groupBy("tree", "label", "c").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    facts = sizes.groupBy("tree", "label").agg(F.max(F.struct("rows", "c", "n")).alias("top"), F.sum("rows").alias("rows"), F.sum("n").alias("n")).filter("rows > top.rows")
    blocks = lambda rows, n: F.greatest(F.ceil(rows / block), F.ceil(n / shingles_))
    facts = facts.select("tree", "label", F.col("top.c").alias("top"), blocks(F.col("rows") - F.col("top.rows"), F.col("n") - F.col("top.n")).alias("outside"), blocks(F.col("top.rows"), F.col("top.n")).alias("inside"))
    h, last = F.xxhash64("id", "tree"), F.when(F.col("c") == F.col("top"), F.col("outside")).otherwise(F.col("outside") + F.col("inside"))
    mine = F.when(F.col("c") == F.col("top"), F.col("outside") + F.pmod(h, "inside")).otherwise(F.pmod(h, "outside"))
    spread = salted_join(at, facts, ["tree", "label"], "id").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last - 1)))
    return spread.select("id", "tree", "label", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.col("mine").alias("side"))


def links_in_block(least: int, out_of: int):
    """Over rows (id, side, n, members) of one pair of blocks: edges that join what its links join."""

    def run(t: pa.Table) -> pa.Table:
        ids, side = t["id"].to_numpy(), t["side"].to_numpy()
        sets = [np.frombuffer(x, U64) for x in t["members"].to_pylist()]
        n = np.array([len(x) for x in sets], np.int64)
        value, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), n)
        shared = seen > 1
        place = np.cumsum(shared) - 1
        keep = shared[at]
        row, at = row[keep], place[at[keep]]
        common = np.zeros((len(sets), len(sets)), np.int64)
        for lo in range(0, int(shared.sum()), WIDTH):
            here = (at >= lo) & (at < lo + WIDTH)
            m = np.zeros((len(sets), min(WIDTH, int(shared.sum()) - lo)), np.float32)
            m[row[here], at[here] - lo] = 1
            common += (m @ m.T).astype(np.int64)
        linked = out_of * common >= least * (n[:, None] + n[None, :] - common)
        if side.min() != side.max():
            linked &= side[:, None] != side[None, :]
        np.fill_diagonal(linked, True)
        label = np.arange(len(sets))
        while True:  # smallest label within reach
            new = np.where(linked, label[None, :], len(sets)).min(1)
            new = new[new]
            if (new == label).all():
                break
            label = new
        other = np.flatnonzero(label != np.arange(len(sets)))
        return pa.table({"a": ids[other], "b": ids[label[other]]})

    return run


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", words: int = 5, least: int = 80, out_of: int = 100, block: int = BLOCK, shingles_: int = BLOCK_SHINGLES) -> DataFrame:
    """id, n_shingles, component_id and kept (id = component_id) of every row.

    Two documents are linked if out_of * common >= least * union over their sets of shingles of ``words`` words; a
    text with fewer words is one shingle, null and wordless texts have none and link with nothing. component_id is the
    smallest id reachable over links. Repeated rows get equal results; rows that share an id are one document, and
    what is linked with one of them is linked with it; rows with a null id stay alone and are kept. A very long text is one set of
    eight bytes a shingle in one task. Other columns don't matter; an empty frame stays empty. ``block`` and
    ``shingles_`` bound what a task compares and change no result.
    """
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    base = landed(signatures(docs, text=text, key=key, k=words), "signatures")
    same = ["n", "fp1", "fp2"]
    reps = landed(base.filter("n > 0 AND id IS NOT NULL").groupBy(*same).agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.count("*").alias("copies")), "classes")
    found = landed(regions(reps.select("id", "n", "sig")), "regions")
    parts = landed(cut_regions(found, block, shingles_), "parts")
    finished = parts.filter("whole").select("tree", "label").distinct()
    cut = found.select("tree", "label", "members").distinct().join(finished, ["tree", "label"], "left_anti")
    uncut = landed(found.join(cut.select("tree", "label"), ["tree", "label"]).select("tree", "label", "id", "n"), "cut")
    member = landed(one_of_each(parts.drop("whole")), "members")
    needed = landed(member.select("id").union(uncut.select("id")).distinct(), "ids")
    sets = landed(shingle_sets(by_ids(texts, needed, "id", "left_semi"), words).join(reps.select("id", "fp1", "fp2"), ["id", "fp1", "fp2"], "left_semi").distinct(), "sets")

    def links(spread: DataFrame) -> DataFrame:
        return spread.join(sets.select("id", "members"), "id").groupBy("tree", "label", "i", "j").applyInArrow(links_in_block(least, out_of), "a long, b long")

    comp = components(links(member))
    # What the first trees join needn't be compared in the others.
    for first, end in OPEN_ROUNDS:
        part = uncut.filter(F.col("tree").between(first, end - 1))
        if part.isEmpty():
            continue
        spread = landed(open_block_pairs(part, comp, block, shingles_), "open")
        if not spread.isEmpty():
            comp = components(links(spread), comp)
    # Only classes of several documents, or in a component of several, tell their documents something.
    told = reps.join(comp, "id", "left").withColumn("component_id", F.coalesce("component_id", "id")).filter("copies > 1 OR component_id <> id").select(*same, "component_id")
    rows = salted_join(base.drop("sig"), told, same, "id", "left")
    rows = rows.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    return rows.select("id", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
