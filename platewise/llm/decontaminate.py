"""Benchmark passages in documents, found with the Wu-Manber multi-pattern search over words.

A pattern is a run of WINDOW consecutive words of a benchmark item, or the whole of a shorter item. All patterns of
one length are searched together: the last two words of the text window index a shift table, most windows are
skipped by more than one word, and where the shift is 0 the block's hash selects the bucket of patterns that end so,
which are compared word by word and confirmed on the bytes.

Patterns are numbers of words in one array of the items' bytes. They reach the tasks with the function itself, some
ten times as large in memory as the items' text, and so in blocks of about BLOCK_BYTES of it: one block at a time is on
the driver and in a task. Every block but the last is a job of its own over the texts, of which only the texts with
hits are written, under a digest of the text, and joined to the last block's pass. A large benchmark costs time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.llm.arrays import LONG, U64, Chunk, chunks, column, lanes, lower_table, mix, ranges, runs, same_lanes, string_hashes
from platewise.llm.common import landed, reject_names, salted_join

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Text windows that one lane of the search visits.
LANE = 64
SLOT_BITS = 20


def word_table() -> np.ndarray:
    """Bytes of words: digits, letters and everything from 0x80."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


def words(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; starts, ends, rows and 64-bit hashes of the words."""
    low = lower_table()[c.data]
    start, end, row = runs(word_table()[low], c.starts, c.ends)
    return low, start, end, row, string_hashes(low, start, end)


@dataclass
class Words:
    """The words of the items of a block."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    ids: list  # of the items


@dataclass
class Patterns:
    """Patterns of one length m, ordered by the hash of their last block: first word and item of each."""

    m: int
    first: np.ndarray
    item: np.ndarray
    block: np.ndarray
    shift: np.ndarray


def block_hash(hashes: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Hash of the block that ends a window of m words at ``at``: two words, or the only one."""
    last = hashes[at + (m - 1)]
    return last if m == 1 else mix(hashes[at + (m - 2)] * U64(3) + last)


def compile_patterns(items: pa.RecordBatch | pa.Table, window: int = WINDOW) -> tuple[Words, list[Patterns]]:
    """Words of the items (item_id, text) and their patterns by length."""
    parts, ids, bytes_, items_ = [[np.zeros(0, np.uint8), *(np.zeros(0, np.int64),) * 3, np.zeros(0, U64)]], [], 0, 0
    for batch in items.to_batches() if isinstance(items, pa.Table) else [items]:
        ids += column(batch, "item_id").to_pylist()
        for c in chunks(column(batch, "text")):
            low, start, end, row, h = words(c)
            parts.append([low, start + bytes_, end + bytes_, row + c.lo + items_, h])
            bytes_ += len(low)
        items_ += batch.num_rows
    low, start, end, item, h = (np.concatenate([p[k] for p in parts]) for k in range(5))
    count = np.bincount(item, minlength=1)
    before = np.cumsum(count) - count
    length = np.minimum(window, count)[item] if len(item) else item
    first = np.flatnonzero(np.arange(len(item)) + length <= (before + count)[item]) if len(item) else item
    out = []
    for m in np.unique(length[first]).tolist():
        at = first[length[first] == m]
        width = min(2, m)
        shift = np.full(1 << SLOT_BITS, m - width + 1, np.uint8)
        for j in range(m - width + 1):  # the block that starts at word j lies m - width - j words before the end
            slot = block_hash(h, at + j, width) >> U64(64 - SLOT_BITS)
            np.minimum.at(shift, slot.astype(np.int64), np.uint8(m - width - j))
        last = block_hash(h, at, m)
        order = np.argsort(last, kind="stable")
        out.append(Patterns(m, at[order], item[at[order]], last[order], shift))
    return Words(low, start, end, h, ids), out


def same_words(x: Words, seen: np.ndarray, own: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a of a text and words b of the items are equal by bytes. ``seen`` are the lanes of the text's bytes,
    ``own`` the items'; words of more than LONG bytes are known by their BLAKE2b hashes alone."""
    size = end[a] - start[a]
    return (size == x.end[b] - x.start[b]) & ((size > LONG) | same_lanes(seen, start[a], x.start[b], np.where(size > LONG, 0, np.minimum(size, x.end[b] - x.start[b])), own))


def search(p: Patterns, x: Words, seen: np.ndarray, own: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the occurrences, and which pattern each is."""
    none = np.zeros(0, np.int64)
    if len(h) < p.m:
        return none, none
    at = np.flatnonzero(row[: len(row) - p.m + 1] == row[p.m - 1 :])  # windows inside one row
    if not len(at):
        return none, none
    # Lanes: at most LANE consecutive windows of one row.
    head = np.flatnonzero(np.diff(row[at], prepend=-1))
    size = np.diff(np.append(head, len(at)))
    pieces = -(-size // LANE)
    now = np.repeat(at[head], pieces) + ranges(pieces) * LANE
    stop = np.minimum(now + LANE, np.repeat(at[head] + size, pieces))
    found = []
    while len(now):
        step = p.shift[(block_hash(h, now, p.m) >> U64(64 - SLOT_BITS)).astype(np.int64)].astype(np.int64)
        found.append(now[step == 0])
        now = now + np.maximum(step, 1)
        on = now < stop
        now, stop = now[on], stop[on]
    at = np.concatenate(found)
    b = block_hash(h, at, p.m)
    lo, hi = np.searchsorted(p.block, b, "left"), np.searchsorted(p.block, b, "right")
    which = np.repeat(lo, hi - lo) + ranges(hi - lo)
    at = np.repeat(at, hi - lo)
    for j in range(p.m):
        same = x.hashes[p.first[which] + j] == h[at + j]
        at, which = at[same], which[same]
    for j in range(p.m):
        same = same_words(x, seen, own, start, end, at + j, p.first[which] + j)
        at, which = at[same], which[same]
    return at, which


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns of each row plus n_words, hits (a bit per word, packed), n_hit and items (ids, sorted).

    A word is hit if it lies in an occurrence of any pattern; items are those with a pattern that occurs. Null and
    empty texts have no words; items without words have no patterns; an empty benchmark hits nothing. Items are named by
    their ids, of any type; repeated ids count once, and a null id is one more name, listed last. Rows are independent,
    repeated rows get equal results, and other columns don't matter; a column of ``keep`` that is called as an output is an
    error. A very long text is a chunk of its own, of some fifty bytes of work space a byte.
    """
    names = list(keep)
    reject_names(names, "n_words", "hits", "n_hit", "items")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    # Columns get names of their own, so that none of docs can clash with what is added.
    kept = [f"c{i}" for i in range(len(names))]
    out = docs.select(*(F.col(x).alias(k) for x, k in zip(names, kept)), F.col(text).alias("text"))

    def patterns(b: int) -> tuple[Words, list[Patterns], pa.DataType]:
        part = benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "text").toArrow()
        return *compile_patterns(part, window), part.schema.field("item_id").type

    item = benchmark.schema["item_id"].dataType
    if blocks > 1:
        out = out.withColumn("digest", F.sha2("text", 256))
        found = [landed(_pass(out, ["digest"], *patterns(b), item).filter("n_hit > 0").groupBy("digest").agg(F.first("hits").alias("hits"), F.first("items").alias("items")), "hits") for b in range(blocks - 1)]
        # A text has at most one row of each block here.
        earlier = reduce(DataFrame.union, found).groupBy("digest").agg(F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items"))
        out = salted_join(out, landed(earlier, "hits"), ["digest"], kept[0] if kept else "text", "left")
    out = _pass(out, kept, *patterns(blocks - 1), item)
    return out.toDF(*names, "n_words", "hits", "n_hit", "items")


def _pass(df: DataFrame, names: list[str], known: Words, patterns: list[Patterns], id_type: pa.DataType, item: T.DataType) -> DataFrame:
    """One search of the column text, which adds to what earlier ones found (columns hits and items: a list of each, or
    null), if df has that."""
    more = "hits" in df.columns
    schema = T.StructType([*df.select(*names).schema.fields]).add("n_words", "long").add("hits", "binary").add("n_hit", "long").add("items", T.ArrayType(item))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lanes(known.low)
        for batch in batches:
            n_words, n_hit, hits, items = [], [], [], []
            before = {k: (batch_hits, batch_items) for k, (batch_hits, batch_items) in enumerate(zip(column(batch, "hits").to_pylist(), column(batch, "items").to_pylist())) if batch_hits} if more else {}
            for c in chunks(column(batch, "text")):
                low, start, end, row, h = words(c)
                edge = np.zeros(len(h) + 1, np.int64)
                seen = lanes(low)
                mine: list[set] = [set() for _ in range(c.rows)]
                for p in patterns:
                    at, which = search(p, known, seen, own, start, end, row, h)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + p.m, -1)
                    for r, k in zip(row[at].tolist(), which.tolist()):
                        mine[r].add(known.ids[p.item[k]])
                hit = np.cumsum(edge[:-1]) > 0
                cut = np.searchsorted(row, np.arange(c.rows + 1))
                for i in range(c.rows):
                    bits = hit[cut[i] : cut[i + 1]]
                    for packed, ids in zip(*before.get(c.lo + i, ((), ()))):
                        bits = bits | np.unpackbits(np.frombuffer(packed, np.uint8), count=len(bits)).astype(bool)
                        mine[i].update(ids)
                    n_words.append(len(bits))
                    n_hit.append(int(bits.sum()))
                    hits.append(np.packbits(bits).tobytes())
                    items.append(sorted(mine[i], key=lambda x: (x is None, x)))
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, x) for x in names), pa.array(n_words, pa.int64()), pa.array(hits, pa.binary()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(id_type))],
                [*names, "n_words", "hits", "n_hit", "items"],
            )

    return df.mapInArrow(run, schema)
