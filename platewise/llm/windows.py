"""Removal of repeated passages: every word that a window of WINDOW words covers which also starts in a smaller document.

Every window of every text gets two Rabin-Karp hashes, taken from prefix sums of the words' hashes, so a window costs the
same whatever its length. One shuffle deals the windows by hash to partitions of about PART windows, where the smallest
document of each hash is found; the windows of all others come back to their documents and are joined there into maximal
intervals. Inside a chunk of texts a window is sent once, for its smallest document: what other documents of the chunk
hold of it is removed at once, and its repeats in the same document follow the one that was sent. So a window of very
many documents sends one entry a chunk.

Two windows count as equal if 80 bits of their hashes and the partition agree, of which the partition is another 20 bits
in a million million windows: about four in a million corpora of 10**13 windows hold two different windows that meet.
Hashes of words rest on two seeds, so words that meet under one of them do no harm.

In the shuffle an entry takes some eleven bytes, as long as a chunk has many windows for each partition; in a corpus of
10**13 windows it takes some thirty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.arrays import U64, Chunk, chunks, column, mix, nonspace_table, powers, ranges, runs, string_hashes
from platewise.llm.common import by_ids, landed

WINDOW = 50
#: Bytes of text whose windows are told apart before they are sent.
CHUNK = 4 << 20
#: Windows in a hash partition, about.
PART = 1 << 20
#: Words hashed at a time.
SLICE = 1 << 20
#: Bytes of a word and what parts it from the next, for an estimate of the number of words.
WORD_BYTES = 6
LAST_ID = (1 << 63) - 1

ENTRIES = "part long, docs binary, at binary, high binary, low binary, doc long, mark long, start long, stop long, of long"
SPANS = "doc long, mark long, start long, stop long, of long"


def words_of(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words."""
    return runs(nonspace_table()[c.data], c.starts, c.ends)


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hashes of every run of ``size`` numbers."""
    n = len(h) - size + 1
    out = np.empty(max(0, n), U64)
    for lo in range(0, n, SLICE):
        part = h[lo : lo + SLICE + size - 1]
        up, down = powers(len(part))
        prefix = np.zeros(len(part) + 1, U64)
        np.cumsum(part * up, out=prefix[1:])
        k = len(part) - size + 1
        out[lo : lo + k] = mix((prefix[size:] - prefix[:-size]) * down[:k])
    return out


def told_apart(high: np.ndarray, low: np.ndarray, doc: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: the smallest doc with its hashes, and the first row with its hashes, doc and mark."""
    least, first = doc.copy(), np.arange(len(doc))
    order = np.argsort(high, kind="stable")
    again = np.zeros(len(doc), bool)
    same = high[order[1:]] == high[order[:-1]]
    again[1:] |= same
    again[:-1] |= same
    some = order[again]
    if len(some):
        some = some[np.lexsort((some, mark[some], doc[some], low[some], high[some]))]
        new = np.ones(len(some), bool)
        new[1:] = (high[some[1:]] != high[some[:-1]]) | (low[some[1:]] != low[some[:-1]])
        least[some] = doc[some[np.flatnonzero(new)[np.cumsum(new) - 1]]]
        new[1:] |= (doc[some[1:]] != doc[some[:-1]]) | (mark[some[1:]] != mark[some[:-1]])
        first[some] = some[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return least, first


def stretches(row: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that start at words ``at`` (ascending) of rows, as rows, starts and stops of runs of consecutive ones."""
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(at))[: len(head)] - 1
    return row[head], at[head], at[last] + window


def entries(texts: DataFrame, window: int, parts: int, chunk: int) -> DataFrame:
    """ENTRIES of (doc, mark, text) rows: windows packed by partition, and with a negative part what is known already."""
    none64, none = np.zeros(0, np.int64), [b""]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, marks = column(batch, "doc").to_numpy(), column(batch, "mark").to_numpy()
            for c in chunks(column(batch, "text"), chunk):
                start, end, row = words_of(c)
                n = len(row) - window + 1
                at = np.flatnonzero(row[:n] == row[window - 1 :]) if n > 0 else none64
                if not len(at):
                    continue
                high, low = (rolling(string_hashes(c.data, start, end, seed), window)[at] for seed in (0, 1))
                base = np.searchsorted(row, np.arange(c.rows))
                mine, doc, mark = row[at], ids[c.lo + row[at]], marks[c.lo + row[at]]
                least, first = told_apart(high, low, doc, mark)
                own = np.arange(len(at))
                gone, follows = least < doc, (least == doc) & (first != own)
                r, lo, hi = stretches(mine[gone], at[gone], window)
                f = np.flatnonzero(follows)
                known_doc, known_mark = (np.concatenate([x[c.lo + r], x[c.lo + mine[f]]]) for x in (ids, marks))
                known_start, known_stop = np.concatenate([lo - base[r], at[f] - base[mine[f]]]), np.concatenate([hi - base[r], at[f] - base[mine[f]] + window])
                known_of = np.concatenate([np.full(len(r), -1), at[first[f]] - base[mine[f]]])

                sent = np.flatnonzero(~gone & ~follows)
                part = ((low[sent] >> U64(16)) % U64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                sent, part = sent[order], part[order]
                head = np.flatnonzero(np.diff(part, prepend=-1))
                cut = np.append(head, len(sent)).tolist()
                packed = packer.compress(np.diff(np.stack([ids[c.lo : c.hi], marks[c.lo : c.hi], base]), prepend=0).tobytes())
                places, k1, k2 = [], [], []
                for a, b in zip(cut[:-1], cut[1:]):
                    places.append(packer.compress(np.diff(at[sent[a:b]], prepend=0).astype(np.uint32).tobytes()))
                    k1.append(high[sent[a:b]].tobytes())
                    k2.append((low[sent[a:b]] & U64(0xFFFF)).astype(np.uint16).tobytes())
                more, blobs = len(known_doc), len(head)
                zero = np.zeros(blobs, np.int64)
                columns = [
                    pa.array(np.concatenate([part[head], -1 - (mix(known_doc.view(U64)) % U64(parts)).astype(np.int64)])),
                    *(pa.array(x + none * more, pa.binary()) for x in ([packed] * blobs, places, k1, k2)),
                    *(pa.array(np.concatenate([zero, x])) for x in (known_doc, known_mark, known_start, known_stop, known_of)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "docs", "at", "high", "low", "doc", "mark", "start", "stop", "of"])

    return texts.mapInArrow(run, ENTRIES)


def later_windows(window: int):
    """Over the entries of a partition: SPANS of the windows that a smaller document holds, and what was known."""
    names = ["doc", "mark", "start", "stop", "of"]

    def run(t: pa.Table) -> pa.Table:
        if t["part"][0].as_py() < 0:
            return t.select(names)
        unpack = zstandard.ZstdDecompressor().decompress
        found = []
        for docs, at, high, low in zip(*(t[k].to_pylist() for k in ("docs", "at", "high", "low"))):
            ids, marks, base = np.cumsum(np.frombuffer(unpack(docs), np.int64).reshape(3, -1), axis=1)
            place = np.cumsum(np.frombuffer(unpack(at), np.uint32).astype(np.int64))
            row = np.searchsorted(base, place, "right") - 1
            found.append((np.frombuffer(high, U64), np.frombuffer(low, np.uint16), ids[row], marks[row], place - base[row]))
        high, low, doc, mark, start = (np.concatenate([f[k] for f in found]) for k in range(5))
        gone = told_apart(high, low, doc, mark)[0] < doc
        doc, mark, start = doc[gone], mark[gone], start[gone]
        return pa.table([doc, mark, start, start + window, np.full(len(doc), -1)], names)

    return run


def without(texts: DataFrame, window: int) -> DataFrame:
    """Of (doc, text, spans) rows: doc, n_words, n_removed, kept_sha256 and kept. ``spans`` may be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = column(batch, "spans")
            lengths = pa.compute.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = spans.flatten()
            start_, stop_, of_ = (flat.field(k).to_numpy() for k in ("start", "stop", "of"))
            offset = np.append(0, np.cumsum(lengths))
            for c in chunks(column(batch, "text")):
                start, end, row = words_of(c)
                count = np.bincount(row, minlength=c.rows)
                base = np.cumsum(count) - count
                these = slice(offset[c.lo], offset[c.hi])
                at = np.repeat(base, lengths[c.lo : c.hi])
                first, stop, of = at + start_[these], at + stop_[these], of_[these]
                whole = of < 0
                begins = np.zeros(len(row) + 1, np.int64)
                np.add.at(begins, first[whole], 1)
                np.add.at(begins, stop[whole] - window + 1, -1)
                follows = np.flatnonzero(~whole)
                follows = follows[np.cumsum(begins)[at[follows] + of[follows]] > 0]
                edge = np.zeros(len(row) + 1, np.int64)
                for x, step in ((first, 1), (stop, -1)):
                    np.add.at(edge, x[whole], step)
                    np.add.at(edge, x[follows], step)
                keep = np.cumsum(edge[:-1]) == 0
                size = end[keep] - start[keep] + 1
                out = np.append(c.data, np.uint8(0x20))[np.repeat(start[keep], size) + ranges(size)]
                out[np.cumsum(size) - 1] = 0x20
                kept = np.bincount(row[keep], minlength=c.rows)
                cut = np.append(0, np.cumsum(np.bincount(row[keep], weights=size, minlength=c.rows))).astype(np.int64).tolist()
                data = out.tobytes()
                texts_ = [data[a : b - 1] if b > a else b"" for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc").slice(c.lo, c.rows), pa.array(count), pa.array(count - kept), pa.array([hashlib.sha256(x).hexdigest() for x in texts_]), pa.array(texts_, pa.binary()).cast(pa.string())],
                    ["doc", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return texts.mapInArrow(run, "doc long, n_words long, n_removed long, kept_sha256 string, kept string")


def document_id(c: Column) -> Column:
    """Ids as longs; null comes last."""
    return F.coalesce(c.cast("long"), F.lit(LAST_ID))


def remove_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, part: int = PART, chunk: int = CHUNK) -> DataFrame:
    """doc, n_words, n_removed, kept_sha256 (of the kept words, joined by a space) and kept (those words) of every row.

    A word goes if a window of ``window`` words covers it whose words also start in a row with a smaller id; windows are
    judged on the input. Texts of fewer words lose nothing and null ones have no words. A null id is larger than all
    others; rows that share an id don't count against each other, and repeated rows get equal results. Other columns
    don't matter; an empty frame stays empty. A very long text is a chunk of its own, of some thirty bytes of work
    space a byte.
    """
    base = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    sized = base.select(document_id(F.col("doc")).alias("doc"), F.octet_length("text").alias("size"))
    facts = sized.groupBy("doc").agg(F.sum("size").alias("size"), F.count("*").alias("n")).agg(F.sum("size").alias("size"), F.max("n").alias("n")).first()
    parts = max(1, -(-(facts["size"] or 0) // (WORD_BYTES * part)))
    # Only where ids repeat must rows of one id be told apart, by their texts.
    mark = F.xxhash64("text") if (facts["n"] or 0) > 1 else F.lit(0).cast("long")
    marked = base.select(document_id(F.col("doc")).alias("doc"), mark.alias("mark"), F.col("doc").isNull().alias("unnamed"), "text")
    sent = entries(marked.select("doc", "mark", "text"), window, parts, chunk)
    spans = landed(sent.groupBy("part").applyInArrow(later_windows(window), SPANS), "spans")
    touched = landed(spans.filter("of < 0").select("doc").distinct(), "touched")
    gathered = by_ids(spans, touched, "doc", "left_semi").groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "stop", "of")).alias("spans"))
    cut = by_ids(marked, touched, "doc", "left_semi").join(gathered, ["doc", "mark"], "left")
    whole = by_ids(marked, touched, "doc", "left_anti").withColumn("spans", F.lit(None).cast(gathered.schema["spans"].dataType))
    named = F.when(~F.col("unnamed"), F.col("doc")).alias("doc")
    return without(cut.unionByName(whole).select(named, "text", "spans"), window)
