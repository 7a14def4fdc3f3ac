"""Removal of repeated byte strings: every byte that a 100-byte string covers which also starts earlier.

Every window of WINDOW bytes holds an anchor, its least hashed K-gram (the leftmost of equals); equal windows have
equal anchors at equal places, so it is enough to compare the contexts of equal anchors, the WINDOW - K bytes on
either side. One shuffle brings together the anchors of all texts by K-gram hash, with a hash of the context:

* an anchor whose whole context occurs earlier loses the whole context. Inside a batch of texts (of PART bytes) the bytes are compared
  at once and only the outcome goes on, so an anchor meets at most one row per context and batch. Across batches the
  repeats of a text are joined to spans that lie alike in an earlier text, and the spans are compared by BLAKE2b
  digests of their bytes. Where these differ, two contexts had one hash, and the search is repeated with another hash;
* contexts that differ are cut out of the texts and compared. The suffixes that start at their anchors are sorted by
  mergesort; a comparison finds the common extension by binary search on prefix polynomial hashes, so it takes
  log(WINDOW) steps. Neighbours in the order give the extension to the right of any two suffixes, a search on the
  same hashes the one to the left; together they give what each context shares with earlier ones. The bytes of the
  pairs that decide are compared in the end, and if they differ the bucket is sorted again with other hashes;
* in a group of more than FEW suffixes the order is cut, for every offset of a window, into the runs that agree far
  enough to the right; inside a run the hash of what lies to the left tells equal windows;
* an anchor with more than CROWD different contexts (the edge of a passage that very many texts hold) is cut into the
  windows it owns, known by 128-bit digests, whose first occurrences are found by a combined minimum. Anchors that are
  crowded within the batches are told apart beforehand and spread by context, so no task gets all rows of one.

All windows with a given anchor contain it, so what they cover is one run, known from its two ends. The three ways
give the same result; CROWD and FEW choose the cheapest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.arrays import U64, chunks, column, mix, powers, prefix_hashes, ranges, same_strings, span_hashes, string_hashes, text_buffers
from platewise.llm.common import by_ids, landed, salted_join

WINDOW = 100
K = 29
#: Contexts of one anchor that meet in one task; more are cut into windows.
CROWD = 50_000
#: Groups of up to so many suffixes are compared pair by pair, larger ones offset by offset.
FEW = 64
#: Contexts that one task compares at a time.
BUCKET = 20_000
#: Different contexts in one batch from which on an anchor may be a crowded one.
BUSY = 4
#: Bits of the context hashes of the first search and of those that a collision asks for.
HASH_BITS = (64, 64, 64)
#: Windows whose anchors are found at a time.
SLICE = 1 << 18
#: Bytes of text that are hashed at a time, and in which repeats are looked for at once; one text may be longer.
CHUNK, PART = 1 << 18, 16 << 20
LAST_ID = (1 << 63) - 1
POSITION = U64((1 << 24) - 1)


def anchors_of_windows(data: np.ndarray, window: int, k: int) -> np.ndarray:
    """For every start of a window in data: the place of its anchor."""
    width, n = window - k + 1, len(data) - window + 1
    out = np.empty(max(0, n), np.int64)
    for lo in range(0, n, SLICE):
        hi = min(n, lo + SLICE)
        part = data[lo : hi + window - 1]
        at = np.arange(len(part) - k + 1)
        key = (mix(span_hashes(prefix_hashes(part), at, at + k)) & ~POSITION) | at.astype(U64)
        w = 1
        while 2 * w <= width:
            key = np.minimum(key[:-w], key[w:])
            w *= 2
        if w < width:
            key = np.minimum(key[: hi - lo], key[width - w : width - w + hi - lo])
        out[lo:hi] = (key & POSITION).astype(np.int64) + lo
    return out


def document_id(c: Column) -> Column:
    """Ids as longs; null comes last."""
    return F.coalesce(c.cast("long"), F.lit(LAST_ID))


def joined(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping intervals of equal key: index of the first, start and stop of each; sorted by key, start."""
    if not len(key):
        z = np.zeros(0, np.int64)
        return z, z, z
    group = np.cumsum(np.diff(key, prepend=key[0]) != 0)
    far = int(stop.max()) + 1  # so that a running maximum doesn't cross groups
    reach = np.maximum.accumulate(stop + group * far)
    new = np.ones(len(key), bool)
    new[1:] = start[1:] + group[1:] * far > reach[:-1]
    head = np.flatnonzero(new)
    return head, start[head], np.maximum.reduceat(stop, head)


def parts(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most PART bytes of text, or of one text."""
    _, offsets, _ = text_buffers(column(batch, text))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PART, "right")) - 1)
        hi = min(hi, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def anchor_rows(texts: DataFrame, window: int, k: int, seed: int, bits: int) -> DataFrame:
    """Of (doc, mark, text) rows: anchor and context hashes, doc, mark and pos of the anchors, and whether the anchor is
    busy here; with a null anchor, spans pos..stop that lie in an earlier text of the batch byte by byte."""
    side = window - k
    mask = U64((1 << bits) - 1)

    def found_in(col: pa.Array) -> tuple[np.ndarray, ...]:
        """Anchor and context hashes, row and pos of all anchors of some texts."""
        found = [(np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.int32))]
        for c in chunks(col, CHUNK):
            place = anchors_of_windows(c.data, window, k)
            if not len(place):
                continue
            row = np.searchsorted(c.ends, np.arange(len(place)), "right")
            a = np.unique(place[np.arange(len(place)) + window <= c.ends[row]])
            row = np.searchsorted(c.ends, a, "right")
            l, r = np.maximum(a - side, c.starts[row]), np.minimum(a + window, c.ends[row])
            context = mix(string_hashes(c.data, l, r, seed) + (a - l).astype(U64) * U64(0xC2B2AE3D27D4EB4F)) & mask
            found.append((string_hashes(c.data, a, a + k), context, (row + c.lo).astype(np.int32), (a - c.starts[row]).astype(np.int32)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, "text")):
            ids, marks = column(batch, "doc").to_numpy(), column(batch, "mark").to_numpy()
            data, offsets, _ = text_buffers(column(batch, "text"))
            data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
            anchor, context, row, pos = found_in(column(batch, "text"))
            order = np.lexsort((pos, ids[row], context, anchor))
            anchor, context, row, pos = anchor[order], context[order], row[order], pos[order]
            n = len(order)
            del order
            again = np.zeros(n, bool)
            again[1:] = (anchor[1:] == anchor[:-1]) & (context[1:] == context[:-1])
            group = np.cumsum(np.diff(anchor, prepend=~anchor[:1]) != 0, dtype=np.int32) - 1
            busy = (np.bincount(group, weights=~again) >= BUSY)[group] if n else again
            del group
            x = np.flatnonzero(again)
            head = np.maximum.accumulate(np.where(again, 0, np.arange(n, dtype=np.int32)))[x] if n else x
            same = (ids[row[x]] == ids[row[head]]) & (pos[x] == pos[head])
            here = same & (marks[row[x]] == marks[row[head]])  # a repeated row

            def context_of(i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                """Start in data, bytes before the anchor and size of contexts."""
                p, r = pos[i].astype(np.int64), row[i]
                left = np.minimum(p, side)
                return offsets[r] + p - left, left, left + np.minimum(window, offsets[r + 1] - offsets[r] - p)

            keep = np.ones(n, bool)
            keep[x[here]] = False
            sure, head = x[~same], head[~same]
            (at, left, size), (at_head, left_head, size_head) = context_of(sure), context_of(head)
            alike = np.flatnonzero((left == left_head) & (size == size_head))
            alike = alike[same_strings(data, at[alike], at_head[alike], size[alike])]
            sure, start, size = sure[alike], pos[sure[alike]] - left[alike], size[alike]
            keep[sure] = False
            doc, mark = ids[row[sure]], marks[row[sure]]
            order = np.lexsort((pos[sure], mark, doc))
            doc, mark, start, size = doc[order], mark[order], start[order], size[order]
            text = np.cumsum((np.diff(doc, prepend=-1) != 0) | (np.diff(mark, prepend=0) != 0))
            first, start, stop = joined(text, start, start + size)
            doc, mark = doc[first], mark[first]
            names = ["anchor", "context", "doc", "mark", "pos", "stop", "busy"]
            kept = np.flatnonzero(keep)
            for lo in range(0, len(kept), 100_000):
                p = kept[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[p].view(np.int64), context[p].view(np.int64), ids[row[p]], marks[row[p]], pos[p], np.zeros(len(p), np.int32), busy[p])], names)
            for lo in range(0, len(doc), 100_000):
                p = slice(lo, lo + 100_000)
                none = pa.nulls(len(doc[p]), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *(pa.array(x[p]) for x in (doc, mark, start.astype(np.int32), stop.astype(np.int32))), pa.array(np.zeros(len(none), bool))], names)

    return texts.mapInArrow(run, "anchor long, context long, doc long, mark long, pos int, stop int, busy boolean")


def packed(texts: DataFrame) -> DataFrame:
    """(doc, mark, text) with the texts compressed, for the joins that move them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offsets, valid = text_buffers(column(batch, "text"))
            small = [z.compress(data[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([column(batch, "doc"), column(batch, "mark"), pa.array(small, pa.binary())], ["doc", "mark", "z"])

    return texts.mapInArrow(run, "doc long, mark long, z binary")


CUT = "anchor long, crowd boolean, doc long, mark long, pos int, left int, bytes binary, stop int, ydoc long, ymark long, ystart int"


def contexts(found: DataFrame, window: int, k: int) -> DataFrame:
    """Rows (doc, mark, z, want: array of (pos, anchor, crowd, y)) as rows CUT: one per wanted anchor with its bytes, and
    with a null anchor one per span pos..stop that should lie at ystart of ydoc too, with the digest of its bytes."""
    side = window - k
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in CUT.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            docs, marks, packs, wants = column(batch, "doc").to_pylist(), column(batch, "mark").to_pylist(), column(batch, "z"), column(batch, "want")
            rows: list[tuple] = []
            for i, (doc, mark) in enumerate(zip(docs, marks)):
                text, want = z.decompress(packs[i].as_py()), wants[i].values
                new = np.asarray(want.field("anchor").is_valid())
                some = want.filter(pa.array(new))
                for pos, anchor, crowd in zip(some.field("pos").to_pylist(), some.field("anchor").to_pylist(), some.field("crowd").to_pylist()):
                    l = max(0, pos - side)
                    rows.append((anchor, crowd, doc, mark, pos, pos - l, text[l : pos + window], None, None, None, None))
                rest = want.filter(pa.array(~new))
                if len(rest):
                    y = rest.field("y")
                    pos = rest.field("pos").to_numpy().astype(np.int64)
                    shift = pos - y.field("pos").to_numpy()
                    other, theirs = y.field("doc").to_numpy(), y.field("mark").to_numpy()
                    order = np.lexsort((pos, theirs, shift, other))
                    pos, shift, other, theirs = pos[order], shift[order], other[order], theirs[order]
                    key = np.cumsum((np.diff(other, prepend=-1) != 0) | (np.diff(shift, prepend=0) != 0) | (np.diff(theirs, prepend=0) != 0))
                    for h, a, b in zip(*(x.tolist() for x in joined(key, np.maximum(pos - side, 0), np.minimum(pos + window, len(text))))):
                        rows.append((None, False, doc, mark, a, 0, digest(text[a:b]), b, int(other[h]), int(theirs[h]), a - int(shift[h])))
                if len(rows) >= 50_000 or i == len(docs) - 1:
                    t = list(zip(*rows)) or [()] * len(schema)
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(t, schema)], schema=schema)
                    rows = []

    return found.mapInArrow(run, CUT)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def unlike(asked: DataFrame) -> DataFrame:
    """Of rows (doc, mark, z, want: array of (start, n, digest)): ids of texts whose bytes there have another digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            packs, wants, out = column(batch, "z"), column(batch, "want").to_pylist(), []
            for i, doc in enumerate(column(batch, "doc").to_pylist()):
                text = z.decompress(packs[i].as_py())
                out += [doc for w in wants[i] if digest(text[w["start"] : w["start"] + w["n"]]) != w["digest"]]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["doc"])

    return asked.mapInArrow(run, "doc long")


class Suffixes:
    """Suffixes of some bytes that start at ``at``, reaching ``left`` bytes back and ``right`` bytes on."""

    def __init__(self, data: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, seed: int = 0):
        self.data, self.at, self.left, self.right = data, at, left, right
        self.prefix = prefix_hashes(data, seed)
        self.inverse = powers(len(self.prefix))[1]

    def equal(self, s: np.ndarray, t: np.ndarray, n: np.ndarray) -> np.ndarray:
        p, v = self.prefix, self.inverse
        return (p[s + n] - p[s]) * v[s] == (p[t + n] - p[t]) * v[t]

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def _search(self, most: np.ndarray, same) -> np.ndarray:
        lo, hi = np.zeros_like(most), most.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            ok = same(mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return lo

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension to the right of suffixes i and j."""
        s, t = self.at[i], self.at[j]
        return self._search(np.minimum(self.right[i], self.right[j]), lambda n: self.equal(s, t, n))

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        s, t = self.at[i], self.at[j]
        return self._search(np.minimum(self.left[i], self.left[j]), lambda n: self.equal(s - n, t - n, n))

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = self.forward(i, j)
        ri, rj = self.right[i], self.right[j]
        over = (n == ri) | (n == rj)
        last = len(self.data) - 1
        a, b = self.data[np.minimum(self.at[i] + n, last)], self.data[np.minimum(self.at[j] + n, last)]
        return np.where(over, ri < rj, a < b)

    def sorted(self, group: np.ndarray) -> np.ndarray:
        """Mergesort inside runs of equal ``group``; all merges of a level go on together."""
        n = len(group)
        order = np.arange(n)
        head = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if n else order
        size = np.diff(np.append(head, n))
        base, size = np.repeat(head, size), np.repeat(size, size)
        place = np.arange(n) - base
        w = 1
        while n and w < size.max():
            run = place // w
            start = (run ^ 1) * w
            lo, hi = np.zeros(n, np.int64), np.clip(size - start, 0, w)
            while len(todo := np.flatnonzero(lo < hi)):
                mid = (lo[todo] + hi[todo]) >> 1
                me, other = order[todo], order[base[todo] + start[todo] + mid]
                # From the left run: how many of the right are less; from the right run: how many of the left aren't greater.
                first = run[todo] % 2 == 0
                before = self.less(np.where(first, other, me), np.where(first, me, other))
                go = np.where(first, before, ~before)
                lo[todo], hi[todo] = np.where(go, mid + 1, lo[todo]), np.where(go, hi[todo], mid)
            new = base + (run // 2) * 2 * w + (place - run * w) + lo
            out = np.empty_like(order)
            out[new] = order
            order = out
            w *= 2
        return order


def shared_runs(group: np.ndarray, rank: np.ndarray, s: Suffixes, window: int, few: int = FEW) -> tuple[np.ndarray, np.ndarray] | None:
    """For each suffix: how far to the left and right of its start reach the windows it shares with suffixes of its
    group that have a lower rank; 0 and 0 if it shares none. Groups are contiguous. None if two strings have one hash."""
    n = len(group)
    best_l, best_r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 2:
        return best_l, best_r
    order = s.sorted(group)
    sorted_group = group[order]
    pairs = np.flatnonzero(sorted_group[1:] == sorted_group[:-1])
    near = np.full(n, -1, np.int64)  # common extension with the next suffix in order; -1 at the end of a group
    near[pairs] = s.forward(order[pairs], order[pairs + 1])
    size = np.diff(np.append(np.flatnonzero(np.diff(sorted_group, prepend=sorted_group[0] - 1)), n))
    size = np.repeat(size, size)

    def found(later: np.ndarray, other: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        np.maximum.at(best_l, later, (left << 32) | other)
        np.maximum.at(best_r, later, (right << 32) | other)

    x = np.flatnonzero((size <= few) & (near >= 0))
    right, d = near[x], 1
    while len(x):
        i, j = order[x], order[x + d]
        left = s.backward(i, j)
        good = (left + right >= window) & (rank[i] != rank[j])
        i, j, swap = i[good], j[good], (rank[i] < rank[j])[good]
        found(np.where(swap, j, i), np.where(swap, i, j), left[good], right[good])
        d += 1
        on = (x + d < n) & (sorted_group[np.minimum(x + d, n - 1)] == sorted_group[x])
        x, right = x[on], right[on]
        right = np.minimum(right, near[x + d - 1])
    many = np.flatnonzero(size > few)
    if len(many):
        who, ahead = order[many], np.concatenate([[-1], near[many][:-1]])
        for o in range(int(s.left[who].max()) + 1):
            fits = (s.left[who] >= o) & (s.right[who] >= window - o)
            run = np.cumsum(ahead < window - o)[fits]
            me = who[fits]
            key = mix(s.span(s.at[me] - o, s.at[me]) + run.astype(U64) * U64(0x9FB21C651E98DF25))
            by = np.lexsort((rank[me], key))
            key, me = key[by], me[by]
            head = np.maximum.accumulate(np.where(np.diff(key, prepend=~key[:1]) != 0, np.arange(len(key)), 0)) if len(key) else by
            again = rank[me] > rank[me[head]]
            one = np.full(int(again.sum()), o, np.int64)
            found(me[again], me[head][again], one, window - one)
    mask = (1 << 32) - 1
    l, r = best_l >> 32, best_r >> 32
    # The pairs that decide are compared byte by byte.
    for length, partner, back in ((l, best_l & mask, True), (r, best_r & mask, False)):
        some = np.flatnonzero(length)
        at, n_bytes = ranges(length[some]), length[some]
        shift = np.repeat(n_bytes, n_bytes) if back else 0
        mine = np.repeat(s.at[some], n_bytes) + at - shift
        theirs = np.repeat(s.at[partner[some]], n_bytes) + at - shift
        if not np.array_equal(s.data[mine], s.data[theirs]):
            return None
    return l, r


def compare_bucket(window: int, few: int = FEW):
    """Over rows (anchor, doc, mark, pos, left, bytes) of whole anchors: runs (doc, mark, from, to) to remove."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("anchor", "ascending"), ("doc", "ascending"), ("pos", "ascending")]).combine_chunks()
        anchor, doc, mark, pos, left = (t[c].to_numpy() for c in ("anchor", "doc", "mark", "pos", "left"))
        data, offsets, _ = text_buffers(t["bytes"].combine_chunks())
        at = offsets[:-1] - offsets[0] + left
        rank = np.cumsum((np.diff(doc, prepend=-1) != 0) | (np.diff(pos, prepend=-1) != 0))
        seed, found = 0, None
        while found is None:
            found = shared_runs(anchor, rank, Suffixes(data[offsets[0] : offsets[-1]], at, left.astype(np.int64), offsets[1:] - offsets[0] - at, seed), window, few)
            seed += 1
        l, r = found
        some = r > 0
        return pa.table({"doc": doc[some], "mark": mark[some], "start": (pos - l)[some].astype(np.int32), "stop": (pos + r)[some].astype(np.int32)})

    return run


def own_windows(crowds: DataFrame, window: int, k: int) -> DataFrame:
    """The windows of the contexts that have their anchor: digest, doc, mark, pos of the anchor, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(column(batch, "bytes")):
                place, data = anchors_of_windows(c.data, window, k), c.data.tobytes()
                start = np.arange(len(place))
                row = np.searchsorted(c.ends, start, "right")
                left = column(batch, "left").to_numpy()[c.lo : c.hi]
                mine = (start + window <= c.ends[row]) & (place == c.starts[row] + left[row])
                start, row = start[mine], row[mine]
                doc, mark, pos = (column(batch, x).to_numpy()[c.lo : c.hi][row] for x in ("doc", "mark", "pos"))
                yield pa.RecordBatch.from_arrays([pa.array([digest(data[x : x + window]) for x in start.tolist()], pa.binary()), pa.array(doc), pa.array(mark), pa.array(pos), pa.array((pos - left[row] + start - c.starts[row]).astype(np.int32))], ["window", "doc", "mark", "pos", "start"])

    return crowds.mapInArrow(run, "window binary, doc long, mark long, pos int, start int")


def repeated_runs(texts: DataFrame, window: int = WINDOW, k: int = K, crowd: int = CROWD, bucket: int = BUCKET, few: int = FEW, hash_bits: tuple[int, ...] = HASH_BITS) -> DataFrame:
    """Runs (doc, mark, start, stop) to remove from (doc, mark, text) rows; they overlap, and stop may lie beyond the
    text. A search whose hashes collide is repeated with the next of ``hash_bits``."""
    for seed, bits in enumerate(hash_bits):
        runs = _search(texts, window, k, crowd, bucket, few, seed, bits)
        if runs is not None:
            return runs
    raise RuntimeError("different strings had one hash in every search")


def _search(texts: DataFrame, window: int, k: int, crowd: int, bucket: int, few: int, seed: int, bits: int) -> DataFrame | None:
    place = ["doc", "mark"]
    rows = landed(anchor_rows(texts, window, k, seed, bits), "anchors")
    near = rows.filter("anchor IS NULL").select(*place, F.col("pos").alias("start"), "stop")
    # Anchors with more than ``crowd`` rows, of those that are busy in some batch: their rows are spread by context. What
    # isn't busy anywhere has fewer than BUSY rows a batch.
    open_ = rows.filter("anchor IS NOT NULL").drop("stop")
    hot = landed(open_.filter("busy").groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("anchor"), "hot")
    some_hot = not hot.isEmpty()
    cold = (by_ids(open_, hot, "anchor", "left_anti") if some_hot else open_).repartition("anchor")
    new = F.struct("doc", "pos") == F.struct("first.doc", "first.pos")
    first = F.expr("min(struct(doc, pos, mark)) OVER (PARTITION BY anchor, context)")
    cold = cold.withColumn("first", first).withColumn("new", new).withColumn("different", F.expr("count_if(new) OVER (PARTITION BY anchor)"))
    hits = cold.filter(~F.col("new") | (F.col("different") > 1)).withColumn("crowd", F.col("different") > crowd).drop("different")
    if some_hot:
        hits = hits.unionByName(by_ids(open_, hot, "anchor", "left_semi").withColumn("first", first).withColumn("new", new).withColumn("crowd", F.lit(True)))
    hits = hits.select(*place, F.struct("pos", F.when(F.col("new"), F.col("anchor")).alias("anchor"), "crowd", F.when(~F.col("new"), F.col("first")).alias("y")).alias("w"))
    wanted = hits.groupBy(*place).agg(F.collect_list("w").alias("want"))
    cut = landed(contexts(packed(texts).join(wanted, place), window, k), "contexts")
    spans = cut.filter("anchor IS NULL")
    asked = spans.select(F.col("ydoc").alias("doc"), F.col("ymark").alias("mark"), F.col("ystart").alias("start"), (F.col("stop") - F.col("pos")).alias("n"), F.col("bytes").alias("digest")).distinct()
    asked = landed(asked.groupBy(*place).agg(F.collect_list(F.struct("start", "n", "digest")).alias("want")), "asked")
    held = packed(by_ids(texts, asked.select("doc").distinct(), "doc", "left_semi")).join(asked, place)
    if not unlike(held).isEmpty():
        return None
    whole = spans.select(*place, F.col("pos").alias("start"), "stop")
    mixed = cut.filter("anchor IS NOT NULL AND NOT crowd").select("anchor", *place, "pos", "left", "bytes")
    buckets = max(1, mixed.count() // bucket)
    pairs = mixed.withColumn("bucket", F.pmod("anchor", F.lit(buckets))).groupBy("bucket").applyInArrow(compare_bucket(window, few), "doc long, mark long, start int, stop int")
    every = own_windows(cut.filter("crowd"), window, k)
    earliest = every.groupBy("window").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = salted_join(every, earliest, ["window"], "doc").filter(F.struct("doc", "start") > F.col("first"))
    again = again.groupBy(*place, "pos").agg(F.min("start").alias("start"), (F.max("start") + window).alias("stop")).drop("pos")
    return near.unionByName(whole).unionByName(pairs).unionByName(again)


def remove_repeats(docs: DataFrame, *, text: str = "text", key: str = "doc_id", window: int = WINDOW, k: int = K, crowd: int = CROWD, bucket: int = BUCKET, few: int = FEW, hash_bits: tuple[int, ...] = HASH_BITS) -> DataFrame:
    """doc, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes) and kept_sha256 of each row.

    Null and empty texts have no bytes; texts shorter than the window lose nothing. Earlier means a smaller id (null
    is the largest), then an earlier start. Rows that share an id count as the same place: of equal strings that start
    at one place of theirs none is earlier, and repeated rows get equal results. A text of any length is one value in
    a task, with some twenty bytes of work space a byte. Other columns don't matter; an empty frame stays empty.
    """
    texts = docs.select(document_id(F.col(key)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    runs = repeated_runs(texts, window, k, crowd, bucket, few, hash_bits).groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            found, out, held = column(batch, "runs"), [], 0
            docs_here, packs = column(batch, "doc").to_pylist(), column(batch, "z")
            for i, doc in enumerate(docs_here):
                data = np.frombuffer(z.decompress(packs[i].as_py()), np.uint8)
                n = len(data)
                gone = np.zeros(n + 1, np.int32)
                if found[i].is_valid:
                    start, stop = (found[i].values.field(x).to_numpy().astype(np.int64) for x in ("start", "stop"))
                    stop = np.minimum(stop, n)
                    full = stop - start >= window
                    np.add.at(gone, start[full], 1)
                    np.add.at(gone, stop[full], -1)
                gone = np.cumsum(gone[:-1]) > 0
                kept = data[~gone].tobytes()
                out.append((None if doc == LAST_ID else doc, n, int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), kept, hashlib.sha256(kept).hexdigest()))
                held += len(kept)
                if held > 4 << 20 or i == len(docs_here) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()))], ["doc", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
                    out, held = [], 0

    return packed(texts).join(runs, ["doc", "mark"], "left").mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
