"""Token counts of texts under a unigram model, with one dynamic program per shared prefix.

A pre-token is a run of non-space bytes with the single space before it, if there is one; any other space byte is a
pre-token of its own. The distinct pre-tokens of some megabytes of text form a trie. Node by node, level by level,
the forward score of a prefix is the least cost of cutting it into pieces of the vocabulary; pre-tokens that share a
prefix share its nodes. The token count of a pre-token is stored at its last node and summed over the text. A
pre-token of more than DEEP bytes goes on from its node at that depth by itself, a segment of bytes at a time.

The vocabulary is a public one (ranks, as in a ``.tiktoken`` file). A piece of rank r costs ln(r + 2), in thousandths;
equal costs go to fewer pieces, a byte that no piece covers costs UNKNOWN_COST.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from platewise.llm.arrays import LONG, U64, Chunk, chunks, column, fixed_hashes, lanes, nonspace_table, runs, same_lanes, same_strings, string_hashes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
UNKNOWN_COST = 20_000
#: A score holds the cost above and the number of pieces in so many bits below.
COUNT_BITS = 24
CHUNK = 4 << 20
FILTER_BITS = 20
#: Levels of the trie, and bytes of a longer pre-token that are looked up at a time.
DEEP, SEGMENT = 256, 1 << 18


@dataclass
class Vocabulary:
    data: np.ndarray  # bytes of the pieces
    at: np.ndarray  # where each piece starts, in the order of the hashes
    lengths: list[int]
    hashes: np.ndarray  # sorted
    scores: np.ndarray
    present: np.ndarray  # bool by the top bits of a hash


def piece_cost(rank: int) -> int:
    return round(1000 * math.log(rank + 2))


def load_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Pieces and costs. The file lies on the driver, which reads it; its pieces go to the tasks with the function."""
    with open(path, "rb") as f:
        pairs = (line.split() for line in f)
        return {base64.b64decode(p): piece_cost(int(r)) for p, r in (x for x in pairs if x)}


def compile_vocabulary(costs: dict[bytes, int]) -> Vocabulary:
    if any(len(p) > LONG for p in costs):
        raise ValueError(f"a piece has more than {LONG} bytes")
    pieces = [p for p in costs if p]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces], np.int64)
    end = np.cumsum(size)
    h = string_hashes(data, end - size, end)
    order = np.argsort(h)
    if (np.diff(h[order]) == 0).any():
        raise ValueError("two pieces have one hash")
    present = np.zeros(1 << FILTER_BITS, bool)
    present[(h >> U64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Vocabulary(data, (end - size)[order], sorted(set(size.tolist())), h[order], np.array([(costs[p] << COUNT_BITS) + 1 for p in pieces], np.int64)[order], present)


def pieces_at(v: Vocabulary, seen: np.ndarray, own: int, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the places ``at`` end a piece of n bytes, and its score. ``seen`` are the lanes of the text's bytes and,
    from ``own`` on, the vocabulary's; what the hashes find is compared byte by byte."""
    h = fixed_hashes(seen, at - n, n)
    some = np.flatnonzero(v.present[(h >> U64(64 - FILTER_BITS)).astype(np.int64)])
    k = np.minimum(np.searchsorted(v.hashes, h[some]), max(0, len(v.hashes) - 1))
    found = v.hashes[k] == h[some]
    some, k = some[found], k[found]
    found = same_lanes(seen, at[some] - n, own + v.at[k], np.full(len(k), n))
    return some[found], v.scores[k[found]]


def pre_tokens(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the pre-tokens with non-space bytes; per row, the number of the others."""
    inside = nonspace_table()[c.data]
    start, end, row = runs(inside, c.starts, c.ends)
    led = (start > c.starts[row]) & (c.data[np.maximum(start - 1, 0)] == 0x20)
    spaces = np.concatenate([[0], np.cumsum(~inside)])
    alone = spaces[c.ends] - spaces[c.starts] - np.bincount(row, weights=led, minlength=c.rows).astype(np.int64)
    return start - led, end, row, alone


def trie_counts(data: np.ndarray, start: np.ndarray, end: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Number of pieces of each of the distinct strings data[start:end]."""
    seen, own = lanes(np.concatenate([data, v.data])), len(data)
    order = np.argsort(start - end, kind="stable")  # the longest first: those with a byte at a depth are a head of the list
    start, size = start[order], (end - start)[order]
    deepest = min(DEEP, int(size[0])) if len(size) else 0
    reach = np.searchsorted(-size, -np.arange(1, deepest + 2), "right")
    node = [np.zeros(len(start), np.int64)]  # per depth: the node of each string
    best = [np.zeros(1, np.int64)]
    out = np.zeros(len(start), np.int64)
    for d in range(1, deepest + 1):
        a = reach[d - 1]
        # A node is its parent and a byte.
        _, first, inverse = np.unique(node[d - 1][:a] * 256 + data[start[:a] + d - 1], return_index=True, return_inverse=True)
        at = start[first] + d
        score = best[d - 1][node[d - 1][first]] + (UNKNOWN_COST << COUNT_BITS) + 1
        for n in v.lengths:
            if n > d:
                break
            some, piece = pieces_at(v, seen, own, at, n)
            if len(some):
                score[some] = np.minimum(score[some], best[d - n][node[d - n][first[some]]] + piece)
        node.append(inverse)
        best.append(score)
        done = np.arange(reach[d], a)
        out[done] = score[inverse[done]] & ((1 << COUNT_BITS) - 1)
    for i in range(int(reach[deepest]) if deepest == DEEP else 0):
        known = [int(best[d][node[d][i]]) for d in range(DEEP + 1)]
        out[i] = long_count(data[start[i] : start[i] + size[i]], known, v)
    back = np.empty_like(out)
    back[order] = out
    return back


def long_count(text: np.ndarray, known: list[int], v: Vocabulary) -> int:
    """Number of pieces of a text whose first len(known) - 1 bytes have the scores known[1:]."""
    wide, low = 64, (1 << COUNT_BITS) - 1  # Python's numbers have room for any count
    score = [(x >> COUNT_BITS << wide) + (x & low) for x in known]
    most = v.lengths[-1] if v.lengths else 1
    unknown = (UNKNOWN_COST << wide) + 1
    for lo in range(len(known) - 1, len(text), SEGMENT):
        hi = min(len(text), lo + SEGMENT)
        base = max(0, lo - most)
        part = text[base:hi]
        seen, own = lanes(np.concatenate([part, v.data])), len(part)
        ends = [(np.zeros(0, np.int64),) * 3]
        for n in v.lengths:
            at = np.arange(lo + 1, hi + 1) - base
            at = at[at >= n]
            some, piece = pieces_at(v, seen, own, at, n)
            ends.append((at[some] + base, np.full(len(some), n), piece))
        end, n, piece = (np.concatenate([x[i] for x in ends]) for i in range(3))
        order = np.argsort(end, kind="stable")
        cut = np.searchsorted(end[order], np.arange(lo + 1, hi + 2)).tolist()
        n, cost = n[order].tolist(), (piece[order] >> COUNT_BITS).tolist()
        back = score[-most:]
        for j in range(hi - lo):
            least = back[-1] + unknown
            for x in range(cut[j], cut[j + 1]):
                s = back[-n[x]] + (cost[x] << wide) + 1
                if s < least:
                    least = s
            back.append(least)
        score = back[-most:]
    return score[-1] & ((1 << wide) - 1)


def count_tokens(docs: DataFrame, costs: dict[bytes, int], *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus n_bytes, n_pre_tokens and n_tokens of each row.

    Null and empty texts count 0. Rows are independent, repeated rows get equal counts, other columns don't matter (one
    of ``keep`` must not be called as an output), and an empty frame stays empty. A very long text is a chunk of its own, of some fifty bytes of work space a byte; a
    word without spaces takes a few seconds a megabyte.
    """
    names = list(keep)
    vocabulary = compile_vocabulary(costs)
    schema = docs.select(*names).schema.add("n_bytes", "long").add("n_pre_tokens", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [np.zeros((0, 3), np.int64)]
            for c in chunks(column(batch, text), CHUNK):
                start, end, row, alone = pre_tokens(c)
                _, first, inverse = np.unique(string_hashes(c.data, start, end), return_index=True, return_inverse=True)
                size, same = end - start, first[inverse]
                other = np.flatnonzero((size != size[same]) | ~same_strings(c.data, start, start[same], np.minimum(size, size[same])))
                inverse[other] = len(first) + np.arange(len(other))  # of one hash with a different string
                first = np.concatenate([first, other])
                tokens = trie_counts(c.data, start[first], end[first], vocabulary)[inverse]
                sums.append(np.stack([c.ends - c.starts, np.bincount(row, minlength=c.rows) + alone, np.bincount(row, weights=tokens, minlength=c.rows).astype(np.int64) + alone], 1))
            total = np.concatenate(sums)
            yield pa.RecordBatch.from_arrays([*(column(batch, x) for x in names), *(pa.array(total[:, k]) for k in range(3))], [*names, "n_bytes", "n_pre_tokens", "n_tokens"])

    return docs.select(*names, *([] if text in names else [text])).mapInArrow(run, schema)
