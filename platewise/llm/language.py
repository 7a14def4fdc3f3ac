"""Language identification of whole and mixed-language texts.

Letters are scored by smoothed log-probabilities of letter trigrams (hashed into a fixed table), words by the sum
over their letters. The script of a word, read off code point ranges, narrows its candidates to the languages that
were seen in that script. A Viterbi pass over the words of a text, in which a change of language costs
``switch_penalty``, labels every word; runs of equal labels are the spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.llm.arrays import Chunk, chunks, column
from platewise.llm.common import reject_names

#: Trigrams are hashed into so many cells.
CELLS = 1 << 17
#: At most about so many labelled rows are learned from, as many of every language; they are picked by a hash of their id.
TRAIN_ROWS = 20_000
#: Letters that are scored at a time, and bytes of texts that are labelled together.
LETTERS, GROUP_BYTES = 1 << 16, 2 << 20
SWITCH_PENALTY = 10.0
#: A text of more than so many words is labelled by itself, in stretches of STRETCH words; the labels are the same.
LONG_TEXT, STRETCH = 1 << 17, 4096
#: Scores are added up in whole numbers of one part in so many.
POINTS = 1 << 16
#: Languages that a model knows at most: 512 KB of its table each. The ones with most rows are learned.
MOST_LANGUAGES = 200
#: Candidates of a script: languages with at least this share of their training letters in it.
SCRIPT_SHARE = 0.01
#: First and last code points of scripts; a letter outside them has script 0.
SCRIPTS = (
    (0x0041, 0x024F, 1), (0x1E00, 0x1EFF, 1), (0x0370, 0x03FF, 2), (0x1F00, 0x1FFF, 2), (0x0400, 0x052F, 3), (0x0530, 0x058F, 4), (0x0590, 0x05FF, 5), (0x0600, 0x077F, 6),
    (0x0900, 0x097F, 7), (0x0980, 0x09FF, 8), (0x0A00, 0x0A7F, 9), (0x0A80, 0x0AFF, 10), (0x0B80, 0x0BFF, 11), (0x0C00, 0x0C7F, 12), (0x0E00, 0x0E7F, 13), (0x10A0, 0x10FF, 14),
    (0x1100, 0x11FF, 15), (0xAC00, 0xD7AF, 15), (0x3040, 0x30FF, 16), (0x3400, 0x9FFF, 17), (0x20000, 0x3FFFF, 17),
)
N_SCRIPTS = 18
#: Code points from here on are letters if they are ideographs.
TABLE_END = 0x20000
UNKNOWN = "und"
FAR = np.float32(-1e4)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # CELLS x languages, float32
    allowed: np.ndarray  # N_SCRIPTS x languages, bool


@lru_cache
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For code points below TABLE_END: the lower-case letter (0 if none), and the script."""
    low, script = np.zeros(TABLE_END, np.uint32), np.zeros(TABLE_END, np.uint8)
    for i in range(TABLE_END):
        c = chr(i)
        if c.isalpha():
            x = c.lower()
            low[i] = ord(x) if len(x) == 1 else i
    for a, b, k in SCRIPTS:
        script[a : b + 1] = k
    return low, script


def code_points(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a chunk and the row offsets among them."""
    s = np.frombuffer(c.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])
    if before[-1] == len(s):
        return s, np.append(before[c.starts], before[-1])
    rows = [np.frombuffer(c.data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32) for a, b in zip(c.starts, c.ends)]
    return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])


def letters(c: Chunk) -> tuple[np.ndarray, ...]:
    """Positions of the letters, their rows, trigram cells and scripts; first letters of words; row offsets."""
    cp, offsets = code_points(c)
    low_table, script_table = letter_tables()
    if cp.size and cp.max() >= TABLE_END:
        high = cp >= TABLE_END
        inside = np.where(high, 0, cp)
        low, script = low_table[inside], script_table[inside]
        ideograph = high & (cp < 0x40000)
        low[ideograph], script[ideograph] = cp[ideograph], 17
    else:
        low, script = low_table[cp], script_table[cp]
    padded = np.zeros(len(low) + 2, np.uint32)
    padded[1:-1] = low
    at = np.flatnonzero(low)
    row = np.searchsorted(offsets, at, "right") - 1
    prev, nxt = padded[at], padded[at + 2]
    prev = np.where(at == offsets[row], 0, prev)
    nxt = np.where(at + 1 == offsets[row + 1], 0, nxt)
    h = prev.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + low[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + nxt.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    cell = (h >> np.uint64(47)).astype(np.int64)
    # A script without spaces would make one word of a sentence: there every letter is a word.
    first = (prev == 0) | (script[at] >= 16)
    return at, row, cell, script[at], first, offsets


def word_scores(c: Chunk, m: Model) -> tuple[np.ndarray, ...]:
    """Per word: row, first and end code point, letters, scores by language, and letters in a script of a language."""
    at, row, cell, script, first, offsets = letters(c)
    w = np.flatnonzero(first)
    if not len(w) or not m.languages:
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros((0, len(m.languages)), np.float32), z
    s, word = np.zeros((len(w), len(m.languages)), np.float32), np.cumsum(first) - 1
    for lo in range(0, len(at), LETTERS):
        here = word[lo : lo + LETTERS]
        head = np.flatnonzero(np.diff(here, prepend=-1))
        s[here[head]] += np.add.reduceat(m.table[cell[lo : lo + LETTERS]], head, axis=0)
    ends = np.append(w[1:], len(at))
    ok = m.allowed[script[w]]
    s[~ok & ok.any(1, keepdims=True)] += FAR
    s -= s.max(1, keepdims=True)
    start = at[w]
    return row[w], start - offsets[row[w]], at[ends - 1] + 1 - offsets[row[w]], ends - w, s, (ends - w) * ok.any(1)


def points(x: np.ndarray | float) -> np.ndarray:
    """Scores as whole numbers of 2**-16. Sums of them are exact, so equal ways are equal however they are summed."""
    return np.rint(np.asarray(x) * np.float32(POINTS)).astype(np.int64)


def _step(x: np.ndarray, penalty: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values before the next words, less the best of each row; which labels stay, and the best label, from which others
    come."""
    top = x.argmax(1)
    x = x - x[np.arange(len(x)), top][:, None]
    stay = x >= -penalty
    return np.where(stay, x, -penalty), stay, top


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float, long_text: int = LONG_TEXT, stretch: int = STRETCH) -> np.ndarray:
    """Best labels of sequences that lie one after the other, counts[i] rows each.

    The last row takes the first of the best labels; going back, a label stays where that costs no more than a change,
    and else comes from the first of the best labels before it. All sequences advance together, the longest first, so
    that each step is one operation on those still running. A sequence of more than ``long_text`` rows is labelled by
    itself, its stretches advancing together, with the same values and so the same labels.
    """
    if (counts > long_text).any():
        path, long, end = np.zeros(len(scores), np.int32), counts > long_text, np.cumsum(counts)
        for e, c in zip(end[long], counts[long]):
            path[e - c : e] = _in_stretches(scores[e - c : e], penalty, stretch)
        rest = np.repeat(~long, counts)
        path[rest] = viterbi(scores[rest], counts[~long], penalty, long_text, stretch)
        return path
    n, k = scores.shape
    change = int(points(penalty))
    order = np.argsort(-counts, kind="stable")
    begin = (np.cumsum(counts) - counts)[order]
    length = counts[order]
    active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")
    stay, top = np.ones((n, k), bool), np.zeros(n, np.int32)
    v = np.zeros((len(order), k), np.int64)
    last = np.zeros(len(order), np.int64)
    path = np.zeros(n, np.int32)
    for t, a in enumerate(active):
        at = begin[:a] + t
        x, stay[at], top[at] = _step(v[:a], change)
        v[:a] = x + points(scores[at])
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        b = active[t + 1] if t + 1 < len(active) else 0
        last[b:a] = v[b:a].argmax(1)
        at, now = begin[:a] + t, last[:a]
        path[at] = now
        last[:a] = np.where(stay[at, now], now, top[at])
    return path


def _in_stretches(scores: np.ndarray, penalty: float, size: int) -> np.ndarray:
    """Labels of one long sequence as viterbi gives them, its stretches of ``size`` rows advancing together.

    First every stretch is run from each label alone, which gives the values before each stretch in turn; from those it is
    run again as one of many sequences. Going back, the label before each stretch is found for every label at its end;
    once the last is known these give the labels at all ends, and a last run fills in the rest.
    """
    n, k = scores.shape
    m, change = -(-n // size), int(points(penalty))
    v = np.tile(np.where(np.eye(k, dtype=bool), 0, -change), (m, 1, 1))  # stretch, label before it, label now
    for t in range(size):
        s = points(scores[t::size])  # row t of every stretch that has one
        x = v[: len(s)]
        if t:
            np.maximum(x, x.max(2, keepdims=True) - change, out=x)
        x += s[:, None]
    before = np.zeros((m, k), np.int64)
    for j in range(1, m):
        before[j] = (before[j - 1][:, None] + v[j - 1]).max(0)
        before[j] -= before[j].max()
    stay, top, x = np.zeros((n, k), bool), np.zeros(n, np.int32), before
    for t in range(size):
        s = points(scores[t::size])
        y, stay[t::size], top[t::size] = _step(x[: len(s)], change)
        x[: len(s)] = y + s

    def back(now: np.ndarray, path: np.ndarray | None = None) -> np.ndarray:
        """Labels before the stretches, of the labels (stretch, way) at their ends."""
        for t in range(size - 1, -1, -1):
            kept, came = stay[t::size], top[t::size]
            a = now[: len(came)]
            if path is not None:
                path[t::size] = a[:, 0]
            now[: len(came)] = np.where(np.take_along_axis(kept, a, 1), a, came[:, None])
        return now

    came, last = back(np.tile(np.arange(k), (m, 1))), np.zeros((m, 1), np.int64)
    last[-1] = x[-1].argmax()
    for j in range(m - 1, 0, -1):
        last[j - 1] = came[j, last[j]]
    path = np.zeros(n, np.int32)
    back(last, path)
    return path


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), switch_penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``keep`` columns plus lang_pred, score and spans of each row.

    lang_pred labels most letters of the text, score is their share of all letters (0 to 1), and letters of a script in
    which no language was seen count for none; spans are the runs of equal labels as
    code point offsets. Null, empty and letterless texts: ``und``, score 0, no spans. Rows are independent, so
    repeated rows get equal results; other columns don't matter; an empty frame stays empty. A tie between languages
    goes to the one that sorts first. A very long text is scored some letters at a time and labelled as one sequence,
    with six bytes a word and language. A column of ``keep`` that is called lang_pred, score or spans is an error.
    """
    names = list(keep)
    reject_names(names, "lang_pred", "score", "spans")
    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double").add("spans", SPANS)
    langs = model.languages

    def group(parts: list[tuple[Chunk, tuple]], share: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
        """Labels whole texts, adds their letters to share and total, and gives row, start, end and label of their spans."""
        rows = np.concatenate([r + c.lo for c, (r, *_) in parts])
        start, end, size, known = (np.concatenate([p[k] for _, p in parts]) for k in (1, 2, 3, 5))
        if not len(rows):
            return rows, start, end, rows
        cut = np.flatnonzero(np.diff(rows, prepend=-1))
        path = viterbi(np.concatenate([p[4] for _, p in parts]), np.diff(np.append(cut, len(rows))), switch_penalty)
        np.add.at(share, (rows, path), known)
        total += np.bincount(rows, weights=size, minlength=len(total))
        cut = np.flatnonzero((np.diff(rows, prepend=-1) != 0) | (np.diff(path, prepend=-1) != 0))
        return rows[cut], start[cut], end[np.append(cut[1:], len(rows)) - 1], path[cut]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found, parts, held = batch.num_rows, [(np.zeros(0, np.int64),) * 4], [], 0
            share, total = np.zeros((n, max(1, len(langs)))), np.zeros(n)
            for c in chunks(column(batch, text)):
                parts.append((c, word_scores(c, model)))
                held += len(c.data)
                if held > GROUP_BYTES:
                    found.append(group(parts, share, total))
                    parts, held = [], 0
            if parts:
                found.append(group(parts, share, total))
            rows, start, end, label = (np.concatenate([f[k] for f in found]) for k in range(4))
            best = share.argmax(1)
            pred = [langs[b] if t else UNKNOWN for b, t in zip(best, total)]
            score = np.where(total > 0, share.max(1) / np.maximum(total, 1), 0.0)
            spans = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array([langs[x] for x in label], pa.string())], ["start", "end", "lang"])
            offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(column(batch, x) for x in names), pa.array(pred, pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)], [*names, "lang_pred", "score", "spans"])

    return docs.select(*names, text).mapInArrow(run, schema) if text not in names else docs.select(*names).mapInArrow(run, schema)


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS, smoothing: float = 0.05, languages: int = MOST_LANGUAGES) -> Model:
    """Learns from about ``rows`` rows with non-null lang and text, picked by a hash of ``key``: the same number of every
    language, and all rows of a language that has fewer, so that a rare language is learned however large the table is.

    The driver receives sums per language and trigram cell, at most CELLS of them a language, and of more than
    ``languages`` labels only those with most rows (ties to the label that sorts first) are learned. Without any
    labelled row the model knows no language and every text is ``und``.
    """
    docs = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    labels = docs.groupBy("lang").agg(F.count("*").alias("n"))
    seen = labels.orderBy(F.desc("n"), "lang").limit(languages).collect()
    langs = sorted(r["lang"] for r in seen)
    if not langs:
        return Model([], np.zeros((CELLS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool))
    quota, scale = max(1, rows // len(langs)), 1 << 60
    share = F.create_map(*(F.lit(x) for r in seen for x in (r["lang"], min(scale, scale * quota // r["n"] + 1))))
    picked = docs.filter(F.pmod(F.xxhash64("k"), F.lit(scale)) < share[F.col("lang")])  # null, so false, for labels not learned
    index = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            which = np.array([index[x] for x in column(batch, "lang").to_pylist()], np.int64)
            for c in chunks(column(batch, "text")):
                _, row, cell, script, *_ = letters(c)
                owner = which[row + c.lo]
                for k in np.unique(owner):
                    mine = owner == k
                    sums[k] = sums.get(k, 0) + np.concatenate([np.bincount(cell[mine], minlength=CELLS), np.bincount(script[mine], minlength=N_SCRIPTS)])
        for k, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(s[at].astype(np.int64))], ["lang", "cell", "n"])

    found = picked.mapInArrow(count, "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), CELLS + N_SCRIPTS))
    counts[found["lang"].to_numpy(), found["cell"].to_numpy()] = found["n"].to_numpy()
    cells, scripts = counts[:, :CELLS], counts[:, CELLS:]
    table = np.log((cells + smoothing) / (cells.sum(1, keepdims=True) + smoothing * CELLS)).T
    table -= table.max(1, keepdims=True)
    return Model(langs, np.ascontiguousarray(table, np.float32), (scripts > SCRIPT_SHARE * np.maximum(1, scripts.sum(1, keepdims=True))).T)
