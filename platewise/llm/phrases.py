"""Collocations: frequent phrases of two to five words by how much more often they occur than their parts suggest.

First passes find a superset of the frequent phrases. Each deals the counts of a chunk's phrases by hash to partitions
of about PART occurrences; a partition merges them into one Misra-Gries summary whose capacity exceeds its mass divided
by the threshold. Whatever a merge takes off a counter it takes off more than ``capacity`` of them, so no counter loses
the threshold and every frequent phrase survives; with the loss added back, hardly another does. Since no phrase is more
frequent than its parts, three words are only counted if both pairs in them survived, and four and five if all triples
did. Survivors reach the tasks as a bit field of a fixed size: where it fills up, more phrases are counted, and the
result stays the same.

The last pass counts the survivors exactly, by their words and not by hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.arrays import U64, Chunk, chunks, column, lower_table, mix, ranges, runs, same_strings, string_hashes, text_buffers
from platewise.llm.common import landed
from platewise.llm.windows import WORD_BYTES, rolling

LONGEST = 5
LEAST = 100
TOP = 2000
#: A phrase goes if a longer one has at least this percentage of its occurrences.
COVER = 100
CHUNK = 4 << 20
#: Occurrences in a hash partition, about.
PART = 1 << 20
#: Bits of the field of survivors: 16 MB.
FIELD_BITS = 27
SEGMENT_BITS = 16
UNKNOWN = "und"
#: Candidates of one language that are ordered in one task at first.
ORDERED = 1_000_000


@lru_cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and which end a piece."""
    end = np.zeros(256, bool)
    end[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
    word = ~end
    word[[0x20, 0x09]] = False
    return word, end


class Words:
    """The words of a chunk: lower-cased bytes, starts, ends, rows and pieces."""

    def __init__(self, c: Chunk):
        word, end = tables()
        self.low = lower_table()[c.data]
        self.start, self.end, self.row = runs(word[self.low], c.starts, c.ends)
        ended = np.cumsum(end[self.low], dtype=np.int64)[self.start]
        new = np.ones(len(self.row), bool)
        new[1:] = (ended[1:] != ended[:-1]) | (self.row[1:] != self.row[:-1])
        self.piece = np.cumsum(new)

    def at(self, n: int) -> np.ndarray:
        """First words of the phrases of n words."""
        k = len(self.piece) - n + 1
        return np.flatnonzero(self.piece[:k] == self.piece[n - 1 :]) if k > 0 else np.zeros(0, np.int64)


def phrase_hashes(words: Words, language: np.ndarray, sizes: tuple[int, ...], field: np.ndarray | None, base: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size: it, the first words and the hashes of the phrases whose parts of ``base`` words are in the field."""
    h = string_hashes(words.low, words.start, words.end)
    tell = language[words.row]
    if field is not None:
        fits = np.zeros(len(h) + LONGEST, bool)
        at = words.at(base)
        fits[at] = known(mix(rolling(h, base)[at] ^ tell[at] ^ U64(base)), field)
    for n in sizes:
        at = words.at(n)
        if field is not None:
            for k in range(n - base + 1):
                at = at[fits[at + k]]
        yield n, at, mix(rolling(h, n)[at] ^ tell[at] ^ U64(n))


def known(h: np.ndarray, field: np.ndarray) -> np.ndarray:
    bit = h >> U64(64 - FIELD_BITS)
    return (field[(bit >> U64(3)).astype(np.int64)] >> (bit & U64(7)).astype(np.uint8)) & 1 > 0


def language_hashes(col: pa.Array) -> np.ndarray:
    data, offsets, _ = text_buffers(col)
    return string_hashes(data, offsets[:-1], offsets[1:], 2)


def counts_by_part(texts: DataFrame, sizes: tuple[int, ...], field: np.ndarray | None, base: int, parts: int, chunk: int) -> DataFrame:
    """part, mass, hashes and counts: what each chunk of (lang, text) rows holds, by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            language = language_hashes(column(batch, "lang"))
            for c in chunks(column(batch, "text"), chunk):
                found = [h for _, _, h in phrase_hashes(Words(c), language[c.lo : c.hi], sizes, field, base)]
                h, n = np.unique(np.concatenate(found), return_counts=True)
                part = ((h & U64(0xFFFFFFFF)) % U64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                h, n, part = h[order], n[order], part[order]
                head = np.flatnonzero(np.diff(part, prepend=-1))
                cut = np.append(head, len(h)).tolist()
                spans = list(zip(cut[:-1], cut[1:]))
                mass = [int(n[a:b].sum()) for a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[head]), pa.array(mass, pa.int64()), pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([packer.compress(n[a:b].astype(np.uint32).tobytes()) for a, b in spans], pa.binary())],
                    ["part", "mass", "hashes", "counts"],
                )

    return texts.mapInArrow(run, "part long, mass long, hashes binary, counts binary")


def summary(parts: Iterator[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Misra-Gries summary of mergeable counts: hashes, counters and what any counter lost at most."""
    h, n, lost, wait, waiting = np.zeros(0, U64), np.zeros(0, np.int64), 0, [], 0

    def merged() -> None:
        nonlocal h, n, lost, wait, waiting
        all_h = np.concatenate([h, *(w[0] for w in wait)])
        all_n = np.concatenate([n, *(w[1] for w in wait)])
        h, at = np.unique(all_h, return_inverse=True)
        n = np.bincount(at, weights=all_n, minlength=len(h)).astype(np.int64)
        wait, waiting = [], 0
        if len(h) > capacity:
            least = int(np.partition(n, len(n) - capacity - 1)[len(n) - capacity - 1])
            lost += least
            h, n = h[n > least], n[n > least] - least

    for part in parts:
        wait.append(part)
        waiting += len(part[0])
        if waiting > 4 * capacity:
            merged()
    merged()
    return h, n, lost


def survivors(least: int):
    """Over the counts of a partition: the hashes that may occur ``least`` times."""

    def run(t: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        capacity = sum(t["mass"].to_pylist()) // least + 1
        parts = ((np.frombuffer(a, U64), np.frombuffer(unpack(b), np.uint32).astype(np.int64)) for a, b in zip(t["hashes"].to_pylist(), t["counts"].to_pylist()))
        h, n, lost = summary(parts, capacity)
        return pa.table({"h": h[n + lost >= least].view(np.int64)})

    return run


def bit_field(hashes: DataFrame, before: np.ndarray | None) -> np.ndarray:
    """The field with a bit for each hash, and those of the field before; of one size however many hashes there are."""
    bit = F.shiftrightunsigned("h", 64 - FIELD_BITS)

    def run(t: pa.Table) -> pa.Table:
        own = np.zeros(1 << SEGMENT_BITS, np.uint8)
        own[t["bit"].to_numpy() & ((1 << SEGMENT_BITS) - 1)] = 1
        return pa.table({"segment": t["segment"][:1], "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    bits = hashes.select(bit.alias("bit"), F.shiftright(bit, SEGMENT_BITS).alias("segment")).distinct().groupBy("segment").applyInArrow(run, "segment long, bits binary")
    out = np.zeros(1 << (FIELD_BITS - 3), np.uint8) if before is None else before.copy()
    width = 1 << (SEGMENT_BITS - 3)
    for r in bits.toLocalIterator():
        out[r["segment"] * width : (r["segment"] + 1) * width] |= np.frombuffer(r["bits"], np.uint8)
    return out


def joined_words(words: Words, at: np.ndarray, n: int) -> pa.Array:
    """The phrases of n words that start at words ``at``, with one space between the words."""
    w = (at[:, None] + np.arange(n)).ravel()
    size = words.end[w] - words.start[w] + 1
    out = np.append(words.low, np.uint8(0x20))[np.repeat(words.start[w], size) + ranges(size)]
    out[np.cumsum(size) - 1] = 0x20
    ends = np.cumsum(size.reshape(-1, n).sum(1)) if len(at) else at
    out = np.delete(out, ends - 1)  # the space after the last word
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(0, ends - np.arange(1, len(at) + 1)).astype(np.int64)), pa.py_buffer(out))


def exact_counts(texts: DataFrame, field: np.ndarray, longest: int, parts: int, chunk: int) -> DataFrame:
    """lang, part, phrases (lengths and bytes), counts and words: occurrences of the phrases in the field, by chunk; words
    are all words of the language, told once a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            lang = column(batch, "lang").dictionary_encode()
            code = lang.indices.to_numpy()
            language = language_hashes(column(batch, "lang"))
            for c in chunks(column(batch, "text"), chunk):
                words = Words(c)
                total = np.bincount(code[c.lo + words.row], minlength=len(lang.dictionary))
                # Every language of the chunk has a row, in a part that differs from chunk to chunk.
                told = np.unique(code[c.lo : c.hi])
                key, phrases, counts = [told.astype(np.int64) * parts + total[told] % parts], [pa.array([""] * len(told), pa.large_string())], [np.zeros(len(told), np.int64)]
                for n, at, h in phrase_hashes(words, language[c.lo : c.hi], tuple(range(1, longest + 1)), None, 0):
                    some = known(h, field)
                    at, h = at[some], h[some]
                    _, first, of = np.unique(h, return_index=True, return_inverse=True)
                    head = at[first][of]
                    same = code[c.lo + words.row[at]] == code[c.lo + words.row[head]]
                    for k in range(n):
                        x, y = at + k, head + k
                        same &= words.end[x] - words.start[x] == words.end[y] - words.start[y]
                    for k in range(n):
                        s = np.flatnonzero(same)
                        x, y = at[s] + k, head[s] + k
                        same[s] = same_strings(words.low, words.start[x], words.start[y], words.end[x] - words.start[x])
                    # A phrase whose hash met that of another one counts for itself.
                    shown = np.concatenate([first, np.flatnonzero(~same)])
                    key.append(code[c.lo + words.row[at[shown]]].astype(np.int64) * parts + ((h[shown] & U64(0xFFFFFFFF)) % U64(parts)).astype(np.int64))
                    phrases.append(joined_words(words, at[shown], n))
                    counts.append(np.concatenate([np.bincount(of[same], minlength=len(first)), np.ones(len(shown) - len(first), np.int64)]))
                key, counts = np.concatenate(key), np.concatenate(counts)
                order = np.argsort(key, kind="stable")
                key, counts = key[order], counts[order].astype(np.uint32)
                data, offsets, _ = text_buffers(pa.concat_arrays(phrases).take(pa.array(order)))
                lengths = np.diff(offsets).astype(np.uint32)
                head = np.flatnonzero(np.diff(key, prepend=-1))
                spans = list(zip(head.tolist(), np.append(head[1:], len(key)).tolist()))
                of, part = key[head] // parts, key[head] % parts
                yield pa.RecordBatch.from_arrays(
                    [
                        lang.dictionary.take(pa.array(of)),
                        pa.array(part),
                        pa.array([packer.compress(lengths[x:y].tobytes() + data[offsets[x] : offsets[y]].tobytes()) for x, y in spans], pa.binary()),
                        pa.array([packer.compress(counts[x:y].tobytes()) for x, y in spans], pa.binary()),
                        pa.array(np.where(total[of] % parts == part, total[of], 0)),
                    ],
                    ["lang", "part", "phrases", "counts", "words"],
                )

    return texts.mapInArrow(run, "lang string, part long, phrases binary, counts binary, words long")


def summed(least: int):
    """Over the packed counts of a language and part: phrases that occur ``least`` times, and the words, with no phrase."""

    def run(t: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        phrases, counts = [], []
        for a, b in zip(t["phrases"].to_pylist(), t["counts"].to_pylist()):
            n, a = np.frombuffer(unpack(b), np.uint32), unpack(a)
            offsets = np.append(0, np.cumsum(np.frombuffer(a, np.uint32, len(n)), dtype=np.int64))
            phrases.append(pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(a[4 * len(n) :])))
            counts.append(n.astype(np.int64))
        f = pa.table({"phrase": pa.concat_arrays(phrases), "f": np.concatenate(counts)}).group_by("phrase").aggregate([("f", "sum")])
        f = f.filter(pa.compute.greater_equal(f["f_sum"], least))
        names = pa.chunked_array([*f["phrase"].cast(pa.string()).chunks, pa.nulls(1, pa.string())])
        n = pa.chunked_array([*f["f_sum"].chunks, pa.array([pa.compute.sum(t["words"]).as_py()], pa.int64())])
        return pa.table({"lang": pa.array([t["lang"][0].as_py()] * len(names), pa.string()), "phrase": names, "f": n})

    return run


def frequent_phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, part: int = PART, chunk: int = CHUNK) -> DataFrame:
    """lang, phrase, n_words, f of every phrase of 1 to ``longest`` words that occurs ``least`` times in its language; rows with
    a null phrase add up to the number of all words of the language."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    field = None
    for sizes in ((1, 2), (3,), (4, 5)):
        sizes = tuple(n for n in sizes if n <= longest)
        if sizes:
            parts = max(1, -(-size * len(sizes) // (WORD_BYTES * part)))
            base = min(sizes) - 1
            counted = counts_by_part(texts, sizes, field, base, parts, chunk)
            field = bit_field(counted.groupBy("part").applyInArrow(survivors(least), "h long"), field)
    parts = max(1, -(-size * longest // (WORD_BYTES * part)))
    counted = exact_counts(texts, field, longest, parts, chunk).groupBy("lang", "part").applyInArrow(summed(least), "lang string, phrase string, f long")
    n_words = F.coalesce(F.size(F.split("phrase", " ")), F.lit(0)).cast("long")
    return landed(counted.select("lang", "phrase", F.when(F.col("phrase").isNull(), F.lit(0)).otherwise(n_words).alias("n_words"), "f"), "phrases")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, cover: int = COVER, part: int = PART, chunk: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the ``top`` phrases of 2 to ``longest`` words by score.

    Texts are lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line ends and these into words at spaces and tabs; a
    phrase lies inside a piece. a counts its occurrences, l and r those of its two parts at the cut with the smallest
    score (of equal ones the first) and n all words of the language; score is floor(1000 * a * n / (l * r)), computed in
    decimals. A phrase that lies in a longer frequent one which has ``cover`` percent of its occurrences isn't listed.
    Ties of score and a go by the phrase's bytes. Null texts have no words; null languages are ``und``; repeated rows count
    each; other columns don't matter; an empty frame gives no rows. A very long text is a chunk of its own, of some
    thirty bytes of work space a byte.
    """
    counts = frequent_phrases(docs, text=text, lang=lang, longest=longest, least=least, part=part, chunk=chunk)
    total = counts.filter("phrase IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    phrases = counts.filter("phrase IS NOT NULL")
    candidates = phrases.filter("n_words > 1").select("lang", "phrase", F.split("phrase", " ").alias("w"), F.col("f").alias("a"))
    piece = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("first"), piece(F.col("k") + 1, F.size("w")).alias("rest"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(total, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumn("up", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("down", wide("l") * wide("r"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr("up div down").alias("score"), "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")

    inner = candidates.filter(F.size("w") > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("i"))
    over = inner.groupBy("lang", piece(F.col("i"), F.col("m")).alias("phrase")).agg(F.max("a").alias("over"))
    best = best.join(over, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("over") < cover * F.col("a"), F.lit(True)))
    order = "ORDER BY score DESC, a DESC, phrase"
    best = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.expr(f"CAST(ceil(greatest(1, n / {least} / {ORDERED})) AS BIGINT)")))
    best = best.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, salt {order})")).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})").cast("long")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
