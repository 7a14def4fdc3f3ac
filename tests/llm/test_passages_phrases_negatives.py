import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from platewise.llm.negatives import hard_negatives
from platewise.llm.phrases import collocations, frequent_phrases, summary
from platewise.llm.windows import remove_passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = "doc_id long, text string, lang string, part long, doc long, mark string, spans string, f long, rank string, phrase string"


def passages(rows, window):
    """{doc_id: (n_words, n_removed, sha256)} of rows with distinct ids; null is the largest id."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    seen, out = {}, {}
    for doc, text in rows:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[i : i + window]), doc) is not doc:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[doc] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(n=150, seed=11):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 3)))
    shared = [" ".join(word() for _ in range(r.randint(8, 40))) for _ in range(6)]
    texts = [None, "", " \t\n", "one", "x " * 300, "x " * 150, "y " * 40 + "x " * 40]
    while len(texts) < n:
        t = " \n".join(word() for _ in range(r.randint(1, 80)))
        if r.random() < 0.5:
            t = f"{t}\t{r.choice(shared)} {word()} {r.choice(shared)}"
        texts.append(r.choice(texts) if r.random() < 0.15 else t)
    rows = list(enumerate(texts)) + [(None, shared[0] + " x")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [{}, {"part": 100}, {"part": 100, "chunk": 300}, {"chunk": 1}])
def test_passages(spark, limits):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", 1, 2, "m", "s", 3, "r", "p") for i, t in rows], CLASHING).repartition(5)
    got = {r["doc"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_passages(df, window=7, **limits).collect()}
    want = passages(rows, 7)
    assert got == want
    assert 10 < sum(n > 0 for _, n, _ in want.values()) < 140


def test_passages_of_rows_with_one_id_and_long_texts(spark):
    r = random.Random(3)
    words = lambda n: " ".join(str(r.randrange(10**6)) for _ in range(n))
    passage, other = words(60), words(200_000)
    rows = [(1, passage), (2, passage + " " + words(5)), (2, passage + " " + words(6)), (2, words(5)), (3, other + " " + passage), (3, other + " " + passage), (4, "z" * 2_000_000)]
    got = sorted((r["doc"], r["n_words"], r["n_removed"]) for r in remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 60, 0), (2, 5, 0), (2, 65, 60), (2, 66, 60), (3, 200_060, 60), (3, 200_060, 60), (4, 1, 0)]


def phrases(rows, least, longest, top, cover=100):
    """Rows of collocations() by counting everything."""
    f, n = {}, Counter()
    for lang, text in rows:
        name = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[name] += len(w)
            for k in range(1, longest + 1):
                f.setdefault(name, Counter()).update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        c = {p: a for p, a in counts.items() if a >= least and " " in p}
        found = []
        for p, a in c.items():
            w = p.split(" ")
            inside = [q for q in c if len(q.split(" ")) > len(w) and f" {p} " in f" {q} "]
            if any(100 * c[q] >= cover * a for q in inside):
                continue
            cuts = [(1000 * a * n[lang] // (counts[" ".join(w[:k])] * counts[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.append((p, a, counts[" ".join(w[:k])], counts[" ".join(w[k:])], n[lang], score))
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(found[:top])]
    return sorted(out)


def prose(n=200, seed=4):
    r = random.Random(seed)
    vocabulary = ["New", "york", "city", "of", "the", "in", "élan", "vital", "a", "b", "x" * 300, "ad", "hoc"]
    fixed = ["new york city", "ad hoc", "élan vital", "in the city of new york", "A b", "the the the the the the"]
    rows = [(None, None), ("en", ""), ("en", "..;\n"), ("", "ad hoc ad hoc")]
    for _ in range(n):
        parts = [r.choice(fixed) if r.random() < 0.4 else r.choice(vocabulary) + r.choice(["", "", ".", ",", "!"]) for _ in range(r.randint(1, 40))]
        rows.append((r.choice(["en", "en", "fr", None]), r.choice([" ", "\t", "  ", "\n"]).join(parts)))
    return rows


@pytest.mark.parametrize("limits", [{}, {"part": 1000, "chunk": 400}, {"top": 5}, {"longest": 2}, {"longest": 3, "cover": 60}])
def test_collocations(spark, limits):
    rows = prose()
    df = spark.createDataFrame([(i, t, lang, 1, 2, "m", "s", 3, "r", "p") for i, (lang, t) in enumerate(rows)], CLASHING)
    got = sorted(tuple(r) for r in collocations(df, least=15, **limits).collect())
    assert got == phrases(rows, 15, limits.get("longest", 5), limits.get("top", 2000), limits.get("cover", 100))
    assert len(got) > 8


def test_summaries_keep_what_is_frequent():
    r = np.random.default_rng(2)
    parts = []
    for _ in range(50):
        h, n = np.unique(np.concatenate([r.integers(0, 50_000, 2000), r.zipf(1.3, 400) % 300]).astype(np.uint64), return_counts=True)
        parts.append((h, n))
    true, mass = Counter(), 0
    for h, n in parts:
        true.update(dict(zip(h.tolist(), n.tolist())))
        mass += int(n.sum())
    least = 100
    capacity = mass // least + 1
    h, n, lost = summary(iter(parts), capacity)
    assert len(h) <= capacity and lost < least
    counters = dict(zip(h.tolist(), n.tolist()))
    for x, f in true.items():
        assert f < least or f - lost <= counters[x] <= f
    assert lost > 0


def test_products_past_64_bits(spark):
    # 1000 * a * n and l * r of some 10**12 occurrences each, on counts that stand for a large corpus.
    from pyspark.sql import functions as F

    a, n, l, r = 10**12, 9 * 10**14, 3 * 10**12, 7 * 10**12
    wide = lambda x: F.lit(x).cast("decimal(18,0)")
    got = spark.range(1).select(F.lit(0), (wide(a) * wide(n) * F.lit(1000).cast("decimal(4,0)")).alias("up"), (wide(l) * wide(r)).alias("down")).selectExpr("up div down AS s").first()[0]
    assert got == 1000 * a * n // (l * r)


def test_phrases_of_one_long_text(spark):
    text = "alpha beta " * 200_000 + "w" * 1_000_000
    got = Counter()
    for r in frequent_phrases(spark.createDataFrame([("en", text)], "lang string, text string")).collect():
        got[r["phrase"]] += r["f"]
    assert got[None] == 400_001 and got["alpha beta"] == 200_000 and got["beta alpha beta alpha"] == 199_998


def negatives(rows, every, k, least, scale):
    """Rows of hard_negatives() by comparing everything."""
    good = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(scale * x) for x in v]
        if i not in good or (label, v) < good[i][2]:
            good[i] = (label, q, (label, v))
    out = []
    for a, (label, q, _) in good.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(q, p)) for i, (_, p, _) in good.items() if i != a and len(p) == len(q)}
        first = lambda ids: sorted(ids, key=lambda i: (-score[i], i))[:k]
        for p in first([i for i in score if good[i][0] == label]):
            hard = first([i for i in score if good[i][0] != label and least * score[p] <= 100 * score[i] <= 100 * score[p]])
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"anchors_": 3, "blocks": (4, 16)}, {"anchors_": 5, "sample": 12, "blocks": (7, 50)}])
def test_hard_negatives(spark, limits):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((6, 8))
    vectors = [(base[i % 6] * rng.uniform(0.2, 1) + rng.standard_normal(8) * 0.3).astype(np.float32).tolist() for i in range(300)]
    rows = [(i, v, (i * 7) % 4) for i, v in enumerate(vectors)]
    rows += [(300 + i, vectors[0], i % 3) for i in range(90)]  # one vector very often: ties
    rows += [(1000, None, 1), (1010, [1.0] * 8, None), (1020, [float("nan")] * 8, 1), (1030, [1.0, None] * 4, 1), (1040, [float("inf")] * 8, 1), (None, vectors[1], 1)]
    rows += [(1050 + i, [0.0] * 8, i % 2) for i in range(20)] + [(1100 + i, [0.5, -0.25], i % 2) for i in range(0, 30, 5)] + [(1200, [], 1), (1201, [], 1), (1202, [], 2)]
    rows += [(10, vectors[11], 2), (10, vectors[12], 1), (-10, vectors[13], 1)]
    df = spark.createDataFrame([(i, v, label, 1, "b") for i, v, label in rows], "vec_id long, embedding array<float>, label int, c int, slot string")
    got = sorted(tuple(r) for r in hard_negatives(df, every=10, **limits).collect())
    assert got == negatives(rows, 10, 5, 80, 256)


def test_hard_negatives_reject_what_passes_64_bits(spark):
    with pytest.raises(Exception, match="components must be below"):
        hard_negatives(spark.createDataFrame([(0, [1e12], 1), (1, [1.0], 1)], "vec_id long, embedding array<double>, label int")).collect()
    large = [(i, [float(2**30 - i)] * 3, i % 2) for i in range(8)]  # past 2**53, not past 2**63
    got = sorted(tuple(r) for r in hard_negatives(spark.createDataFrame(large, "vec_id long, embedding array<double>, label int"), every=4, scale=1).collect())
    assert got == negatives(large, 4, 5, 80, 1) and got


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert remove_passages(none).collect() == collocations(none).collect() == []
    assert hard_negatives(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    nulls = spark.createDataFrame([(None, None, None)] * 2, "doc_id long, text string, lang string")
    assert [(r["doc"], r["n_words"]) for r in remove_passages(nulls).collect()] == [(None, 0)] * 2 and collocations(nulls).collect() == []
