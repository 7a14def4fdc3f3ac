import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from brute import hits, near, repeats

from platewise.llm.common import components
from platewise.llm.decontaminate import decontaminate
from platewise.llm.embeddings import near_vectors
from platewise.llm.minhash import near_duplicates
from platewise.llm.substrings import anchor_rows, remove_repeats

DOCS = "doc_id long, text string, n string, z string"


def corpus(n=120, seed=3):
    """Texts with exact and edited copies, shared passages, empty and null ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgéß") for _ in range(r.randint(1, 7)))
    passage = " ".join(word() for _ in range(45))
    texts = [None, "", " \n\t", "one", "One", "two words", "x" * 400, "ab" * 300]
    while len(texts) < n:
        kind = r.random()
        if kind < 0.4 or len(texts) < 20:
            t = " ".join(word() for _ in range(r.randint(1, 160)))
        elif kind < 0.5:
            t = r.choice(texts)
        else:
            w = (r.choice(texts) or "").split()
            for _ in range(r.randint(0, 4)):
                if w:
                    w[r.randrange(len(w))] = word()
            t = " ".join(w)
        texts.append(f"{t} {passage} {word()}" if t and r.random() < 0.2 else t)
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "n", "z") for i, t in rows], DOCS)


@pytest.mark.parametrize("limits", [{}, {"block": 4}, {"shingles_": 300}])
def test_near_duplicates(spark, rows, limits):
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(frame(spark, rows), words=3, least=85, **limits).collect()}
    assert got == near(rows, 3, 85)


@pytest.mark.parametrize("limits", [{}, {"block": 8}])
def test_regions_that_were_cut_are_whole(spark, rows, limits):
    # Variants of one text that resemble it and not each other: only a comparison with that very text joins them.
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    star = [(1000 + i, " ".join(w if not i or k % 100 not in spots else f"v{i}.{k}" for k, w in enumerate(base))) for i in range(90) for spots in [r.sample(range(100), 2)]]
    want = near(rows + star, 3, 85)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(frame(spark, rows + star), words=3, least=85, **limits).collect()}
    assert got == want
    assert len({c for d, (_, c) in want.items() if d >= 1000}) < 45


def test_many_near_copies_are_one_component(spark):
    # 5,000 different variants of one text, far more than a block holds.
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: i % 100], f"x{i}", *base[i % 100 :]])) for i in range(5000)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, least=85)
    assert [tuple(r) for r in got.groupBy("component_id").count().collect()] == [(0, 5000)]


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_patterned_words_are_told_apart(spark):
    rows = [(2 * k + f, thue_morse(1 << (8 + k), f)) for k in range(5) for f in (0, 1)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, least=85).collect()
    assert all(r["kept"] for r in got) and len(got) == len(rows)


def test_long_texts_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 1_000_000), (4, "x" * 1_000_000), (None, "a b c d"), (None, long)]
    got = {(r["id"], r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, least=85, shingles_=1000).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 3, True), (4, 3, False), (None, None, True)}


@pytest.mark.parametrize("limits", [{}, {"few": 2, "bucket": 10}, {"crowd": 2}, {"hash_bits": (6, 64)}])
def test_repeats(spark, rows, limits):
    got = {r["doc"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(frame(spark, rows), **limits).collect()}
    assert got == repeats(rows)


def test_repeats_of_one_passage_in_many_texts(spark):
    # One passage with different surroundings, more often than CROWD, so that its anchors are crowded.
    passage = " ".join(f"p{i * i}" for i in range(30))
    rows = [(i, f"{i * 7919} {i} {passage} {i * 104729}") for i in range(3000)]
    want = repeats(rows)
    for limits in ({"crowd": 500}, {}):
        got = {r["doc"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), **limits).collect()}
        assert got == want


def test_repeats_in_a_long_text_and_rows_with_one_id(spark):
    r = random.Random(9)
    line = "".join(r.choice("abcdefgh ") for _ in range(5000))
    long = "".join(r.choice("abcdefgh ") for _ in range(1_500_000)) + line
    df = spark.createDataFrame([(1, line), (2, long), (2, long), (3, line[:150]), (3, "other text"), (None, line)], "doc_id long, text string")
    got = [(r["doc"], r["n_bytes"], r["n_removed"]) for r in remove_repeats(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 5000, 0), (2, 1_505_000, 5000), (2, 1_505_000, 5000), (3, 150, 150), (3, 10, 0), (None, 5000, 5000)], key=str)


def test_decontaminate(spark, rows):
    items = [(1, " ".join((rows[30][1] or "a b").split()[:14])), (2, "one"), (3, None), (4, "..."), (5, rows[40][1]), (5, rows[40][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = hits(rows, items)
    for size in (1 << 20, 64):  # one block, and several
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in decontaminate(frame(spark, rows), bench, block_bytes=size).collect()}
        assert got == want


def test_decontaminate_a_large_benchmark(spark, rows):
    items = [(i, " ".join((t or "").split()[:12])) for i, t in rows[:60]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    odd = frame(spark, [*rows, rows[3], (None, rows[5][1])]).selectExpr("doc_id", "text", "text AS digest", "1 AS c0")
    size = sum(len((t or "").encode()) for _, t in items)
    found = decontaminate(odd, bench, keep=("c0", "doc_id", "digest"), block_bytes=-(-size // 12))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # one block of patterns in a task, however many there are
    want = hits(rows, items)
    got = [(r["doc_id"], (r["n_words"], r["n_hit"], list(r["items"]))) for r in found.collect()]
    assert len(got) == len(rows) + 2 and dict(got) == {**want, None: want[rows[5][0]]}
    with pytest.raises(ValueError, match="hits"):
        decontaminate(odd.withColumnRenamed("c0", "hits"), bench, keep=("doc_id", "hits"))


def test_decontaminate_ids_and_long_texts(spark):
    long = "word " * 200_000 + "alpha beta gamma " + "x" * 1_000_000 + " end"
    items = [(None, "alpha beta gamma"), ("b", "x" * 1_000_000), ("a", "end"), (None, None), ("c", "y" * 1_000_000)]
    df = spark.createDataFrame([(1, long), (2, "end"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate(df, spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert got == {1: (200_005, 5, ["a", "b", None]), 2: (1, 1, ["a"]), 3: (0, 0, [])}


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((150, 16))
    near_ = base[:60] + rng.standard_normal((60, 16)) * 0.08
    ring = base[:1] + rng.standard_normal((200, 16)) * 0.05
    vectors = [v.astype(np.float32).tolist() for v in np.concatenate([base, near_, ring, base[:5]])]
    rows = [(i, v) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0, None] + [0.0] * 14), (904, [float("nan")] * 16), (905, [float("inf")] + [0.0] * 15), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, vectors[0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    label = np.arange(len(x))
    while (new := np.where(linked | np.eye(len(x), dtype=bool), label[None, :], len(x)).min(1)).tolist() != label.tolist():
        label = new
    # The third limits let a sample of 60 vectors grow trees whose leaves are too large and split again.
    for limits in ({}, {"leaf": 40, "block": 16}, {"leaf": 20, "block": 16, "sample": 60, "most": 60}):
        got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df, **limits).collect()}
        assert [got[i] for i in range(len(x))] == [(int(linked[i].sum()), int(label[i]), bool(label[i] == i)) for i in range(len(x))]
        assert got[907] == (1, 906, False) and all(got[i] == (0, i, True) for i, _ in odd[:6]) and got[None] == (0, None, True)


def test_recall_of_the_trees(spark):
    """20,000 vectors, more than a leaf holds: pairs around the threshold and a group that lies within it."""
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.standard_normal((14_000, 64)))
    mates = unit(base[:5000] + unit(rng.standard_normal((5000, 64))) * rng.uniform(0.25, 0.33, (5000, 1)))
    group = unit(base[:1] + unit(rng.standard_normal((1000, 64))) * 0.23)
    x = np.concatenate([base, mates, group]).astype(np.float32)
    y = unit(x.astype(np.float64))
    want = np.concatenate([(y[i : i + 2000] @ y.T >= 0.95).sum(1) - 1 for i in range(0, len(y), 2000)])
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()})).selectExpr("vec_id", "cast(embedding AS array<float>) AS embedding")
    got = near_vectors(df).select("id", "n_links").toPandas().set_index("id")["n_links"].reindex(range(len(x))).to_numpy()
    assert (got <= want).all() and got.sum() >= 0.999 * want.sum() > 500_000


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}


def test_components_of_more_edges(spark):
    """Edges that come later, a star around its largest id among them, give what all edges give at once."""
    r = random.Random(5)
    parts = [[(r.randrange(400), r.randrange(400)) for _ in range(90)] for _ in range(2)]
    parts += [[(999, i) for i in range(0, 400, 9)], [(5000, 5001), (5002, 5002)], [], [(999, 5001), (3, 3)]]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    known, root = None, {}
    find = lambda v: v if root.setdefault(v, v) == v else find(root[v])
    for edges in parts:
        known = components(frame(edges), known)
        for a, b in edges:
            low, high = sorted((find(a), find(b)))
            root[high] = low
        assert sorted(map(tuple, known.collect())) == sorted((v, find(v)) for v in list(root))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).collect() == remove_repeats(none).collect() == []
    assert decontaminate(none, spark.createDataFrame([], "item_id long, text string")).collect() == []
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_memory_of_anchors_follows_a_part_of_the_batch():
    class Frame:
        def mapInArrow(self, run, schema):
            self.run = run
            return self

    def peak(mb):
        data = np.random.default_rng(mb).integers(97, 123, (mb << 10, 1 << 10), dtype=np.uint8)
        texts = pa.array([x.tobytes().decode() for x in data])
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64())] * 2 + [texts], ["doc", "mark", "text"])
        run = anchor_rows(Frame(), 100, 29, 0, 64).run
        tracemalloc.start()
        n = sum(len(x) for x in run(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return n / mb, most / (1 << 20)

    (rows, small), (more, large) = peak(16), peak(40)
    assert rows == pytest.approx(more, rel=0.01)
    assert large < 1.25 * small and small < 8 * 16
