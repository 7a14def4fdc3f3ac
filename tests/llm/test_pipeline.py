"""The whole pipeline against a plain version of its stages."""

import hashlib
import random

import corpus_pipeline
from brute import hits, near, words

GOLDEN, POINTS = 712544676207699905, 1 << 60


def plain_mix(rows):
    """{doc_id: taken} of (doc_id, text, source) rows with distinct ids: targets, blocks of 32 words and golden slots."""
    size = {d: len(words(t)) for d, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s))
    total = {s: sum(size[d] for d, _, x in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), float(sum(total.values()))
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = [s for s in open_ if level * weight[s] >= 3 * total[s]]
        if not full:
            break
        for s in full:
            target[s] = 3.0 * total[s]
            left -= target[s]
            open_.discard(s)
    target |= {s: level * weight[s] for s in open_}
    blocks = {s: max(1, round(total[s] / 32)) if total[s] else 0 for s in sources}
    wanted = {s: round(target[s] * blocks[s] / total[s]) if total[s] else 0 for s in sources}
    slots, at, reach = sum(wanted.values()), 0, {}
    for s in sources:
        reach[s] = (at * POINTS // max(1, slots), (at + wanted[s]) * POINTS // max(1, slots))
        at += wanted[s]
    times, rank = {}, dict.fromkeys(sources, 0)
    for i in range(slots):
        p = i * GOLDEN % POINTS
        s = next(s for s in sources if reach[s][0] <= p < reach[s][1])
        if rank[s] < 3 * blocks[s]:
            times[s, rank[s] % blocks[s]] = times.get((s, rank[s] % blocks[s]), 0) + 1
        rank[s] += 1
    taken = {}
    for s in sources:
        laid = [d for d, _, x in sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0])) if x == s for _ in range(size[d])]
        per, more = divmod(total[s], blocks[s]) if blocks[s] else (0, 0)
        for w, d in enumerate(laid):
            b = w // (per + 1) if w < more * (per + 1) else more + (w - more * (per + 1)) // per
            taken[d] = taken.get(d, 0) + times.get((s, b), 0)
    return {d: n for d, n in taken.items() if n}


def test_pipeline_is_the_plain_one(spark, tmp_path):
    r = random.Random(11)
    english, german = ("the old fox and a dog rest under trees while it rains on every house again".split(), "der alte Fuchs und ein Hund ruhen unter Bäumen während es auf jedes Haus regnet".split())
    say = lambda vocabulary, n: " ".join(r.choice(vocabulary) + r.choice(["", "s", "n", "en"]) for _ in range(n))
    texts = [say(r.choice((english, german)), r.randint(20, 300)) for _ in range(60)]
    for _ in range(20):  # near copies
        w = r.choice(texts[:60]).split()
        w[r.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    texts += [None, "", "12 34", "αβγ δεζ ηθι κλμ " * 9, texts[3], "Mrs Anna Schmidt wrote to anna.s@mail.example.org about " + (tail := say(english, 200))]
    rows = [(i, t, None if "α" in (t or "") else "de" if "ä" in (t or "") else "en", r.choice(["a", "b", "c", None]), 5) for i, t in enumerate(texts)]
    # Labels of the texts themselves don't matter here: all Latin texts are of some learned language.
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join(texts[5].split()[4:16])), (2, None), (3, "of nothing that is anywhere")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    latin = lambda t: sum(c.isalpha() and ord(c) < 0x250 for c in t or "")
    kept = [x for x in rows if latin(x[1]) and 2 * latin(x[1]) >= sum(c.isalpha() for c in x[1])]
    classes = near([x[:2] for x in kept], 5, 80)
    kept = [x for x in kept if classes[x[0]][1] == x[0]]
    found = hits([x[:2] for x in kept], items)
    kept = [x for x in kept if not found[x[0]][1]]
    want = plain_mix([(d, t, s) for d, t, _, s, _ in kept])

    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {d: x["taken"] for d, x in got.items()} == want
    last = len(texts) - 1
    assert all(x["text"] == texts[d] for d, x in got.items() if d != last)
    assert last in got and "Schmidt" not in got[last]["text"] and got[last]["text"].endswith(tail)
