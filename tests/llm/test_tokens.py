import re
import time

from platewise.llm.tokens import COUNT_BITS, UNKNOWN_COST, count_tokens, load_vocabulary, pre_tokens


def brute(text, costs):
    if not text:
        return 0, 0
    data = text.encode()
    pieces = re.findall(rb" ?[^\x20\x09-\x0d]+|[\x20\x09-\x0d]", data)
    total = 0
    for p in pieces:
        if re.fullmatch(rb"[\x20\x09-\x0d]", p):
            total += 1
            continue
        best = [(0, 0)]
        for d in range(1, len(p) + 1):
            ways = [(best[d - 1][0] + UNKNOWN_COST, best[d - 1][1] + 1)]
            ways += [(best[a][0] + costs[p[a:d]], best[a][1] + 1) for a in range(d) if p[a:d] in costs]
            best.append(min(ways))
        total += best[-1][1]
    return len(pieces), total


TEXTS = ["", None, "The quick brown fox", "a  b\n\tc ", "naïve café — straße " * 40, "x" * 700, "ab" * 90 + " " + "ab" * 91, " lead", "你好 world", "The quick brown fox", "0" * 3 + "!!", "\n\n"]


def test_matches_brute_force(spark):
    costs = load_vocabulary()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string").drop("n_tokens")
    got = {r["doc_id"]: r for r in count_tokens(df, costs).collect()}
    for i, t in enumerate(TEXTS):
        assert (got[i]["n_pre_tokens"], got[i]["n_tokens"]) == brute(t, costs), t
        assert got[i]["n_bytes"] == len((t or "").encode())


def test_small_vocabulary_and_ties(spark):
    costs = {b"a": 5, b"b": 5, b"ab": 10, b"aba": 15}
    texts = ["abab", "aba ab", "zz", "ba"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r["n_tokens"] for r in count_tokens(df, costs).orderBy("doc_id").collect()] == [brute(t, costs)[1] for t in texts]
    assert COUNT_BITS == 24


def test_long_words(spark):
    costs = {b"a": 5, b"b": 7, b"ab": 10, b"aba": 15, b"ba" * 20: 30}
    texts = ["ab" * 400, "ab" * 400 + "z" * 300 + "ba" * 100, ("a" * 256) + " " + "b" * 257, "".join("ab"[bin(i).count("1") % 2] for i in range(2048)), "".join("ba"[bin(i).count("1") % 2] for i in range(2048))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["n_tokens"] for r in count_tokens(df, costs).orderBy("doc_id").collect()] == [brute(t, costs)[1] for t in texts]


def test_a_word_of_a_megabyte_and_a_long_text(spark):
    costs = load_vocabulary()
    word = "".join(chr(97 + (i * i * 7919) % 26) for i in range(1_000_000))
    df = spark.createDataFrame([(1, word), (2, "lorem ipsum " * 400_000)], "doc_id long, text string")
    start = time.perf_counter()
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(df, costs).collect()}
    assert time.perf_counter() - start < 30
    one = brute(" lorem", costs)[1] + brute(" ipsum", costs)[1]
    assert got[2] == one * 399_999 + brute("lorem", costs)[1] + brute(" ipsum", costs)[1] + 1 and got[1] > 100_000


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), {b"a": 1}).collect() == []
