"""Plain versions of operators, for comparison on small inputs."""

import hashlib


def repeats(rows, window=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)} of (doc_id, text) rows with distinct ids."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            s = data[i : i + window]
            if s in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", _lower(text or ""))


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def near(rows, k, least):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text) rows with distinct ids."""
    sets = {}
    for doc, text in rows:
        w = words(text)
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {d: d for d in sets}

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= least * len(x | y):
                p, q = sorted((top(a), top(b)))
                label[q] = p
    return {d: (len(sets[d]), top(d)) for d in sets}


def hits(rows, items, window=10):
    """{doc_id: (n_words, n_hit, items)} of (id, text) rows and items."""
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t or ""))
    patterns = {}
    for item, text in items:
        w = cut(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            patterns.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = {}
    for doc, text in rows:
        w, hit, found = cut(text), set(), set()
        for p, ids in patterns.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found |= ids
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def viterbi(scores, penalty):
    """Best labels of one sequence, step by step; of equals the label that stays, then the first."""
    k = range(len(scores[0]))
    best, back = list(scores[0]), []
    for now in scores[1:]:
        top = max(k, key=lambda j: (best[j], -j))
        back.append([j if best[j] >= best[top] - penalty else top for j in k])
        best = [max(best[j], best[top] - penalty) + now[j] for j in k]
    path = [max(k, key=lambda j: (best[j], -j))]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def _letter_words(text):
    """Words as lists of (trigram cell, script) of their letters."""
    import unicodedata

    low = [0] * (len(text) + 2)
    for i, c in enumerate(text):
        if c.isalpha():
            low[i + 1] = ord(c.lower()) if len(c.lower()) == 1 else ord(c)
    out = []
    for i, c in enumerate(text):
        if low[i + 1]:
            h = (low[i] * 0x9E3779B97F4A7C15 + low[i + 1] * 0xC2B2AE3D27D4EB4F + low[i + 2] * 0x165667B19E3779F9) % 2**64
            h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64
            script = unicodedata.name(c).split()[0]
            if low[i] == 0 or script in ("CJK", "HIRAGANA", "KATAKANA"):
                out.append([])
            out[-1].append((h >> 47, script))
    return out


def languages(labelled, texts, penalty=10.0, smoothing=0.05, least=0.01):
    """(label, share of letters) of each text, learned from (text, lang) rows."""
    import math
    from collections import Counter

    langs = sorted({x for _, x in labelled})
    cells, scripts = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for text, lang in labelled:
        for w in _letter_words(text):
            cells[lang].update(c for c, _ in w)
            scripts[lang].update(s for _, s in w)
    size = {x: cells[x].total() for x in langs}
    out = []
    for text in texts:
        scores, known, letters = [], [], []
        for w in _letter_words(text or ""):
            s = [sum(math.log((cells[x][c] + smoothing) / (size[x] + smoothing * 2**17)) for c, _ in w) for x in langs]
            seen = [scripts[x][w[0][1]] > least * max(1, size[x]) for x in langs]
            s = [a - (10_000 if any(seen) and not ok else 0) for a, ok in zip(s, seen)]
            scores.append([round((a - max(s)) * 2**16) for a in s])
            known.append(len(w) if any(seen) else 0)
            letters.append(len(w))
        if not scores:
            out.append(("und", 0.0))
            continue
        share = [0] * len(langs)
        for x, n in zip(viterbi(scores, penalty * 2**16), known):
            share[x] += n
        out.append((langs[share.index(max(share))], max(share) / sum(letters)))
    return out
